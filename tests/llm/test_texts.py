"""Encodings, quality statistics, tokens: against round trips, brute force and the tokenizer's own library."""

import os
import random

import numpy as np
import pytest

from corvidex.llm import bpe, mojibake, quality

PROSE = [
    "The café on the corner opens at seven, and the crème brûlée is naïve – “simple” – but good.",
    "Die größere Straße führt über die Brücke, und das Mädchen hört schöne Töne.",
    "El niño pequeño soñaba con una montaña más allá del río, según la canción.",
    "O coração não é só um órgão: são emoções, irmãos e lições de avião.",
    "Książka leży na stole, a źródło światła świeci słabo i żółto.",
    "Новый дом стоит у реки, и старый сад зимой очень красивый и тёплый.",
    "La forêt était élevée, et le château près du théâtre paraissait âgé.",
]


def corpus(seed, n=700):
    rng = random.Random(seed)
    words = [t.split() for t in PROSE]
    return [" ".join(rng.choices(words[i % len(words)], k=25)) for i in range(n)]


WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "latin-1"), ("cp1251", "cp866")]


def test_wrong_encodings_are_found_and_restored(spark):
    texts, damaged = corpus(1), {}
    for i, (true, wrong) in enumerate(WRONG * 2):
        k = i * 35 + (5 if true != "utf-8" else i % 5 if wrong != "cp1251" else 0)
        k += (5 - k) % 7 if true != "utf-8" else 0  # a Russian one
        try:
            shown = texts[k].encode(true).decode(wrong)
        except UnicodeError:
            continue
        if shown != texts[k]:
            damaged[k] = texts[k]
            texts[k] = shown
    twice = texts[620].encode().decode("latin-1").encode().decode("latin-1")
    damaged[620], texts[620] = texts[620], twice
    texts[621] = texts[621].encode("cp1252", "replace").decode("utf-8", "replace") if "é" in texts[621] else "caf� r�el"
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    rows += [(9000, None, ""), (9001, "", ""), (9002, "The � sign, Â and Ã or © and ™ alone – √39 “RÉSUMÉ” NÃO É", ""), (9003, "plain", ""), (9004, "Ж" * 50_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, content string, restored string")
    got = {r.doc_id: r for r in mojibake.wrongly_decoded(df).collect()}
    assert set(got) == set(damaged) | {621}
    assert len(damaged) >= 12
    assert sum(got[i].restored == t for i, t in damaged.items()) >= 0.9 * len(damaged)
    assert got[621].mappings == ["lost"]
    assert mojibake.wrongly_decoded(df.limit(0)).count() == 0


WORDS = [("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("utf-8", "cp1252")]


def test_single_damaged_words_are_found(spark):
    rng, clean = random.Random(11), corpus(5)
    rows, want = list(enumerate(clean)), {}
    for true, wrong in WORDS:
        for k in (1, 3):
            for _ in range(8):
                while True:
                    words = rng.choice(clean).split()
                    odd = [i for i, w in enumerate(words) if len(w.strip(",.")) > 3 and not w.isascii() and w.strip(",.").isalpha()]
                    shown = {}
                    for i in odd:
                        try:
                            shown[i] = words[i].encode(true).decode(wrong)
                        except UnicodeError:
                            continue
                    shown = {i: w for i, w in shown.items() if w != words[i]}
                    if len({words[i] for i in shown}) >= k:
                        break
                text = " ".join(words)
                for i in rng.sample(sorted(shown), k):
                    words[i] = shown[i]
                want[10_000 + len(want)] = text
                rows.append((9_999 + len(want), " ".join(words)))
    got = {r.doc_id: r.restored for r in mojibake.wrongly_decoded(spark.createDataFrame(rows, "doc_id long, content string")).collect()}
    assert all(i >= 10_000 for i in got)
    assert len(got) >= 0.9 * len(want)
    assert sum(got[i] == want[i] for i in got) >= 0.8 * len(want)


def test_misread_four_times_and_in_a_language_the_corpus_lacks(spark):
    texts = corpus(6)
    deep = texts[0]
    for _ in range(4):
        deep = deep.encode().decode("latin-1")
    greek = "Η γρήγορη αλεπού πηδάει πάνω από τον τεμπέλη σκύλο κάθε πρωί."
    rows = [*enumerate(texts), (5000, deep), (5001, greek.encode().decode("latin-1")), (5002, greek), (5003, "сад. Сад и сад, сад."), (5004, "“RÉSUMÉ”")]
    got = {r.doc_id: r.restored for r in mojibake.wrongly_decoded(spark.createDataFrame(rows, "doc_id long, content string")).collect()}
    assert got == {5000: texts[0], 5001: greek}


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(1, 25)).astype(float) + 0.25
        got = mojibake.improbable_runs(scores)

        def brute(a, b):
            """The best stretch of scores[a:b], then the same to its left and right."""
            best = max(((scores[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*brute(a, i), scores[i:j].sum(), *brute(j, b)]

        assert np.allclose([scores[a:b].sum() for a, b in got], brute(0, len(scores)))


def test_quality_statistics(spark):
    texts = {
        1: "The cat sat on the mat. It was warm.\nThe dog ran to the house!",
        2: "- milk\n- eggs\n- bread\n- cheese and ham",
        3: "a | b | c\n1 | 2 | 3\n4 | 5 | 6",
        4: "###$$$ %%% &&&& ****",
        5: "",
        6: " \t\r\n ",
        7: None,
        8: "x" * 100_000,
        9: "one\n" * 20_000,
        10: 'The end (of "it")',
    }
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, content string, n_words int")
    common = spark.createDataFrame([("the", "en"), ("it", "en"), ("it", "de"), (None, "en")], "word string, lang string")
    rows = {r.doc_id: r for r in quality.text_quality(df, common).collect()}
    assert set(rows) == set(texts) - {7}
    for i, r in rows.items():
        words = [w for w in texts[i].replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        lines = [x for x in (y.strip(" \t\r") for y in texts[i].split("\n")) if x]
        assert r.n_words == len(words) and r.n_chars == sum(map(len, words))
        assert r.mean_word == (pytest.approx(r.n_chars / len(words)) if words else None)
        assert r.symbol_ratio == (pytest.approx(sum(c in quality.SYMBOLS for c in texts[i]) / r.n_chars) if words else None)
        assert r.punct_share == (pytest.approx(sum(x[-1] in quality.LINE_ENDS for x in lines) / len(lines)) if lines else None)
        assert r.common_share == (pytest.approx(sum(w.lower().strip(quality.WORD_EDGES) in ("the", "it") for w in words) / len(words)) if words else None)
        shares = [r.prose_share, r.list_share, r.table_share, r.junk_share]
        assert (sum(shares) == pytest.approx(1)) if lines else shares == [None] * 4
    assert rows[1].prose_share == 1 and rows[2].list_share == 1 and rows[3].table_share == 1 and rows[4].junk_share == 1
    assert {r.doc_id for r in quality.not_prose(spark.createDataFrame(list(rows.values()))).collect()} == {2, 3, 4, 5, 6, 8, 9, 10} - ({10} if len('The end (of "it")'.split()) >= 5 else set())
    joined = quality.text_quality(df, common, most_words=1)
    assert {r.doc_id: r.common_share for r in joined.collect()} == {i: r.common_share for i, r in rows.items()}
    assert quality.text_quality(df.limit(0), common.limit(0)).count() == 0


def test_lines_of_known_kinds_get_their_label(spark):
    rng = random.Random(8)
    words = sorted({w.strip(",.–“”") for t in PROSE for w in t.split()} - {""})
    common = "the on is and but die und das el con una la o não é um na i w стоит и где et le du".split()
    letters = "abcdefghijklmnopqrstuvwxyz"

    def prose():
        return " ".join(w for _ in range(rng.randrange(5, 12)) for w in (rng.choice(words), rng.choice(common))).capitalize() + rng.choice(".!?")

    def item():
        return rng.choice(["- ", "* ", f"{rng.randrange(1, 30)}. "]) + " ".join(rng.choices(words, k=rng.randrange(1, 5)))

    def row():
        return " | ".join(rng.choice([str(rng.randrange(1000)), rng.choice(words)]) for _ in range(rng.randrange(3, 7)))

    def junk():
        return rng.choice([
            lambda: "".join(rng.choices(words, k=9)),
            lambda: " ".join(rng.choices(letters + "!.", k=30)),
            lambda: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(8)),
            lambda: "".join(rng.choices("#$%&*+/<=>@~0123456789 ", k=40)),
        ])()

    made = {"prose": prose, "list": item, "table": row, "junk": junk}
    rows, kinds = [], {}
    for i in range(800):
        kind = rng.choices(list(made), [5, 1, 1, 1])[0]
        kinds[i] = kind
        rows.append((i, "\n".join(made[kind]() for _ in range(rng.randrange(1, 6)))))
    got = quality.text_quality(spark.createDataFrame(rows, "doc_id long, content string"), spark.createDataFrame([(w,) for w in common], "word string")).collect()
    right = {k: [] for k in made}
    for r in got:
        right[kinds[r.doc_id]].append(r[f"{kinds[r.doc_id]}_share"])
    assert all(np.mean(x) >= 0.9 for x in right.values()), {k: np.mean(x) for k, x in right.items()}


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(2)
    model = quality.prior()
    lines = [rng.integers(0, quality.N_SYMBOLS, k) for k in (3, 0, 5, 1, 4, 5)]
    logs = [np.log(x) for x in model]
    for seq, path in zip(lines, quality.viterbi(lines, model), strict=True):
        score = lambda p: logs[0][p[0]] + sum(logs[1][a, b] for a, b in zip(p, p[1:], strict=False)) + sum(logs[2][a, s] for a, s in zip(p, seq, strict=True))  # noqa: E731, B023
        assert len(path) == len(seq)
        if len(seq):
            assert score(list(path)) == pytest.approx(max(score(p) for p in product(range(4), repeat=len(seq))))


needs_files = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no tokenizer files here")


@needs_files
def test_ids_equal_those_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    own.encode_special_tokens = True
    rng = random.Random(4)
    pool = [chr(c) for c in range(1, 0x3000)] + [chr(c) for c in range(0x1F300, 0x1F600)] + list(" \n\t\r\x0b\x0c\x1c\x85\xa0'sdtrevml") * 30
    texts = ["", None, " ", "<|endoftext|> is text", "don't  we'll 'S", "a" * 3000, "ab" * 2500, "\n" * 2000, "  x", "naïve\r\ncafé ", *PROSE]
    texts += ["".join(rng.choices(pool, k=40)) for _ in range(300)] + ["same words here"] * 3
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    want = own.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert len(got) == len(texts)
    assert all(got[i] == w.ids for i, w in enumerate(want))
    assert all(own.decode(got[i]) == t for i, t in enumerate(texts[10:17], 10))
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, keep=("doc_id", "ids")).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bpe.encode_texts(df.limit(0)).count() == 0


@needs_files
def test_heap_and_query_agree():
    encoder = bpe.Encoder(bpe.read_merges())
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeth", k=rng.randrange(1, 200))) for _ in range(200)] + ["aaaa" * k for k in range(1, 30)]
    words = list(dict.fromkeys(words))
    encoder.learn(words)
    assert all(encoder.kept[w] == encoder.by_heap(w.encode()) for w in words)
    long = "abcth" * 5000
    encoder.learn([long])
    assert sum(len(x) for x in [encoder.kept[long]]) > 0


@pytest.mark.parametrize(("true", "wrong", "k", "same"), [("koi8-r", "cp1251", 5, True), ("utf-8", "cp1252", 6, True), ("utf-8", "cp1252", 6, False), ("utf-8", "cp1251", 5, False)])
def test_damage_of_a_third_of_the_rows_is_found(spark, true, wrong, k, same):
    texts = corpus(3)
    damaged = {}
    for i in range(350):
        t = texts[k] if same else texts[7 * (i % 50) + k] + f" {i}"
        shown = t.encode(true).decode(wrong, "ignore")
        if shown.encode(wrong).decode(true, "ignore") == t:
            damaged[1000 + i] = (t, shown)
    assert len(damaged) > 100
    df = spark.createDataFrame([*enumerate(texts), *((i, shown) for i, (_, shown) in damaged.items())], "doc_id long, content string")
    got = {r.doc_id: r.restored for r in mojibake.wrongly_decoded(df).collect()}
    assert set(got) == set(damaged)
    assert sum(got[i] == t for i, (t, _) in damaged.items()) >= 0.9 * len(damaged)
