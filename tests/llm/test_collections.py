"""Terms, near-duplicates, mixing and shared spans: against brute force and on edge cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvidex.llm import mixing, neardup, spans, terms

POSTINGS = "word string, doc_id long, frequency long"


def test_term_counts(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"w{rng.randrange(40)}", rng.randrange(60), rng.randrange(1, 4)) for _ in range(4000)]
    rows += [(None, 1, 1), ("", 1, 1), ("x", None, 1), ("nul", 1, None), *[("tie", 7, 1)] * 5]
    df = spark.createDataFrame(rows, POSTINGS).withColumn("records", F.lit("clash")).repartition(5)
    good = [r for r in rows if r[0] and r[1] is not None]
    got = {r.word: (r.occurrences, r.records, r.mark) for r in terms.marked_terms(df, partitions=7).collect()}
    n = len({r[1] for r in good})
    for word in {r[0] for r in good}:
        own = [r for r in good if r[0] == word]
        records = len({r[1] for r in own})
        assert got[word] == (sum(r[2] or 0 for r in own), records, "rare" if records < 3 else "common" if records >= n / 2 else None)
    assert len(got) == len({r[0] for r in good})
    assert terms.marked_terms(df.limit(0)).count() == 0


def test_scan_carries_records_over_batches():
    import pyarrow as pa

    words, ids = ["a", "a", "a", "b", "b"], [1, 2, 2, 2, 2]
    for cut in range(6):
        parts = [pa.record_batch([pa.array(words[s], pa.string()), pa.array(ids[s], pa.int64()), pa.array([1] * len(words[s]), pa.int64())], names=["word", "doc_id", "frequency"]) for s in (slice(0, cut), slice(cut, 5))]
        total = defaultdict(lambda: [0, 0])
        for batch in terms._scan(iter(parts)):
            for w, o, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[w][0] += o
                total[w][1] += r
        assert total == {"a": [3, 2], "b": [2, 1]}


def test_log_entropy(spark):
    even = [("even", d, 2) for d in range(10)]
    rows = [*even, ("once", 3, 1), ("pair", 4, 5), ("pair", 5, 5), ("split", 6, 1), ("split", 6, 3)]
    got = {(r.doc_id, r.word): r for r in terms.distinctive_terms(spark.createDataFrame(rows, POSTINGS)).collect()}
    assert got[0, "even"].weight == pytest.approx(0, abs=1e-12)
    assert got[3, "once"].weight == pytest.approx(np.log(2))
    assert got[4, "pair"].weight == pytest.approx(np.log(6) * (1 - np.log(2) / np.log(10)))
    assert got[6, "split"].tf == 4 and got[6, "split"].doc_len == 6 and got[6, "split"].n_records == 10
    one = terms.distinctive_terms(spark.createDataFrame([("a", 1, 1)], POSTINGS)).collect()
    assert one[0].weight == pytest.approx(np.log(2))
    empty = spark.createDataFrame([], POSTINGS)
    assert terms.distinctive_terms(empty).count() == 0
    assert terms.top_terms(terms.distinctive_terms(empty)).count() == 0


def test_ties_and_single_words_are_no_top_terms(spark):
    filler = [(f"f{d}", d, 1) for d in range(20)]
    rows = [*filler, ("x", 1, 1), ("x", 2, 1), ("y", 1, 1), ("y", 2, 1), ("z", 3, 1), ("z", 4, 1)]
    assert terms.top_terms(terms.distinctive_terms(spark.createDataFrame(rows, POSTINGS))).count() == 0
    rows += [("w", 3, 1), *[("w", d, 1) for d in range(5, 12)]]
    assert [tuple(r) for r in terms.top_terms(terms.distinctive_terms(spark.createDataFrame(rows, POSTINGS))).collect()] == [(3, "z")]


def edited(rng, words, base, edits):
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        how = rng.randrange(3)
        if how == 0:
            out[at] = rng.choice(words)
        elif how == 1:
            out.insert(at, rng.choice(words))
        elif len(out) > 5:
            del out[at]
    return out


def brute_pairs(texts, words, least, similarity):
    tokens = {i: [w.lower() for w in re.findall("[0-9A-Za-z]+", t)] for i, t in texts.items() if t is not None}
    sets = {i: {tuple(t[k : k + words]) for k in range(len(t) - words + 1)} for i, t in tokens.items()}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}


@pytest.mark.parametrize(("words", "least", "similarity"), [(3, 8, 0.6), (5, 1, 0.8), (1, 1, 0.5)])
def test_near_duplicates(spark, words, least, similarity):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = rng.choices(vocabulary, k=12)  # a stretch that most texts have
    texts = {}
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.choice([9, 14, 30, 80])) + (shared if k % 3 else [])
        for v in range(5):
            texts[k * 5 + v] = " ".join(edited(rng, vocabulary, base, rng.randrange(0, 1 + len(base) // 6)))
    texts |= {1000 + i: "one and the same text of more than eight words, twice or more often" for i in range(30)}
    texts |= {2000: None, 2001: "", 2002: "...", 2003: "x " * 30_000, 2004: "X " * 30_000, 2005: "a b c"}
    rows = [(i, t, "clash") for i, t in texts.items()] * 2
    df = spark.createDataFrame(rows, "doc_id long, content string, rep string")
    links, members = neardup.near_duplicates(df, similarity, words, least)
    got = [tuple(r) for r in neardup.document_pairs(links, members).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(texts, words, least, similarity)
    links, members = neardup.near_duplicates(df.limit(0), similarity, words, least)
    assert neardup.document_pairs(links, members).count() == 0


def test_salted_signatures_give_the_same_links(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    base = rng.choices(vocabulary, k=40)
    texts = {i: " ".join(edited(rng, vocabulary, base, 3)) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    monkeypatch.setattr(neardup, "SALT_ROWS", 7)
    monkeypatch.setattr(neardup, "MOST_PARTNERS", 9)
    got = [tuple(r) for r in neardup.document_pairs(*neardup.near_duplicates(df, 0.6, 3, 8)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 3, 8, 0.6)


def test_no_link_is_lost_by_signatures():
    """Whatever is frequent, similar sets share a signature in a band of one of them."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        similarity, least = (0.6, 8) if trial % 2 else (0.8, 1)
        base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
        sets = []
        for _ in range(60):
            n = int(rng.integers(least, 120))
            start = int(rng.integers(0, 40))
            keep = rng.random(n) > 0.12
            sets.append(np.unique(np.concatenate([base[start : start + n][keep], rng.integers(1, 1 << 62, rng.integers(1, 4)).astype(np.uint64)])))
        sets = [s for s in sets if len(s) >= least]
        known = np.unique(base[:60])
        out = neardup.signatures(sets, (known, np.full(len(known), 100)), similarity, least)
        sigs = defaultdict(set)
        for k, s, o, p in zip(*(out[c].tolist() for c in ("set", "sig", "own", "pos")), strict=True):
            sigs[k].add((s, o, p))
        sketches = np.unpackbits(np.stack([out["p0"], out["p1"]], axis=1).view(np.uint8), axis=1)
        for a, b in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert (sketches[a] != sketches[b]).sum() <= len(sets[a]) + len(sets[b]) - 2 * both
            if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
                (_, small), (_, large) = sorted([(len(sets[a]), a), (len(sets[b]), b)])
                own = {s: p for s, o, p in sigs[large] if o}
                least_common = similarity / (1 + similarity) * (len(sets[a]) + len(sets[b])) - 1e-9
                assert any(s in own and min(len(sets[small]) - p, len(sets[large]) - own[s]) >= least_common for s, _, p in sigs[small])


def test_wide_sketches_reject_what_the_narrow_one_cannot():
    rng = np.random.default_rng(5)
    similarity, n = 0.6, 1998  # shingles of a text of 2,000 words
    ends = neardup.bands(8, similarity)
    upper = int(ends[np.searchsorted(ends, n, "right")])
    most, rejected = (1 - similarity) / (1 + similarity) * 2 * n, 0
    for trial in range(60):
        both = int(n * (0.3 if trial % 3 else 0.8))
        common = rng.integers(1, 1 << 62, both).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(1, 1 << 62, n - both).astype(np.uint64)]) for _ in range(2))
        words, sizes = neardup.parity_sketches([a, b], np.array([upper, upper]))
        apart = int(np.bitwise_count(words[: sizes[0]] ^ words[sizes[0] :]).sum())
        assert apart <= 2 * (n - both)
        if trial % 3:
            rejected += apart > most
        else:
            assert apart <= most
    assert rejected >= 36


def test_long_near_duplicates(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for k in range(12):
        base = rng.choices(vocabulary, k=2000)
        for v in range(4):
            texts[k * 4 + v] = " ".join(edited(rng, vocabulary, base, v * 130))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    got = {tuple(r) for r in neardup.document_pairs(*neardup.near_duplicates(df, 0.6, 3, 8)).collect()}
    assert got == brute_pairs(texts, 3, 8, 0.6) and got


def brute_spans(texts, length):
    windows = defaultdict(set)
    for i, t in texts.items():
        for k in range(len(t or "") - length + 1):
            windows[t[k : k + length]].add(i)
    return {p for w in windows.values() for p in combinations(sorted(w), 2)}


@pytest.mark.parametrize(("length", "gram"), [(12, 9), (20, 5), (8, 8), (200, 160)])
def test_shared_spans(spark, length, gram):
    rng = random.Random(length)
    letters = "abcé– \n"
    pieces = ["".join(rng.choices(letters, k=rng.randrange(length // 2, 2 * length))) for _ in range(12)]
    texts = {}
    for i in range(80):
        texts[i] = "".join(rng.choice(pieces) if rng.random() < 0.3 else "".join(rng.choices(letters, k=rng.randrange(length))) for _ in range(6))
    texts |= {90: texts[0], 91: texts[0], 92: None, 93: "", 94: "a" * 5 * length, 95: "b" + "a" * 4 * length + "c", 96: "ab" * 3 * length, 97: "z" * length + texts[5] + "y" * 3000}
    rows = [(i, t, "clash") for i, t in texts.items()]
    df = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string, key string")
    sites = spans.anchor_sites(df, length, gram)
    rows = spans.shared_spans(sites).collect()
    for r in rows:
        a, b = texts[r.rep_a][r.start_a : r.start_a + r.length], texts[r.rep_b][r.start_b : r.start_b + r.length]
        assert a == b and r.length >= length
        before = r.start_a and r.start_b and texts[r.rep_a][r.start_a - 1] == texts[r.rep_b][r.start_b - 1]
        after = texts[r.rep_a][r.start_a + r.length : r.start_a + r.length + 1], texts[r.rep_b][r.start_b + r.length : r.start_b + r.length + 1]
        assert not before and (after[0] != after[1] or not after[0])
    assert len(rows) == len(set(map(tuple, rows)))
    pairs = [tuple(r) for r in neardup.document_pairs(spans.shared_pairs(sites), sites.members).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_spans(texts, length)
    assert {(r.rep_a, r.rep_b) for r in rows} == {tuple(r) for r in spans.shared_pairs(sites).collect()}
    shares = {r.doc_id: r.n_shared for r in spans.shared_shares(sites).collect()}
    assert shares == brute_shares(texts, length)
    empty = spans.anchor_sites(df.limit(0), length, gram)
    assert spans.shared_spans(empty).count() == 0 and spans.shared_shares(empty).count() == 0


def brute_shares(texts, length):
    """Characters of each text in windows that another text has, too."""
    have = defaultdict(set)
    for i, t in texts.items():
        for k in range(len(t or "") - length + 1):
            have[t[k : k + length]].add(i)
    return {i: len({k + x for k in range(len(t) - length + 1) if len(have[t[k : k + length]]) > 1 for x in range(length)}) for i, t in texts.items() if len(t or "") >= length}


def brute_matches(a, b, length):
    """All maximal common runs of at least `length` characters."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if k >= length:
                    out.add((i, j, k))
    return out


@pytest.mark.parametrize(("length", "gram"), [(12, 9), (20, 5), (8, 8)])
def test_repeated_passages_are_spans_and_shares_in_full(spark, length, gram):
    rng = random.Random(length)
    passage, other = ("".join(rng.choices("abcdefgh", k=n)) for n in (30, 24))
    noise = lambda: "".join(rng.choices("xyzw", k=rng.randrange(1, 9)))
    texts = {
        0: passage * 20,
        1: "x" + passage + "y",
        2: other * 6 + noise(),
        3: noise() + other * 2 + noise() + other,
        4: "".join(passage + noise() for _ in range(7)),
        5: "a" * 90,
        6: "b" + "a" * 50 + "c",
        7: "ab" * 40,
        8: "ab" * 20 + "c" + "ab" * 15,
        9: "nothing of all this is in another text",
    }
    df = spark.createDataFrame([*texts.items(), (50, texts[4])], "doc_id long, text string")
    sites = spans.anchor_sites(df, length, gram)
    rows = [tuple(r) for r in spans.shared_spans(sites).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(i, j, *m) for i, j in combinations(texts, 2) for m in brute_matches(texts[i], texts[j], length)}
    shares = {r.doc_id: r.n_shared for r in spans.shared_shares(sites).collect()}
    assert shares == brute_shares({**texts, 50: texts[4]}, length)
    assert shares[0] == len(texts[0])


def test_boilerplate_gives_shares_without_pairs(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, texts = word(600), {}
    for i in range(150):
        texts[i] = word(50 + i % 90) + passage[i % 7 * 20 :] + word(120)
    texts[500] = word(900)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(spans, "MOST_PAIRS", 3_000)
    monkeypatch.setattr(neardup, "MOST_PARTNERS", 50)
    sites = spans.anchor_sites(df)
    assert {r.doc_id: r.n_shared for r in spans.shared_shares(sites).collect()} == brute_shares(texts, 200)
    assert {tuple(r) for r in spans.shared_pairs(sites).collect()} == set(combinations(range(150), 2))


TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "big" if rng.random() < 0.7 else rng.choice(["mid", "small", "other"]), rng.randrange(0, 50)) for i in range(6000)] + [(7000, None, 5), (7001, "tiny", 9), (7002, "zero", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("block", F.lit("clash"))
    wanted = {"big": (0.3, 1), "mid": (0.3, 4), "small": (0.3, 2), "tiny": (0.05, 3), "zero": (0.01, 2), "none": (0.04, 2)}
    targets = spark.createDataFrame([(s, *w) for s, w in wanted.items()] + [(None, 0.1, 1)], TARGETS)
    mix = mixing.mix_sources(df, targets, shards=5, blocks=1000)
    report = {r.source: r for r in mix.report.collect()}
    total = sum(t for _, s, t in rows if s in wanted)
    used, tokens, got = Counter(), Counter(), mix.rows.collect()
    size = {i: t for i, _, t in rows}
    for r in got:
        used[r.doc_id] += 1
        tokens[r.source] += size[r.doc_id]
    for source, (share, repeats) in wanted.items():
        own = sum(t for _, s, t in rows if s == source)
        r = report[source]
        assert r.n_tokens == own and r.drawn_tokens == tokens[source]
        assert r.short == (own * repeats < share * total)
        assert tokens[source] == own * repeats if r.short else 0 <= share * total - tokens[source] < 50
    assert all(used[i] <= wanted[s][1] for i, s, _ in rows if s in wanted)
    assert len({(r.doc_id, r.repeat) for r in got}) == len(got)
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert len(shards) == 5
    for own in shards.values():
        assert sorted(r.place for r in own) == list(range(1, len(own) + 1))
        assert 0.7 < sum(r.source == "big" for r in own) / len(own) / (sum(r.source == "big" for r in got) / len(got)) < 1.3
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(3), targets, shards=5, blocks=1000).rows.collect()))


def test_a_text_larger_than_the_quota_does_not_end_the_draw(spark):
    rows = [(i, "a", 100) for i in range(2000)] + [(5000, "a", 300_000), (6000, "b", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 150_050 / 500_010, 1)], TARGETS)
    targets = targets.union(spark.createDataFrame([("b", 0.1, 1)], TARGETS))
    for seed in (1, 2, 3):
        mix = mixing.mix_sources(df, targets, shards=2, blocks=16, seed=seed)
        got, report = mix.rows.where("source = 'a'").collect(), {r.source: r for r in mix.report.collect()}
        assert len({r.doc_id for r in got}) == len(got) == 1500
        assert report["a"].drawn_tokens == 150_000 and not report["a"].short


def test_very_many_repeats_are_dealt_evenly(spark):
    df = spark.createDataFrame([(i, "tiny", 7) for i in range(3)] + [(10, "big", 500_000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("tiny", 0.5, 2_000_000), ("big", 0.5, 1)], TARGETS)
    mix = mixing.mix_sources(df, targets, shards=4, blocks=16)
    got = mix.drawn.where("source = 'tiny'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repeat").alias("d"), F.max("repeat").alias("last")).collect()
    times = 250_010 // 21
    assert {r.doc_id for r in got} == {0, 1, 2} and all(r.n == r.d == r.last + 1 and times <= r.n <= times + 1 for r in got)
    by_shard = [r["count"] for r in mix.drawn.where("source = 'tiny'").groupBy("shard").count().collect()]
    assert len(by_shard) == 4 and max(by_shard) - min(by_shard) <= 12


def test_mix_edges(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mix = mixing.mix_sources(df, targets)
    assert mix.rows.count() == 0 and mix.report.first().n_tokens == 0
    assert mixing.mix_sources(df, targets.limit(0)).report.count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, targets.union(targets))


def test_split_tree_keeps_quotas():
    rng = np.random.default_rng(1)
    tree = mixing.split_tree(np.array([1000, 10, 0, 333]), 7, rng)
    assert tree.shape == (7, 4) and (tree >= 0).all() and (tree.sum(0) == [1000, 10, 0, 333]).all()
    assert abs(tree.sum(1) - 1343 / 7).max() < 3
