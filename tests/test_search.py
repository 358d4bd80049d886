"""Tokens, codec, scores, layout and search on hand-made texts, and against a document-at-a-time model in Python."""

import heapq
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvidex.frames import positions, running_sum
from corvidex.functions import codec, scoring, text
from corvidex.operators import blocks, corpus, index, search
from corvidex.sources import documents


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def test_tokens(spark):
    assert column(spark, ["Ab\tcd é-9 naïve", "..", "", None], "string", text.tokens) == [["Ab", "cd", "9", "na", "ve"], [], [], []]
    assert column(spark, ["b a b A"], "string", text.query_terms) == [["b", "a", "A"]]
    assert text.terms_of("b a b A..") == ["b", "a", "A"]


def test_vbyte(spark):
    rng = random.Random(1)
    values = [0, 1, 127, 128, 130, 16383, 16384, 2**31 - 1, 2**35, 2**62, *(rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(300))]
    digits = column(spark, values, "long", codec.vbyte_hex)
    assert digits[4] == "8201"
    assert column(spark, digits, "string", codec.vbyte_value) == values
    assert column(spark, values, "long", codec.vbyte_length) == [len(d) // 2 for d in digits]


def test_quantize(spark):
    assert column(spark, [0.0, 1.0, 7.0, -3.0], "double", scoring.quantize) == [0, 36, 108, 0]
    scores = [random.Random(2).uniform(0, 40) for _ in range(200)]
    back = column(spark, scores, "double", lambda c: scoring.dequantize(scoring.quantize(c)))
    assert all(b <= s + 1e-9 and (1 + s) / (1 + b) < 2 ** (1 / 36.06) + 1e-9 for s, b in zip(scores, back, strict=True))


def test_corpus(spark):
    d = docs(spark, ["a b", "a a c", "", None])
    assert sorted(map(tuple, corpus.postings(d).collect())) == [("a", 0, 1, 2), ("a", 1, 2, 3), ("b", 0, 1, 2), ("c", 1, 1, 3)]
    assert tuple(corpus.corpus_stats(d).first()) == (4, 5, 1)
    assert tuple(corpus.corpus_stats(d.limit(0)).first()) == (0, 0, 0)
    assert sorted(map(tuple, corpus.doc_lengths(d).collect())) == [(0, 2), (1, 3), (2, 0), (3, 0)]


def test_page_table_and_tsv(spark, tmp_path):
    loads = spark.createDataFrame([(1, 7, "old", "x"), (2, 7, "new", "x"), (3, 8, None, "x"), (4, None, "lost", "x")], "row_seq long, doc_id long, content string, _rank string")
    assert [tuple(r) for r in documents.page_table(loads).collect()] == [(7, "new")]
    (tmp_path / "c.tsv").write_bytes(b"1\ta\tb\nno tab\nx\ty\n1\tag\rain\r\n2\tlast, no line feed")
    lines = documents.read_tsv(spark, str(tmp_path / "c.tsv"))
    assert [(r.reason, r.line) for r in documents.tsv_rejects(spark, str(tmp_path / "c.tsv")).orderBy("row_seq").collect()] == [("no tab", "no tab"), ("doc_id", "x\ty")]
    assert sorted((r.doc_id, r.content) for r in lines.collect()) == [(1, "a\tb"), (1, "ag\rain"), (2, "last, no line feed")]
    assert sorted(map(tuple, documents.page_table(lines).collect())) == [(1, "ag\rain"), (2, "last, no line feed")]
    assert [tuple(r) for r in documents.lookup(docs(spark, ["a"]), [0, 5]).orderBy("doc_id").collect()] == [(0, "a"), (5, None)]


def test_chunks(spark):
    d = docs(spark, ["t128 t129 t256 t257"] * 128 + ["t129 t256 t257"] + ["t256 t257"] * 127 + ["t257"])
    impacts = index.impacts(d)
    lexicon = {r.term: r.end_chunk - r.start_chunk + 1 for r in index.lexicon(corpus.term_df(impacts)).collect()}
    assert lexicon == {"t128": 1, "t129": 2, "t256": 2, "t257": 3}
    chunks = index.chunk_directory(impacts).orderBy("chunk_no").collect()
    assert [c.n_postings for c in chunks] == [128, 128, 1, 128, 128, 128, 128, 1]
    assert sorted(map(tuple, index.undo_gaps(index.placed(impacts)).collect())) == sorted((r.term, r.doc_id) for r in impacts.collect())


def test_hot_terms_are_arranged_in_parts(spark):
    rng = random.Random(4)
    rows = [(t, d, rng.randrange(1, 5), 9) for t, n in (("hot", 700), ("warm", 300), ("cold", 20), ("once", 1)) for d in rng.sample(range(5000, 9000), n)]
    found = spark.createDataFrame(rows, "term string, doc_id long, tf long, doc_len long").repartition(5)
    want = {}
    for term in {r[0] for r in rows}:
        ids = sorted(r[1] for r in rows if r[0] == term)
        want |= {(term, d): (len(ids), i, ids[i - 1] if i else None) for i, d in enumerate(ids)}
    for least in (100, 100_000):
        assert {(r.term, r.doc_id): (r.df, r.position, r.before) for r in index.arranged(found, least).collect()} == want
    assert index.arranged(found.limit(0)).count() == 0


@pytest.mark.parametrize("file_blocks", [1, 2, 3, 24_000])
def test_files_end_with_a_term_that_fills_them(spark, file_blocks):
    rng = random.Random(file_blocks)
    terms = [(f"t{i:04}", rng.choice([1, 1, 1, 3, 70, 200])) for i in range(60)]
    files, blocks, place, chunks = [[]], {}, {}, []
    for term, n in terms:
        if len(files[-1]) and math.ceil(len(files[-1]) / 64) >= file_blocks:
            files.append([])
        for _ in range(n):
            files[-1].append(term)
            at = (len(files) - 1, (len(files[-1]) - 1) // 64)
            blocks[at] = blocks.get(at, 0) + 1
            place.setdefault(term, []).append(at)
            chunks.append((len(chunks) + 1, term, 5))
    df = spark.createDataFrame(chunks, "chunk_no long, term string, n_bytes long")
    got = {(r.file_no, r.block_no): (r.n_chunks, r.payload_bytes) for r in index.block_directory(df, file_blocks).collect()}
    assert got == {k: (n, 5 * n) for k, n in blocks.items()}
    lexicon = df.groupBy("term").agg(F.min("chunk_no").alias("start_chunk"), F.max("chunk_no").alias("end_chunk"))
    some = [t for t, _ in terms[::6]]
    places = {r.term: (r.file_no, r.first_block, r.last_block) for r in index.list_places(lexicon, index.file_starts(df, file_blocks), [*some, "absent"]).collect()}
    assert places == {t: (place[t][0][0], place[t][0][1], place[t][-1][1]) for t in some}


def test_positions_and_running_sum_cross_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3 * 0 + F.when(F.col("id") < 4500, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("o"))
    got = positions(rows, "k", "o").collect()
    assert all(r.position == (r.o if r.o < 4500 else 0) for r in got) and len(got) == 5000
    sums = running_sum(spark.range(1000).select("id", (F.col("id") % 7).alias("v")), "id", "v", "s").collect()
    assert all(r.s == sum(i % 7 for i in range(r.id + 1)) for r in sums)
    assert running_sum(spark.range(0).select("id", F.lit(1).alias("v")), "id", "v", "s").count() == 0


def model(texts, query, mode, k=20):
    """The same search by heaps over sorted lists."""
    split = [re.findall("[0-9A-Za-z]+", t or "") for t in texts]
    n, avg = len(texts), sum(map(len, split)) // len(texts)
    terms = list(dict.fromkeys(re.findall("[0-9A-Za-z]+", query)))
    lists = []
    for t in terms:
        have = [(i, s.count(t)) for i, s in enumerate(split) if t in s]
        postings = []
        for i, tf in have:
            idf = math.log((n - len(have) + 0.5) / (len(have) + 0.5))
            score = idf * 2.2 * tf / (1.2 * (0.25 + 0.75 * len(split[i]) / max(avg, 1)) + tf)
            q = 0 if score <= 0 else int(math.log2(score + 1) * 36.06)
            postings.append((i, 0.0 if q == 0 else 2 ** (q / 36.06) - 1))
        lists.append(postings)
    at, hits = [0] * len(lists), []
    while any(a < len(p) for a, p in zip(at, lists, strict=True)):
        doc = min(p[a][0] for a, p in zip(at, lists, strict=True) if a < len(p))
        own = [j for j, p in enumerate(lists) if at[j] < len(p) and p[at[j]][0] == doc]
        if mode == "or" or len(own) == len(lists):
            hits.append((round(sum(lists[j][at[j]][1] for j in own), 6), -doc))
        for j in own:
            at[j] += 1
    return [(-d, s) for s, d in heapq.nlargest(k, hits)]


@pytest.mark.parametrize("mode", ["and", "or"])
def test_search_matches_model(spark, mode):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("the of a river garden coastal stove x y z".split(), range(20, 0, -2), k=rng.randrange(12))) for _ in range(150)] + [None, ""]
    scores = search.byte_scores(index.impacts(docs(spark, texts).repartition(3)))
    for query in ("river garden", "the", "coastal stove the", "garden nothere", "..."):
        got = [(r.doc_id, r.score) for r in search.search(scores, query, mode).orderBy("rank").collect()]
        want = model(texts, query, mode) if search.terms_of(query) else []
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_rejected_queries():
    assert [search.rejected(q) for q in (None, "", " \t", "..", "é", "a..")] == ["empty", "empty", "empty", "no terms", "no terms", None]


@pytest.mark.parametrize(("lead", "whole"), [(1, 0), (50, 0), (50, 10**9)])
def test_batches_equal_single_searches(spark, tmp_path, monkeypatch, lead, whole):
    rng = random.Random(lead)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [40 / (i + 1) for i in range(40)], k=rng.randrange(25))) for _ in range(300)]
    index.write_index(docs(spark, texts), str(tmp_path))
    opened = index.open_index(spark, str(tmp_path))
    monkeypatch.setattr(search, "LEAD", lead)
    monkeypatch.setattr(search, "MOST_JOINED", 200)
    monkeypatch.setattr(search, "MOST_WHOLE", whole)
    asked = {f"q{i}": " ".join(rng.sample(words, rng.randrange(1, 9))) for i in range(12)} | {"own": texts[5], "none": "..", "missing": "w1 zz", "gone": "zz"}
    batch = spark.createDataFrame([*asked.items(), ("null", None)], "item string, text string")
    for mode in ("or", "and"):
        got = {}
        for r in search.search_batch(opened, batch, mode, 7).collect():
            got.setdefault(r.item, []).append((r.rank, r.doc_id, r.score))
        for item, query in asked.items():
            want = model(texts, query, mode, 7) if search.terms_of(query) else []
            assert [(r[0], r[1]) for r in sorted(got.get(item, []))] == [(i + 1, w[0]) for i, w in enumerate(want)]
            assert all(abs(r[2] - w[1]) < 2e-6 for r, w in zip(sorted(got.get(item, [])), want, strict=True))
    counts = {r.mode: r.n_docs for r in search.count_matches(opened, asked["q1"]).collect()}
    assert counts == {mode: len(model(texts, asked["q1"], mode, 1000)) for mode in ("and", "or")}
    assert search.search_index(opened, "w1 zz", "and").count() == 0
    assert [r.doc_id for r in search.search_index(opened, asked["q1"], "or", 7).orderBy("rank").collect()] == [d for d, _ in model(texts, asked["q1"], "or", 7)]


def test_search_edges(spark):
    d = docs(spark, ["a b", "b", None])
    scores = search.byte_scores(index.impacts(d))
    assert search.search(scores, "a zz", "and").count() == 0
    assert search.search(scores, "..").count() == 0
    assert search.search(search.byte_scores(index.impacts(d.limit(0))), "a").count() == 0
    with pytest.raises(ValueError):
        search.search(scores, "a", "xor")
    hits = search.with_content(search.search(scores, "a"), d.where("doc_id > 0"))
    assert [(r.doc_id, r.content) for r in hits.collect()] == [(0, None)]


def test_zero_scores_still_match(spark):
    got = search.search(search.byte_scores(index.impacts(docs(spark, ["a", "a", "a b"]))), "a").collect()
    assert [(r.doc_id, r.score) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_written_index(spark, tmp_path):
    d = docs(spark, ["red fox", "red hen", "blue hen hen"])
    index.write_index(d, str(tmp_path))
    opened = index.open_index(spark, str(tmp_path))
    hits = search.with_content(search.search(search.byte_scores(opened.postings), "hen fox"), opened.pages).collect()
    assert {r.content for r in hits} == {"red fox", "red hen", "blue hen hen"}
    found = opened.postings.where(F.col("term").isin("hen"))
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().toString() or "EqualTo(term" in found._jdf.queryExecution().toString()


def test_runs_merge_to_postings(spark):
    d = docs(spark, ["a b a", "b", "c a", None, "a"])
    merged = corpus.merge_runs(corpus.segment_postings(d, 3))
    assert sorted(map(tuple, merged.collect())) == sorted((r.term, r.doc_id, r.tf) for r in corpus.postings(d).collect())


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from corvidex import __main__ as cli

    (tmp_path / "c.tsv").write_text("3\told\n1\tred fox\n2\tblue hen\n3\tred hen\n4\tgreen tree\n5\told tree\n")
    cli.main(["index", str(tmp_path / "c.tsv"), str(tmp_path / "i")])
    cli.main(["search", str(tmp_path / "i"), "red", "hen", "--mode", "and"])
    assert capsys.readouterr().out.split("\t")[::2] == ["3", "red hen\n"]
    typed = iter(["9", "1", "...", "2", "fox", "3"])
    monkeypatch.setattr("builtins.input", lambda _: next(typed))
    cli.main(["search", str(tmp_path / "i")])
    assert "1\t" in capsys.readouterr().out
    monkeypatch.setattr("builtins.input", lambda _: (_ for _ in ()).throw(EOFError))
    assert list(cli.asked()) == []


def test_and_is_part_of_or_whatever_the_order_of_rows(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.randrange(9))) for _ in range(120)]
    d = docs(spark, texts)
    found = {}
    for name, rows in (("plain", d), ("shuffled", d.orderBy(F.rand(3)).repartition(5))):
        scores = search.byte_scores(index.impacts(rows))
        found[name] = {m: [tuple(r) for r in search.search(scores, "ab kl gh", m, 200).orderBy("rank").collect()] for m in ("and", "or")}
    assert found["plain"] == found["shuffled"]
    either = {r[1]: r[2] for r in found["plain"]["or"]}
    assert all(either[r[1]] == r[2] for r in found["plain"]["and"])


def test_large_batches_shuffle_no_pairs_of_query_and_document(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=25)) for _ in range(1500)]
    index.write_index(docs(spark, texts), str(tmp_path))
    opened = index.open_index(spark, str(tmp_path))
    monkeypatch.setattr(search, "MOST_WHOLE", 0)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled(after):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return max(s.stageId() for s in stages), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after)

    last, _ = shuffled(-1)
    batch = spark.createDataFrame(list(enumerate(texts[:200])), "item int, text string")
    assert len(search.search_batch(opened, batch, "or", 5).collect()) == 1000
    assert shuffled(last)[1] < 200 * 1500 / 2


@pytest.mark.parametrize("lead", [1, 5, 30, 1000])
def test_blocks_give_the_k_best_with_ties_and_zeros(lead):
    rng = random.Random(lead)
    lists = {n: {d: rng.choice([0, 0, 3, 3, 90]) * (n % 4 > 0) for d in rng.sample(range(700, 1000), rng.choice([1, 9, 200]))} for n in range(1, 40)}
    rows = [(n, d, q) for n, own in lists.items() for d, q in own.items()]
    block = blocks.Block(*(np.array(x) for x in zip(*rows, strict=True)))
    asked = [rng.sample(range(1, 50), rng.randrange(1, 9)) for _ in range(60)] + [[], [4], [4, 8, 3], [45]]
    queries = pa.record_batch({"id": pa.array(range(len(asked)), pa.int64()), "terms": pa.array(asked, pa.list_(pa.int32()))})
    got = {}
    for r in block.search(queries, 5, lead).to_pylist():
        got.setdefault(r["query"], []).append((-r["score"], r["doc_id"]))
    for i, own in enumerate(asked):
        sums = {}
        for n in own:
            for d, q in lists.get(n, {}).items():
                sums[d] = sums.get(d, 0) + (2 ** (q / scoring.STEP) - 1 if q else 0)
        assert got.get(i, []) == sorted((-round(s, 6), d) for d, s in sums.items())[:5]
