"""Parsing of bad lines, totals of skewed keys, and the shared helpers on edge cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvidex import frames
from corvidex.operators.eager import eager_join_totals, heavy_keys
from corvidex.sources.bad_rows import parse_lines
from corvidex.streaming.ingest import ingest, line_stream

LONG = "x" * 200_000
LINES = [
    ("1\tplain text", None, 1, "plain text"),
    ("007\tzeros", None, 7, "zeros"),
    ("2147483647\tmost\r", None, 2147483647, "most"),
    ("2147483648\tabove", "doc_id", None, None),
    ("00000000000000000000005\tlong zeros", None, 5, "long zeros"),
    ("99999999999999999999999\tx", "doc_id", None, None),
    ("\tno id", "doc_id", None, None),
    ("-1\tx", "doc_id", None, None),
    (" 1\tx", "doc_id", None, None),
    ("١\tx", "doc_id", None, None),
    ("1\n\tx", "doc_id", None, None),
    (None, "columns", None, None),
    ("", "columns", None, None),
    ("1 no tab", "columns", None, None),
    ("1\ta\tb", "columns", None, None),
    ('1\t"a\tb"', None, 1, "a\tb"),
    ('1\t"a ""b"" c"', None, 1, 'a "b" c'),
    ('1\t"a"\tb', "columns", None, None),
    ('1\t"a"b', "quoting", None, None),
    ('1\t"a', "quoting", None, None),
    ('1\t"a""', "quoting", None, None),
    ('1\t"', "quoting", None, None),
    ('1\t""', "content", None, None),
    ('1\t"""', "quoting", None, None),
    ('1\t""""', None, 1, '"'),
    ('x\t"a', "quoting", None, None),
    ('1\ta "b" c', None, 1, 'a "b" c'),
    ("1\t", "content", None, None),
    ("1\t \r\r", "content", None, None),
    ("1\t\\N", "content", None, None),
    ('1\t"\\N"', "content", None, None),
    ("x\t\\N", "doc_id", None, None),
    ("1\t\\N ", None, 1, "\\N "),
    ('1\t"a"\r', None, 1, "a"),
    ("3\t" + LONG, None, 3, LONG),
    ('4\t"' + '""' * 50_000 + '"', None, 4, '"' * 50_000),
]


def test_lines(spark):
    rows = [(i, line, "clash", "clash") for i, (line, *_) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "line_no long, raw_line string, reason string, content string")
    got = {r.line_no: (r.reason, r.doc_id, r.content) for r in parse_lines(df).collect()}
    assert len(got) == len(LINES)
    for i, (line, *want) in enumerate(LINES):
        assert got[i] == tuple(want), line and line[:40]


def test_no_lines_and_one_hot_bad_value(spark):
    df = spark.createDataFrame([(i, "bad\tx" if i % 3 else f"{i}\tok") for i in range(3000)], "line_no long, raw_line string")
    assert Counter(r.reason for r in parse_lines(df).collect()) == {"doc_id": 2000, None: 1000}
    assert parse_lines(df.limit(0)).count() == 0


def test_hot_invalid_values_and_others(spark):
    line = F.when(F.col("id") % 4 == 0, "bad\tx").when(F.col("id") % 4 == 1, "\t ").when(F.col("id") % 4 == 2, F.concat(F.lit("bad"), F.col("id"), F.lit("\tx")))
    df = spark.range(240_000).select(F.col("id").alias("line_no"), F.coalesce(line, F.concat("id", F.lit("\tok"))).alias("raw_line"))
    df = df.unionByName(spark.range(9).select((F.col("id") - 9).alias("line_no"), F.lit(None).cast("string").alias("raw_line")))
    got = parse_lines(df).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).collect()
    assert {r.reason: (r.n, r.ids) for r in got} == {"doc_id": (180_000, 0), None: (60_000, 60_000), "columns": (9, 0)}


def test_values_are_cast_after_they_are_made_distinct(spark, monkeypatch):
    from corvidex.sources import bad_rows

    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return frames.cut(df)

    monkeypatch.setattr(bad_rows, "cut", cut)
    df = spark.createDataFrame([(1, "1\tx"), (2, "1\tx"), (3, "y\tx")], "line_no long, raw_line string")
    assert {r.line_no: r.reason for r in parse_lines(df).collect()} == {1: None, 2: None, 3: "doc_id"}
    _, distinct, invalid = plans
    assert "Aggregate" in distinct and "try_cast" not in distinct.lower() and "try_cast" in invalid.lower() and "Aggregate" not in invalid


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    def fake(master, folder, known=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: known, setCheckpointDir=lambda x: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: folder))

    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            frames.shared_folder(fake(master, None))
        frames.shared_folder(fake(master, "/shared"))
    frames.shared_folder(fake("local[4]", None))


def test_scratch_removes_what_was_cut(spark):
    with frames.scratch(spark):
        inside = frames.cut(spark.range(5))
        assert inside.count() == 5
    outside = frames.cut(spark.range(3))
    with pytest.raises(Exception, match="(?i)exist|found"):
        inside.collect()
    assert outside.count() == 3


def test_numbered(spark):
    got = frames.numbered(spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v")), "n", "v").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.v)] == list(range(1, 3001))
    assert frames.numbered(spark.range(0), "n", "id").count() == 0


def test_eager_totals_equal_the_join(spark):
    rng = random.Random(1)
    left = [("hot" if rng.random() < 0.6 else rng.choice("abcde"), rng.randrange(9), rng.choice([None, 1, 2])) for _ in range(900)] + [(None, 5, 5)]
    right = [("hot" if rng.random() < 0.6 else rng.choice("cdefg"), rng.randrange(9)) for _ in range(300)] + [(None, 5)]
    l_df = spark.createDataFrame(left, "k string, x long, y long").withColumn("left_rows", F.lit(1))
    r_df = spark.createDataFrame(right, "k string, z long")
    got = {r.k: r for r in eager_join_totals(l_df, r_df, "k", {"sx": "x", "sy": "y"}, {"sz": "z"}).collect()}
    assert set(got) == set("abcdefg") | {"hot"}
    joined = [(a, b) for a in left for b in right if a[0] is not None and a[0] == b[0]]
    for k, r in got.items():
        own = [(a, b) for a, b in joined if a[0] == k]
        assert r.join_rows == len(own)
        assert r.join_sx == sum(a[1] for a, _ in own) and r.join_sz == sum(b[1] for _, b in own)
        assert r.sy == sum(a[2] or 0 for a in left if a[0] == k)
    assert eager_join_totals(l_df.limit(0), r_df.limit(0), "k", {"sx": "x"}, {}).count() == 0


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 25), ("b", 24), ("c", 951), ("d", 0)], "k string, n long")
    assert {r.k for r in heavy_keys(df, "k", "n", 25).collect()} == {"a", "c"}
    assert heavy_keys(df.where("n = 0"), "k", "n", 25).count() == 0
    assert heavy_keys(df.limit(0), "k", "n", 25).count() == 0


ITEMS = "run_no int, item_no long, word string, posting_count int, doc_ids array<long>, frequencies array<int>, p string"


def test_valid_items(spark):
    rows = [
        (0, 1, "a", 2, [1, 2], [1, 3], "x"),
        (0, 1, "a", 2, [1, 2], [1, 3], "x"),
        (1, 1, "a", 1, [1], [2], "x"),
        (0, 2, "", 1, [1], [1], "x"),
        (0, 3, None, 1, [1], [1], "x"),
        (0, 4, "b", None, [1], [1], "x"),
        (0, 5, "b", 2, [1], [1], "x"),
        (0, 6, "b", 1, None, [1], "x"),
        (0, 7, "b", 1, [1], None, "x"),
        (0, 8, "b", 1, [1], [None], "x"),
        (0, 9, "b", 1, [1], [0], "x"),
        (0, 10, "c", 0, [], [], "x"),
        (0, 11, "d", 1, [None], [4], "x"),
    ]
    df = spark.createDataFrame(rows, ITEMS)
    assert Counter(r.word for r in frames.valid_items(df).collect()) == {"a": 2, "c": 1, "d": 1}
    assert sorted(map(tuple, frames.item_postings(df).collect())) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 3)]
    assert frames.item_postings(df.limit(0)).count() == 0


def test_left_join_unique_keeps_all(spark):
    facts = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 3 > 0, F.col("id") % 5000).alias("k"), "id")
    dim = facts.where("k < 100").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = frames.join_unique(facts, dim, "k", "n", how="left")
    assert got.count() == 200_000 and got.where("n is not null").count() == facts.where("k < 100").count()


def test_join_unique_with_hot_keys(spark):
    facts = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
    dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = frames.join_unique(facts, dim, "k", "n")
    assert got.count() == 200_000 and got.where("k = 0").select("n").distinct().collect()[0][0] == 100_000


def test_bounded(spark):
    with pytest.raises(ValueError):
        frames.bounded(spark.range(11), 10, "rows")
    assert len(frames.bounded(spark.range(10), 10, "rows")) == 10


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\tone\nbad\n2\ttwo\n")
    out = [str(tmp_path / x) for x in ("pages", "rejects", "state")]
    ingest(line_stream(spark, str(tmp_path / "in")), *out).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("3\tthree\n")
    ingest(line_stream(spark, str(tmp_path / "in")), *out).awaitTermination()
    pages = spark.read.parquet(out[0])
    assert {(r.doc_id, r.content) for r in pages.collect()} == {(1, "one"), (2, "two"), (3, "three")}
    assert pages.select("row_seq").distinct().count() == 3
    assert [r.doc_id for r in pages.orderBy("row_seq").collect()] == [1, 2, 3]
    assert [r.reason for r in spark.read.parquet(out[1]).collect()] == ["columns"]
