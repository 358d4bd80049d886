"""Helpers shared by the operators: table access, current rows, lineage cuts, skew-safe joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(pages: DataFrame, *columns: str, key: str = "doc_id", order: str = "row_seq") -> DataFrame:
    """The row of each key with the greatest order; rows without a key are dropped.

    Spark limits each map partition to one row a key before the shuffle, so a key that was loaded
    millions of times does not reach one task.
    """
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return (
        pages.select(key, order, *columns)
        .where(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(last))
        .where("_rank = 1")
        .select(key, *columns)
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local master gets one of its own where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_left: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators cut inside is removed at the end, so results have to be written or collected inside, too."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            remove(spark, path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    _left.append((spark, path))


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there: lineage ends, sizes are known, nothing runs twice.

    The table is removed at the end of the enclosing `scratch`, else when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    paths = _scope.get()
    if paths is None:
        keep_until_exit(spark, path)
    else:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_left() -> None:
    for spark, path in _left:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: its folder is the cluster's to clear
            return


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is a plain scan of fewer partitions than these; else as it is.

    For work that is heavy by row: one large row group would keep it in one task.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Adaptive" in plan.getClass().getSimpleName() or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Collect at most `most` rows; a larger result is an error, not a truncated one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def is_small(df: DataFrame, most_mb: int = 8) -> bool:
    """Whether the rows of df, a written table, take at most most_mb."""
    widths = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16) for c, kind in df.dtypes]
    return (df.agg(F.sum(sum(widths[1:], widths[0]).cast("long"))).first()[0] or 0) <= most_mb * 1_000_000


def broadcast_if_small(df: DataFrame, most_mb: int = 8) -> DataFrame:
    """df, written once and measured, with a broadcast hint if its rows take at most most_mb; else unhinted for a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if is_small(df, most_mb) else df


def join_unique(facts: DataFrame, dim: DataFrame, key: str, weight: str, share: float = 1 / 500, how: str = "inner") -> DataFrame:
    """Inner or left join of facts with a dim that is unique by key, without one task per hot key.

    weight is a column of dim: the number of facts of the key. Keys with at least `share` of all facts
    are at most 1/share many, so those rows of dim are broadcast; the rest is a shuffled join in which no
    key holds more than `share` of the facts.
    """
    dim = cut(dim)
    total = dim.agg(F.sum(weight)).first()[0] or 0
    least = max(1.0, total * share)
    hot = [r[0] for r in bounded(dim.where(F.col(weight) >= least).select(key), int(1 / share), "hot keys")] if total > 100_000 else []
    if not hot:
        return facts.join(dim, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return facts.where(is_hot).join(F.broadcast(dim.where(is_hot)), key).unionByName(facts.where(~is_hot).join(dim.where(~is_hot), key, how))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the number of each row by order (unique), from 1; the driver gets one number a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id is made of the partition and, in its lower 33 bits, the place in the sorted partition.
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 1
    for at, count in sorted(ranged.groupBy(part).count().collect()):
        starts.append((at, total))
        total += count
    start = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return ranged.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start", "_id")


def positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `position`, the place of each row within its key by order, from 0; (key, order) is unique.

    No key is gathered in one task: rows are range-partitioned by (key, order) and numbered in their
    partition, and keys that cross partitions get the counts of the partitions before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).where("_before > 0").select(key, "_part", "_before")
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1
    numbered = ranged.withColumn("_local", local).join(broadcast_if_small(before), [key, "_part"], "left")
    return numbered.withColumn("position", (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_local", "_before")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to this one by order (unique); the driver gets one number a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    sums = dict(ranged.groupBy("_part").agg(F.sum(value)).collect())
    starts, total = [], 0
    for part in sorted(sums):
        starts.append((part, total))
        total += sums[part]
    start = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_sum", local).join(F.broadcast(start), "_part").withColumn(name, F.col("_sum") + F.col("_start")).drop("_part", "_sum", "_start")


def valid_items(items: DataFrame, *columns: Column) -> DataFrame:
    """Valid items without copies: the given columns, or (word, posting_count, doc_ids, frequencies).

    Valid: word neither null nor empty, both arrays there and as long as posting_count, every
    frequency non-null and >= 1. Of several valid items with the same (run_no, item_no), nulls being alike, one stays.
    Columns are computed before copies are dropped, so that arrays no one needs are not shuffled.
    """
    chosen = columns or tuple(F.col(c) for c in ("word", "posting_count", "doc_ids", "frequencies"))
    return items.where(valid_item()).select(*chosen, F.struct("run_no", "item_no").alias("_item")).dropDuplicates(["_item"]).drop("_item")


def valid_item() -> Column:
    return (
        (F.col("word") != "")
        & (F.size("doc_ids") == F.col("posting_count"))
        & (F.size("frequencies") == F.col("posting_count"))
        & F.col("doc_ids").isNotNull()
        & F.col("frequencies").isNotNull()
        & F.forall("frequencies", lambda f: F.coalesce(f >= 1, F.lit(False)))
    )


def item_postings(items: DataFrame) -> DataFrame:
    """(word, doc_id, frequency) of valid items; postings without a doc_id belong to no record and are dropped."""
    return (
        valid_items(items)
        .select("word", F.explode(F.arrays_zip("doc_ids", "frequencies")).alias("p"))
        .select("word", F.col("p.doc_ids").alias("doc_id"), F.col("p.frequencies").cast("long").alias("frequency"))
        .where("doc_id is not null")
    )


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """(word, doc_id, frequency) of valid nodes, one per node_id."""
    return (
        nodes.where("word <> '' and doc_id is not null and frequency >= 1")
        .select("node_id", "word", "doc_id", F.col("frequency").cast("long").alias("frequency"))
        .dropDuplicates(["node_id"])
        .drop("node_id")
    )
