"""The inverted index: scored postings, their layout in chunks, blocks and files, and the lexicon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.frames import bounded, cut, numbered, running_sum, scratch
from corvidex.functions.codec import vbyte_length
from corvidex.functions.scoring import bm25, dequantize, quantize
from corvidex.operators.corpus import corpus_stats, doc_lengths, postings, term_df

CHUNK = 128
BLOCK = 64
FILE_BLOCKS = 24_000
HOT = 500
PARTS = 64
ROW_GROUP = 16 << 20  # bytes; a search reads the row groups of its terms


def arranged(found: DataFrame, least: int = 100_000) -> DataFrame:
    """Postings (term, doc_id, ...), unique, with df, position (by doc_id in the term, from 0) and before (the doc_id before it).

    One shuffle by term. A term with at least `least` and 1/HOT of all postings is cut into PARTS ranges of doc_ids;
    what lies before each range is a table of at most HOT * PARTS rows, which is broadcast.
    """
    sizes = cut(term_df(found))
    total = sizes.agg(F.sum("df")).first()[0] or 0
    hot = {r.term: r.df for r in bounded(sizes.where(F.col("df") >= max(least, total / HOT)), max(HOT, total // least), "hot terms")}
    part = F.lit(0)
    if hot:
        large = found.where(F.col("term").isin(list(hot)))
        edges = [int(x) for x in large.approxQuantile("doc_id", [i / PARTS for i in range(1, PARTS)], 0.001)]
        part = F.when(F.col("term").isin(list(hot)), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("doc_id")))).otherwise(0)
    rows = found.withColumn("_part", part)
    whole = Window.partitionBy("term", "_part")
    order = whole.orderBy("doc_id")
    rows = rows.select("*", F.count(F.lit(1)).over(whole).alias("_n"), (F.row_number().over(order) - 1).alias("_at"), F.lag("doc_id").over(order).alias("_lag"))
    if hot:
        ends = large.withColumn("_part", part).groupBy("term", "_part").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        parts = Window.partitionBy("term").orderBy("_part")
        ahead = ends.select("term", "_part", (F.sum("n").over(parts) - F.col("n")).alias("_ahead"), F.lag("last").over(parts).alias("_last"), F.sum("n").over(Window.partitionBy("term")).alias("_df"))
        rows = rows.join(F.broadcast(ahead), ["term", "_part"], "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("_ahead", "_last", "_df")])
    return rows.select(
        *found.columns,
        F.coalesce("_df", "_n").alias("df"),
        (F.col("_at") + F.coalesce("_ahead", F.lit(0))).cast("long").alias("position"),
        F.coalesce("_lag", "_last").alias("before"),
    )


def impacts(docs: DataFrame, terms: list[str] | None = None, shifted: bool = False) -> DataFrame:
    """(term, doc_id, tf, df, score, q, position, before) of the postings of all terms or those given.

    shifted pairs a posting with the length of doc_id - 1 (0 if there is no such document), as indexes of an
    older build do.
    """
    found = cut(postings(docs, terms))
    if terms is None:
        n_docs, total = docs.count(), found.agg(F.sum("tf")).first()[0] or 0
        avg_len = total // max(n_docs, 1)
    else:
        n_docs, _, avg_len = corpus_stats(docs).first()
    if shifted:
        before = doc_lengths(docs).select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_len").alias("own"))
        found = found.join(before, "doc_id", "left").select("term", "doc_id", "tf", F.coalesce("own", F.lit(0)).alias("doc_len"))
    scored = arranged(found).withColumn("score", bm25(F.lit(n_docs), F.col("df"), F.col("tf"), F.col("doc_len"), F.lit(avg_len)))
    return scored.select("term", "doc_id", "tf", "df", "score", quantize(F.col("score")).alias("q"), "position", "before")


def placed(index: DataFrame) -> DataFrame:
    """Postings with chunk_in_term (from 0), place (in the chunk), gap (doc_id less that before it in the chunk) and vbyte_len."""
    at = index.select("*", F.expr(f"position div {CHUNK}").alias("chunk_in_term"), (F.col("position") % CHUNK).alias("place"))
    gap = F.col("doc_id") - F.when(F.col("place") > 0, F.col("before")).otherwise(0)
    return at.withColumn("gap", gap).withColumn("vbyte_len", vbyte_length(F.col("gap"))).drop("position", "before")


def undo_gaps(gaps: DataFrame) -> DataFrame:
    """(term, doc_id) from (term, chunk_in_term, place, gap)."""
    chunk = Window.partitionBy("term", "chunk_in_term").orderBy("place")
    return gaps.select("term", F.sum("gap").over(chunk).alias("doc_id"))


def decoded(index: DataFrame, sticky_zero: bool = False) -> DataFrame:
    """(term, doc_id, score): scores as read back from bytes.

    sticky_zero reads every posting of a chunk from its first zero byte on as 0, as readers of an older build do.
    """
    if not sticky_zero:
        return index.select("term", "doc_id", dequantize(F.col("q")).alias("score"))
    chunk = Window.partitionBy("term", "chunk_in_term").orderBy("place")
    zero = F.max((F.col("q") == 0).cast("int")).over(chunk) == 1
    return placed(index).select("term", "doc_id", F.when(zero, F.lit(0.0)).otherwise(dequantize(F.col("q"))).alias("score"))


def lexicon(terms: DataFrame) -> DataFrame:
    """Terms (term, df, ...) with start_chunk and end_chunk: chunks are numbered from 1 over all terms in byte order; each term starts a new one."""
    ends = running_sum(terms.withColumn("n_chunks", F.ceil(F.col("df") / CHUNK)), "term", "n_chunks", "end_chunk")
    return ends.select(*terms.columns, (F.col("end_chunk") - F.col("n_chunks") + 1).alias("start_chunk"), "end_chunk")


def chunk_directory(index: DataFrame) -> DataFrame:
    """(chunk_no, term, n_postings, last_doc_id, n_bytes): a byte for each score and the gaps in variable bytes."""
    chunks = placed(index).groupBy("term", "chunk_in_term").agg(
        F.count(F.lit(1)).alias("n_postings"), F.max("doc_id").alias("last_doc_id"), F.sum(F.col("vbyte_len") + 1).alias("n_bytes")
    )
    return numbered(chunks, "chunk_no", "term", "chunk_in_term").select("chunk_no", "term", "n_postings", "last_doc_id", "n_bytes")


def file_starts(chunks: DataFrame, file_blocks: int = FILE_BLOCKS) -> list[int]:
    """The first chunk_no of each index file. A file ends with the first term that fills its last block; one small job a file."""
    ends = cut(chunks.groupBy("term").agg(F.max("chunk_no").alias("end")).select("end"))
    total = ends.agg(F.max("end")).first()[0] or 0
    starts = [1]
    while (end := ends.where(F.col("end") >= starts[-1] + BLOCK * (file_blocks - 1)).agg(F.min("end")).first()[0]) is not None and end < total:
        starts.append(end + 1)
    return starts


def block_directory(chunks: DataFrame, file_blocks: int = FILE_BLOCKS) -> DataFrame:
    """(file_no, block_no, n_chunks, payload_bytes): blocks of 64 chunks, numbered from 0 in each file. A file's first term starts a fresh block."""
    starts = F.array(*map(F.lit, file_starts(chunks, file_blocks)))
    file_no = (F.size(F.filter(starts, lambda s: s <= F.col("chunk_no"))) - 1).cast("long")
    at = chunks.select("chunk_no", "n_bytes", file_no.alias("file_no")).withColumn("block_no", F.floor((F.col("chunk_no") - F.get(starts, F.col("file_no").cast("int"))) / BLOCK))
    return at.groupBy("file_no", "block_no").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_bytes").alias("payload_bytes"))


def list_places(lexicon: DataFrame, starts: list[int], terms: list[str]) -> DataFrame:
    """(term, file_no, first_block, last_block): where the list of each term lies; terms that are not there give no row."""
    firsts = F.array(*map(F.lit, starts))
    at = lexicon.where(F.col("term").isin(terms)).withColumn("file_no", (F.size(F.filter(firsts, lambda s: s <= F.col("start_chunk"))) - 1).cast("long"))
    begin = F.get(firsts, F.col("file_no").cast("int"))
    return at.select("term", "file_no", F.floor((F.col("start_chunk") - begin) / BLOCK).alias("first_block"), F.floor((F.col("end_chunk") - begin) / BLOCK).alias("last_block"))


def index_stats(index: DataFrame) -> DataFrame:
    """One row: n_terms, n_postings, n_chunks, n_blocks, payload_bytes."""
    c = cut(chunk_directory(index))
    return c.agg(
        F.count_distinct("term").alias("n_terms"),
        F.coalesce(F.sum("n_postings"), F.lit(0)).alias("n_postings"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.lit(block_directory(c).count()).alias("n_blocks"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("payload_bytes"),
    )


@dataclass(frozen=True)
class Index:
    """A written index: postings (term, doc_id, q) and lexicon (term, df, max_q, start_chunk, end_chunk) in the order of terms, and pages."""

    postings: DataFrame
    lexicon: DataFrame
    pages: DataFrame


def write_index(docs: DataFrame, path: str) -> None:
    """Write postings, lexicon and pages below path. Postings are range-partitioned and sorted by (term, doc_id), so that
    a term's rows lie together (a frequent one over several files) and readers skip row groups by their statistics."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch(docs.sparkSession):
        scored = cut(impacts(docs).select("term", "doc_id", "q"))
        ranged = scored.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id")
        ranged.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
        terms = scored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("q").alias("max_q"))
        lexicon(terms).repartitionByRange(n, "term").sortWithinPartitions("term").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/lexicon")
        docs.select("doc_id", "content").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/pages")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lexicon", "pages")))
