"""Terms of documents (doc_id, content), and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.frames import spread
from corvidex.functions.text import tokens


def tokenize(docs: DataFrame) -> DataFrame:
    """(doc_id, term), a row for each occurrence."""
    return docs.select("doc_id", F.explode(tokens(F.col("content"))).alias("term"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_len): tokens of each document, 0 for one without any."""
    return docs.select("doc_id", F.size(tokens(F.col("content"))).cast("long").alias("doc_len"))


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, doc_len), for all terms or those given.

    All tokens of a document are in its row, so they are sorted and counted there: no shuffle. The length comes
    with them, so that postings need no join with lengths later. Documents have one row each (see page_table).
    """
    split = spread(docs.select("doc_id", "content")).select("doc_id", F.sort_array(tokens(F.col("content"))).alias("tokens"))
    # The empty list gets one token too many here, which no document has.
    size = F.size("tokens")
    first = F.filter(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda i: F.coalesce((i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)), F.lit(False)))
    runs = split.select("doc_id", "tokens", size.cast("long").alias("doc_len"), first.alias("first"))

    def run(start: Column, k: Column) -> Column:
        return F.struct(F.get("tokens", start).alias("term"), (F.coalesce(F.get("first", k + 1), size) - start).cast("long").alias("tf"))

    found = runs.select("doc_id", "doc_len", F.inline(F.transform("first", run))).where("term is not null")
    if terms is not None:
        found = found.where(F.col("term").isin(terms))
    return found.select("term", "doc_id", "tf", "doc_len")


def term_df(found: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_doc_len (truncated). Documents without tokens count; of no documents all are 0."""
    sums = doc_lengths(spread(docs)).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
    return sums.select("n_docs", "total_len", F.expr("coalesce(try_divide(total_len - total_len % n_docs, n_docs), 0)").cast("long").alias("avg_doc_len"))


def segment_postings(docs: DataFrame, segments: int = 8) -> DataFrame:
    """(segment, term, doc_id, tf): postings of each of `segments` equal ranges of doc_ids, as separate runs."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // segments))
    segment = F.floor((F.col("doc_id") - F.lit(low or 0)) / width).cast("long")
    return postings(docs).select(segment.alias("segment"), "term", "doc_id", "tf")


def merge_runs(runs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of several runs; a posting in more than one adds up."""
    return runs.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
