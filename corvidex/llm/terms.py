"""Term statistics of the whole collection: how often each term occurs, and how characteristic it is of a record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.frames import cut, join_unique


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal terms in sorted (word, doc_id, frequency) rows: one row a run and batch.

    Sums of a term, and of a record at a batch's edge, are carried in `fresh`: a record that goes on from
    the batch before isn't counted again.
    """
    last: tuple | None = None
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        word, doc, freq = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        new_word = np.ones(n, bool)
        new_word[1:] = pc.not_equal(word.slice(1), word.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_doc = new_word.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        if last is not None and last == (word[0].as_py(), doc[0]):
            new_doc[0] = False
        at = np.flatnonzero(new_word)
        yield pa.record_batch(
            [word.take(pa.array(at)), pa.array(np.add.reduceat(freq, at).astype("int64")), pa.array(np.add.reduceat(new_doc.astype("int64"), at))],
            names=["word", "occurrences", "records"],
        )
        last = (word[n - 1].as_py(), doc[n - 1])


def term_counts(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """(word, occurrences, records) of postings (word, doc_id, frequency): total frequency and number of distinct records.

    An external sort: pairs are range-partitioned by (word, doc_id), so that a hot word spreads over many
    partitions while equal pairs stay together, sorted there (spilling as needed), and scanned for runs. The
    few words that cross partitions are added up at the end. Rows with a null or empty word or a null doc_id
    do not count; a null frequency counts 0.
    """
    rows = postings.where("word <> '' and doc_id is not null").select("word", "doc_id", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))
    n = partitions or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(n, "word", "doc_id").sortWithinPartitions("word", "doc_id").mapInArrow(_scan, "word string, occurrences long, records long")
    return runs.groupBy("word").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(postings: DataFrame, rare_below: int = 3, common_share: float = 0.5, partitions: int | None = None) -> DataFrame:
    """term_counts with a mark: `rare` below rare_below records, `common` from common_share of all records on, else null.

    In a collection so small that a word is both, `rare` wins.
    """
    records = postings.where("word <> '' and doc_id is not null").select("doc_id").distinct().agg(F.count("doc_id"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= records.scalar() * common_share, "common")
    return term_counts(postings, partitions).withColumn("mark", mark)


def distinctive_terms(postings: DataFrame) -> DataFrame:
    """(doc_id, word, tf, records, weight, doc_len, n_records, total_len) for every word of every record, by log-entropy weighting.

    Two aggregations: tf of each (doc_id, word), then of each word its records and the entropy of its spread,
    H = ln(g) - sum(tf * ln(tf)) / g with g its total frequency. weight = ln(1 + tf) * (1 - H / ln(N)), N being
    the number of records: 0 for a word spread evenly over all, the more the fewer records share it. With
    N = 1 the second factor is 1. Postings without word or doc_id do not count.
    """
    pairs = postings.where("word <> '' and doc_id is not null").groupBy("doc_id", "word").agg(F.sum("frequency").alias("tf"))
    pairs = cut(pairs)
    spread = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("records"), F.sum("tf").alias("total"), F.sum(F.col("tf") * F.ln("tf")).alias("tf_ln_tf")
    )
    lengths = pairs.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
    n, total = lengths.agg(F.count("doc_id"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    entropy = F.greatest(F.lit(0.0), F.ln("total") - F.col("tf_ln_tf") / F.col("total"))
    spread = spread.select("word", "records", (F.greatest(F.lit(0.0), 1 - entropy / float(np.log(n))) if n > 1 else F.lit(1.0)).alias("focus"))
    scored = join_unique(pairs, spread, "word", "records").join(lengths, "doc_id")
    return scored.select("doc_id", "word", "tf", "records", (F.log1p("tf") * F.col("focus")).alias("weight"), "doc_len", F.lit(n).alias("n_records"), F.lit(total).alias("total_len"))


def top_terms(terms: DataFrame, ratio: float = 1.5) -> DataFrame:
    """(doc_id, word): words whose BM25 score leads their record's second by `ratio`, out of rows of distinctive_terms.

    The log-entropy weight ranks by spread of frequency, BM25 by spread of records and length, so the lead
    can't be read off the weight: every row of the operator is scored, and equal scores are ordered by weight.
    A word of one record doesn't compete, nor has a record with one competing word a case.
    """
    n, avg = F.col("n_records"), F.floor(F.col("total_len") / F.greatest(F.col("n_records"), F.lit(1)))
    idf = F.ln((n - F.col("records") + 0.5) / (F.col("records") + 0.5))
    score = idf * 2.2 * F.col("tf") / (1.2 * (0.25 + 0.75 * F.col("doc_len") / F.greatest(avg, F.lit(1))) + F.col("tf"))
    scored = terms.where("records >= 2").select("doc_id", "word", "weight", F.greatest(F.lit(0.0), score).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("weight"), "word")
    two = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    ends = two.groupBy("doc_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("word"))).alias("word"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )
    return ends.where((F.col("first") > 0) & (F.col("first") >= ratio * F.col("second"))).select("doc_id", "word")
