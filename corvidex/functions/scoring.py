"""BM25 impact scores, their one-byte form, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75
STEP = 36.06  # bytes per doubling of 1 + score


def bm25(n_docs: Column, df: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """The impact of a posting; negative for terms in more than half of the documents. avg_len 0 counts as 1."""
    idf = F.ln((n_docs - df + 0.5) / (df + 0.5))
    length = doc_len / F.greatest(avg_len, F.lit(1)).cast("double")
    return idf * ((K1 + 1) * tf) / (K1 * ((1 - B) + B * length) + tf)


def quantize(score: Column) -> Column:
    """0 for scores that are not positive, else floor(log2(1 + score) * STEP)."""
    return F.when(score <= 0, 0).otherwise(F.floor(F.log2(score + 1) * STEP)).cast("int")


def dequantize(q: Column) -> Column:
    return F.when(q == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), q / STEP) - 1)
