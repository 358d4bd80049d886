"""Large batches of `or` queries: every query against one block of documents after another, in Python.

Scores add up in an array of a block's documents, so only the k best of each query and block leave a task: neither
(query, document) pairs nor parts of their scores are shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions.scoring import STEP

QUERY = (1 << 31) - 1  # takes the place of a list's number in rows that are queries, so that these come last
MARGIN = 2e-6  # scores are compared to 6 decimals


def best_in_blocks(lists: DataFrame, queries: DataFrame, n_blocks: int, k: int, lead: int) -> DataFrame:
    """(query, doc_id, score): the k best documents of each query and block, by score to 6 decimals, then doc_id.

    lists are (no int, doc_id long, q), queries (query long, terms array<int> of numbers of lists). Lists are shuffled
    once, by document; queries are repeated for each block and read in batches. The first `lead` documents of
    a block set the bar that its others have to reach.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks).cast("long")).cast("int")
    # Empty and not null: Arrow's writer goes through all rows of a batch before each null list.
    none = F.array().cast("array<int>").alias("terms")
    found = lists.select(block.alias("block"), "no", F.col("doc_id").alias("id"), F.col("q").cast("int").alias("q"), none)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(QUERY).alias("no"), F.col("query").alias("id"), F.lit(0).alias("q"), "terms")
    rows = found.unionByName(asked).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("no").drop("block")
    return rows.mapInArrow(_searcher(k, lead), "query long, doc_id long, score double")


def _searcher(k: int, lead: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block = [], None
        for batch in batches:
            n = int(np.searchsorted(batch.column("no").to_numpy(), QUERY))
            if n:
                parts.append([batch.column(c).slice(0, n).to_numpy() for c in ("no", "id", "q")])
            if n < batch.num_rows and parts:
                block = block or Block(*map(np.concatenate, zip(*parts, strict=True)))
                yield block.search(batch.slice(n), k, lead)

    return run


class Block:
    """The lists of a block of documents, by number: no, doc_id and q of each posting in the order of no."""

    def __init__(self, no: np.ndarray, ids: np.ndarray, q: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(no, prepend=-1))
        self.numbers, self.starts, self.ends = no[first], first, np.append(first[1:], len(no))
        self.docs, self.at = np.unique(ids, return_inverse=True)
        self.scores = np.where(q == 0, 0.0, 2.0 ** (q / STEP) - 1)
        self.counts = np.maximum.reduceat(q, first) > 0  # else no posting of the list adds anything

    def search(self, queries: pa.RecordBatch, k: int, lead: int) -> pa.RecordBatch:
        terms = queries.column("terms")
        flat, sizes = terms.flatten().to_numpy(), pc.list_value_length(terms).to_numpy()
        place = np.minimum(np.searchsorted(self.numbers, flat), len(self.numbers) - 1)
        here, ends = self.numbers[place] == flat, np.cumsum(sizes)
        tops = [self.top(place[a:b][here[a:b]], k, lead) for a, b in zip(ends - sizes, ends, strict=True)]
        query = np.repeat(queries.column("id").to_numpy(), [len(docs) for docs, _ in tops])
        return pa.record_batch([pa.array(query), *(pa.array(np.concatenate(x)) for x in zip(*tops, strict=True))], names=["query", "doc_id", "score"])

    def top(self, lists: np.ndarray, k: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best documents that are in any of these lists."""
        adding = lists[self.counts[lists]]
        total = np.bincount(self._of(self.at, adding), self._of(self.scores, adding), len(self.docs))
        bar = _kth(total[:lead], k) - MARGIN
        found = np.flatnonzero(total >= bar if bar > 0 else total)
        if len(found) < k:  # documents that count 0 match, too
            found = np.flatnonzero(np.bincount(self._of(self.at, lists), minlength=len(self.docs)))
        elif len(found) > 4 * k:
            found = found[total[found] >= _kth(total[found], k) - MARGIN]
        score = _rounded(total[found])
        best = np.lexsort((found, -score))[:k]
        return self.docs[found[best]], score[best]

    def _of(self, values: np.ndarray, lists: np.ndarray) -> np.ndarray:
        spans = zip(self.starts[lists].tolist(), self.ends[lists].tolist(), strict=True)
        return np.concatenate([values[:0], *(values[a:b] for a, b in spans)])


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest, 0 of fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To 6 decimals, halves up, as round in SQL."""
    scaled = scores * 1e6
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 1e6
