"""Encoding of texts by a byte-level BPE vocabulary: merges by recursive queries of DuckDB within each partition."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvidex.frames import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 2_000  # bytes; longer words are merged by a heap, as every round of a query holds the whole word
BATCH = 500_000  # bytes a query
MOST_KEPT = 200_000

# Rows (word, position, token) of the words that still change are joined with the merge table in each round.
# All pairs of a word's least rank are contracted at once, leftmost first where they overlap: of a run of hits
# the first, third and so on (`since` counts them, `before` those up to the row before). Merging them one by one
# gives the same, as a pair with the new token has a higher rank.
MERGE = """
with recursive state as (
    select 0 as round, word, pos, token from start
    union all
    select round + 1, word, pos, case when since % 2 = 1 then merged else token end
    from (
        select *,
            place - coalesce(max(case when not hit then place end) over (w rows between unbounded preceding and current row), 0) as since,
            place - 1 - coalesce(max(case when not hit then place end) over (w rows between unbounded preceding and 1 preceding), 0) as before
        from (
            select *, coalesce(rank = least, false) as hit
            from (
                select p.*, m.rank, m.token as merged, min(m.rank) over (partition by p.word) as least
                from (
                    select *, lead(token) over (partition by word order by pos) as following,
                        row_number() over (partition by word order by pos) as place
                    from state
                ) p left join merges m on m.a = p.token and m.b = p.following
            )
            where least is not null
        )
        window w as (partition by word order by pos)
    )
    where before % 2 = 0
)
select word, list(token order by pos) as ids
from (select *, max(round) over (partition by word) as last from state)
where round = last
group by word
"""


def read_merges(path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the 256 bytes, rows (a, b, rank, token) of the merge table) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    others = (b for b in range(256) if b not in set(plain))
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    table = np.array([(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)], np.int32)
    return np.array([vocab[letter[b]] for b in range(256)], np.int32), table


class Encoder:
    """Words to ids; keeps words it has met, up to MOST_KEPT of them."""

    def __init__(self, merges: tuple[np.ndarray, np.ndarray]) -> None:
        import duckdb
        import regex

        self.split = regex.compile(PATTERN).findall
        self.bytes, self.table = merges
        self.kept: dict[str, list[int]] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._load("merges", dict(zip(("a", "b", "rank", "token"), self.table.T, strict=True)))
        self.ranks: dict[tuple[int, int], tuple[int, int]] | None = None

    def _load(self, name: str, columns: dict[str, np.ndarray]) -> None:
        self.db.register("arrived", pa.table({k: pa.array(np.ascontiguousarray(v)) for k, v in columns.items()}))
        self.db.execute(f"create or replace table {name} as select * from arrived")
        self.db.unregister("arrived")

    def learn(self, words: list[str]) -> None:
        """Merge words that are not known yet, up to BATCH bytes a query."""
        waiting, size = [], 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                self.kept[word] = self.by_heap(raw)
                continue
            waiting.append((word, raw))
            size += len(raw)
            if size >= BATCH:
                self._merge(waiting)
                waiting, size = [], 0
        self._merge(waiting)

    def _merge(self, words: list[tuple[str, bytes]]) -> None:
        """One query; words that are too many for its memory are merged in halves, as nothing goes to a disk."""
        import duckdb

        if not words:
            return
        sizes = np.array([len(raw) for _, raw in words])
        tokens = self.bytes[np.frombuffer(b"".join(raw for _, raw in words), np.uint8)]
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        try:
            self._load("start", {"word": np.repeat(np.arange(len(words)), sizes), "pos": pos, "token": tokens})
            found = self.db.execute(MERGE).fetchall()
        except duckdb.OutOfMemoryException:
            if len(words) == 1:
                raise
            self._merge(words[: len(words) // 2])
            self._merge(words[len(words) // 2 :])
            return
        for i, ids in found:
            self.kept[words[i][0]] = ids

    def by_heap(self, word: bytes) -> list[int]:
        """One long word: the least rank first, leftmost among equals, over linked positions."""
        if self.ranks is None:
            self.ranks = {(a, b): (rank, token) for a, b, rank, token in self.table.tolist()}
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.ranks.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, token, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = token, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (m := self.ranks.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (*m, left, ids[left], ids[after[left]]))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> list[list[list[int]]]:
        """Of each text, the ids of each word; none for a null or empty text."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        self.learn([w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.kept])
        return [[self.kept[w] for w in text] for text in words]


def _mapper(merges: object, counts: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                coded = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
                sizes = np.fromiter((sum(map(len, text)) for text in coded), np.int64, len(coded))
                if counts:
                    last = pa.array(sizes)
                else:
                    flat = np.fromiter(chain.from_iterable(chain.from_iterable(coded)), np.int32, int(sizes.sum()))
                    last = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
                yield pa.record_batch([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], "n_tokens" if counts else "ids"])

    return run


def _encoded(docs: DataFrame, text: str, keep: list[str], path: str, counts: bool) -> DataFrame:
    merges = docs.sparkSession.sparkContext.broadcast(read_merges(path))
    chosen = spread(docs.select(*keep, text))
    kinds = dict(chosen.dtypes)
    result = "n_tokens long" if counts else "ids array<int>"
    return chosen.mapInArrow(_mapper(merges, counts), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), result]))


def encode_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = TOKENIZER) -> DataFrame:
    """keep and ids, the token ids of the text without special tokens; an empty list for null and empty texts.

    Strings of special tokens are ordinary text. The vocabulary file is read by the driver and broadcast.
    """
    return _encoded(docs, text, list(keep), path, False)


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = TOKENIZER) -> DataFrame:
    """keep and n_tokens, the length of encode_texts' ids."""
    return _encoded(docs, text, list(keep), path, True)
