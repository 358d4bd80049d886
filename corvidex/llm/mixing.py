"""Mixing of sources to target shares of tokens, by a splitting tree of hypergeometric draws over blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.frames import bounded, cut, positions

SUB_BLOCKS = 1_024
ROWS_A_ROUND = 10_000  # rows of a source the driver gets at once
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """drawn: doc_id, source, repeat, shard. report: one row a target source, with the shares reached."""

    drawn: DataFrame
    report: DataFrame
    seed: int

    @property
    def rows(self) -> DataFrame:
        """drawn with `place`, from 1: each shard in random order, however large it is."""
        order = F.struct(F.xxhash64(F.lit(self.seed + 2), "doc_id", "repeat").alias("h"), "doc_id", "repeat").alias("order")
        return positions(self.drawn.select("*", order), "shard", "order").select("doc_id", "source", "repeat", "shard", (F.col("position") + 1).alias("place"))


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[s] blocks of each source, split over shards: every node draws its left half's blocks without replacement."""
    if shards == 1:
        return quotas[None]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def mix_sources(sized: DataFrame, targets: DataFrame, shards: int = 16, blocks: int = 4_096, seed: int = 1) -> Mix:
    """Combine rows (doc_id, source, n_tokens) so that each source has target_share of T, the tokens of all target sources.

    No row is used more than max_repeats times; a source too small for that gives all it has, and its row of the
    report is marked short. Rows are hashed into blocks, about `blocks` of them over all sources, whose sums are
    all that the driver sees. A source is passed over as often as its quota holds it whole (a number a block and shard,
    expanded by the executors), then blocks are drawn
    in random order, without those that exceed what is open. These are split into SUB_BLOCKS and at last into rows,
    until what is open is less than the least row that is left. Drawn blocks are dealt to the shards by split_tree, and each shard is shuffled on its own.

    Rows of other or null sources are left out, those without tokens are drawn like others. Of targets, rows with
    a null source, share or repeats are left out; a repeated source is an error. A source without rows has 0 tokens.
    """
    wanted = bounded(targets.where("source is not null and target_share is not null and max_repeats is not null").select("source", "target_share", "max_repeats"), MOST_SOURCES, "target sources")
    names = [r["source"] for r in wanted]
    if len(set(names)) < len(names):
        raise ValueError("a source has several targets")
    spark, number = sized.sparkSession, {s: i for i, s in enumerate(names)}
    schema = "source string, target_share double, max_repeats int, n_rows long, n_tokens long, wanted_tokens double, drawn_tokens long, actual_share double, short boolean"
    of = spark.createDataFrame(list(number.items()), "source string, s int")
    rows = cut(sized.select(F.col("doc_id"), "source", F.col("n_tokens").cast("long").alias("n_tokens")).join(F.broadcast(of), "source"))
    sums = {r["s"]: r for r in rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    n_rows, tokens = (np.array([sums[i][c] if i in sums else 0 for i in range(len(names))], np.int64) for c in ("n", "tokens"))
    total = int(tokens.sum())
    want = np.array([r["target_share"] for r in wanted]) * total
    most = tokens * np.array([r["max_repeats"] for r in wanted], np.int64)
    short = most < want
    amount = np.minimum(want, most)

    rng = np.random.default_rng(seed)
    per_source = np.maximum(1, np.minimum(np.maximum(blocks * tokens // max(total, 1), 16), n_rows))
    size_of = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(per_source)], "s int, n_blocks int"))
    spread = rows.join(size_of, "s").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks").cast("long")).cast("int")).withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(SUB_BLOCKS)).cast("int"))
    block_sums: list[dict[int, int]] = [{} for _ in names]
    for r in spread.groupBy("s", "block").agg(F.sum("n_tokens").alias("tokens")).collect():
        block_sums[r["s"]][r["block"]] = r["tokens"]

    draws: list[list[int]] = []  # of each source, the blocks drawn once more than it is passed over whole
    full = [int(amount[s] // tokens[s]) if tokens[s] else 0 for s in range(len(names))]
    left = [int(amount[s]) - full[s] * int(tokens[s]) for s in range(len(names))]
    over: dict[int, list[int]] = {}  # of each source, the blocks that did not fit, in random order
    for s in range(len(names)):
        mine: list[int] = []
        if left[s] > 0:
            for b in rng.permutation(sorted(block_sums[s])).tolist():
                if block_sums[s][b] > left[s]:
                    over.setdefault(s, []).append(b)
                else:
                    mine.append(b)
                    left[s] -= block_sums[s][b]
        draws.append(mine)

    # What is open then comes from sub-blocks of those blocks, twice as many blocks each time, and at last from rows.
    parts: dict[tuple[int, int], list[int]] = {}  # (source, block): its sub-blocks that are drawn
    tried, size, active = {s: 0 for s in over}, 1, {s for s in over if left[s] > 0}
    while active:
        at = [(s, b) for s in sorted(active) for b in over[s][tried[s] : tried[s] + size]]
        subs: dict[int, dict[tuple[int, int], int]] = {}
        sums_of = spread.join(F.broadcast(spark.createDataFrame(at, "s int, block int")), ["s", "block"]).groupBy("s", "block", "sub").agg(F.sum("n_tokens").alias("tokens"))
        most_open = F.broadcast(spark.createDataFrame([(s, left[s]) for s in sorted(active)], "s int, open long"))
        for r in sums_of.join(most_open, "s").where("tokens <= open").collect():
            subs.setdefault(r["s"], {})[r["block"], r["sub"]] = r["tokens"]
        for s in sorted(active):
            used = False
            fits = sorted(subs.get(s, {}))
            for i in rng.permutation(len(fits)).tolist():
                if subs[s][fits[i]] <= left[s]:
                    block, sub = fits[i]
                    parts.setdefault((s, block), []).append(sub)
                    left[s] -= subs[s][fits[i]]
                    used = True
            tried[s] += size
            if left[s] <= 0 or not used or tried[s] >= len(over[s]):
                active.discard(s)
        size *= 2

    single: dict[tuple[int, int], list] = {}  # (source, block): its rows that are drawn by themselves
    key = spread.schema["doc_id"].dataType.simpleString()
    active = {s for s in over if left[s] > 0}
    chosen = spread.select("s", "block", "sub", "doc_id", "n_tokens").where("n_tokens > 0 and doc_id is not null") if active else None
    while active:
        free = [(s, b, left[s], parts.get((s, b), []), single.get((s, b), [])) for s in sorted(active) for b in over[s]]
        opened = F.broadcast(spark.createDataFrame(free, f"s int, block int, open long, subs array<int>, docs array<{key}>"))
        rest = chosen.join(opened, ["s", "block"]).where("not array_contains(subs, sub) and not array_contains(docs, doc_id)")
        rest = rest.groupBy("s", "block", "doc_id", "open").agg(F.sum("n_tokens").alias("tokens")).where("tokens <= open")
        first = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id")
        some: dict[int, list] = {}
        for r in rest.withColumn("place", F.row_number().over(first)).where(F.col("place") <= ROWS_A_ROUND).orderBy("s", "place").collect():
            some.setdefault(r["s"], []).append(r)
        for s in sorted(active):
            for r in some.get(s, []):
                if r["tokens"] <= left[s]:
                    single.setdefault((s, r["block"]), []).append(r["doc_id"])
                    left[s] -= r["tokens"]
            if left[s] <= 0 or len(some.get(s, [])) == 0:
                active.discard(s)
    for s, block in sorted(parts.keys() | single.keys()):
        draws[s].append(block)
    drawn = np.array([int(amount[s]) - left[s] for s in range(len(names))], np.int64)

    # Of whole passes, as many as go evenly are the same for all shards; what is over is dealt by the tree.
    quotas = np.array([full[s] % shards * len(block_sums[s]) + len(draws[s]) for s in range(len(names))], np.int64)
    tree = split_tree(quotas, shards, rng) if len(names) else np.zeros((shards, 0), int)
    dealt = []  # source, block, shard, first repeat, repeats, and of a part of a block its sub-blocks and rows
    for s, mine in enumerate(draws):
        taken = rng.multivariate_hypergeometric(tree[:, s], len(mine), method="marginals")
        for i, shard in zip(rng.permutation(len(mine)).tolist(), np.repeat(np.arange(shards), taken).tolist(), strict=True):
            block = mine[i]
            split = (s, block) in parts or (s, block) in single
            dealt.append((s, block, shard, full[s], 1, parts.get((s, block), []) if split else None, single.get((s, block), []) if split else None))
        quota = tree[:, s] - taken
        for block in sorted(block_sums[s]) if full[s] else ():
            over_even = rng.multivariate_hypergeometric(quota, full[s] % shards, method="marginals")
            quota = quota - over_even
            times = over_even + full[s] // shards
            for shard, first, n in zip(range(shards), (np.cumsum(times) - times).tolist(), times.tolist(), strict=True):
                if n:
                    dealt.append((s, block, shard, first, n, None, None))
    deal = F.broadcast(spark.createDataFrame(dealt, f"s int, block int, shard int, first int, times int, subs array<int>, docs array<{key}>"))
    mixed = spread.join(deal, ["s", "block"]).where("subs is null or array_contains(subs, sub) or array_contains(docs, doc_id)")
    mixed = mixed.select("doc_id", "source", F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)).alias("repeat"), "shard")
    whole = int(drawn.sum())
    report = [
        (r["source"], float(r["target_share"]), int(r["max_repeats"]), int(n_rows[s]), int(tokens[s]), float(want[s]), int(drawn[s]), float(drawn[s]) / whole if whole else 0.0, bool(short[s]))
        for s, r in enumerate(wanted)
    ]
    return Mix(mixed, spark.createDataFrame(report, schema), seed)
