"""Long exact spans shared between texts: winnowed anchors seed matches, which are extended both ways."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.frames import cut, join_unique, spread
from corvidex.llm.chars import codepoints
from corvidex.llm.neardup import attach, mix

BASE = np.uint64(0x9E3779B97F4A7C15)
MOST_PAIRS = 4_000_000  # joined rows of an anchor in one task
EDGE = 0x110000  # stands beyond the ends of a text
KEPT_TEXTS = 100  # of a batch, whose anchors stay for the next pair
MOST_ROWS = 50_000  # spans of a batch that goes back to Spark
PLACE_BITS = 31  # more than the longest text has characters; 33 bits of hash are left to order neighbours


def gram_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` characters, by differences of one running sum."""
    if len(chars) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars) - 1, BASE)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars) - size, inverse)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(chars.astype(np.uint64), 3) * powers, dtype=np.uint64)])
        return mix((sums[size:] - sums[:-size]) * back, 5)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every `window` neighbours, the last one of equals.

    The low bits of a hash give way to its position, counted backwards; minima over windows then come from
    minima over halves.
    """
    n = len(hashes)
    if n < window:
        return np.empty(0, int)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: n - window + 1], least[window - size :])
    return np.unique(low - (least & low)).astype(int)


def anchors(chars: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, keys) of the anchors of a text. Any `length` characters hold one, chosen by these characters alone.

    Anchors with equal hashes and keys also follow equal anchors at the same distance, without a gap between. The
    first of a text and those after a gap have the key 0.
    """
    hashes = gram_hashes(chars, gram)
    at = winnow(hashes, length - gram + 1)
    hashes, gap = hashes[at], np.diff(at)
    before = mix(hashes[:-1] + mix(gap.astype(np.uint64), 7), 9)
    return at, hashes, np.concatenate([np.zeros(min(1, len(at)), np.uint64), np.where(gap <= gram, before, np.uint64(0))])


def padded(chars: np.ndarray, reach: int) -> np.ndarray:
    edge = np.full(reach, EDGE, np.uint32)
    return np.concatenate([edge, chars, edge])


def _anchorer(length: int, gram: int) -> Callable:
    """Rows (sig, ctx, key, rep, places): anchors by hash, by that of all characters up to length - gram to both sides, and key."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chars = codepoints(text)
                at, sig, key = anchors(chars, length, gram)
                if not len(at):
                    continue
                ctx = gram_hashes(padded(chars, reach), length + reach)[at]
                _, first, same = np.unique(mix(ctx ^ mix(key, 13), 17), return_index=True, return_inverse=True)
                order = np.argsort(same, kind="stable")
                for column, values in zip(out, (sig[first], ctx[first], key[first], np.full(len(first), rep, np.int64), at[order], np.bincount(same)), strict=True):
                    column.append(values)
            sig, ctx, key, reps, places, sizes = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), places.astype(np.int32))
            yield pa.record_batch([*(pa.array(c.astype(np.uint64).view(np.int64)) for c in (sig, ctx, key)), pa.array(reps.astype(np.int64)), lists], names=["sig", "ctx", "key", "rep", "places"])

    return run


def extend(a: np.ndarray, b: np.ndarray, at: int, bt: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run through a[at] and b[bt], which are equal."""
    left, right = min(at, bt), min(len(a) - at, len(b) - bt)
    differ = np.flatnonzero(a[at : at + right] != b[bt : bt + right])
    ahead = int(differ[0]) if len(differ) else right
    differ = np.flatnonzero(a[at - left : at] != b[bt - left : bt])
    behind = left - 1 - int(differ[-1]) if len(differ) else left
    return at - behind, bt - behind, behind + ahead


def every_match(a: tuple, b: tuple, length: int) -> Iterator[tuple[int, int, int]]:
    """(start in a, start in b, length) of each maximal common run of at least `length` characters, of two texts' (characters, *anchors).

    Of anchors that follow equal ones the run is met at those, so repeats back to back cost what they give.
    """
    (x, at_x, hash_x, key_x), (y, at_y, hash_y, key_y) = a, b
    order_x, order_y = np.argsort(hash_x, kind="stable"), np.argsort(hash_y, kind="stable")
    sorted_x, sorted_y = hash_x[order_x], hash_y[order_y]
    for h in np.intersect1d(hash_x, hash_y):
        i = order_x[np.searchsorted(sorted_x, h) : np.searchsorted(sorted_x, h, "right")]
        j = order_y[np.searchsorted(sorted_y, h) : np.searchsorted(sorted_y, h, "right")]
        for key in np.unique(key_x[i]):
            others = at_y[j[(key_y[j] != key) | (key == 0)]].tolist()
            for p in at_x[i[key_x[i] == key]].tolist() if others else ():
                for q in others:
                    start_x, start_y, size = extend(x, y, p, q)
                    if size >= length:
                        # The first anchor that both have in the run stands for it.
                        own = at_x[np.searchsorted(at_x, start_x) : np.searchsorted(at_x, p)]
                        if not np.isin(own - (p - q), at_y[np.searchsorted(at_y, start_y) : np.searchsorted(at_y, q)]).any():
                            yield start_x, start_y, size


def _matcher(length: int, gram: int) -> Callable:
    names = ["rep_a", "rep_b", "start_a", "start_b", "length"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            known: dict[int, tuple] = {}
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for rep, text in ((a, text_a), (b, text_b)):
                    if rep not in known:
                        if len(known) >= KEPT_TEXTS:
                            known = {k: v for k, v in known.items() if k in (a, b)}
                        chars = codepoints(text)
                        known[rep] = (chars, *anchors(chars, length, gram))
                for match in every_match(known[a], known[b], length):
                    rows.append((a, b, *match))
                    if len(rows) >= MOST_ROWS:
                        yield table(rows)
                        rows = []
            yield table(rows)

    return run


def _surrounder(length: int, gram: int) -> Callable:
    """(rep, sites, text) to a row a site with `around`: the length - gram characters to its left, then those to its right."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                lists, around = batch.column(1), []
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                sites = lists.flatten()
                at = sites.field("at").to_numpy().astype(np.int64)
                start = 0
                for text, n in zip(batch.column(2).to_pylist(), sizes.tolist(), strict=True):
                    near = at[start : start + n, None] + np.arange(reach)
                    chars = padded(codepoints(text), reach)
                    around.append(np.concatenate([chars[near], chars[near + reach + gram]], axis=1).astype(np.uint32))
                    start += n
                flat = np.concatenate(around).tobytes() if around else b""
                width = 8 * reach
                binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(at) + 1, np.int32)), pa.py_buffer(flat)])
                reps = pa.array(np.repeat(batch.column(0).to_numpy(), sizes))
                names = [f.name for f in sites.type]
                yield pa.record_batch([reps, *(sites.field(n) for n in names), binary], names=["rep", *names, "around"])

    return run


def _surrounded(sites: DataFrame, reps: DataFrame, length: int, gram: int) -> DataFrame:
    """Sites (rep, at, ...) with `around`. Each text is read once, whatever the number of its sites."""
    names = [c for c in sites.columns if c != "rep"]
    kinds = dict(sites.dtypes)
    grouped = sites.groupBy("rep").agg(F.collect_list(F.struct(*names)).alias("sites")).join(reps, "rep").select("rep", "sites", "text")
    return grouped.mapInArrow(_surrounder(length, gram), "rep long, " + ", ".join(f"{n} {kinds[n]}" for n in names) + ", around binary")


def _chars_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), width)


def _near_enough(reach: int) -> Callable:
    """Pairs of sites of one anchor whose common run, extended both ways, reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_chars_of(batch.column(i), 2 * reach) for i in (2, 3))
            same = (a == b) & (a != EDGE)
            behind, ahead = same[:, :reach][:, ::-1], same[:, reach:]
            run_of = np.cumprod(behind, axis=1).sum(1) + np.cumprod(ahead, axis=1).sum(1)
            keep = pa.array(run_of >= reach)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["rep_a", "rep_b"])

    return run


def _windows(length: int, gram: int) -> Callable:
    """(sig, ctx, low, high, around) to a row for each `length` characters with the anchor inside: its place there and two hashes."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                chars = _chars_of(batch.column(4), 2 * reach).astype(np.uint64)
                n = len(chars)
                left, right = chars[:, :reach], chars[:, reach:]
                with np.errstate(over="ignore"):
                    # Window j has the last j characters to the left of the anchor and reach - j to its right.
                    sums = []
                    for seed in (21, 22):
                        base = mix(np.arange(2 * reach, dtype=np.uint64), seed) | np.uint64(1)
                        values = mix(chars, seed) * base
                        tail = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(values[:, :reach][:, ::-1], axis=1, dtype=np.uint64)], axis=1)
                        head = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(values[:, reach:], axis=1, dtype=np.uint64)], axis=1)
                        sig = batch.column(0).to_numpy().view(np.uint64)[:, None]
                        place = mix(np.arange(reach + 1, dtype=np.uint64), seed + 9)
                        sums.append(mix(tail + head[:, ::-1] + mix(sig, seed) + place, seed))
                out_left = np.concatenate([np.zeros((n, 1), bool), np.logical_or.accumulate((left == EDGE)[:, ::-1], axis=1)], axis=1)
                out_right = np.concatenate([np.zeros((n, 1), bool), np.logical_or.accumulate(right == EDGE, axis=1)], axis=1)
                row, place = np.nonzero(~(out_left | out_right[:, ::-1]))
                take = pa.array(row)
                yield pa.record_batch(
                    [*(batch.column(i).take(take) for i in range(4)), pa.array(place.astype(np.int32)), *(pa.array(s[row, place].view(np.int64)) for s in sums)],
                    names=["sig", "ctx", "low", "high", "place", "w", "w2"],
                )

    return run


def _coverer(length: int, gram: int) -> Callable:
    """(rep, n_chars, sites) to (rep, covered): characters within shared windows, each counted once."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered = []
            for n, sites in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                starts = [np.empty(0, np.int64)]
                for site in sites:
                    shift = np.arange(reach + 1) if site["shifts"] is None else np.array(site["shifts"])
                    starts.append((np.array(site["places"])[:, None] - shift).ravel())
                start = np.unique(np.concatenate(starts))
                start = start[(start >= 0) & (start + length <= n)]
                covered.append(int(np.minimum(np.diff(start), length).sum()) + length if len(start) else 0)
            yield pa.record_batch([batch.column(0), pa.array(covered, pa.int64())], names=["rep", "covered"])

    return run


@dataclass(frozen=True)
class Sites:
    """Distinct texts of documents and their anchors.

    members: doc_id, rep (the smallest doc_id with the same text), n_chars, of all texts that are long enough.
    reps: rep, text. rows: sig, ctx, key, rep, places, as _anchorer gives them.
    """

    members: DataFrame
    reps: DataFrame
    rows: DataFrame
    length: int
    gram: int


def anchor_sites(docs: DataFrame, length: int = 200, gram: int = 160) -> Sites:
    """Anchors of documents (doc_id, text): winnowed runs of `gram` characters, one in any `length` characters.

    Null and shorter texts take no part, repeated rows count once, and of several texts of a doc_id the one with the
    smallest hash is used. The nearer gram is to length, the fewer anchors fail to extend and the more there are.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.length("text") >= length) & F.col("doc_id").isNotNull()))
    texts = texts.withColumn("key", F.sha2("text", 256))
    keyed = texts.groupBy("doc_id").agg(F.min(F.struct("key", F.length("text").alias("n_chars"))).alias("k")).select("doc_id", "k.key", "k.n_chars")
    keyed = cut(keyed)
    copies = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = cut(join_unique(keyed, copies, "key", "n").select("doc_id", "rep", "n_chars", "key"))
    own = ["doc_id", "key"]
    reps = cut(texts.join(members.where("doc_id = rep").select(own), own).dropDuplicates(own).select(F.col("doc_id").alias("rep"), "text"))
    rows = cut(reps.mapInArrow(_anchorer(length, gram), "sig long, ctx long, key long, rep long, places array<int>"))
    return Sites(members.select("doc_id", "rep", "n_chars"), reps, rows, length, gram)


def shared_pairs(sites: Sites) -> DataFrame:
    """(rep_a, rep_b), smaller first: the pairs of different texts with a common run of at least `length` characters.

    Texts are joined on anchors and each meeting is extended both ways, up to the threshold, on the characters
    around it. Where all that have an anchor come to it from the same one before, they met there: only anchors with
    several keys are joined, and of these the rows of the most frequent key not with each other. Anchors are
    compared by a 64-bit hash, their surroundings by the characters.
    """
    rows = sites.rows.select("sig", "key", "rep", F.get("places", F.lit(0)).alias("at"))
    by_key = rows.groupBy("sig", "key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("n"))
    main = F.max(F.struct(F.when(F.col("key") != 0, F.col("n")).otherwise(0).alias("n"), "key"))
    several = (
        by_key.groupBy("sig")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), main.alias("main"), F.count(F.lit(1)).alias("keys"), F.max(F.col("key") == 0).alias("open"))
        .where("low < high and (keys > 1 or open)")
    )
    salts = F.greatest(F.lit(1), F.least(F.col("n") - F.col("main.n"), F.ceil((F.col("n") - F.col("main.n")) * F.col("n") / MOST_PAIRS))).cast("int")
    wanted = several.select("sig", "n", F.when(F.col("main.n") > 0, F.col("main.key")).otherwise(0).alias("main"), salts.alias("salts"))
    seeds = cut(join_unique(rows, wanted, "sig", "n").drop("n"))
    seeds = cut(_surrounded(seeds, sites.reps, sites.length, sites.gram))
    left = seeds.where("key = 0 or key <> main").select("sig", *[F.col(c).alias(f"{c}_a") for c in ("rep", "key", "around")], F.pmod(F.xxhash64("rep", "at"), F.col("salts").cast("long")).cast("int").alias("salt"))
    right = seeds.select("sig", *[F.col(c).alias(f"{c}_b") for c in ("rep", "key", "around")], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = left.join(right, ["sig", "salt"]).where("rep_a <> rep_b and (key_a = 0 or key_a <> key_b)")
    kept = met.select("rep_a", "rep_b", "around_a", "around_b").mapInArrow(_near_enough(sites.length - sites.gram), "rep_a long, rep_b long")
    return kept.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()


def shared_spans(sites: Sites) -> DataFrame:
    """(rep_a, rep_b, start_a, start_b, length): the maximal runs of at least `length` characters that two different texts share.

    rep_a < rep_b; starts are in code points from 0. Of a passage that a text repeats, every position is reported with
    every position in the other text. Runs are compared on the texts themselves.
    """
    pairs = cut(shared_pairs(sites))
    texts = attach(attach(pairs, sites.reps, "a", "text"), sites.reps, "b", "text").select("rep_a", "rep_b", "text_a", "text_b")
    return texts.mapInArrow(_matcher(sites.length, sites.gram), "rep_a long, rep_b long, start_a int, start_b int, length int")


def shared_shares(sites: Sites) -> DataFrame:
    """(doc_id, n_chars, n_shared, share): how many characters of each long text lie in a run of `length` that another record has, too.

    No pairs of texts are formed. Every such run holds an anchor and lies within the characters around it, so
    anchors are classed by these: if two texts have a class, all runs at the anchor are shared. Where a class
    belongs to one text, each of its runs is compared by 128 bits with those of the anchor's other classes, one row
    a class. A text with an exact copy is shared as a whole. Overlapping runs count once, at every position of a
    repeated passage.
    """
    rows = sites.rows.select("sig", "ctx", "rep", "places")
    one = F.min(F.struct("rep", F.get("places", F.lit(0)).alias("at")))
    classes = cut(rows.groupBy("sig", "ctx").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("n"), one.alias("one")))
    by_sig = classes.groupBy("sig").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count(F.lit(1)).alias("classes"), F.max(F.col("low") == F.col("high")).alias("single"))
    partly = join_unique(classes, by_sig.where("l < h and single and classes > 1").select("sig", "classes"), "sig", "classes")
    around = _surrounded(partly.select("sig", "ctx", "low", "high", F.col("one.rep").alias("rep"), F.col("one.at").alias("at")), sites.reps, sites.length, sites.gram)
    windows = cut(around.select("sig", "ctx", "low", "high", "around").mapInArrow(_windows(sites.length, sites.gram), "sig long, ctx long, low long, high long, place int, w long, w2 long"))
    shared = windows.groupBy("w", "w2").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count(F.lit(1)).alias("windows")).where("l < h").select("w", F.col("w2").alias("same"), "windows")
    found = join_unique(windows.where("low = high"), shared, "w", "windows").where("w2 = same").groupBy("sig", "ctx").agg(F.collect_set("place").alias("shifts"))
    every = F.lit(None).cast("array<int>").alias("shifts")
    known = classes.where("low < high").select("sig", "ctx", every).unionByName(found).join(classes.select("sig", "ctx", "n"), ["sig", "ctx"]).withColumnRenamed("sig", "own")
    sited = join_unique(rows, known, "ctx", "n").where("sig = own").groupBy("rep").agg(F.collect_list(F.struct("places", "shifts")).alias("sites"))
    copies = sites.members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"), F.first("n_chars").alias("n"))
    covered = sited.join(copies, "rep").select("rep", "n", "sites").mapInArrow(_coverer(sites.length, sites.gram), "rep long, covered long")
    per_rep = copies.select("rep", "copies").join(covered, "rep", "left")
    n_shared = F.when(F.col("copies") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0)))
    return join_unique(sites.members, per_rep, "rep", "copies").select("doc_id", "n_chars", n_shared.alias("n_shared"), (n_shared / F.col("n_chars")).alias("share"))
