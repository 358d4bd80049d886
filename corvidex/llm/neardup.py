"""Near-duplicates by word shingles: parity sketches joined by pigeonhole per size band, then verified."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.frames import broadcast_if_small, cut, join_unique

TOKEN = re.compile("[0-9A-Za-z]+")
MOST_HOT = 200_000  # frequent shingles known to every task; the others only lose their place in the order
MOST_KEPT = 200_000
SALT_ROWS = 2_000
MOST_PARTNERS = 5_000  # rows that one copy of a set or text meets


_token_hashes: dict[str, int] = {}


def token_hash(token: str) -> int:
    """Of a token, case put aside; what was met is kept, up to MOST_KEPT."""
    if (h := _token_hashes.get(token)) is None:
        if len(_token_hashes) > MOST_KEPT:
            _token_hashes.clear()
        h = _token_hashes[token] = xxhash.xxh64_intdigest(token.lower())
    return h


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of `words` lower-case tokens, sorted."""
    tokens = np.fromiter(map(token_hash, TOKEN.findall(text)), np.uint64)
    n = len(tokens) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(words):
            out = mix(out + tokens[k : k + n], k + 1)
    return np.unique(out)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bands(least: int, similarity: float, most: int = 1 << 40) -> np.ndarray:
    """Lower ends of size bands. Partners of a set are in its own band or one beside it."""
    ends = [least]
    while ends[-1] < most:
        ends.append(int(ends[-1] / similarity) + 1)
    return np.array(ends)


def _shingler(words: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, keys = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(s := shingles(text, words)) >= least:
                    ids.append(doc)
                    sets.append(s.view(np.int64))
                    keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(ids, batch.schema.types[0]), pa.array(keys, pa.string()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "set_key", "shingles"])

    return run


def several_a_piece(similarity: float) -> bool:
    """Whether sets so similar differ in few enough members for pieces of more than two members."""
    return (1 - similarity) / (1 + similarity) * (1 + 1 / similarity) <= 0.3


def signatures(sets: list[np.ndarray], hot: tuple[np.ndarray, np.ndarray], similarity: float, least: int) -> dict[str, np.ndarray]:
    """Rows (set, sig, own, pos) of the sets; n, band and (p0, p1), a parity sketch of 128 bits, of each set.

    By pigeonhole, each set sends so many pieces that one of them is alike in any partner, for its own size band
    and, if larger partners may be there, for the next one. Pieces come by the frequency of their rarest member. Where
    several_a_piece, the hash space of a band is cut into blocks, two for each of d + 1, d being the largest difference to
    a partner, and the members of a block are XORed: two sets differ in at most d blocks, so the first d + 1
    non-empty ones of both hold a common one, unless one set has only d; such sets send every member as well.
    Else a piece is one member. A member that only one set has then breaks no piece of the other, so fewer do: all
    but as many as the overlap has to hold, and one more. pos is the member's place in that order.
    """
    sizes = np.array([len(s) for s in sets])
    doc, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    known, counts = hot
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    freq = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
    order = np.lexsort((h, freq, doc))
    h, freq = h[order], freq[order]
    pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends, far = bands(least, similarity), np.floor(sizes / similarity + 1e-9).astype(np.int64)
    band = np.searchsorted(ends, sizes, "right") - 1
    part, overlap = (1 - similarity) / (1 + similarity), similarity / (1 + similarity)
    out: dict[str, list] = {"set": [], "sig": [], "own": [], "pos": []}

    def send(of: np.ndarray, sig: np.ndarray, own: bool, pos: np.ndarray | None = None) -> None:
        for name, column in (("set", of), ("sig", sig), ("own", np.full(len(of), own)), ("pos", np.zeros(len(of), np.int64) if pos is None else pos)):
            out[name].append(column)

    for own in (True, False):
        label = band if own else band + 1
        upper = ends[label + 1]
        there = np.ones(len(sets), bool) if own else far >= ends[label]
        if not several_a_piece(similarity):
            # A larger set has at least similarity * n in common with a partner, a smaller one more by the partner's size.
            common = similarity * sizes if own else overlap * (sizes + ends[label])
            use = there[doc] & (pos < (sizes - np.ceil(common - 1e-9) + 1)[doc])
            send(doc[use], mix(h[use] ^ mix(label[doc[use]].astype(np.uint64), 0x3EAC), 11), own, pos[use])
            continue
        d = np.floor(part * (sizes + np.minimum(far, upper - 1)) + 1e-9).astype(np.int64)
        use = there[doc]
        own_doc, own_h, own_freq = doc[use], h[use], freq[use]
        if not len(own_h):
            continue
        most = np.floor(part * (upper + upper / similarity)).astype(np.int64)
        block = mix(own_h, 0x51ED) % (2 * (most + 1))[own_doc].astype(np.uint64)
        order = np.lexsort((block, own_doc))
        own_doc, own_h, own_freq, block = own_doc[order], own_h[order], own_freq[order], block[order]
        first = np.ones(len(own_h), bool)
        first[1:] = (own_doc[1:] != own_doc[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(first)
        sig = mix(np.bitwise_xor.reduceat(own_h, start) ^ mix(block[start], 0xB10C) ^ mix(label[own_doc[start]].astype(np.uint64), 0xBA4D), 7)
        rare, of = np.minimum.reduceat(own_freq, start), own_doc[start]
        filled = np.bincount(of, minlength=len(sets))
        order = np.lexsort((sig, rare, of))
        place = np.arange(len(of)) - np.concatenate([[0], np.cumsum(filled)])[of]
        keep = place <= d[of]
        send(of[order][keep], sig[order][keep], own)
        weak = filled[own_doc] <= d[own_doc]
        send(own_doc[weak], mix(own_h[weak] ^ mix(label[own_doc[weak]].astype(np.uint64), 0x3EAC), 11), own)
    odd = np.zeros((len(sets), 128), np.uint8)
    np.bitwise_xor.at(odd, (doc, (mix(h, 0x5EED) % np.uint64(128)).astype(int)), 1)
    sketch = np.packbits(odd, axis=1).view(np.int64)
    result = {k: np.concatenate(v) for k, v in out.items()}
    return result | {"p0": sketch[:, 0].copy(), "p1": sketch[:, 1].copy(), "n": sizes, "band": band}


def parity_sketches(sets: list[np.ndarray], upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 bits of all sets one after another, number of words of each): parities of the members' hashes.

    There are 4 bits for each of a set's `upper` members; sets with the same `upper` compare.
    """
    sizes, words = np.array([len(s) for s in sets], int), -(-4 * upper // 64)
    bit = mix(np.concatenate(sets), 0x0DD) % np.repeat(64 * words, sizes).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.cumsum(words) - words, sizes) + (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
    return out, words


def _sets_of(lists: pa.ListArray) -> list[np.ndarray]:
    return [lists[i].values.to_numpy().view(np.uint64) for i in range(len(lists))]


def _sketcher(hot: object, similarity: float, least: int) -> Callable:
    """(rep, shingles) to (sig, rep, meta, p0, p1); meta is n << 32 | band << 25 | own << 24 | pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids = batch.column(0).to_numpy()
                s = signatures(_sets_of(batch.column(1)), hot.value, similarity, least)
                of = s["set"]
                # A lower place than the true one is only less strict.
                meta = (s["n"][of].astype(np.int64) << 32) | (s["band"][of].astype(np.int64) << 25) | (s["own"].astype(np.int64) << 24) | np.minimum(s["pos"], (1 << 24) - 1)
                yield pa.record_batch([pa.array(s["sig"].view(np.int64)), pa.array(ids[of]), pa.array(meta), pa.array(s["p0"][of]), pa.array(s["p1"][of])], names=["sig", "rep", "meta", "p0", "p1"])

    return run


def _wide_sketcher(similarity: float, least: int) -> Callable:
    """(rep, shingles) to (rep, band, words): parity sketches for the set's own size band and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bands(least, similarity)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = _sets_of(batch.column(1))
                band = np.searchsorted(ends, [len(s) for s in sets], "right") - 1
                for label in (band, band + 1):
                    words, sizes = parity_sketches(sets, ends[label + 1])
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), words.view(np.int64))
                    yield pa.record_batch([batch.column(0), pa.array(label.astype(np.int32)), lists], names=["rep", "band", "words"])

    return run


def attach(pairs: DataFrame, table: DataFrame, side: str, column: str, *also: str) -> DataFrame:
    """pairs (rep_a, rep_b, ...) with column of the table's row for rep_<side> (and the same `also`), as <column>_<side>.

    A row with very many partners stands in several tasks.
    """
    key = f"rep_{side}"
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PARTNERS)
    parts = broadcast_if_small(counts.select(key, F.ceil(F.col("n") / MOST_PARTNERS).cast("int").alias("parts")))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep_a", "rep_b"), F.col("parts").cast("long")).cast("int"))
    salted = pairs.join(parts, key, "left").withColumn("part", part).drop("parts")
    rows = table.select(F.col("rep").alias(key), F.col(column).alias(f"{column}_{side}"), *also).join(parts, key, "left")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(rows, [key, "part", *also]).drop("part")


def attach(pairs: DataFrame, table: DataFrame, side: str, column: str, *also: str) -> DataFrame:
    """pairs (rep_a, rep_b, ...) with column of the table's row for rep_<side> (and the same `also`), as <column>_<side>.

    A row with very many partners stands in several tasks.
    """
    key = f"rep_{side}"
    parts = cut(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / MOST_PARTNERS).cast("int")))
    salted = join_unique(pairs, parts, key, "n").withColumn("part", F.pmod(F.xxhash64("rep_a", "rep_b"), F.col("parts").cast("long")).cast("int")).drop("n", "parts")
    rows = table.select(F.col("rep").alias(key), F.col(column).alias(f"{column}_{side}"), *also).join(parts, key)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n", "parts")
    return salted.join(rows, [key, "part", *also]).drop("part")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, content), the pairs of shingle sets at least so similar (Jaccard), and who has them.

    Returns (links, members). members: doc_id, rep - the smallest doc_id with the same set. links: rep_a < rep_b,
    shared, similarity - every pair of different sets at or above the threshold, none missed. Documents with
    null content or fewer than `least` distinct shingles take no part. doc_id is a long; repeated rows count once,
    and of several contents of a doc_id the one whose set has the smallest key is used.
    """
    spark = docs.sparkSession
    sets = cut(
        docs.where("content is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(_shingler(words, max(1, least)), "doc_id long, set_key string, shingles array<long>")
    )
    keys = sets.groupBy("doc_id").agg(F.min("set_key").alias("set_key"))
    firsts = keys.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = cut(keys.join(firsts, "set_key").select("doc_id", "rep", "set_key"))
    own = ["doc_id", "set_key"]
    reps = cut(sets.join(members.where("doc_id = rep").select(own), own).dropDuplicates(own).select(F.col("doc_id").alias("rep"), "shingles"))
    members = members.select("doc_id", "rep")

    enough = max(50, reps.count() // 2000)
    frequent = reps.select(F.explode("shingles").alias("h")).groupBy("h").count().where(F.col("count") >= enough).orderBy(F.desc("count"), "h").limit(MOST_HOT).toPandas()
    known = frequent["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    hot = spark.sparkContext.broadcast((known[order], frequent["count"].to_numpy(np.int64)[order]))

    floor = max(1, least)
    rows = cut(reps.mapInArrow(_sketcher(hot, similarity, floor), "sig long, rep long, meta long, p0 long, p1 long"))
    crowded = broadcast_if_small(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > SALT_ROWS))

    def side(df: DataFrame, name: str, *salt: Column) -> DataFrame:
        return df.select("sig", *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "meta", "p0", "p1")], *salt)

    # Both sides of the first join are the same rows: they are shuffled once. Signatures of very many sets are salted.
    few, many = rows.join(crowded.select("sig"), "sig", "left_anti"), rows.join(crowded, "sig")
    salts = F.ceil(F.col("sets") / SALT_ROWS)
    salt, every = F.pmod(F.xxhash64("rep"), salts).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
    met = side(few, "a").join(side(few, "b"), "sig").unionByName(side(many, "a", salt).join(side(many, "b", every), ["sig", "salt"]).drop("salt"))
    # a is the smaller set, of equal ones that with the smaller rep, and b is in its own band.
    n_a, n_b = (F.shiftright(f"meta_{x}", 32) for x in "ab")
    pos_a, pos_b = (F.col(f"meta_{x}").bitwiseAND(F.lit((1 << 24) - 1)) for x in "ab")
    own_b = F.col("meta_b").bitwiseAND(F.lit(1 << 24)) != 0
    part = (1 - similarity) / (1 + similarity)
    apart = F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))) + F.bit_count(F.col("p1_a").bitwiseXOR(F.col("p1_b")))
    near = (
        own_b
        & ((n_a < n_b) | ((n_a == n_b) & (F.col("rep_a") < F.col("rep_b"))))
        & (n_a + 1e-9 >= similarity * n_b)
        # What follows the first common member is all that may be in common, too.
        & (F.least(n_a - pos_a, n_b - pos_b) + 1e-9 >= (n_a + n_b) * (similarity / (1 + similarity)))
        & (apart <= part * (n_a + n_b) + 1e-9)
    )
    band = F.shiftright("meta_b", 25).bitwiseAND(F.lit(127)).cast("int")
    candidates = cut(met.where(near).select("rep_a", "rep_b", band.alias("band"), (part * (n_a + n_b) + 1e-9).alias("most")).distinct())

    # Sketches as wide as the sets come once for each candidate, shingles for what these leave.
    def of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
        return cut(reps.join(broadcast_if_small(ends), "rep", "left_semi"))

    wide = cut(of(candidates).mapInArrow(_wide_sketcher(similarity, floor), "rep long, band int, words array<long>"))
    compared = attach(attach(candidates, wide, "a", "words", "band"), wide, "b", "words", "band")
    differ = F.aggregate(F.zip_with("words_a", "words_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    close = cut(compared.where(differ <= F.col("most")).select("rep_a", "rep_b"))
    left = of(close)
    both = attach(attach(close, left, "a", "shingles"), left, "b", "shingles")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    verified = both.select("rep_a", "rep_b", shared.alias("shared"), (F.size("shingles_a") + F.size("shingles_b")).alias("both"))
    links = verified.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "shared", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))
    return links.where(F.col("similarity") >= similarity), members


def document_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: links and equal sets, as pairs of documents."""
    a, b = members.select(F.col("doc_id").alias("x"), F.col("rep").alias("rep_a")), members.select(F.col("doc_id").alias("y"), F.col("rep").alias("rep_b"))
    linked = links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Pairs of equal sets are the result itself; salts spread a group's rows over tasks.
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    grouped = members.join(several, "rep").withColumn("salts", salts)
    equal = grouped.select("rep", F.col("doc_id").alias("x"), F.pmod(F.xxhash64("doc_id"), F.col("salts").cast("long")).cast("int").alias("salt")).join(
        grouped.select("rep", F.col("doc_id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), ["rep", "salt"]
    ).where("x < y").select("x", "y")
    return linked.unionByName(equal).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
