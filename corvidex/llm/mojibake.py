"""Text decoded with the wrong character encoding: improbable runs are isolated, and inverse mappings tested in them."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.frames import cut, join_unique
from corvidex.llm.chars import codepoints

# Encodings a text may have been read with, and those it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "cp852")
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "iso8859-2", "iso8859-5")
RAREST = 2e-6  # share of all pairs below which pairs are no more likely than this
MOST_PAIRS = 500_000  # pairs that the model tells apart, the most frequent; others count as unknown
SMOOTHING = 10  # occurrences at which a pair's information counts half
MOST_KEPT = 200_000
HOPE = 3.0  # nats by which a swap of a single word has to gain for the corpus's words to be asked
KNOWN = 3  # distinct contents that have a restored word at least,
TIMES = 4  # and how many times as many as have the damaged one
SURE = 4  # multi-byte characters of UTF-8 in a run that chance does not make
COMMON_MASS = 0.75  # of all pairs, those that make up this share are probable
WORD = re.compile(r"(\s+)")
LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
NOT_ASCII = re.compile("[^\x00-\x7f]+")
LOST = "\ufffd"
LOST_INSIDE = re.compile(f"\\w{LOST}|{LOST}\\w")


def pair_codes(chars: np.ndarray) -> np.ndarray:
    return (chars[:-1].astype(np.int64) << 21) | chars[1:]


def as_utf8(cluster: str, read_as: str) -> str | None:
    """The text whose UTF-8 bytes give a cluster of non-ASCII characters when read so, if there is one."""
    raw = as_bytes(cluster, read_as) if len(cluster) > 1 else None
    try:
        return raw.decode("utf-8") if raw is not None else None
    except UnicodeDecodeError:
        return None


def misread(cluster: str) -> bool:
    """Whether a cluster by itself looks like UTF-8 read wrongly.

    All of its bytes are UTF-8 in some encoding, and it gives several characters, or a mark or symbol, or starts with
    an upper-case letter or symbol; a lower-case letter before a mark or space may be plain text.
    """
    found = [new for read_as in READ_AS if (new := as_utf8(cluster, read_as)) is not None]
    lead = unicodedata.category(cluster[0])
    return any(len(new) > 1 or lead[0] == "S" or lead == "Lu" or unicodedata.category(new)[0] in "PS" for new in found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs but those at lost characters and at UTF-8 that was read wrongly: whatever their share, they never become probable."""
    known: dict[str, bool] = {}

    def codes_of(text: str) -> np.ndarray:
        codes = pair_codes(codepoints(text))
        if text.isascii():
            return codes
        kept = (codes >> 21 != ord(LOST)) & (codes & 0x1FFFFF != ord(LOST))
        for m in NOT_ASCII.finditer(text):
            if len(m.group()) > 1:
                if (bad := known.get(m.group())) is None:
                    if len(known) > MOST_KEPT:
                        known.clear()
                    bad = known[m.group()] = misread(m.group())
                if bad:
                    kept[max(m.start() - 1, 0) : m.end()] = False
        return codes[kept]

    for batch in batches:
        codes = [codes_of(t) for t in batch.column(0).to_pylist() if len(t) > 1]
        values, counts = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
        yield pa.record_batch([pa.array(values), pa.array(counts.astype(np.int64))], names=["pair", "n"])


@dataclass(frozen=True)
class PairModel:
    """Log probabilities of pairs, and the corpus mutual information each contributes; all others are `floor`."""

    pairs: np.ndarray
    log_p: np.ndarray
    gain: np.ndarray
    floor: float
    level: float

    def _of(self, codes: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(codes), other)
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, values[at], other)

    @cached_property
    def chars(self) -> frozenset[str]:
        return frozenset(map(chr, np.unique(np.concatenate([self.pairs >> 21, self.pairs & 0x1FFFFF])).tolist()))

    @cached_property
    def by_pair(self) -> dict[str, float]:
        return {chr(c >> 21) + chr(c & 0x1FFFFF): p for c, p in zip(self.pairs.tolist(), self.log_p.tolist(), strict=True)}

    def scores(self, text: str) -> list[float]:
        """The log probability of each pair."""
        get, floor = self.by_pair.get, self.floor
        return [get(text[i : i + 2], floor) for i in range(len(text) - 1)]

    def surprise(self, text: str) -> np.ndarray:
        """Of each pair, how far its share of the mutual information is below the level of probable pairs; negative above."""
        return np.clip(self.level - self._of(pair_codes(codepoints(text)), self.gain, self.level - 4), -2, 4)


def fit_pairs(contents: DataFrame) -> PairModel:
    """Count the adjacent pairs of distinct contents (one column). The driver gets the MOST_PAIRS most frequent only."""
    counts = cut(contents.mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where("n >= 3").orderBy(F.desc("n"), "pair").limit(MOST_PAIRS).toPandas().sort_values("pair")
    pairs, n = known["pair"].to_numpy(np.int64), known["n"].to_numpy(float)
    floor = float(np.log(RAREST / 4))
    if not len(pairs):
        return PairModel(pairs, n, n, floor, 0.0)
    first, second = pairs >> 21, pairs & 0x1FFFFF
    a_values, a_at = np.unique(first, return_inverse=True)
    b_values, b_at = np.unique(second, return_inverse=True)
    a_share, b_share = np.bincount(a_at, n)[a_at] / total, np.bincount(b_at, n)[b_at] / total
    p = n / total
    # What a pair adds to the corpus's mutual information. That of rare pairs is held back: those of damaged text
    # are few, but go together almost always. Pairs that repel each other add next to nothing.
    information = np.maximum(np.log(p / (a_share * b_share)) * n / (n + SMOOTHING), 0.5)
    common = np.sort(p)[::-1]
    level = common[min(int(np.searchsorted(np.cumsum(common), COMMON_MASS)), len(p) - 1)]
    return PairModel(pairs, np.maximum(np.log(p), np.log(RAREST)), np.log(p * information), floor, float(np.log(level)))


def improbable_runs(surprise: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-scoring segments [start, end) of the scores, in order (in linear time, over runs of one sign)."""
    if not len(surprise):
        return []
    positive = surprise > 0
    start = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums, stop = np.add.reduceat(surprise, start), np.append(start[1:], len(surprise))
    done: list[list[float]] = []
    found: list[list[float]] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for a, b, s in zip(start.tolist(), stop.tolist(), sums.tolist(), strict=True):
        if s > 0:
            segment = [a, b, total, total + s]
            while found:
                k = len(found) - 1
                while k >= 0 and found[k][2] >= segment[2]:
                    k -= 1
                if k < 0:  # no later segment can reach back over this one's low sum
                    done += found
                    found = []
                    break
                if found[k][3] >= segment[3]:
                    break
                segment = [found[k][0], segment[1], found[k][2], segment[3]]
                del found[k:]
            found.append(segment)
        total += s
    return [(int(a), int(b)) for a, b, _, _ in done + found]


def as_bytes(text: str, read_as: str) -> bytes | None:
    """The bytes that give text when read so. Bytes a Windows encoding leaves open stand for themselves."""
    try:
        return text.encode(read_as)
    except UnicodeEncodeError:
        if not read_as.startswith("cp125"):
            return None
        out = bytearray()
        for c in text:
            try:
                out += c.encode(read_as)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) < 0xA0:
                    return None
                out.append(ord(c))
        return bytes(out)


def swap_tables() -> list[tuple[str, dict[int, int]]]:
    """(name, character to character) for each one-byte encoding read as another one."""
    tables = []
    for read_as in READ_AS:
        for written_in in WRITTEN_IN:
            table = {}
            for byte in range(0x80, 0x100):
                try:
                    shown, meant = bytes([byte]).decode(read_as), bytes([byte]).decode(written_in)
                except UnicodeDecodeError:
                    continue
                if shown != meant:
                    table[ord(shown)] = ord(meant)
            if table and read_as != written_in:
                tables.append((f"{written_in} as {read_as}", table))
    return tables


def assigned(text: str) -> bool:
    """Whether all characters are letters, marks, numbers, punctuation, symbols or spaces."""
    return all(unicodedata.category(c)[0] in "LMNPSZ" or c in "\n\t" for c in text)


def drawn_box(code: int) -> bool:
    return 0x2500 <= code < 0x2600


class Inverse:
    """Inverse mappings of runs under a pair model; what is found for a word or cluster is kept for the next one."""

    def __init__(self, model: PairModel) -> None:
        self.model = model
        self.swaps = swap_tables()
        self.words: dict[str, dict[int, tuple[float, str]]] = {}
        self.clusters: dict[str, dict[str, str]] = {}
        self.seen: dict[int, list[int]] = {}
        self.changes: dict[tuple[int, ...], list[tuple[dict[int, int], list[int]]]] = {}

    def cluster(self, text: str) -> dict[str, str]:
        """Of a cluster of non-ASCII characters, by encoding, the UTF-8 text its bytes are; only of assigned characters."""
        if (found := self.clusters.get(text)) is None:
            found = {}
            for read_as in READ_AS:
                new = as_utf8(text, read_as)
                if new is not None and misread(new) and (deeper := self.cluster(new)):  # read wrongly more than once
                    new = next(iter(deeper.values()))
                if new is not None and assigned(new):
                    found[read_as] = new
            if len(self.clusters) > MOST_KEPT:
                self.clusters.clear()
            self.clusters[text] = found
        return found

    def images(self, char: int) -> list[int]:
        """What each swap makes of a character."""
        if (found := self.seen.get(char)) is None:
            found = self.seen[char] = [table.get(char, char) for _, table in self.swaps]
        return found

    def choices(self, chars: tuple[int, ...]) -> list[tuple[dict[int, int], list[int]]]:
        """(character to character, swaps) for each way in which swaps change these characters to plausible ones."""
        if (found := self.changes.get(chars)) is None:
            alike: dict[tuple[int, ...], list[int]] = {}
            for k, images in enumerate(zip(*(self.images(c) for c in chars), strict=True)):
                alike.setdefault(images, []).append(k)
            found = [(dict(zip(chars, i, strict=True)), ks) for i, ks in alike.items() if i != chars and assigned("".join(map(chr, i))) and not any(map(drawn_box, i))]
            if len(self.changes) > MOST_KEPT:
                self.changes.clear()
            self.changes[chars] = found
        return found

    def word(self, text: str) -> dict[int, tuple[float, str]]:
        """Of a word, by swap, the gain and the new word where that is more probable."""
        if (found := self.words.get(text)) is None:
            before, found = sum(self.model.scores(f" {text} ")), {}
            for change, ks in self.choices(tuple(sorted({ord(c) for c in text if c > "\x7f"}))):
                new = text.translate(change)
                gain = sum(self.model.scores(f" {new} ")) - before
                if gain > 0:
                    found.update((k, (gain, new)) for k in ks)
            if len(self.words) > MOST_KEPT:
                self.words.clear()
            self.words[text] = found
        return found

    def hopes(self, run: str) -> set[tuple[str, str, str]]:
        """(word, what a swap makes of it, swap): single words of a run to be judged by how often the corpus has either."""
        found = set()
        for w in {w for w in run.split() if len(w) > 2 and not w.isascii()}:
            old = w.strip(string.punctuation)
            for k, (gain, new) in self.word(w).items():
                core = new.strip(string.punctuation)
                if gain > HOPE and len(core) == len(old) > 2 and LETTERS.fullmatch(core) and not core.isascii():
                    found.add((old, core, self.swaps[k][0]))
        return found

    def restore(self, run: str) -> tuple[str, str] | None:
        """(restored run, mapping) if an inverse mapping makes the run clearly more probable, else None.

        UTF-8 read as something else has to give pairs that the corpus knows for the most part, or as many multi-byte
        characters as chance does not make, in nearly all clusters of the run: then the corpus need not know them.
        A swap of one-byte encodings has to improve half of the non-ASCII words of a stretch, by 1 nat a pair and
        12 nats in all.
        """
        found = [self.cluster(m) for m in NOT_ASCII.findall(run)]
        best: tuple[float, str, str] | None = None
        for read_as in dict.fromkeys(k for f in found for k in f):
            new = NOT_ASCII.sub(lambda m, r=read_as: self.cluster(m.group()).get(r, m.group()), run)
            scores = self.model.scores(new)
            # Fewer characters mean fewer pairs: what is left over counts as a typical one each.
            gain = sum(scores) - 4.0 * (len(run) - len(new)) - sum(self.model.scores(run))
            likely = sum(x > self.model.floor for x in scores) >= 0.5 * len(scores)
            whole = [f[read_as] for f in found if read_as in f]
            likely = likely and all(map(self.model.chars.issuperset, whole))
            sure = len(whole) >= 0.8 * len(found) and sum(c > "\x7f" for w in set(whole) for c in w) >= SURE
            if gain > 1.0 and (likely or sure) and (best is None or gain > best[0]):
                best = gain, new, f"utf-8 as {read_as}"
        if best is not None:
            return best[1], best[2]
        parts = WORD.split(run)
        odd = [i for i, w in enumerate(parts) if not w.isascii()]
        hopes: dict[int, float] = {}
        for w in {parts[i] for i in odd if len(parts[i]) > 2}:
            for k, (gain, _) in self.word(w).items():
                hopes[k] = hopes.get(k, 0.0) + gain
        for _, k in sorted(((g, k) for k, g in hopes.items() if g > 12.0), key=lambda x: (-x[0], x[1])):
            if found := self._stretch(parts, odd, k):
                return found, self.swaps[k][0]
        return None

    def _stretch(self, parts: list[str], odd: list[int], k: int) -> str | None:
        """The run with swap k in the stretch of words that gains most, if the gain there is clear."""
        best, low, total, segment = 0.0, 0, 0.0, (0, 0)
        for j, i in enumerate(odd):
            if total <= 0:
                low, total = j, 0.0
            total += self.word(parts[i])[k][0] if k in self.word(parts[i]) else -6.0
            if total > best:
                best, segment = total, (low, j + 1)
        inside = odd[slice(*segment)]
        # A word that comes again is no further evidence, one of one or two characters is none.
        words = {parts[i] for i in inside if len(parts[i]) > 2}
        new = {w: self.word(w)[k] for w in words if k in self.word(w)}
        scores = [x for _, w in new.values() for x in self.model.scores(f" {w} ")]
        if (
            sum(g for g, _ in new.values()) <= max(12.0, len(scores))
            or 2 * len(new) < len(words)
            or sum(x > self.model.floor for x in scores) < 0.8 * len(scores)
        ):
            return None
        at = {i: self.word(parts[i])[k][1] for i in inside if k in self.word(parts[i])}
        return "".join(at.get(i, w) for i, w in enumerate(parts))


def _widen(text: str, start: int, end: int) -> tuple[int, int]:
    """The run's characters, out to the ends of the words it touches."""
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


@dataclass
class Repaired:
    """A text as far as it can be restored, the mappings found, and single words to be judged by the corpus.

    A mapping `lost` is a replacement character beside a letter or digit.
    """

    text: str
    kinds: list[str]
    hopes: set[tuple[str, str, str]]


def repair(text: str, inverse: Inverse) -> Repaired:
    """Test inverse mappings in the improbable runs of a text, until no run changes any more."""
    kinds: list[str] = []
    seen = {text}
    while True:
        spans: list[list[int]] = []
        for a, b in improbable_runs(inverse.model.surprise(text)):
            if text[a : b + 1].isascii():
                continue
            start, end = _widen(text, a, b + 1)
            if spans and start <= spans[-1][1] + 1:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        before, hopes = text, set()
        for start, end in reversed(spans):
            low, high = max(0, start - 1), min(len(text), end + 1)  # with the spaces around it
            run = text[low:high]
            if "lost" not in kinds and LOST in run and LOST_INSIDE.search(run):
                kinds.append("lost")
            if restored := inverse.restore(run):
                text = text[:low] + restored[0] + text[high:]
                kinds.append(restored[1])
            else:
                hopes |= inverse.hopes(run)
        if text == before or text in seen:
            return Repaired(text, kinds, hopes)
        seen.add(text)


def _repairer(model: object) -> Callable:
    """(row, doc_id, content) to (row, doc_id, restored, mappings, hopes) of texts with mappings or hopes."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("new", pa.string()), ("how", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = Inverse(PairModel(*model.value))
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = repair(text, inverse)
                if r.kinds or r.hopes:
                    hopes = [dict(zip(("word", "new", "how"), h, strict=True)) for h in sorted(r.hopes)]
                    for column, value in zip(out, (row, doc, r.text, sorted(set(r.kinds)), hopes), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), kind]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row", "doc_id", "restored", "mappings", "hopes"])

    return run


def _replacer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, restored, mappings, swaps) to (doc_id, restored, mappings) with the swapped words in their places."""
    for batch in batches:
        texts, kinds = [], []
        for text, before, swaps in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            new = {s["word"]: s["new"] for s in swaps}
            parts = WORD.split(text)
            for i, part in enumerate(parts):
                if (core := part.strip(string.punctuation)) in new:
                    parts[i] = part.replace(core, new[core])
            texts.append("".join(parts))
            kinds.append(sorted({*before, *(s["how"] for s in swaps)}))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "restored", "mappings"])


def word_counts(contents: DataFrame) -> DataFrame:
    """(word, n): words with other than ASCII characters and the number of contents (distinct) that have them.

    A word is counted without the ASCII punctuation at its ends, and, if that is another one, without anything there but letters.
    """
    ends = r"!-/:-@\[-`{-~"
    odd = F.filter(F.split("content", r"\s+"), lambda w: w.rlike(r"[^\x00-\x7F]"))
    plain = F.transform(odd, lambda w: F.regexp_replace(w, rf"\A[{ends}]+|[{ends}]+\z", ""))
    bare = F.transform(odd, lambda w: F.regexp_replace(w, r"\A[^\p{L}\p{M}]+|[^\p{L}\p{M}]+\z", ""))
    return contents.select(F.explode(F.array_union(plain, bare)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def judged(hopes: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, new, how), one a word, of hopes (word, new, how): where many more contents have the new word than the old one."""
    tried = hopes.groupBy("word", "new").agg(F.min("how").alias("how"))
    new, old = counts.select(F.col("word").alias("new"), F.col("n").alias("n_new")), counts.withColumnRenamed("n", "n_old")
    good = tried.join(new, "new").join(old, "word", "left").where((F.col("n_new") >= KNOWN) & (F.col("n_new") >= TIMES * F.coalesce("n_old", F.lit(1))))
    return good.groupBy("word").agg(F.max(F.struct("n_new", "new", "how")).alias("best")).select("word", "best.new", "best.how")


def wrongly_decoded(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, mappings) of the documents (doc_id, content) with wrongly decoded parts.

    Adjacent pairs are counted over all distinct contents, without those of UTF-8 read wrongly. Of a document's pairs,
    those that contribute little to the corpus's mutual information form improbable runs (maximal-scoring segments);
    in these only, inverse mappings are tested, and kept if they make the run clearly more probable. A swap of
    one-byte encodings in a single word may be too short for that: it is kept if the corpus has the restored word in
    many more distinct contents than the word as it stands. Characters lost to U+FFFD can't be restored and stay. Null
    and empty contents, and those of ASCII only, are never cases.
    """
    text = docs.where("content is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "content")
    contents = cut(text.select("content").distinct())
    model = docs.sparkSession.sparkContext.broadcast(astuple(fit_pairs(contents)))
    odd = F.col("content").rlike("[^\\x00-\\x7F]")
    hope = "array<struct<word:string,new:string,how:string>>"
    tested = text.where(odd).select(F.monotonically_increasing_id().alias("row"), "doc_id", "content")
    first = cut(tested.mapInArrow(_repairer(model), f"row long, doc_id long, restored string, mappings array<string>, hopes {hope}"))
    hopes = first.select("row", F.inline("hopes"))
    swaps = cut(judged(hopes, word_counts(contents.where(odd))))
    rows = hopes.select("row", "word").distinct()
    sized = swaps.join(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    found = join_unique(rows, sized, "word", "n").groupBy("row").agg(F.collect_list(F.struct("word", "new", "how")).alias("swaps"))
    both = first.drop("hopes").join(found, "row", "left").where("swaps is not null or size(mappings) > 0").withColumn("swaps", F.coalesce("swaps", F.array().cast(hope)))
    return both.select("doc_id", "restored", "mappings", "swaps").mapInArrow(_replacer, "doc_id long, restored string, mappings array<string>")
