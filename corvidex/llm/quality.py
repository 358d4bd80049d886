"""Per-document text statistics, and line labels (prose, list, table, junk) by a hidden Markov model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.frames import broadcast_if_small, cut

SPACE = " \t\n\r"
SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~"
LINE_ENDS = '.!?")'
WORD_EDGES = ".,;:!?\"'()"
STATES = ("prose", "list", "table", "junk")

VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýąęóœăîâаеёиоуыэюяіїєαεηιουωάέήίόύώ"
LONG_TOKEN = 25

# A line is observed by these features, independent of each other within a state. Of each, the shares of its values
# in lines of prose, lists, tables and junk from which fitting starts.
FEATURES = {
    "words (1-2, 3-7, 8 and more)": ((0.05, 0.25, 0.70), (0.35, 0.50, 0.15), (0.15, 0.50, 0.35), (0.45, 0.30, 0.25)),
    "ends like a sentence (no, yes)": ((0.10, 0.90), (0.90, 0.10), (0.95, 0.05), (0.90, 0.10)),
    "starts like an item (no, yes)": ((0.97, 0.03), (0.20, 0.80), (0.90, 0.10), (0.95, 0.05)),
    "has cell separators (no, yes)": ((0.98, 0.02), (0.95, 0.05), (0.15, 0.85), (0.90, 0.10)),
    "share of letters (up to 0.5, 0.8, 1)": ((0.02, 0.18, 0.80), (0.10, 0.30, 0.60), (0.35, 0.45, 0.20), (0.50, 0.30, 0.20)),
    "characters a word (under 2.5, 8, 12, more)": ((0.02, 0.93, 0.04, 0.01), (0.10, 0.75, 0.10, 0.05), (0.30, 0.60, 0.07, 0.03), (0.30, 0.20, 0.10, 0.40)),
    "vowels of letters (under 0.25 or none for long, up to 0.6, more)": ((0.03, 0.94, 0.03), (0.15, 0.75, 0.10), (0.30, 0.60, 0.10), (0.55, 0.30, 0.15)),
    "words repeat (no, yes)": ((0.92, 0.08), (0.90, 0.10), (0.75, 0.25), (0.50, 0.50)),
    "has a very long word (no, yes)": ((0.99, 0.01), (0.97, 0.03), (0.97, 0.03), (0.75, 0.25)),
    "share of common words (0, up to 0.15, more)": ((0.08, 0.17, 0.75), (0.60, 0.20, 0.20), (0.80, 0.10, 0.10), (0.90, 0.05, 0.05)),
}
SIZES = [len(x[0]) for x in FEATURES.values()]
STEPS = [int(x) for x in np.cumprod([1, *SIZES])]
N_SYMBOLS = STEPS[-1]
STAY = 0.85
START_DOCUMENTS = 50  # documents of each state that the start counts as: of no account in a corpus
UNIT = 1_000_000  # what a document counts, over all its lines: whole numbers add up alike in any order
MOST_ROUNDS = 30


def values_of(symbols: np.ndarray) -> list[np.ndarray]:
    """The value of each feature in lines' symbols."""
    return [symbols // step % size for step, size in zip(STEPS, SIZES, strict=False)]


def emissions(shares: list[np.ndarray]) -> np.ndarray:
    """Of each state, the probability of each symbol, from each feature's shares of values (state, value)."""
    return np.prod([f[:, v] for f, v in zip(shares, values_of(np.arange(N_SYMBOLS)), strict=True)], axis=0)


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities before any text is seen."""
    move = np.full((4, 4), (1 - STAY) / 3)
    np.fill_diagonal(move, STAY)
    return np.full(4, 0.25), move, emissions([np.array(x) for x in FEATURES.values()])


def viterbi(lines: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of each sequence of symbols; all sequences advance together, ties go to the earlier state."""
    start, move, emit = (np.log(x) for x in model)
    order = np.argsort([-len(x) for x in lines], kind="stable")
    lengths = np.array([len(lines[i]) for i in order], dtype=int)
    n = int((lengths > 0).sum())
    out: list[np.ndarray] = [np.empty(0, int)] * len(lines)
    if not n:
        return out
    score = start + emit[:, [lines[i][0] for i in order[:n]]].T
    back: list[np.ndarray] = []
    final = np.empty((n, 4))
    final[:] = score
    for t in range(1, lengths[0]):
        m = int(np.searchsorted(-lengths[:n], -t, "left"))  # sequences longer than t
        step = score[:m, :, None] + move[None]
        back.append(step.argmax(1).astype(np.int8))
        score = step.max(1) + emit[:, [lines[i][t] for i in order[:m]]].T
        final[:m] = score
    state = final.argmax(1)
    paths = [np.empty(k, int) for k in lengths[:n]]
    for t in range(lengths[0] - 1, -1, -1):
        m = int(np.searchsorted(-lengths[:n], -t, "left"))
        for i in range(m):
            paths[i][t] = state[i]
        if t:
            state[:m] = back[t - 1][np.arange(m), state[:m]]
    for i, path in zip(order[:n], paths, strict=True):
        out[i] = path
    return out


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(x, dtype=int) for x in batch.column("symbols").to_pylist()]


def _counter(model: tuple) -> Callable:
    """(symbols, n) to counts under the model: of states at the start, of moves, and of each feature's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emits = np.zeros(4, int), np.zeros((4, 4), int), np.zeros((4, N_SYMBOLS), int)
        for batch in batches:
            lines = _symbols(batch)
            for symbols, path, n in zip(lines, viterbi(lines, model), batch.column("n").to_pylist(), strict=True):
                if len(path):
                    n = n * UNIT // len(path)
                    starts[path[0]] += n
                    np.add.at(moves, (path[:-1], path[1:]), n)
                    np.add.at(emits, (path, symbols), n)
        values = values_of(np.arange(N_SYMBOLS))
        each = [np.stack([[e[v == x].sum() for x in range(size)] for e in emits]).ravel() for v, size in zip(values, SIZES, strict=True)]
        flat = np.concatenate([starts, moves.ravel(), *each]).astype(np.int64)
        yield pa.record_batch([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["cell", "n"])

    return run


def _labeller(model: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = viterbi(_symbols(batch), model)
            counts = np.array([np.bincount(p, minlength=4) for p in paths]).reshape(-1, 4)
            whole = counts.sum(1)
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "symbols"]
            shares = [pa.array(counts[:, k] / np.maximum(whole, 1), mask=whole == 0) for k in range(4)]
            yield pa.record_batch([*columns, *shares], names=[*(x for x in batch.schema.names if x != "symbols"), *(f"{s}_share" for s in STATES)])

    return run


def fit(symbols: DataFrame, most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi training over all documents: label with the model so far and count, until the counts stay.

    A document counts the same whatever its number of lines, the start as START_DOCUMENTS of each state, so that one without
    lines keeps its meaning. Equal sequences of symbols are labelled once. A task sends 124 numbers.
    """
    sequences = cut(symbols.where("size(symbols) > 0").groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    model, before = prior(), None
    start, move, _ = model
    shares = [np.array(x) for x in FEATURES.values()]
    edges = np.cumsum([20, *(4 * size for size in SIZES)])
    for _ in range(most_rounds):
        cells = dict(sequences.mapInArrow(_counter(model), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
        flat = np.array([cells.get(i, 0) for i in range(edges[-1])], float)
        if before is not None and np.abs(flat - before).sum() <= 1e-3 * flat[edges[0] : edges[1]].sum():
            break
        before = flat
        seen = [flat[:4], flat[4:20].reshape(4, 4), *(flat[a:b].reshape(4, -1) for a, b in zip(edges, edges[1:], strict=False))]
        new = [s / UNIT + START_DOCUMENTS * p for s, p in zip(seen, [start, move, *shares], strict=True)]
        new = [x / x.sum(-1, keepdims=True) for x in new]
        model = new[0], new[1], emissions(new[2:])
    return model


def _line(line: Column, known: Callable[[Column], Column]) -> Column:
    """(symbol, hits) of a line: its features as one number, and how many of its words are known ones."""
    words = F.filter(F.split(line, "[ \t\r]+"), lambda w: w != "")

    def observed(w: Column) -> Column:
        n, solid = F.size(w), F.length(F.translate(line, " \t\r", ""))
        parts = F.struct(
            n.alias("n"),
            solid.alias("solid"),
            F.length(F.regexp_replace(line, r"\P{L}+", "")).alias("letters"),
            F.length(F.regexp_replace(F.lower(line), f"[^{VOWELS}]+", "")).alias("vowels"),
            F.size(F.array_distinct(w)).alias("distinct"),
            F.array_max(F.transform(w, lambda x: F.length(x))).alias("longest"),
            F.size(F.filter(w, known)).alias("hits"),
        )
        return F.transform(F.array(parts), coded)[0]

    def coded(p: Column) -> Column:
        yes = lambda c: F.when(c, 1).otherwise(0)
        values = [
            F.when(p["n"] <= 2, 0).when(p["n"] <= 7, 1).otherwise(2),
            yes(F.substring(line, -1, 1).isin(*LINE_ENDS)),
            yes(line.rlike(r"\A(?:[-*•·–]|[0-9]{1,3}[.)]|[0-9]{1,3} -|[A-Za-z][.)])[ \t]")),
            yes(line.rlike(r"\||\t|\.{4,}| [·»>] ")),
            F.when(p["letters"] <= 0.5 * p["solid"], 0).when(p["letters"] <= 0.8 * p["solid"], 1).otherwise(2),
            F.when(p["solid"] < 2.5 * p["n"], 0).when(p["solid"] < 8 * p["n"], 1).when(p["solid"] < 12 * p["n"], 2).otherwise(3),
            F.when((p["vowels"] < 0.25 * p["letters"]) | (p["letters"] == 0), 0).when(p["vowels"] <= 0.6 * p["letters"], 1).otherwise(2),
            yes(p["distinct"] < 0.7 * p["n"]),
            yes(p["longest"] > LONG_TOKEN),
            F.when(p["hits"] == 0, 0).when(p["hits"] <= 0.15 * p["n"], 1).otherwise(2),
        ]
        return F.struct(sum((v * step for v, step in zip(values, STEPS, strict=False)), F.lit(0)).cast("int").alias("symbol"), p["hits"].alias("hits"))

    return F.transform(F.array(words), observed)[0]


def text_quality(docs: DataFrame, common: DataFrame, most_words: int = 20_000) -> DataFrame:
    """One row a document with content (doc_id, content): statistics of its words and lines, and its label shares.

    Columns: doc_id, n_words, n_chars, mean_word, symbol_ratio, punct_share, common_share, <label>_share for
    each label. White space is space, tab, LF, CR. Ratios over nothing (no words, no lines) are null; documents
    with null content give no row. common has a column `word`; up to most_words distinct ones are compared
    as a set within the scan, more are joined. Labels come from a hidden Markov model over lines (see FEATURES and fit).
    """
    text = docs.where("content is not null").select("doc_id", "content")
    plain = F.translate("content", SPACE, "")
    words = F.filter(F.split("content", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    known = common.select("word").where("word is not null").distinct()
    listed = [r[0] for r in known.limit(most_words + 1).collect()]
    stripped = lambda w: F.btrim(F.lower(w), F.lit(WORD_EDGES))
    marked = lambda w: stripped(w).isin(listed) if listed else F.lit(False)
    if len(listed) > most_words:
        # Of each document, the known ones among its distinct words.
        every = text.select("doc_id", F.explode(F.array_distinct(F.transform(words, stripped))).alias("word"))
        found = every.join(broadcast_if_small(known), "word").groupBy("doc_id").agg(F.collect_list("word").alias("_known"))
        text = text.join(found, "doc_id", "left")
        marked = lambda w: F.coalesce(F.array_contains("_known", stripped(w)), F.lit(False))
    observed = text.select("*", F.transform(lines, lambda x: _line(x, marked)).alias("_lines"))
    counted = observed.select(
        "doc_id",
        F.size(words).alias("n_words"),
        F.length(plain).alias("n_chars"),
        (F.length("content") - F.length(F.translate("content", SYMBOLS, ""))).alias("n_symbols"),
        F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.substring(x, -1, 1).isin(*LINE_ENDS))).alias("n_ends"),
        F.aggregate("_lines", F.lit(0), lambda total, x: total + x["hits"]).alias("n_common"),
        F.transform("_lines", lambda x: x["symbol"]).alias("symbols"),
    )
    counted = cut(counted)
    labelled = counted.mapInArrow(_labeller(fit(counted)), ", ".join(f"{n} {t}" for n, t in counted.dtypes if n != "symbols") + "".join(f", {s}_share double" for s in STATES))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return labelled.select(
        "doc_id",
        "n_words",
        "n_chars",
        ratio("n_chars", "n_words").alias("mean_word"),
        ratio("n_symbols", "n_chars").alias("symbol_ratio"),
        ratio("n_ends", "n_lines").alias("punct_share"),
        ratio("n_common", "n_words").alias("common_share"),
        *(f"{s}_share" for s in STATES),
    )


def not_prose(quality: DataFrame) -> DataFrame:
    """doc_ids of text_quality rows outside the fixed bounds of natural prose."""
    rules = [F.col("n_words") < 5, F.col("mean_word") < 2.5, F.col("mean_word") > 12, F.col("symbol_ratio") > 0.10, F.col("punct_share") < 0.5, F.col("common_share") < 0.10]
    hit = rules[0]
    for rule in rules[1:]:
        hit = hit | F.coalesce(rule, F.lit(False))
    return quality.where(hit).select("doc_id")
