"""Top-k search over scored postings (term, doc_id, score), or over a written index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.frames import broadcast_if_small, cut, is_small, join_unique, numbered
from corvidex.functions.scoring import dequantize
from corvidex.functions.text import query_terms, terms_of
from corvidex.operators.blocks import best_in_blocks
from corvidex.operators.index import Index

K = 20
LEAD = 50  # documents of a block, for each of the k, whose scores set the first bar of a batch query
MOST_WHOLE = 50_000_000  # rows of all terms, lists times queries: few enough to add up without a bar
MOST_JOINED = 1_000_000  # rows of one term, list times queries, in one task
BLOCK_POSTINGS = 2_000_000  # of the documents that a task scores at once


def _mode(mode: str) -> str:
    if mode not in ("and", "or"):
        raise ValueError("mode must be 'and' or 'or'")
    return mode


def rejected(query: str | None) -> str | None:
    """Why a query gives no rows whatever the index: `empty` or `no terms`; null for a query with terms."""
    if query is None or not query.strip():
        return "empty"
    return None if terms_of(query) else "no terms"


def _matches(scores: DataFrame, query: str, mode: str) -> DataFrame:
    terms = terms_of(query)
    found = scores.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(terms)) if _mode(mode) == "and" else found


def search(scores: DataFrame, query: str, mode: str = "or", k: int = K) -> DataFrame:
    """(rank, doc_id, score): the k best documents with all (`and`) or any (`or`) of the query's distinct terms.

    scores are (term, doc_id, score). The score of a document is the sum over its matching terms; terms that
    count 0 still match. Ordered by the score to 6 decimals, then by doc_id. A term that no document has leaves
    nothing of an `and` query and is ignored by an `or` query; a query that is `rejected` gives no rows.
    """
    best = _matches(scores, query, mode).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


def known_scores(index: Index, query: str, mode: str = "or") -> DataFrame:
    """(term, doc_id, score) of a written index to search for the query: none if an `and` query has a term that the lexicon has not."""
    terms = terms_of(query)
    if _mode(mode) == "and" and index.lexicon.where(F.col("term").isin(terms)).count() < len(terms):
        return byte_scores(index.postings.where("false"))
    return byte_scores(index.postings)


def search_index(index: Index, query: str, mode: str = "or", k: int = K) -> DataFrame:
    """search over a written index; the lexicon is asked first."""
    return search(known_scores(index, query, mode), query, mode, k)


def count_matches(index: Index, query: str) -> DataFrame:
    """(mode, n_docs): how many documents match the query by each mode, with scores of 0, too."""
    n = F.count(F.lit(1)).alias("n_docs")
    both = [_matches(known_scores(index, query, mode), query, mode).agg(n).select(F.lit(mode).alias("mode"), "n_docs") for mode in ("and", "or")]
    return both[0].unionByName(both[1])


def with_content(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits of search with the text of each, null where the page is gone. There are at most k hits."""
    rows = hits.collect()
    found = pages.where(F.col("doc_id").isin([r["doc_id"] for r in rows])).select("doc_id", "content")
    return hits.sparkSession.createDataFrame(rows, hits.schema).join(F.broadcast(found), "doc_id", "left").select("rank", "doc_id", "score", "content")


def batch_terms(queries: DataFrame) -> DataFrame:
    """(item, term, n_terms) of queries (item, text): the distinct terms of each."""
    split = queries.select("item", query_terms(F.col("text")).alias("terms"))
    return split.select("item", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def search_batch(index: Index, queries: DataFrame, mode: str = "or", k: int = K) -> DataFrame:
    """(item, rank, doc_id, score): search_index for each query (item, text; items are unique) in one plan.

    Lists are joined whole with the queries that have their term only if that gives at most MOST_WHOLE rows in all, and
    either way the rows are the same. Else an `and` query starts from the documents of
    its rarest term, and `or` queries are scored in blocks of documents, of which only the k best of each query
    are shuffled. Terms with many documents and queries are split.
    """
    _mode(mode)
    batch = batch_terms(queries)
    counts = batch.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(1), F.least(F.col("df"), F.ceil(F.col("df") * F.col("n") / MOST_JOINED))).cast("int")
    known = cut(index.lexicon.join(counts, "term").select("term", "n", "df", parts.alias("parts")))
    whole = (known.agg(F.sum(F.col("df") * F.col("n"))).first()[0] or 0) <= MOST_WHOLE
    if mode == "or" and not whole:
        return _search_blocks(index, batch, known.drop("parts"), k)
    wanted = join_unique(batch, known, "term", "n")
    item = Window.partitionBy("item")
    if mode == "and":
        wanted = wanted.withColumn("known", F.count(F.lit(1)).over(item)).where("known = n_terms")
        wanted = wanted.withColumn("first", F.row_number().over(item.orderBy("df", "term")) == 1)
    wanted = cut(wanted.drop("n"))
    scores = byte_scores(index.postings)
    hot = broadcast_if_small(known.where("parts > 1").select("term", "parts"))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int"))
    salted = scores.join(hot, "term", "left").select("term", "doc_id", "score", salt.alias("salt"))

    def matches(terms: DataFrame) -> DataFrame:
        """(item, doc_id, score, n) over these rows of wanted; the list of a hot term is split, its queries are repeated."""
        met = salted.join(terms.select("item", "term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")), ["term", "salt"])
        return met.groupBy("item", "doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))

    total = matches(wanted) if whole else _completed(cut(matches(wanted.where("first"))), wanted.where("not first"), scores)
    if mode == "and":
        total = total.join(wanted.where("first").select("item", "n_terms"), "item").where("n = n_terms")
    return _ranked(total.select("item", "doc_id", F.round("score", 6).alias("score")), "item", k)


def _ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """(key, rank, doc_id, score): the k best rows of each key."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(key, "rank", "doc_id", "score")


def _search_blocks(index: Index, batch: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """search_batch by `or`: batch as of batch_terms, known (term, n, df) the terms of the lexicon that it has, by n queries."""
    lists = cut(numbered(known, "no", "term").withColumn("no", F.col("no").cast("int")))
    n_postings = lists.agg(F.sum("df")).first()[0] or 0
    n_blocks = max(index.postings.sparkSession.sparkContext.defaultParallelism, -(-n_postings // BLOCK_POSTINGS))
    asked = join_unique(batch, lists, "term", "n").groupBy("item").agg(F.array_sort(F.collect_list("no")).alias("terms"))
    asked = cut(asked.withColumn("query", F.monotonically_increasing_id()))
    numbers = lists.select("term", "no", "df")
    found = index.postings.join(F.broadcast(numbers), "term") if is_small(numbers) else join_unique(index.postings, numbers, "term", "df")
    best = best_in_blocks(found.select("no", "doc_id", "q"), asked.select("query", "terms"), n_blocks, k, LEAD * k)
    return _ranked(best, "query", k).join(asked.select("query", "item"), "query").select("item", "rank", "doc_id", "score")


def _completed(found: DataFrame, others: DataFrame, scores: DataFrame) -> DataFrame:
    """found (item, doc_id, score, n) with what the other terms of the items add to these documents."""
    lists = scores.join(broadcast_if_small(others.select("term").distinct()), "term", "left_semi")
    more = found.select("item", "doc_id").join(others.select("item", "term"), "item").join(lists, ["term", "doc_id"])
    every = found.unionByName(more.select("item", "doc_id", "score", F.lit(1).cast("long").alias("n")))
    return every.groupBy("item", "doc_id").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))


def next_geq(postings: DataFrame, terms: list[str], targets: list[int]) -> DataFrame:
    """(term, target, doc_id): the first document of the term from target on, -1 if there is none. One pass for all targets."""
    firsts = [F.struct(F.lit(t).cast("long").alias("target"), F.min(F.when(F.col("doc_id") >= t, F.col("doc_id"))).alias("doc_id")) for t in targets]
    rows = postings.where(F.col("term").isin(terms)).groupBy("term").agg(F.array(*firsts).alias("all")).select("term", F.explode("all").alias("r"))
    return rows.select("term", "r.target", F.coalesce("r.doc_id", F.lit(-1)).cast("long").alias("doc_id"))


def lookup_terms(lexicon: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, start_chunk, end_chunk) of the lexicon for each term, with nulls for one that it hasn't."""
    wanted = lexicon.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    found = lexicon.where(F.col("term").isin(terms)).select("term", "df", "start_chunk", "end_chunk")
    return wanted.join(F.broadcast(found), "term", "left")


def byte_scores(index: DataFrame) -> DataFrame:
    """(term, doc_id, score) of postings with one-byte scores."""
    return index.select("term", "doc_id", dequantize(F.col("q")).alias("score"))
