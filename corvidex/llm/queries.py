"""The queries of this subpackage, by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.frames import current_rows, item_postings, table, valid_nodes
from corvidex.llm import bpe, mixing, mojibake, neardup, quality, spans, terms

Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "page_table"), "content")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return item_postings(table(spark, d, "parsed_items"))


def _all_postings(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).unionByName(valid_nodes(table(spark, d, "linked_list_nodes")))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(_pages(spark, d), table(spark, d, "common_words"))


def _p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("doc_id", "n_words", "n_chars", *[F.round(c, 6).alias(c) for c in ("mean_word", "symbol_ratio", "punct_share", "common_share")])


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(_pages(spark, d), similarity=0.6, words=3, least=8)


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    sized = bpe.count_tokens(table(spark, d, "documents"), keep=("doc_id", "source"))
    return mixing.mix_sources(sized, table(spark, d, "mix_targets"))


def _sites(spark: SparkSession, d: str) -> spans.Sites:
    return spans.anchor_sites(table(spark, d, "documents"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(terms.distinctive_terms(_postings(spark, d)))


def _p2_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = terms.distinctive_terms(_postings(spark, d))
    return rows.select("doc_id", "word", "tf", "records", F.round("weight", 6).alias("weight"))


def _p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(_all_postings(spark, d))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    sites = _sites(spark, d)
    return neardup.document_pairs(spans.shared_pairs(sites), sites.members)


def _p10_members(spark: SparkSession, d: str) -> DataFrame:
    sites = _sites(spark, d)
    return _members(spans.shared_pairs(sites), sites.members)


def _p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(_sites(spark, d)).select("doc_id", "n_chars", "n_shared", F.round("share", 6).alias("share"))


def _members(found: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, rep, links): whose copy each record is, itself included, and to how many others that one has links."""
    ends = found.select(F.col("rep_a").alias("rep")).unionByName(found.select(F.col("rep_b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.select("doc_id", "rep").join(links, "rep", "left").select("doc_id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: mojibake.wrongly_decoded(_pages(s, d)).select("doc_id"),
    "p1_restored": lambda s, d: mojibake.wrongly_decoded(_pages(s, d)),
    "p2_found": _p2_found,
    "p2_weights": _p2_weights,
    "p4_found": lambda s, d: _p4_counts(s, d).where("mark is not null").select("word", "mark"),
    "p4_counts": _p4_counts,
    "p5_found": lambda s, d: quality.not_prose(_quality(s, d)),
    "p5_quality": _quality,
    "p5_statistics": _p5_statistics,
    "p6_found": lambda s, d: neardup.document_pairs(*_near(s, d)),
    "p6_links": lambda s, d: _near(s, d)[0].select("rep_a", "rep_b", "shared", F.round("similarity", 6).alias("similarity")),
    "p6_members": lambda s, d: _members(*_near(s, d)),
    "p8_ids": lambda s, d: bpe.encode_texts(table(s, d, "documents")),
    "p9_found": lambda s, d: _mix(s, d).report.where("short").select("source"),
    "p9_mix": lambda s, d: _mix(s, d).rows,
    "p9_shares": lambda s, d: _mix(s, d).report,
    "p10_found": _p10_found,
    "p10_spans": lambda s, d: spans.shared_spans(_sites(s, d)),
    "p10_members": _p10_members,
    "p10_shares": _p10_shares,
}

_CURRENT = "current_pages as (select doc_id, content from page_table qualify row_number() over (partition by doc_id order by row_seq desc) = 1)"
_VALID = """items as (
    select word, unnest(doc_ids) as doc_id, unnest(frequencies) as frequency
    from (
        select run_no, item_no, any_value(word) as word, any_value(doc_ids) as doc_ids, any_value(frequencies) as frequencies
        from parsed_items
        where word <> '' and len(doc_ids) = posting_count and len(frequencies) = posting_count
            and len(list_filter(frequencies, lambda f: coalesce(f < 1, true))) = 0
        group by run_no, item_no
    )
), postings as (select word, doc_id, cast(frequency as bigint) as frequency from items where doc_id is not null)"""
_PAIRS = f"{_VALID}, pairs as (select doc_id, word, sum(frequency) as tf from postings group by all)"
_ALL = f"""{_VALID}, every as (
    select * from postings
    union all
    select word, doc_id, frequency from (
        select node_id, any_value(word) as word, any_value(doc_id) as doc_id, any_value(frequency) as frequency
        from linked_list_nodes where word <> '' and doc_id is not null and frequency >= 1 group by node_id
    )
), counted as (select word, cast(sum(frequency) as bigint) as occurrences, count(distinct doc_id) as records from every group by word),
marked as (
    select *, case when records < 3 then 'rare' when records >= 0.5 * (select count(distinct doc_id) from every) then 'common' end as mark from counted
)"""
_QUALITY = f"""{_CURRENT}, words as (
    select doc_id, content, list_filter(string_split_regex(content, '[ \\t\\n\\r]+'), lambda w: w <> '') as words,
        list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as lines
    from current_pages where content is not null
), stats as (
    select doc_id, len(words) as n, list_sum(list_transform(words, lambda w: length(w))) as c,
        length(content) - length(translate(content, '#$%&*+/<=>@[\\]^_`{{|}}~', '')) as symbols,
        len(lines) as n_lines, len(list_filter(lines, lambda x: x[-1] in ('.', '!', '?', '"', ')'))) as n_ends,
        len(list_filter(words, lambda w: list_contains(known, trim(lower(w), '.,;:!?"''()')))) as n_common
    from words, (select list(distinct word) as known from common_words)
)"""
_SHINGLES = f"""{_CURRENT}, tokens as (
    select doc_id, list_transform(regexp_extract_all(content, '[0-9A-Za-z]+'), lambda t: lower(t)) as t from current_pages where content is not null
), grams as (
    select distinct doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) as g from tokens where len(t) >= 3
), sizes as (select doc_id, count(*) as n from grams group by doc_id having n >= 8),
kept as (select g.doc_id, g.g, s.n from grams g join sizes s using (doc_id)),
pairs as (
    select a.doc_id as doc_id_a, b.doc_id as doc_id_b, a.n as n_a, b.n as n_b, count(*) as shared
    from kept a join kept b on a.g = b.g and a.doc_id < b.doc_id group by all
)"""

ORACLES: dict[str, str] = {
    "p2_found": f"""with {_PAIRS}, lens as (select doc_id, sum(tf) as len from pairs group by doc_id),
        corpus as (select count(*) as n, sum(len) // count(*) as avg from lens), dfs as (select word, count(*) as df from pairs group by word having count(*) >= 2),
        scored as (
            select doc_id, word, greatest(0, ln((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (1.2 * (0.25 + 0.75 * len / avg) + tf)) as score
            from pairs join dfs using (word) join lens using (doc_id), corpus
        ), ranked as (select *, row_number() over w as r, lead(score) over w as second from scored window w as (partition by doc_id order by score desc))
        select doc_id, word from ranked where r = 1 and score > 0 and score >= 1.5 * second""",
    "p2_weights": f"""with {_PAIRS}, spread as (
            select word, count(*) as records, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) as h from pairs group by word
        )
        select doc_id, word, cast(tf as bigint) as tf, records, round(ln(1 + tf) * greatest(0, 1 - greatest(0, h) / ln((select count(distinct doc_id) from pairs))), 6) as weight
        from pairs join spread using (word)""",
    "p4_found": f"with {_ALL} select word, mark from marked where mark is not null",
    "p4_counts": f"with {_ALL} select word, occurrences, records, mark from marked",
    "p5_found": f"""with {_QUALITY}
        select doc_id from stats where n < 5 or c / n < 2.5 or c / n > 12 or symbols / c > 0.10 or n_ends < 0.5 * n_lines or n_common < 0.10 * n""",
    "p5_statistics": f"""with {_QUALITY}
        select doc_id, n as n_words, c as n_chars, round(c / nullif(n, 0), 6) as mean_word, round(symbols / nullif(c, 0), 6) as symbol_ratio, round(n_ends / nullif(n_lines, 0), 6) as punct_share, round(n_common / nullif(n, 0), 6) as common_share
        from (select doc_id, n, cast(coalesce(c, 0) as integer) as c, symbols, n_lines, n_ends, n_common from stats)""",
    "p6_found": f"with {_SHINGLES} select doc_id_a, doc_id_b from pairs where shared / (n_a + n_b - shared) >= 0.6",
    "p6_links": f"""with {_SHINGLES}, sets as (select doc_id, list(g order by g) as s from kept group by doc_id), reps as (select min(doc_id) as rep from sets group by s)
        select doc_id_a as rep_a, doc_id_b as rep_b, cast(shared as integer) as shared, round(shared / (n_a + n_b - shared), 6) as similarity from pairs
        where shared / (n_a + n_b - shared) >= 0.6 and doc_id_a in (select rep from reps) and doc_id_b in (select rep from reps)""",
    "p10_found": """with windows as (
            select distinct doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: substring(text, i, 200))) as w from documents where length(text) >= 200
        )
        select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from windows a join windows b on a.w = b.w and a.doc_id < b.doc_id""",
    "p10_shares": """with windows as (
            select doc_id, i, substring(text, i, 200) as w from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)
        ), hits as (select doc_id, i from windows where w in (select w from windows group by w having count(distinct doc_id) > 1)),
        covered as (
            select doc_id, sum(least(200, following - i)) as n from (select *, coalesce(lead(i) over (partition by doc_id order by i), i + 200) as following from hits) group by doc_id
        )
        select doc_id, length(text) as n_chars, cast(coalesce(n, 0) as bigint) as n_shared, round(coalesce(n, 0) / length(text), 6) as share
        from documents left join covered using (doc_id) where length(text) >= 200""",
}
