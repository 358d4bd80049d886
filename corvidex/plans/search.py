"""The queries of the search engine, by name, and SQL that gives the same rows.

The corpus is the table `documents`; batch queries are the words of each language, pairs of these, and every
document whose id is divisible by 50. Searches read an index that the first of them writes to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.frames import cut, item_postings, keep_until_exit, new_path, table
from corvidex.functions.codec import vbyte_hex, vbyte_value
from corvidex.operators import corpus, index, search
from corvidex.sources import documents as sources

Query = Callable[[SparkSession, str], DataFrame]

Q = "coastal garden of the river"
ONE = "garden"
MISSING = "garden zzzzqq river"
ABSENT = "zzzzqq"
IDS = [5000000000, 5000000003, 5000000006, 5000000001, 77]
TARGETS = [0, 5000000100, 5000000555, 5000001000, 5999999999]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return sources.documents(table(spark, d, "documents"))


def _impacts(spark: SparkSession, d: str, **how: bool) -> DataFrame:
    return index.impacts(docs(spark, d), **how)


_written: dict[tuple, index.Index] = {}


def opened(spark: SparkSession, d: str) -> index.Index:
    """The index of the table `documents` in d, written once in a session and for each set of files."""
    key = (spark.sparkContext.applicationId, tuple(sorted(table(spark, d, "documents").inputFiles())))
    if key not in _written:
        path = new_path(spark)
        keep_until_exit(spark, path)
        index.write_index(docs(spark, d), path)
        _written[key] = index.open_index(spark, path)
    return _written[key]


def _search(query: str, mode: str) -> Query:
    return lambda s, d: search.search_index(opened(s, d), query, mode)


def _search_with_content(spark: SparkSession, d: str) -> DataFrame:
    return search.with_content(_search(Q, "or")(spark, d), opened(spark, d).pages)


def _list_places(spark: SparkSession, d: str) -> DataFrame:
    lexicon = opened(spark, d).lexicon
    return index.list_places(lexicon, index.file_starts(lexicon.withColumnRenamed("end_chunk", "chunk_no")), [*search.terms_of(Q), ABSENT])


def _scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The raw lines as a text file, read back."""
    path = new_path(spark)
    keep_until_exit(spark, path)
    table(spark, d, "collection_lines").where("raw_line is not null").select("raw_line").write.text(path, lineSep="\n")
    return sources.parsed_tsv(sources.read_lines(spark, path)).select("doc_id", "content", "reason", "line")


def _language_queries(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "common_words").where("word is not null and lang is not null")
    return words.groupBy(F.col("lang").alias("item")).agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("text"))


def _pair_queries(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "common_words").where("word is not null and lang is not null").distinct()
    following = F.lead("word").over(Window.partitionBy("lang").orderBy("word"))
    text = words.select("lang", F.concat_ws(" ", "word", following).alias("text"))
    return text.select(F.concat_ws(": ", "lang", "text").alias("item"), "text")


def _document_queries(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("item"), F.col("content").alias("text"))


def _batch(of: Query, mode: str) -> Query:
    return lambda s, d: search.search_batch(opened(s, d), of(s, d), mode)


def _sticky_search(spark: SparkSession, d: str) -> DataFrame:
    terms = search.terms_of(Q)
    return search.search(index.decoded(index.impacts(docs(spark, d), terms, shifted=True), sticky_zero=True), Q)


def _arranged(spark: SparkSession, d: str) -> DataFrame:
    return index.arranged(cut(corpus.postings(docs(spark, d))))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_directory(_arranged(spark, d))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return index.placed(_arranged(spark, d)).select("term", "doc_id", "chunk_in_term", "gap", "vbyte_len")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select(F.col("gap").alias("value")).distinct()


def _rounded(name: str, score: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: score(_impacts(s, d)).select("term", "doc_id", (F.round(name, 6) + F.lit(0.0)).alias("score"))


QUERIES: dict[str, Query] = {
    "scan_documents": docs,
    "scan_tsv": _scan_tsv,
    "page_table": lambda s, d: sources.page_table(table(s, d, "page_table")),
    "doc_lookup": lambda s, d: sources.lookup(docs(s, d), IDS),
    "tokenize": lambda s, d: corpus.tokenize(docs(s, d)),
    "query_terms": lambda s, d: search.batch_terms(_document_queries(s, d)).select("item", "term"),
    "doc_lengths": lambda s, d: corpus.doc_lengths(docs(s, d)),
    "postings": lambda s, d: corpus.postings(docs(s, d)).select("term", "doc_id", "tf"),
    "term_df": lambda s, d: corpus.term_df(corpus.postings(docs(s, d))),
    "corpus_stats": lambda s, d: corpus.corpus_stats(docs(s, d)),
    "bm25_impacts": _rounded("score", lambda x: x),
    "quantized_impacts": lambda s, d: _impacts(s, d).select("term", "doc_id", "q"),
    "dequantized_impacts": _rounded("score", index.decoded),
    "search_or": _search(Q, "or"),
    "search_and": _search(Q, "and"),
    "search_single_term": _search(ONE, "or"),
    "search_or_missing_term": _search(MISSING, "or"),
    "search_with_content": _search_with_content,
    "search_batch_or": _batch(_language_queries, "or"),
    "search_batch_and": _batch(_pair_queries, "and"),
    "search_documents": _batch(_document_queries, "or"),
    "result_counts": lambda s, d: search.count_matches(opened(s, d), Q),
    "lexicon_lookup": lambda s, d: search.lookup_terms(opened(s, d).lexicon, [*search.terms_of(Q), ABSENT]),
    "list_places": _list_places,
    "next_geq": lambda s, d: search.next_geq(opened(s, d).postings, search.terms_of(Q), TARGETS),
    "lexicon_chunks": lambda s, d: index.lexicon(corpus.term_df(corpus.postings(docs(s, d)))).select("term", "start_chunk", "end_chunk"),
    "chunk_directory": _chunks,
    "block_directory": lambda s, d: index.block_directory(cut(_chunks(s, d))),
    "docid_gaps": _gaps,
    "docid_gaps_decoded": lambda s, d: index.undo_gaps(index.placed(_arranged(s, d))),
    "vbyte_encode": lambda s, d: _values(s, d).select("value", vbyte_hex(F.col("value")).alias("hex")),
    "vbyte_roundtrip": lambda s, d: _values(s, d).select("value", vbyte_value(vbyte_hex(F.col("value"))).alias("decoded")),
    "segment_runs": lambda s, d: corpus.segment_postings(docs(s, d)).groupBy("segment").agg(F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings")),
    "merged_postings": lambda s, d: corpus.merge_runs(corpus.segment_postings(docs(s, d))),
    "merged_items": lambda s, d: corpus.merge_runs(item_postings(table(s, d, "parsed_items")).select(F.col("word").alias("term"), "doc_id", F.col("frequency").alias("tf"))),
    "index_stats": lambda s, d: index.index_stats(_arranged(s, d)),
    "bm25_impacts_shifted": lambda s, d: _impacts(s, d, shifted=True).select("term", "doc_id", "q"),
    "dequantized_sticky": _rounded("score", lambda x: index.decoded(x, sticky_zero=True)),
    "search_or_compat": _sticky_search,
}


def _list(query: str) -> str:
    return "(" + ", ".join(f"'{t}'" for t in search.terms_of(query)) + ")"


def _corpus(shifted: bool = False) -> str:
    length = "coalesce(b.doc_len, 0)" if shifted else "p.doc_len"
    join = "left join docs b on b.doc_id = p.doc_id - 1" if shifted else ""
    return f"""with docs as (
    select doc_id, text as content, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) as doc_len from documents where doc_id is not null
), stats as (select count(*) as n, cast(sum(doc_len) as bigint) as total, cast(sum(doc_len) // count(*) as bigint) as avg from docs),
tok as (select doc_id, doc_len, unnest(regexp_extract_all(content, '[0-9A-Za-z]+')) as term from docs),
post as (select term, doc_id, count(*) as tf, any_value(doc_len) as doc_len from tok group by term, doc_id),
lex as (select term, count(*) as df from post group by term),
raw as (
    select p.term, p.doc_id, p.tf, l.df, ln((n - df + 0.5) / (df + 0.5)) * (2.2 * tf) / (1.2 * (0.25 + 0.75 * ({length} / greatest(avg, 1))) + tf) as score
    from post p join lex l using (term) {join}, stats
), imp as (select *, cast(case when score <= 0 then 0 else floor(log2(score + 1) * 36.06) end as integer) as q from raw),
deq as (select term, doc_id, case when q = 0 then 0.0 else pow(2, q / 36.06) - 1 end as score from imp),
ranged as (select *, sum(n_chunks) over (order by term) as stop from (select term, df, (df + 127) // 128 as n_chunks from lex)),
chunks as (select term, df, cast(stop - n_chunks + 1 as bigint) as start_chunk, cast(stop as bigint) as end_chunk from ranged),
numbered as (select *, (row_number() over (partition by term order by doc_id) - 1) as position from imp),
put as (select *, position // 128 as chunk_in_term, position % 128 as place from numbered),
gaps as (select *, doc_id - coalesce(lag(doc_id) over (partition by term, chunk_in_term order by doc_id), 0) as gap from put),
sized as (select *, case {" ".join(f"when gap < {1 << 7 * k} then {k}" for k in range(1, 9))} else 9 end as vbyte_len from gaps),
dir as (
    select start_chunk + chunk_in_term as chunk_no, term, count(*) as n_postings, max(doc_id) as last_doc_id, cast(sum(vbyte_len + 1) as bigint) as n_bytes
    from sized join chunks using (term) group by start_chunk, chunk_in_term, term
), sticky as (
    select term, doc_id, case when max(case when q = 0 then 1 else 0 end) over (partition by term, chunk_in_term order by place) = 1 then 0.0 else pow(2, q / 36.06) - 1 end as score from put
)
"""


def _top(query: str, mode: str = "or", source: str = "deq", shifted: bool = False) -> str:
    n = len(search.terms_of(query))
    every = f"having count(*) = {n}" if mode == "and" else ""
    return f"""{_corpus(shifted)} select cast(row_number() over (order by score desc, doc_id) as integer) as rank, doc_id, score
        from (select doc_id, round(sum(score), 6) as score from {source} where term in {_list(query)} group by doc_id {every}) order by score desc, doc_id limit 20"""


def _batch_sql(queries: str, mode: str) -> str:
    every = "having count(*) = any_value(n_terms)" if mode == "and" else ""
    return f"""{_corpus()}, queries as ({queries}), terms as (
        select item, unnest(t) as term, len(t) as n_terms from (select item, list_distinct(regexp_extract_all(text, '[0-9A-Za-z]+')) as t from queries)
    ), hits as (select item, doc_id, round(sum(score), 6) as score from deq join terms using (term) group by item, doc_id {every})
    select item, cast(row_number() over (partition by item order by score desc, doc_id) as integer) as rank, doc_id, score from hits
    qualify row_number() over (partition by item order by score desc, doc_id) <= 20"""


_HEX = "list_aggregate(list_transform(range(vbyte_len), lambda i: printf('%02X', ((gap >> (7 * i)) & 127) + case when i < vbyte_len - 1 then 128 else 0 end)), 'string_agg', '')"

ORACLES: dict[str, str] = {
    "scan_documents": "select doc_id, text as content from documents where doc_id is not null",
    "scan_tsv": r"""with l as (select unnest(string_split(raw_line, chr(10))) as raw from collection_lines where raw_line is not null),
        c as (select case when raw like '%' || chr(13) then raw[:-2] else raw end as line from l), t as (select line, instr(line, chr(9)) as tab from c),
        p as (select line, tab, case when tab > 0 and regexp_full_match(substr(line, 1, tab - 1), '-?[0-9]{1,18}') then cast(substr(line, 1, tab - 1) as bigint) end as doc_id from t)
        select doc_id, case when doc_id is not null then substr(line, tab + 1) end as content,
            case when tab = 0 then 'no tab' when doc_id is null then 'doc_id' end as reason, case when doc_id is null then line end as line from p""",
    "page_table": "select doc_id, content from (select * from page_table qualify row_number() over (partition by doc_id order by row_seq desc) = 1) where doc_id is not null and content is not null",
    "doc_lookup": f"select w.doc_id, text as content from (select unnest({IDS}::bigint[]) as doc_id) w left join documents d on w.doc_id = d.doc_id",
    "tokenize": _corpus() + "select doc_id, term from tok",
    "query_terms": "select doc_id as item, unnest(list_distinct(regexp_extract_all(text, '[0-9A-Za-z]+'))) as term from documents where doc_id % 50 = 0",
    "doc_lengths": _corpus() + "select doc_id, doc_len from docs",
    "postings": _corpus() + "select term, doc_id, tf from post",
    "term_df": _corpus() + "select term, df from lex",
    "corpus_stats": _corpus() + "select n as n_docs, total as total_len, avg as avg_doc_len from stats",
    "bm25_impacts": _corpus() + "select term, doc_id, round(score, 6) + 0.0 as score from imp",
    "quantized_impacts": _corpus() + "select term, doc_id, q from imp",
    "dequantized_impacts": _corpus() + "select term, doc_id, round(score, 6) + 0.0 as score from deq",
    "search_or": _top(Q),
    "search_and": _top(Q, "and"),
    "search_single_term": _top(ONE),
    "search_or_missing_term": _top(MISSING),
    "search_with_content": f"select rank, doc_id, score, text as content from ({_top(Q)}) left join documents using (doc_id)",
    "search_batch_or": _batch_sql("select lang as item, string_agg(word, ' ' order by word) as text from (select distinct lang, word from common_words) where word is not null and lang is not null group by lang", "or"),
    "search_batch_and": _batch_sql(
        """select lang || ': ' || text as item, text from (
            select lang, concat_ws(' ', word, lead(word) over (partition by lang order by word)) as text
            from (select distinct lang, word from common_words) where word is not null and lang is not null)""",
        "and",
    ),
    "search_documents": _batch_sql("select doc_id as item, content as text from docs where doc_id % 50 = 0", "or"),
    "result_counts": _corpus() + f""", m as (select doc_id, count(*) as n from imp where term in {_list(Q)} group by doc_id)
        select 'and' as mode, count(*) as n_docs from m where n = {len(search.terms_of(Q))} union all select 'or', count(*) from m""",
    "list_places": _corpus() + f"""select term, cast(0 as bigint) as file_no, (start_chunk - 1) // 64 as first_block, (end_chunk - 1) // 64 as last_block
        from chunks where term in {_list(Q)}""",
    "lexicon_lookup": _corpus() + f"select w.term, df, start_chunk, end_chunk from (select unnest({[*search.terms_of(Q), ABSENT]}) as term) w left join chunks using (term)",
    "next_geq": _corpus() + f"""select term, target, coalesce(min(doc_id) filter (where doc_id >= target), -1) as doc_id
        from post, (select unnest({TARGETS}::bigint[]) as target) where term in {_list(Q)} group by term, target""",
    "lexicon_chunks": _corpus() + "select term, start_chunk, end_chunk from chunks",
    "chunk_directory": _corpus() + "select * from dir",
    "block_directory": _corpus() + "select cast(0 as bigint) as file_no, (chunk_no - 1) // 64 as block_no, count(*) as n_chunks, cast(sum(n_bytes) as bigint) as payload_bytes from dir group by 2",
    "docid_gaps": _corpus() + "select term, doc_id, chunk_in_term, gap, cast(vbyte_len as bigint) as vbyte_len from sized",
    "docid_gaps_decoded": _corpus() + "select term, doc_id from post",
    "vbyte_encode": _corpus() + f"select distinct gap as value, {_HEX} as hex from sized",
    "vbyte_roundtrip": _corpus() + "select distinct gap as value, gap as decoded from sized",
    "segment_runs": _corpus() + """, w as (select min(doc_id) as low, greatest(1, (max(doc_id) - min(doc_id) + 8) // 8) as width from docs)
        select cast((doc_id - low) // width as bigint) as segment, count(distinct term) as n_terms, count(*) as n_postings from post, w group by 1""",
    "merged_postings": _corpus() + "select term, doc_id, tf from post",
    "merged_items": """with items as (
            select word, unnest(doc_ids) as doc_id, unnest(frequencies) as frequency from (
                select run_no, item_no, any_value(word) as word, any_value(doc_ids) as doc_ids, any_value(frequencies) as frequencies
                from parsed_items
                where word <> '' and len(doc_ids) = posting_count and len(frequencies) = posting_count
                    and len(list_filter(frequencies, lambda f: coalesce(f < 1, true))) = 0
                group by run_no, item_no))
        select word as term, doc_id, cast(sum(frequency) as bigint) as tf from items where doc_id is not null group by all""",
    "index_stats": _corpus() + """select count(distinct term) as n_terms, cast(sum(n_postings) as bigint) as n_postings, count(*) as n_chunks,
        cast(ceil(max(chunk_no) / 64) as bigint) as n_blocks, cast(sum(n_bytes) as bigint) as payload_bytes from dir""",
    "bm25_impacts_shifted": _corpus(shifted=True) + "select term, doc_id, q from imp",
    "dequantized_sticky": _corpus() + "select term, doc_id, round(score, 6) + 0.0 as score from sticky",
    "search_or_compat": _top(Q, source="sticky", shifted=True),
}
