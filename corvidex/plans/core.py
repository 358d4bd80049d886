"""The queries of the core, by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.frames import table, valid_items, valid_nodes
from corvidex.operators.eager import eager_join_totals, heavy_keys
from corvidex.sources.bad_rows import parse_lines

Query = Callable[[SparkSession, str], DataFrame]


def _word_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, postings and summed frequencies of every word, with those of its nodes and of their join."""
    frequency = F.aggregate("frequencies", F.lit(0).cast("long"), lambda a, f: a + f).alias("frequency")
    items = valid_items(table(spark, d, "parsed_items"), F.col("word"), F.col("posting_count"), frequency)
    nodes = valid_nodes(table(spark, d, "linked_list_nodes"))
    return eager_join_totals(items, nodes, "word", {"postings": "posting_count", "frequency": "frequency"}, {"node_frequency": "frequency"})


QUERIES: dict[str, Query] = {
    "p3_found": lambda s, d: heavy_keys(_word_totals(s, d), "word", "postings", 25),
    "p3_totals": _word_totals,
    "p7_found": lambda s, d: parse_lines(table(s, d, "collection_lines")).where("reason is not null").select("line_no", "reason"),
    "p7_rows": lambda s, d: parse_lines(table(s, d, "collection_lines")).where("reason is null").select("line_no", "doc_id", "content"),
}

_ITEMS = """items as (
    select word, posting_count, frequencies from (
        select run_no, item_no, any_value(word) as word, any_value(posting_count) as posting_count, any_value(frequencies) as frequencies
        from parsed_items
        where word <> '' and len(doc_ids) = posting_count and len(frequencies) = posting_count
            and len(list_filter(frequencies, lambda f: coalesce(f < 1, true))) = 0
        group by run_no, item_no
    )
), i as (
    select word, count(*) as left_rows, cast(sum(posting_count) as bigint) as postings, cast(coalesce(sum(list_sum(frequencies)), 0) as bigint) as frequency from items group by word
), n as (
    select word, count(*) as right_rows, cast(sum(frequency) as bigint) as node_frequency from (
        select node_id, any_value(word) as word, any_value(frequency) as frequency
        from linked_list_nodes where word <> '' and doc_id is not null and frequency >= 1 group by node_id
    ) group by word
), totals as (
    select word, coalesce(left_rows, 0) as left_rows, coalesce(right_rows, 0) as right_rows, coalesce(postings, 0) as postings,
        coalesce(frequency, 0) as frequency, coalesce(node_frequency, 0) as node_frequency
    from i full join n using (word)
)"""
_LINES = r"""l as (
    select line_no, raw_line is null as missing, case when raw_line like '%' || chr(13) then raw_line[:-2] else raw_line end as line from collection_lines
), f as (
    select *, instr(line, chr(9)) as tab, case when instr(line, chr(9)) > 0 then substr(line, instr(line, chr(9)) + 1) end as rest from l
), q as (
    select *, case when rest[1] = '"' then substr(rest, 2) end as body,
        case when rest[1] = '"' then instr(replace(substr(rest, 2), '""', 'xx'), '"') end as stop from f
), p as (
    select line_no, substr(line, 1, tab - 1) as id,
        case when body is not null then replace(substr(body, 1, stop - 1), '""', '"') else rest end as content,
        case when stop = 0 or (stop > 0 and substr(body, stop + 1) <> '' and substr(body, stop + 1, 1) <> chr(9)) then 'quoting'
            when tab is null or tab = 0 or (stop > 0 and substr(body, stop + 1) <> '') or (body is null and contains(rest, chr(9))) then 'columns' end as shape
    from q
), parsed as (
    select line_no, id, content, coalesce(shape,
        case when not regexp_full_match(id, '[0-9]+') or length(ltrim(id, '0')) > 10 or coalesce(try_cast(id as hugeint) > 2147483647, true) then 'doc_id' end,
        case when trim(content, ' ' || chr(9) || chr(13)) = '' or content = '\N' then 'content' end) as reason
    from p
)"""

ORACLES: dict[str, str] = {
    "p3_found": f"with {_ITEMS} select word from totals where postings > 0 and postings * 40 >= (select sum(postings) from totals)",
    "p3_totals": f"""with {_ITEMS} select *, left_rows * right_rows as join_rows, postings * right_rows as join_postings,
        frequency * right_rows as join_frequency, node_frequency * left_rows as join_node_frequency from totals""",
    "p7_found": f"with {_LINES} select line_no, reason from parsed where reason is not null",
    "p7_rows": f"with {_LINES} select line_no, cast(id as bigint) as doc_id, content from parsed where reason is null",
}
