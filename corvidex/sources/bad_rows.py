"""Loading of tab-separated lines (doc_id, content) with every bad line kept and its reason named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.frames import cut, join_unique

MOST_DOC_ID = 2147483647


def structure(lines: DataFrame, line_no: str = "line_no", raw: str = "raw_line") -> DataFrame:
    """(line_no, reason, doc_field, content): the structural checks, and both fields where these pass.

    reason is `quoting`, `columns` or null. One trailing CR belongs to the line end. A content field that
    starts with a quote ends at its next quote that isn't doubled. All by position functions, so that the
    length of a line doesn't matter.
    """
    line = F.regexp_replace(F.col(raw), r"\r\z", "")
    split = lines.select(F.col(line_no).alias("line_no"), line.alias("line")).withColumn("tab", F.instr("line", "\t"))
    rest = F.when(F.col("tab") > 0, F.expr("substring(line, tab + 1)"))
    # Doubled quotes are consumed in pairs from the left, so the first quote left over closes the field.
    quoted = F.coalesce(rest.startswith('"'), F.lit(False))
    parts = split.select(
        "line_no", "tab", F.expr("substring(line, 1, tab - 1)").alias("doc_field"), rest.alias("rest"), quoted.alias("quoted")
    ).withColumn("body", F.when(F.col("quoted"), F.expr("substring(rest, 2)")))
    parts = parts.withColumn("close", F.instr(F.replace("body", F.lit('""'), F.lit("xx")), '"'))
    after = F.expr("substring(body, close + 1)")
    reason = (
        F.when(F.col("quoted") & (F.col("close") == 0), "quoting")
        .when(F.col("quoted") & (after != "") & ~after.startswith("\t"), "quoting")
        .when(F.col("tab").isNull() | (F.col("tab") == 0), "columns")
        .when(F.col("quoted") & after.startswith("\t"), "columns")
        .when(~F.col("quoted") & (F.instr("rest", "\t") > 0), "columns")
    )
    content = F.when(F.col("quoted"), F.replace(F.expr("substring(body, 1, close - 1)"), F.lit('""'), F.lit('"'))).otherwise(F.col("rest"))
    checked = parts.select("line_no", reason.alias("reason"), "doc_field", content.alias("content"))
    good = F.col("reason").isNull()
    return checked.select("line_no", "reason", F.when(good, F.col("doc_field")).alias("doc_field"), F.when(good, F.col("content")).alias("content"))


def doc_id_ok(field: Column) -> Column:
    """Whether a field is a number of ASCII digits up to MOST_DOC_ID. Leading zeros are fine."""
    digits = F.regexp_replace(field, r"\A0+(?=.)", "")
    number = F.when(field.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 10), digits).try_cast("long")
    return F.coalesce(number <= MOST_DOC_ID, F.lit(False))


def content_ok(field: Column) -> Column:
    return (F.btrim(field, F.lit(" \t\r")) != "") & (field != "\\N")


def invalid_values(fields: DataFrame) -> DataFrame:
    """(name, key, n): the values of doc_field and content that are invalid, by a 128-bit hash, and in how many lines each stands.

    Values are reduced to distinct ones by column and hash, written, and cast or checked there, each once.
    """
    both = F.array(F.struct(F.lit("doc_id").alias("name"), F.col("doc_key").alias("key"), F.col("doc_field").alias("value")), F.struct(F.lit("content").alias("name"), F.col("content_key").alias("key"), F.col("content").alias("value")))
    every = fields.where("reason is null").select(F.inline(both))
    values = cut(every.groupBy("name", "key").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n")))
    ok = F.when(F.col("name") == "doc_id", doc_id_ok(F.col("value"))).otherwise(content_ok(F.col("value")))
    return cut(values.where(~ok).select("name", "key", "n"))


def parse_lines(lines: DataFrame, line_no: str = "line_no", raw: str = "raw_line") -> DataFrame:
    """One row a line: (line_no, reason, doc_id, content); reason is null for good lines, else the rest is.

    Each distinct value of a column is cast once. Invalid values form a dictionary with their reason, which is joined
    back to the lines by hash: the few that stand in many lines are broadcast, as one may stand in a third of all,
    the others joined by a shuffle. Valid numbers need no further check: joining all of them back, too, would
    shuffle every line.

    A null line is `columns`. An empty table gives no rows. Repeated lines come out once each, by line_no.
    """
    fields = cut(structure(lines, line_no, raw).select("*", F.md5(F.encode("doc_field", "utf-8")).alias("doc_key"), F.md5(F.encode("content", "utf-8")).alias("content_key")))
    bad = invalid_values(fields)

    def looked_up(rows: DataFrame, name: str, key: str) -> DataFrame:
        own = bad.where(F.col("name") == name).select(F.col("key").alias(key), F.lit(name).alias(f"bad_{name}"), F.col("n").alias(f"n_{name}"))
        return join_unique(rows, own, key, f"n_{name}", how="left")

    joined = looked_up(looked_up(fields, "doc_id", "doc_key"), "content", "content_key")
    reason = F.coalesce("reason", "bad_doc_id", "bad_content")
    number = F.regexp_replace("doc_field", r"\A0+(?=.)", "").try_cast("long")
    return joined.select("line_no", reason.alias("reason"), F.when(reason.isNull(), number).alias("doc_id"), F.when(reason.isNull(), F.col("content")).alias("content"))
