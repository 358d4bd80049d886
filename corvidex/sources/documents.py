"""Document sources and the page table: (doc_id, content), one row a document, the last one loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.frames import current_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_seq, line) of text files: lines end at a line feed only, with one carriage return before it as part of the end.

    row_seq orders lines as they stand, by file, then place. Files are split by Spark, so size and number of files
    don't matter; a last line without a line feed counts.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path, lineSep="\n").select(place.alias("row_seq"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def parsed_tsv(lines: DataFrame) -> DataFrame:
    """(row_seq, doc_id, content, reason, line): of each line `doc_id TAB content`, the first tab ends the doc_id.

    reason is null and doc_id and content are there, or reason is `no tab` or `doc_id` (not an integer of up to 18
    digits) and line has the text. A null line is `no tab`.
    """
    tab = F.coalesce(F.instr("line", "\t"), F.lit(0))
    field = F.when(tab > 0, F.expr("substring(line, 1, instr(line, '\t') - 1)"))
    split = lines.select("row_seq", "line", tab.alias("tab"), F.when(field.rlike(r"\A-?[0-9]{1,18}\z"), field).cast("long").alias("doc_id"))
    reason = F.when(F.col("tab") == 0, "no tab").when(F.col("doc_id").isNull(), "doc_id")
    good = reason.isNull()
    return split.select("row_seq", "doc_id", F.when(good, F.expr("substring(line, tab + 1)")).alias("content"), reason.alias("reason"), F.when(~good, F.col("line")).alias("line"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, row_seq) of files of lines `doc_id TAB content`.

    Of a repeated doc_id every line comes out, and page_table keeps the last. Lines that do not parse are left out
    here and come out of tsv_rejects.
    """
    return parsed_tsv(read_lines(spark, path)).where("reason is null").select("doc_id", "content", "row_seq")


def tsv_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(row_seq, reason, line) of the lines that read_tsv leaves out."""
    return parsed_tsv(read_lines(spark, path)).where("reason is not null").select("row_seq", "reason", "line")


def documents(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, content) of a table with other names or more columns; rows without doc_id are dropped, null texts stay."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("content")).where("doc_id is not null")


def page_table(loads: DataFrame, order: str = "row_seq") -> DataFrame:
    """The content of each doc_id as loaded last; a content that is null now is left out, as the table holds texts only."""
    return current_rows(loads, "content", order=order).where("content is not null")


def lookup(pages: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id, content) for each wanted id, null where there is none. The ids reach the scan as a filter."""
    wanted = pages.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long")
    found = pages.where(F.col("doc_id").isin(ids))
    return wanted.join(F.broadcast(found) if len(ids) <= 1000 else found, "doc_id", "left")
