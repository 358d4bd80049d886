"""Lines that arrive in a folder, parsed batch by batch into a table of good rows and one of bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvidex.frames import cut, scratch
from corvidex.sources.bad_rows import parse_lines


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_line) of the text files of a folder, old and new; lines end at a line feed."""
    return spark.readStream.text(folder, lineSep="\n").select(F.col("value").alias("raw_line"))


def ingest(lines: DataFrame, pages: str, rejects: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append good lines (raw_line) to pages (batch, row_seq, doc_id, content) and others to rejects (batch, line_no, reason).

    row_seq is (batch, line_no), so of a doc_id the row with the greatest came last. Each batch writes to a folder of its
    own number and replaces it if it runs again, so that a restart after a lost driver neither drops nor repeats
    rows. With once it ends when all that is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            numbered = cut(batch.select(F.monotonically_increasing_id().alias("line_no"), "raw_line"))
            rows = parse_lines(numbered)
            row_seq = F.struct(F.lit(number).cast("long").alias("batch"), "line_no").alias("row_seq")
            rows.where("reason is null").select(row_seq, "doc_id", "content").write.mode("overwrite").parquet(f"{pages}/batch={number}")
            rows.where("reason is not null").select("line_no", "reason").write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
