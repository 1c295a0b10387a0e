"""Files to raw table to chunk table, each step with a checkpoint of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.chunking import chunk_array
from answerloom.functions.text import mime_type, parse_document, why_unreadable
from answerloom.sources import read_files_stream, stream_table, with_chunk_id

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def append_available(df: DataFrame, table: str, checkpoint: str) -> None:
    """Append what a stream has now to a table, then stop.

    The checkpoint and the sink's log commit each micro-batch once, also when
    the job or an executor is lost half-way and the run is repeated.
    """
    (
        df.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .format("parquet")
        .toTable(table)
        .awaitTermination()
    )


def append_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """:func:`append_available` to a parquet folder instead of a table."""
    (
        df.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .format("parquet")
        .start(path)
        .awaitTermination()
    )


def run_ingest_job(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    max_files: int | None = None,
) -> None:
    """Append the files that are new since the last run, with their MIME type."""
    files = read_files_stream(spark, path, max_files=max_files)
    append_available(files.withColumn("mime_type", mime_type("path")), table, checkpoint)


def chunk_rows(
    raw: DataFrame, size: int = 500, overlap: int = 10, partitions: int | None = None
) -> DataFrame:
    """Raw files to rows of the chunk table. :func:`rejected_rows` has the files that give none.

    ``partitions`` spreads a few large input files over more tasks.
    """
    spread = raw if partitions is None else raw.repartition(partitions)
    parsed = spread.select(
        F.col("path").alias("source"), "mime_type", parse_document("content").alias("parsed")
    ).where(F.col("parsed").isNotNull())
    chunks = parsed.select(
        "source",
        "mime_type",
        F.posexplode(chunk_array("parsed", size, overlap)).alias("chunk_ix", "content"),
    )
    return with_chunk_id(chunks).select("id", "source", "chunk_ix", "mime_type", "content")


def rejected_rows(raw: DataFrame) -> DataFrame:
    """``source, mime_type, reason`` of the raw files that cannot be read as a document."""
    reason = why_unreadable("content")
    return raw.select(F.col("path").alias("source"), "mime_type", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def run_chunk_job(
    spark: SparkSession,
    raw_table: str,
    chunk_table: str,
    checkpoint: str,
    size: int = 500,
    overlap: int = 10,
    arrow_rows: int = 10,
    partitions: int | None = None,
    reject_table: str | None = None,
) -> None:
    """Chunk the raw rows that are new since the last run.

    Documents are large, so Arrow batches are kept to ``arrow_rows`` of them;
    the session's own setting is put back afterwards. Files that cannot be read
    are appended to ``reject_table`` with the reason, by a stream of its own.
    """
    if reject_table is not None:
        rejected = rejected_rows(stream_table(spark, raw_table))
        append_available(rejected, reject_table, f"{checkpoint.rstrip('/')}-rejects")
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        chunks = chunk_rows(stream_table(spark, raw_table), size, overlap, partitions)
        append_available(chunks, chunk_table, checkpoint)
    finally:
        spark.conf.set(ARROW_ROWS, before)
