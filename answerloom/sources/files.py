"""Whole-file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def read_files_stream(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """New files under ``path`` since the last checkpoint, one row per file.

    ``max_files`` bounds a micro-batch, so a first run over a large backlog is
    split into batches that each commit on their own.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
    )
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files under ``path`` at once, with the columns of the stream."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)
