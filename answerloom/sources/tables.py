"""Table scans, the chunk table and table writes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

SPREAD_KEY = "spark.answerloom.spread"

CHUNK_COLUMNS = "id BIGINT, source STRING, chunk_ix INT, mime_type STRING, content STRING"


def scan(
    spark: SparkSession, directory: str, name: str, spread: bool = False
) -> DataFrame:
    """One table of a parquet directory. Nothing is read until an action runs.

    ``spread`` marks work that is heavy per row. A session on one machine, whose
    files are of one row group each, may set ``SPREAD_KEY`` to a number of
    partitions that such tables are dealt out over. Where it is unset, as on a
    cluster, a table of any size is read where it lies, unshuffled.
    """
    table = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    wanted = spark.conf.get(SPREAD_KEY, None) if spread else None
    return table if wanted is None else table.repartition(int(wanted))


def table_stamp(spark: SparkSession, directory: str, name: str) -> tuple[int, int, int]:
    """Bytes, files and last change of a table's files, to tell whether it was written again."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{name}.parquet")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    summary = files.getContentSummary(path)
    return summary.getLength(), summary.getFileCount(), files.getFileStatus(path).getModificationTime()


def stream_scan(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a parquet directory as a stream: what was added since the last checkpoint.

    The last letter stands in brackets because a stream takes a plain path for a folder, while a
    pattern may name one file as well.
    """
    path = f"{directory.rstrip('/')}/{name}.parque[t]"
    return spark.readStream.schema(scan(spark, directory, name).schema).parquet(path)


def load_tables(
    spark: SparkSession, directory: str, names: Iterable[str] = TABLES
) -> dict[str, DataFrame]:
    """Several tables of a directory, also registered as temporary views."""
    tables = {name: scan(spark, directory, name) for name in names}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def stream_table(spark: SparkSession, name: str) -> DataFrame:
    """A table as a stream: rows appended since the last checkpoint."""
    return spark.readStream.table(name)


def ensure_chunk_table(spark: SparkSession, database: str, table: str) -> str:
    """Create the database and chunk table where missing and switch to them.

    Parquet tables have no identity column, so ``id`` comes from
    :func:`with_chunk_id`, which gives the same id on every run.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"USE `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{table}` ({CHUNK_COLUMNS}) USING parquet")
    return f"`{database}`.`{table}`"


def with_chunk_id(df: DataFrame, source: str = "source", ix: str = "chunk_ix") -> DataFrame:
    """Add the surrogate key ``id``, a hash of the natural key."""
    return df.withColumn("id", F.xxhash64(F.col(source), F.col(ix)))


def append_rows(df: DataFrame, table: str) -> None:
    """Append rows to a table, matching columns by name."""
    columns = df.sparkSession.table(table).columns
    df.select(*columns).write.mode("append").insertInto(table)


def overwrite_table(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table by ``df``."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table from local rows: questions, agents, rules."""
    return spark.createDataFrame(list(rows), schema)


