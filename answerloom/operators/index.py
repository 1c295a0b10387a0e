"""Keeping the vector index in step with the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column
from answerloom.functions.embedding import EmbeddingModel, embed


def content_hash(text: Column | str) -> Column:
    return F.md5(as_column(text))


def sync_actions(
    source: DataFrame, index: DataFrame, key: str = "id", text: Column | str = "content"
) -> DataFrame:
    """What a sync has to do per key: ``insert``, ``update``, ``delete``, ``keep``.

    Only keys and hashes are shuffled; the texts stay behind.
    """
    new = source.select(key, content_hash(text).alias("new_hash"), F.lit(True).alias("new"))
    old = index.select(key, F.col("content_hash").alias("old_hash"), F.lit(True).alias("old"))
    # A NULL text has a NULL hash, which is no sign that the row is missing.
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "delete")
        .when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "keep")
        .otherwise("update")
    )
    return new.join(old, key, "full_outer").select(key, action.alias("action"))


def sync_index(
    source: DataFrame,
    index: DataFrame | None,
    *,
    key: str = "id",
    text: str = "content",
    columns: tuple[str, ...] = ("source",),
    model: EmbeddingModel | None = None,
    dim: int = 64,
) -> DataFrame:
    """The next version of the index: ``key, *columns, text, content_hash, embedding``.

    Rows whose text did not change keep their embedding; the model sees only
    new and changed texts. One join on the key decides both, so each text is
    shuffled once. Without an ``index`` everything is embedded.
    """
    hashed = source.select(key, *columns, text, content_hash(text).alias("content_hash"))
    if index is None:
        return hashed.withColumn("embedding", embed(text, model, dim))
    known = index.select(key, "content_hash", F.col("embedding").alias("_known"))
    joined = hashed.join(known, [key, "content_hash"], "left")
    # A text that is masked out is neither sent to Python nor seen by the model.
    unknown = F.when(F.col("_known").isNull(), F.col(text))
    return joined.select(
        *hashed.columns,
        F.coalesce("_known", embed(unknown, model, dim)).alias("embedding"),
    )


def write_index(
    spark: SparkSession, version: DataFrame, path: str, partition_by: str | None = None
) -> str:
    """Write a version to a folder of its own and return the folder.

    A version reads the one before it, so it never overwrites in place. An index
    partitioned by ``cell`` lets an approximate search skip the other cells.
    """
    writer = version.write.mode("errorifexists")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path
