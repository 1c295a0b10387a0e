"""Column mapping, ordered limits and ordered numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerloom.functions.columns import require_columns
from answerloom.session import cut_lineage


def map_columns(df: DataFrame, **new_from_old: str) -> DataFrame:
    """Rename ``old`` to ``new``; a missing column is an error, not a no-op."""
    require_columns(df, new_from_old.values())
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def head_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key``; each task keeps ``n`` rows at most."""
    return df.orderBy(key).limit(n)


def numbered(df: DataFrame, order_by: Sequence[str], number: str) -> DataFrame:
    """Add the place of each row in the order of all rows, from 0, without a task that gets them all.

    Rows are dealt out by ranges and numbered within their range; what lies in the ranges before is
    one count for each of them. Rows that are equal in ``order_by`` are numbered in any order.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id())
    )
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.orderBy("_range"))
    before = counts.select("_range", (upto - F.col("_rows")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by))
    return (
        placed.withColumn("_within", within)
        .join(before, "_range")
        .withColumn(number, F.col("_before") + F.col("_within") - 1)
        .drop("_range", "_within", "_before")
    )
