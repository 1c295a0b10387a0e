"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores put before it until no column has that name."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def fold_of(key: str, folds: int) -> Column:
    """The fold of a row: CRC32 of its key as text, modulo ``folds``; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def map_texts(
    df: DataFrame,
    text: str,
    carry: Sequence[str],
    fields: Sequence[T.StructField],
    compute: Callable[[list[str | None]], Sequence[Sequence]],
) -> DataFrame:
    """``carry`` and one column for each of ``fields``, which ``compute`` makes of a batch's texts.

    Rows are neither moved nor dropped. ``compute`` gets one list of texts (None for null) and
    returns a list for each field. Names of ``fields`` must not be among ``carry``.
    """
    schema = T.StructType([df.schema[name] for name in carry] + list(fields))
    wanted = list(dict.fromkeys([*carry, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(field.dataType) for field in fields]
        names = [*carry, *(field.name for field in fields)]
        for batch in batches:
            at = {name: ix for ix, name in enumerate(batch.schema.names)}
            made = compute(batch.column(at[text]).to_pylist())
            columns = [batch.column(at[name]) for name in carry]
            columns += [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(*(F.col(f"`{name}`") for name in wanted)).mapInArrow(run, schema)


def checksum(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free sum of row hashes, to see whether a step changed anything."""
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(2**31))), F.lit(0)).alias("h"),
    ).first()
    return found["n"], found["h"]
