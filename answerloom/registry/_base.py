"""The list of checked queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``run(spark, directory)`` under ``name``.

    ``sql`` is the same result in standard SQL over the same tables, written
    from the definition of the operator and not from its Spark plan.
    """

    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Entry(name, run, sql)
        return run

    return add
