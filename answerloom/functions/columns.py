"""Small column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    """A column from a column or a column name."""
    return value if isinstance(value, Column) else F.col(value)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise before the job starts if ``df`` lacks one of ``names``."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def ranked_score(score: Column) -> Column:
    """Scores are compared on six places, so that ties are ties everywhere."""
    return F.round(score, 6)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used.

    Higher-order functions are interpreted and have no common-subexpression
    elimination, so a repeated argument would be computed again at each use and,
    inside a lambda, for each element. A lambda variable is computed once.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]
