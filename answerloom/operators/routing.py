"""Classifying questions and sending them to handlers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column, let
from answerloom.functions.text import token_array

Rules = Sequence[tuple[str, Sequence[str]]]
Handler = Callable[[DataFrame], DataFrame]


def keyword_route(text: Column | str, rules: Rules) -> Column:
    """The first rule with a keyword among the words of the text, else NULL."""
    words = F.transform(token_array(text), lambda w: F.regexp_replace(w, r"^\W+|\W+$", ""))

    def first_hit(words: Column) -> Column:
        route = F.lit(None).cast("string")
        for name, keywords in reversed(list(rules)):
            hit = F.arrays_overlap(words, F.array(*[F.lit(k.lower()) for k in keywords]))
            route = F.when(hit, name).otherwise(route)
        return route

    return let(words, first_hit)


def normal_route(answer: Column | str, allowed: Sequence[str], default: str) -> Column:
    """A classifier's answer as one of the allowed routes, else ``default``."""
    cleaned = F.lower(F.trim(as_column(answer), F.lit(" \t\n\r\f")))
    return F.when(cleaned.isin(list(allowed)), cleaned).otherwise(F.lit(default))


def classify_route(
    df: DataFrame,
    text: str,
    rules: Rules,
    allowed: Sequence[str],
    default: str = "general",
    classifier: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``route``. ``classifier`` maps the text column to an answer column."""
    answer = classifier(F.col(text)) if classifier else keyword_route(text, rules)
    return df.withColumn("route", normal_route(answer, allowed, default))


def dispatch(
    df: DataFrame,
    route: str,
    handlers: Mapping[str, Handler],
    default: str,
    then: Handler | None = None,
) -> DataFrame:
    """Send each route's rows through its handler, then all of them through ``then``.

    Rows without a route, or with one that no handler has, go to the handler of ``default``, so no
    row is lost. Every handler must return the same columns. The input is read once per
    route, so cache it or write it first where it is costly to compute; where
    handlers are plain expressions :func:`dispatch_columns` reads it once.
    """
    if default not in handlers:
        raise ValueError(f"the default route {default!r} needs a handler")
    known = F.col(route).isin(list(handlers))
    taken = F.when(known, F.col(route)).otherwise(F.lit(default))
    parts = [handler(df.where(taken == name)) for name, handler in handlers.items()]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return then(joined) if then else joined


def dispatch_columns(
    route: Column | str, handlers: Mapping[str, Column], default: Column | None = None
) -> Column:
    """The expression of each row's route, evaluated in one pass; ``default`` for all other routes."""
    route = as_column(route)
    result = F.lit(None) if default is None else default
    for name, value in handlers.items():
        result = F.when(route == name, value).otherwise(result)
    return result


def step_trace(updates: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Updates per step to one row per message.

    ``updates`` has ``steps: array<struct<node, messages: array<...>>>``; the
    result has the ``keep`` columns and ``step, node, ix, message``.
    """
    stepped = updates.select(*keep, F.posexplode("steps").alias("step", "s"))
    return stepped.select(
        *keep, "step", "s.node", F.posexplode("s.messages").alias("ix", "message")
    )


def agent_names(agents: DataFrame) -> list[str]:
    """Names of a registry, in its order. A registry is a handful of rows."""
    return [row["name"] for row in agents.select("name").collect()]


def agent_tools(agents: DataFrame) -> DataFrame:
    """All tools of a registry: ``name, tool_ix, tool``."""
    return agents.select("name", F.posexplode("tools").alias("tool_ix", "tool"))
