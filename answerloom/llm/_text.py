"""Where patterns match in a text, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.columns import let

#: Matches that are added up before they go to those found so far.
BLOCK = 256


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """``start``, ``end`` (code points from 0, end exclusive) of all matches whose text ``keep`` accepts.

    Splitting by the pattern gives what lies between its leftmost matches, so the lengths of both
    add up to the places. Matches are added up in blocks, since every addition copies what is there.
    """
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    accepts = keep or (lambda hit: F.lit(True))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["gap"]
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        good = pair["hit"].isNotNull() & accepts(pair["hit"])
        return F.struct(end.alias("at"), F.when(good, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    def block(done: Column, pairs: Column) -> Column:
        found = F.aggregate(pairs, F.struct(done["at"].alias("at"), empty.alias("spans")), step)
        return let(found, lambda f: F.struct(f["at"].alias("at"), F.concat(done["spans"], f["spans"]).alias("spans")))

    def walk(gaps: Column, hits: Column) -> Column:
        made = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).cast("bigint").alias("gap"), h.alias("hit")))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

        def blocks(pairs: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))
            return F.transform(starts, lambda at: F.slice(pairs, at, F.lit(BLOCK)))

        return F.aggregate(let(made, blocks), zero, block, lambda done: done["spans"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, empty).otherwise(walk(F.split(text, pattern, -1), h)))
