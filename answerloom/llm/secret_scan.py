"""Secrets by pattern, behind an inverted index of the trigrams that the patterns need."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import let
from answerloom.llm._text import spans
from answerloom.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The patterns asked for. Runs of hex digits of 24 and more are exactly the runs that pass the
#: length test, so the pattern says so; the same holds for access keys of 20 and more.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published token formats of some services.
FORMATS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + FORMATS
#: Strings that a stretch of a pattern may stand for; beyond, the stretch ends there.
ALTERNATIVES = 64

#: All clauses must hold, of a clause one alternative, of an alternative all trigrams.
Query = list[list[frozenset[str]]]


def _exact(tokens: Sequence, runs: list[set[str]]) -> set[str] | None:
    """The strings ``tokens`` stand for; None if too many, and then what must occur is in ``runs``."""
    now, whole = {""}, True

    def close() -> None:
        nonlocal now, whole
        runs.append(now)
        now, whole = {""}, False

    for kind, value in tokens:
        name = str(kind)
        if name == "LITERAL":
            found = {chr(value).lower()}
        elif name == "AT":
            continue
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
            codes = [range(v, v + 1) if str(k) == "LITERAL" else range(v[0], v[1] + 1) for k, v in value]
            found = {chr(c).lower() for r in codes for c in r} if sum(map(len, codes)) <= 8 else None
        elif name == "SUBPATTERN":
            inner: list[set[str]] = []
            found = _exact(value[-1], inner)
            if found is None:
                close()
                runs.extend(inner)
                continue
        elif name == "BRANCH":
            parts = [_exact(branch, []) for branch in value[1]]
            found = None if None in parts else set().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            one = _exact(body, [])
            if one is not None and (low, high) == (0, 1):
                found = one | {""}
            elif one is not None and low == high and len(one) ** low <= ALTERNATIVES:
                found = {"".join(p) for p in product(one, repeat=low)}
            else:
                found = None
        else:
            found = None
        if found is None or len(now) * len(found) > ALTERNATIVES:
            close()
            now = found or {""}
        else:
            now = {a + b for a in now for b in found}
    if whole:
        return now
    runs.append(now)
    return None


def trigram_query(pattern: str) -> Query:
    """What lower-cased trigrams a text must have to match; empty if the pattern demands none.

    Stretches of the pattern that stand for a few strings are clauses: one of the strings, hence
    all its trigrams, must occur. A stretch that may be shorter than three letters demands nothing.
    """
    runs: list[set[str]] = []
    whole = _exact(list(re._parser.parse(pattern)), runs)
    clauses: Query = []
    for run in [whole] if whole is not None else runs:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in sets:
            continue
        clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return clauses


def _postings(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """``key``, ``trigram``: the inverted index, of the trigrams that some rule asks for."""
    wanted = F.array(*map(F.lit, trigrams))
    there = let(F.lower("text"), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return texts.select("key", F.explode(there).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``key``, ``kinds``: the texts whose trigrams allow a match, and of which rules.

    Postings are intersected by counting, for every alternative, how many of its trigrams a text
    has. Texts are told by a hash, so copies share postings; two texts of one hash would only be
    looked at without need.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    asked = [
        (kind, clause, alternative, len(grams), gram)
        for kind, clauses in queries.items()
        for clause, alternatives in enumerate(clauses)
        for alternative, grams in enumerate(alternatives)
        for gram in sorted(grams)
    ]
    spark = texts.sparkSession
    schema = "kind string, clause int, alternative int, need int, trigram string"
    index = cut_lineage(_postings(texts, sorted({row[-1] for row in asked})))
    needed = spark.createDataFrame([(kind, len(clauses)) for kind, clauses in queries.items()], "kind string, clauses int")
    met = (
        index.join(F.broadcast(spark.createDataFrame(asked, schema)), "trigram")
        .groupBy("key", "kind", "clause", "alternative", "need")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = need")
        .groupBy("key", "kind")
        .agg(F.count_distinct("clause").alias("met"))
    )
    return (
        met.join(F.broadcast(needed), "kind")
        .where("met = clauses")
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _found(text: Column, rule: Rule) -> Column:
    if rule.least <= 1:
        return spans(text, rule.pattern)
    return spans(text, rule.pattern, lambda hit: F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least)


def _labelled(found: Column, rank: int, kind: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``doc_id``, ``secrets``: kind, start and end of every match, by start and then by rule.

    Matches of a rule are leftmost and do not overlap; those of which the rule's group is too
    short are dropped afterwards. A rule that demands trigrams is run over the texts the index
    names, any other over all. Null texts count as empty; copies and repeated rows all get their
    result; empty tables give an empty one; other columns are not read.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64("text")
    )
    indexed = [rule for rule in rules if trigram_query(rule.pattern)]
    named = cut_lineage(candidates(texts, indexed))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    parts = []
    for rank, rule in enumerate(rules):
        looked = F.array_contains("kinds", rule.kind) if rule in indexed else F.col("text").rlike(rule.pattern)
        placed = _labelled(_found(F.col("text"), rule), rank, rule.kind)
        parts.append(F.when(F.coalesce(looked, F.lit(False)), placed).otherwise(none))
    return texts.join(named, "key", "left").select(
        F.col("id").alias(doc_id), F.array_sort(F.concat(*parts)).alias("secrets")
    )


def as_text(secrets: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
