"""Personal data by pattern, row by row and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column, let

# The default entity types, in reporting order.
DEFAULT_ENTITIES = (
    "PERSON",
    "CREDIT_CARD",
    "PHONE_NUMBER",
    "IP_ADDRESS",
    "US_SSN",
    "US_PASSPORT",
    "US_BANK_NUMBER",
    "US_ITIN",
    "US_DRIVER_LICENSE",
    "EMAIL_ADDRESS",
    "CRYPTO",
)

GIVEN_NAMES = (
    "Alice Amanda Andrew Angela Anna Anthony Barbara Benjamin Brian Carlos Carol Charles "
    "Christopher Daniel David Deborah Donald Edward Elizabeth Emily Emma Eric Frank George "
    "Hans Helen Henry Jacob James Jane Jennifer Jessica John Jonathan Joseph Joshua Juan Julia "
    "Karen Kevin Laura Linda Lisa Maria Mark Mary Matthew Michael Michelle Nancy Nicole Oliver "
    "Pamela Patricia Patrick Paul Peter Pierre Rachel Rebecca Richard Robert Ryan Samuel Sandra "
    "Sarah Scott Sophie Stephen Steven Susan Thomas Timothy Victoria Walter William"
).split()

# (pattern, group, hint): where running a pattern costs much more than looking
# for its hint, the hint decides per text whether to run it.
PATTERNS = {
    "CREDIT_CARD": (r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b", 0, None),
    "PHONE_NUMBER": (r"\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", 0, None),
    "IP_ADDRESS": (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", 0, None),
    "US_SSN": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0, None),
    "US_PASSPORT": (r"\b[A-Z][0-9]{8}\b", 0, None),
    "US_BANK_NUMBER": (
        r"(?i)\b(?:account|acct|routing|bank|aba)\b[^0-9\n]{0,24}([0-9]{8,17})\b",
        1,
        "[0-9]{8}",
    ),
    "US_ITIN": (r"\b9[0-9]{2}-[5-9][0-9]-[0-9]{4}\b", 0, None),
    "US_DRIVER_LICENSE": (
        r"(?i)\b(?:driver'?s? licen[cs]e|driving licen[cs]e|dl)\b[^0-9\n]{0,16}\b([A-Z]?[0-9]{7,8})\b",
        1,
        "[0-9]{7}",
    ),
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}", 0, "@"),
    "CRYPTO": (r"\b(?:bc1|[13])[A-HJ-NP-Za-km-z1-9]{25,39}\b", 0, None),
}

# Persons are looked for in runs of capitalised words, which are quick to find. The repeated
# groups are possessive: the regex engine then loops where it would otherwise recurse once per
# word, so a run of any length is fine. An address has at most 64 characters before its sign,
# which bounds what is tried from each place of a long run.
CAPITALISED_RUN = r"\b[A-Z][a-z]+\.?(?: [A-Z][\p{L}\p{N}_]*\.?)++"


def person_pattern(names: Sequence[str] = GIVEN_NAMES) -> str:
    """A title or a known given name, followed by capitalised names."""
    known = "|".join(sorted(names))
    return rf"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?|{known})(?: [A-Z][a-z]+\b)++"


def _person_hits(text: Column, names: Sequence[str]) -> Column:
    runs = F.regexp_extract_all(text, F.lit(CAPITALISED_RUN), F.lit(0))
    pattern = F.lit(person_pattern(names))
    return F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, pattern, F.lit(0))))


def _labelled(entity: str, hits: Column) -> Column:
    return F.transform(
        hits,
        lambda hit, ix: F.struct(
            F.lit(entity).alias("entity"), ix.cast("bigint").alias("ix"), hit.alias("hit")
        ),
    )


def pii_hits(
    text: Column | str,
    entities: Sequence[str] = (),
    names: Sequence[str] = GIVEN_NAMES,
) -> Column:
    """``array<struct<entity, ix, hit>>`` in entity order, then text order.

    No entities given means the default ones.
    """
    text = as_column(text)
    wanted = list(entities) or list(DEFAULT_ENTITIES)
    unknown = [entity for entity in wanted if entity not in DEFAULT_ENTITIES]
    if unknown:
        raise ValueError(f"no pattern for entities {unknown}")
    found = []
    for entity in wanted:
        if entity == "PERSON":
            found.append(_labelled(entity, _person_hits(text, names)))
            continue
        pattern, group, hint = PATTERNS[entity]
        hits = _labelled(entity, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
        if hint is not None:
            seen = text.contains(hint) if hint == "@" else text.rlike(hint)
            hits = F.when(seen, hits).otherwise(F.array().cast(_HITS))
        found.append(hits)
    return F.flatten(F.array(*found))


_HITS = "array<struct<entity: string, ix: bigint, hit: string>>"


def detect_pii(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    entities: Sequence[str] = (),
    names: Sequence[str] = GIVEN_NAMES,
) -> DataFrame:
    """One row per hit: the ``keep`` columns, ``entity, ix, hit``."""
    hits = df.select(*keep, F.explode(pii_hits(text, entities, names)).alias("h"))
    return hits.select(*keep, "h.entity", "h.ix", "h.hit")


def pii_verdict(
    text: Column | str, entities: Sequence[str] = (), names: Sequence[str] = GIVEN_NAMES
) -> Column:
    """``struct<passed, message, detail>``; ``detail`` names an entity per hit."""

    def verdict(detail: Column) -> Column:
        message = F.when(
            F.size(detail) > 0, F.concat(F.lit("PII detected: "), F.array_join(detail, ", "))
        ).otherwise("No PII detected")
        return F.struct(
            (F.size(detail) == 0).alias("passed"), message.alias("message"), detail.alias("detail")
        )

    return let(F.transform(pii_hits(text, entities, names), lambda h: h["entity"]), verdict)
