from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int"


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog while nobody looks at all today"
    rows = [
        (1, prose, "en", "a", 5, 0.5, 1),
        (2, prose, "en", "a", 5, None, 1),
        (2, prose, "en", "a", 5, None, 1),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 0.1, 2),
        (5, " \t\n", "de", "b", 3, 0.1, 2),
        (6, "word " * 60_000, "de", "c", 1, 0.1, 2),
        (7, "x" * 200_000, "fr", "c", 1, 0.1, 2),
        (None, "kein Schlüssel und doch ein Text mit einigen Wörtern darin", "de", None, 1, 0.1, 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
