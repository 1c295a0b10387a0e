from __future__ import annotations

import re

import duckdb

from answerloom.llm import mixing as M
from answerloom.llm.queries import OP2_SQL


def test_water_filling_by_hand(spark):
    rows = [("0a", 10, 5), ("0b", 1000, 2), ("0c", 1000, 1), ("1", 0, 5)]
    got = {r.source_key: r.target for r in M.water_fill(spark.createDataFrame(rows, "source_key string, source_size bigint, weight int")).collect()}
    assert got["0a"] == 30 and got["1"] == 0
    assert abs(got["0b"] - 1980 * 2 / 3) < 1e-6 and abs(got["0c"] - 1980 / 3) < 1e-6


def test_awkward_rows(spark, awkward, nothing):
    rows = M.mix_counts(awkward).collect()
    assert len(rows) == awkward.count()
    for row, (text,) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), [(r.text,) for r in awkward.orderBy("doc_id").collect()][1:] + [(awkward.where("doc_id is null").first().text,)], strict=True):
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert row.taken <= 3 * row["size"]
    again = M.mix_counts(awkward.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert M.mix_counts(nothing).collect() == [] and M.mix(nothing).collect() == []


def test_taken_is_near_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = M.mix_counts(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = found.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= max(30, 0.05 * r["max(target)"]) for r in sums)


def test_mixed_rows_agree_with_the_counts(spark, awkward):
    taken = {str(r.doc_id): r.taken // r["size"] for r in M.mix_counts(awkward).collect() if r["size"]}
    times = {}
    for row in M.mix(awkward).collect():
        times[str(row.doc_id)] = times.get(str(row.doc_id), 0) + 1
    times["2"] = times.get("2", 0) // 2
    assert {k: n for k, n in taken.items() if n} == {k: n for k, n in times.items() if n and k in taken}


def test_skewed_sources_equal_sql(spark):
    """One source with most rows, sources of one row, a null source, ties of size."""
    rows = [(i, " ".join(["w"] * (i % 7)), "big") for i in range(400)]
    rows += [(1000 + i, "w " * (50 * i + 1), f"s{i}") for i in range(9)] + [(2000 + i, "a b c", None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix_counts(docs).collect()}
    documents = docs.toPandas()  # noqa: F841
    expected = {r[0]: (r[1], r[2], round(r[3], 6), r[4]) for r in duckdb.sql(f"WITH documents AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents) SELECT doc_id, size, source_size, target, taken FROM ({OP2_SQL})").fetchall()}
    assert got == expected


def test_sums_that_meet_the_remainder_equal_sql(spark):
    """Equal one-word documents: the running sum of a bucket of keys often is exactly what is to be drawn."""
    rows = [(100 * s + i, "w", f"s{s:02}") for s in range(24) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix_counts(docs).collect()}
    documents = docs.toPandas()  # noqa: F841
    expected = {r[0]: (r[1], r[2], round(r[3], 6), r[4]) for r in duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({OP2_SQL})").fetchall()}
    wrong = {key // 100 for key in got if got[key] != expected[key]}
    assert not wrong, f"{len(wrong)} of 24 sources differ"
    assert len(got) == len(expected) == len(rows)


def test_a_remainder_of_all_words_draws_every_document(spark):
    rows = spark.createDataFrame([("0a", k, 1) for k in ("0" * 32, "7" * 32, "f" * 32)], "source_key string, key string, size bigint")
    sources = spark.createDataFrame([("0a", 3, 3)], "source_key string, source_size bigint, left bigint")
    assert rows.join(M._cuts(rows, sources), "source_key").where("key <= cut").count() == 3
