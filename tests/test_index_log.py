from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerloom.operators import index_log
from answerloom.operators import search as S
from answerloom.operators.index import sync_index
from answerloom.operators.index_log import NO_CELL, IndexLog
from answerloom.session import new_folder as fresh_folder
from answerloom.session import rename_folder


def source(spark, rows):
    return spark.createDataFrame([(k, f"s{k}", t) for k, t in rows.items()], "id bigint, source string, content string")


def state(log, spark):
    return {r.id: (r.source, r.content) for r in log.live(spark).collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.dictionaries(st.integers(0, 12), st.sampled_from(["one", "two words", "", "three more words"]), max_size=9), st.booleans()),
        min_size=3,
        max_size=4,
    )
)
def test_any_history_reads_as_its_last_state(spark, history):
    log = IndexLog(fresh_folder(spark, "log"), buckets=3)
    versions = []
    for rows, compacted in history:
        versions.append(log.sync(source(spark, rows)))
        assert state(log, spark) == {k: (f"s{k}", t) for k, t in rows.items()}
        if compacted:
            log.compact(spark, 0.0)
            assert state(log, spark) == {k: (f"s{k}", t) for k, t in rows.items()}
    assert versions == sorted(versions)


def test_a_small_change_writes_little_and_embeds_little(spark):
    seen = spark.sparkContext.accumulator(0)

    def model():
        def encode(texts):
            seen.add(len(texts))
            return np.array([[len(t), t.count("e")] for t in texts], float)

        return encode

    log = IndexLog(fresh_folder(spark, "log"), buckets=4)
    rows = {k: f"text number {k}" for k in range(1000)}
    assert log.sync(source(spark, rows), model=model, dim=2) == 1 and seen.value == 1000
    rows |= {5: "changed", 17: "changed too", 2000: "new"}
    del rows[100], rows[101]
    assert log.sync(source(spark, rows), model=model, dim=2) == 2 and seen.value == 1003
    written = {(r.kind, r.rows) for r in log.entries(spark).where("version = 2").groupBy("kind").agg(F.sum("rows").alias("rows")).collect()}
    assert written == {("delta", 3), ("gone", 4)}
    assert log.sync(source(spark, rows), model=model, dim=2) == 2 and seen.value == 1003  # nothing to do
    assert {r.id: (r.source, r.content) for r in log.live(spark).collect()} == {k: (f"s{k}", t) for k, t in rows.items()}
    full = sync_index(source(spark, rows), None, model=model, dim=2)
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 2.0])], "query_id int, embedding array<double>")
    again = sorted(map(tuple, S.topk(asked, log.live(spark), 7, columns=["content"]).collect()))
    assert again == sorted(map(tuple, S.topk(asked, full, 7, columns=["content"]).collect()))


def test_compaction_rewrites_only_full_buckets(spark):
    log = IndexLog(fresh_folder(spark, "log"), buckets=4)
    rows = {k: f"text {k}" for k in range(400)}
    log.sync(source(spark, rows))
    where = {r.id: r.bucket for r in log.live(spark).select("id", "bucket").collect()}
    hot = [k for k, bucket in where.items() if bucket == 2][:60]
    rows |= {k: f"new {k}" for k in hot}
    log.sync(source(spark, rows))
    assert log.compact(spark, 0.2) == 3
    based = log.entries(spark).where("version = 3 and kind = 'base'").collect()
    assert [(r.bucket, r.rows) for r in based] == [(2, sum(b == 2 for b in where.values()))]
    assert state(log, spark) == {k: (f"s{k}", t) for k, t in rows.items()}
    assert log.compact(spark, 0.2) == 3  # nothing is left to do
    rows[hot[0]] = "once more"
    del rows[hot[1]]
    assert log.sync(source(spark, rows)) == 4 and state(log, spark) == {k: (f"s{k}", t) for k, t in rows.items()}
    everything = {}
    log.sync(source(spark, everything))
    log.compact(spark, 0.0)
    assert state(log, spark) == {}
    log.sync(source(spark, {1: "back"}))
    assert state(log, spark) == {1: ("s1", "back")}


def test_cells_prune_and_bounds_hold(spark):
    draw = np.random.default_rng(2)

    def model():
        return lambda texts: np.array([[float(x) for x in t.split()] for t in texts])

    def rows(n, salt=0):
        centres = np.random.default_rng(1).normal(size=(5, 3)) * 6
        return {k: " ".join(f"{x:.4f}" for x in centres[k % 5] + np.random.default_rng(k + salt).normal(size=3)) for k in range(n)}

    first = rows(300)
    vectors = spark.createDataFrame([(k, [float(x) for x in t.split()]) for k, t in first.items()], "id bigint, embedding array<double>")
    centroids = S.train_centroids(vectors, 5)
    log = IndexLog(fresh_folder(spark, "log"))
    log.sync(source(spark, first), centroids=centroids, model=model, dim=3)
    second = first | {k: v for k, v in rows(330, 999).items() if k % 10 == 0}
    second.pop(7)
    log.sync(source(spark, second), model=model, dim=3)
    with pytest.raises(ValueError, match="first sync"):
        log.sync(source(spark, first), centroids=centroids, model=model, dim=3)
    asked = spark.createDataFrame([(i, [float(x) for x in draw.normal(size=3)]) for i in range(6)], "query_id int, embedding array<double>")
    live, known = log.live(spark), log.centroids(spark)
    exact = sorted(map(tuple, S.topk(asked, live, 4).collect()))
    assert sorted(map(tuple, S.topk_pruned(asked, live, known, 4, radii=log.radii(spark)).collect())) == exact
    assert sorted(map(tuple, S.topk_ann(asked, live, known, 4, nprobe=5).collect())) == exact
    plan = live.where("cell = 3").select("id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "content:" not in plan.split("ReadSchema")[1].split("\n")[0]
    log.compact(spark, 0.0)
    assert sorted(map(tuple, S.topk(asked, log.live(spark), 4).collect())) == exact


def test_awkward_sources(spark):
    log = IndexLog(fresh_folder(spark, "log"), buckets=2)
    with pytest.raises(ValueError, match="nothing was synced"):
        log.live(spark)
    empty = source(spark, {}) if False else spark.createDataFrame([], "id bigint, source string, content string")
    assert log.sync(empty) == 1 and log.live(spark).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "s", ""), (None, "s", "no key")], "id bigint, source string, content string")
    assert log.sync(odd) == 2
    assert {r.id: (r.source, r.content, r.embedding is None) for r in log.live(spark).collect()} == {1: (None, None, True), 2: ("s", "", False)}
    assert NO_CELL not in {r.bucket for r in log.live(spark).collect()}


def test_a_version_is_taken_once(spark):
    folder = fresh_folder(spark, "names")
    for name in ("a", "b"):
        spark.range(1).write.parquet(f"{folder}/{name}")
    assert rename_folder(spark, f"{folder}/a", f"{folder}/log/version=1")
    assert not rename_folder(spark, f"{folder}/b", f"{folder}/log/version=1")
    assert spark.read.parquet(f"{folder}/b").count() == 1


def test_cells_cost_no_second_copy_of_the_texts(spark, monkeypatch):
    """Texts go straight from their model to their bucket, and the model sees each once."""
    seen = spark.sparkContext.accumulator(0)

    def model():
        def encode(texts):
            seen.add(len(texts))
            return np.array([[len(t), t.count("e")] for t in texts], float)

        return encode

    rows = {k: "e" * (k % 9) + "x" * (k % 40) for k in range(700)}
    centroids = spark.createDataFrame([(0, [5.0, 1.0]), (1, [20.0, 4.0]), (2, [35.0, 8.0])], "cell int, centroid array<double>")
    log = IndexLog(fresh_folder(spark, "log"))
    monkeypatch.setattr(index_log, "cut_lineage", None)
    assert log.sync(source(spark, rows), centroids=centroids, model=model, dim=2) == 1
    assert seen.value == 700 and state(log, spark) == {k: (f"s{k}", t) for k, t in rows.items()}
    vector = lambda t: [len(t), t.count("e")]
    nearest = lambda t: min((round((vector(t)[0] - c[0]) ** 2 + (vector(t)[1] - c[1]) ** 2, 6), n) for n, c in enumerate([(5, 1), (20, 4), (35, 8)]))[1]
    assert {r.id: r.cell for r in log.live(spark).select("id", "cell").collect()} == {k: nearest(t) for k, t in rows.items()}
