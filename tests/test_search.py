from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.functions.embedding import embed
from answerloom.operators import search as S
from answerloom.operators._nearest import TopK
from answerloom.operators.index import content_hash, sync_actions, sync_index, write_index


def brute(queries, corpus, k):
    out = []
    for qid, q in queries:
        scored = sorted(
            (-round(float(np.dot(np.float64(q), np.float64(v))), 6), key) for key, v in corpus
        )
        out += [(qid, n + 1, key, -s + 0.0) for n, (s, key) in enumerate(scored[:k])]
    return sorted(out)


def rows(df):
    return sorted((*r[:3], round(r[3], 6) + 0.0) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    # Few distinct values, so that ties are common; one vector is a third of all.
    values = rng.integers(-2, 3, size=(200, 4)).astype(float)
    values[:70] = values[0]
    corpus = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    queries = [(100 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(9, 4)))]
    return (
        queries,
        corpus,
        spark.createDataFrame(queries, "query_id long, embedding array<double>"),
        spark.createDataFrame(corpus, "id long, embedding array<double>").repartition(7),
    )


@pytest.mark.parametrize("k", [1, 5, 300])
def test_topk_equals_brute_force(small, k):
    queries, corpus, q, c = small
    assert rows(S.topk(q, c, k)) == brute(queries, corpus, k)


def test_blocks_equal_scan(small, monkeypatch):
    queries, corpus, q, c = small
    monkeypatch.setattr(S, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    assert rows(S.topk(q, c, 5, max_sent_queries=0)) == brute(queries, corpus, 5)


def test_ann_with_all_cells_is_exact(small):
    queries, corpus, q, c = small
    centroids = S.train_centroids(c, 6)
    index = S.assign_cells(c, centroids)
    expected = brute(queries, corpus, 5)
    assert rows(S.topk_ann(q, index, centroids, 5, nprobe=6)) == expected
    few = S.topk_ann(q, index, centroids, 5, nprobe=1)
    shares = [r.recall for r in S.recall(few, S.topk(q, c, 5), "query_id", "id").collect()]
    assert len(shares) == 9 and all(0 <= share <= 1 for share in shares)


@pytest.mark.parametrize("sent", [100, 0])
def test_pruned_search_is_exact(small, sent):
    queries, corpus, q, c = small
    centroids = S.train_centroids(c, 8)
    index = S.assign_cells(c, centroids)
    got = S.topk_pruned(q, index, centroids, 5, max_sent_queries=sent)
    assert rows(got) == brute(queries, corpus, 5)


def test_more_centroids_than_can_be_sent(spark, small, monkeypatch):
    """Searched in blocks they give the same cells, and the searches the same rows."""
    queries, corpus, q, c = small
    centroids = S.train_centroids(c, 8)
    more = c.union(spark.createDataFrame([(999, None)], c.schema))
    sent = S.with_cells(more, centroids, nprobe=3).orderBy("id").collect()
    monkeypatch.setattr(S, "MAX_SENT_CELLS", 7)
    monkeypatch.setattr(S, "CORPUS_BLOCK", 3)
    monkeypatch.setattr(S, "QUERY_BLOCK", 64)
    assert S.with_cells(more, centroids, nprobe=3).orderBy("id").collect() == sent
    with pytest.raises(ValueError, match="with_cells"):
        S.nearest_cells("embedding", centroids)
    index = S.assign_cells(c, centroids)
    expected = brute(queries, corpus, 5)
    assert rows(S.topk_ann(q, index, centroids, 5, nprobe=8)) == expected
    assert rows(S.topk_pruned(q, index, centroids, 5)) == expected


def test_string_keys_nulls_and_columns(spark):
    corpus = spark.createDataFrame(
        [("b", [1.0, 0.0], "B"), ("a", [1.0, 0.0], "A"), ("n", None, "N"), ("z", [0.0, 1.0], None)],
        "id string, embedding array<float>, text string",
    )
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<float>"
    )
    for sent in (10, 0):
        got = S.topk(queries, corpus, 2, columns=["text"], max_sent_queries=sent)
        assert got.columns == ["query_id", "rk", "id", "text", "score"]
        assert sorted(map(tuple, got.collect())) == [(1, 1, "a", "A", 1.0), (1, 2, "b", "B", 1.0)]
    nothing = S.topk(queries.where("query_id = 2"), corpus, 2)
    assert nothing.collect() == []
    only_z = S.topk(queries, corpus, 2, where="id = 'z'")
    assert [r.id for r in only_z.collect()] == ["z"]


def test_relevant_sources_ranks_first_and_compares_strictly(spark):
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>")
    corpus = spark.createDataFrame(
        [(i, [s]) for i, s in enumerate([0.95, 0.9, 0.8, 0.85, 0.81, 0.82])],
        "id int, embedding array<double>",
    )
    got = S.relevant_sources(queries, corpus, 5, 0.8)
    assert sorted(r.id for r in got.collect()) == [0, 1, 3, 4, 5]
    # The sixth best never comes in, although it is above a lower threshold.
    assert S.relevant_sources(queries, corpus, 5, 0.5).count() == 5


def test_vectors_of_different_length_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>")
    with pytest.raises(Exception, match="same length"):
        S.topk(queries, corpus.coalesce(1), 1).collect()


def test_embed_loads_the_model_once_and_keeps_null(spark):
    def model():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(embed("t", model)).collect()] == [[3.0, 1.0], None, [0.0, 1.0]]
    blank = df.select(embed("t")).collect()[2][0]
    assert blank == [0.0] * 64


def test_sync_embeds_only_what_changed(spark, new_folder):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def encode(texts):
            calls.add(len(texts))
            return np.ones((len(texts), 2))

        return encode

    def source(rows):
        return spark.createDataFrame(rows, "id int, source string, content string")

    first = source([(1, "s", "one"), (2, "s", "two"), (3, "s", "three")])
    path = write_index(spark, sync_index(first, None, model=model), new_folder("index"))
    assert calls.value == 3
    index = spark.read.parquet(path)
    second = source([(1, "s", "one"), (2, "s", "TWO"), (4, "s", "four")])
    actions = {r.id: r.action for r in sync_actions(second, index).collect()}
    assert actions == {1: "keep", 2: "update", 3: "delete", 4: "insert"}
    path = write_index(spark, sync_index(second, index, model=model), new_folder("index"))
    assert calls.value == 5
    version = spark.read.parquet(path)
    assert sorted(r.id for r in version.collect()) == [1, 2, 4]
    assert {r.action for r in sync_actions(second, version).collect()} == {"keep"}
    same = version.where(F.col("content_hash") != content_hash("content"))
    assert same.count() == 0


def test_index_partitioned_by_cell_is_pruned(small, spark, new_folder):
    _, _, q, c = small
    centroids = S.train_centroids(c, 6)
    path = write_index(spark, S.assign_cells(c, centroids), new_folder("index"), "cell")
    index = spark.read.parquet(path)
    found = S.topk_ann(q.limit(1), index, centroids, 3, nprobe=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:80]


def test_more_queries_than_are_sent_go_in_groups(small, monkeypatch):
    """Each group is a scan; no side is copied into blocks of the other."""
    queries, corpus, q, c = small
    monkeypatch.setattr(S, "_blocks", None)
    assert rows(S.topk(q, c, 5, max_sent_queries=2)) == brute(queries, corpus, 5)
    centroids = S.train_centroids(c, 6)
    index = S.assign_cells(c, centroids)
    assert rows(S.topk_ann(q, index, centroids, 5, nprobe=6, max_sent_queries=4)) == brute(queries, corpus, 5)


def test_distances_to_cells_are_taken_in_tiles(spark, small, monkeypatch):
    """However many cells there are, a task holds no more than a tile of distances."""
    _, _, _, c = small
    centroids = S.train_centroids(c, 6)
    expected = S.assign_cells(c, centroids).select("id", "cell").orderBy("id").collect()
    whole = S._distances

    def measured(vectors, middles):
        assert len(vectors) * len(middles) <= 40
        return whole(vectors, middles)

    monkeypatch.setattr(S, "CACHED", 40, raising=False)
    monkeypatch.setattr(S, "_distances", measured)
    assert S.assign_cells(c, centroids).select("id", "cell").orderBy("id").collect() == expected


@pytest.mark.parametrize("kind, keys", [("unit", "text"), ("ties", "number"), ("huge", "number")])
def test_best_rows_by_single_precision_and_a_score_to_beat(kind, keys):
    draw = np.random.default_rng(3)
    vectors, asked = draw.normal(size=(9000, 8)), draw.normal(size=(40, 8))
    if kind == "ties":
        vectors, asked = np.round(vectors), np.round(asked)
    elif kind == "huge":
        vectors, asked = vectors * 1e20, asked * 1e20
    else:
        # Neighbours that only differ in the sixth place of their score.
        vectors[3000:6000] = vectors[:3000] + 1e-6 * draw.normal(size=(3000, 8))
    names = draw.permutation(9000)
    names = np.array([f"{n:05d}" for n in names], dtype=object) if keys == "text" else names
    scores = np.einsum("qd,nd->qn", asked, vectors)
    best = [np.lexsort((names, -np.round(row, 6)))[:7] for row in scores]
    lowest = np.array([np.round(row[found[-1]], 6) for row, found in zip(scores, best, strict=True)])
    for floors in (None, np.full(40, np.nan), *([] if kind == "huge" else [lowest])):
        top = TopK(7, floors)
        for start in range(0, 9000, 4500):
            top.offer(np.arange(40), asked, vectors[start : start + 4500], names[start : start + 4500])
        found = next(top.batches(np.arange(40), ["q", "n", "s"])).to_pandas()
        assert found.n.tolist() == np.concatenate([names[row] for row in best]).tolist()
    low = TopK(7, lowest + 1)
    low.offer(np.arange(40), asked, vectors, names)
    if kind != "huge":
        assert all((batch.to_pandas().s > lowest[batch.to_pandas().q]).all() for batch in low.batches(np.arange(40), ["q", "n", "s"]))


def test_a_model_gets_a_bounded_number_of_texts(spark):
    def model():
        def encode(texts):
            assert len(texts) <= 256
            return np.array([[len(t), 1] for t in texts], float)

        return encode

    texts = [None if i % 7 == 0 else "x" * (i % 50) for i in range(1000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r.e for r in frame.select("id", embed("text", model, 2).alias("e")).collect()}
    assert got == {i: None if t is None else [len(t), 1] for i, t in enumerate(texts)}
