from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from answerloom.operators import compressed as C
from answerloom.operators import search as S
from answerloom.operators import search_many as M
from answerloom.operators._nearest import Asked, TopK
from answerloom.session import cut_lineage


def frame(spark, rows, key="id", parts=3):
    data = [(k, None if v is None else [float(x) for x in v]) for k, v in rows]
    return spark.createDataFrame(data, f"{key} bigint, embedding array<double>").repartition(parts)


def brute(queries, corpus, k):
    out = []
    for qid, q in queries:
        scored = sorted((-round(float(np.dot(q, v)), 6), key) for key, v in corpus if v is not None)
        out += [(qid, n + 1, key, -s + 0.0) for n, (s, key) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((*r[:3], round(r[3], 6) + 0.0) for r in df.collect())


def blocks_of(corpus, cells, rings=4):
    centroids = cut_lineage(S.train_centroids(corpus, cells))
    rows = cut_lineage(M.with_blocks(S.assign_cells(corpus, centroids), centroids, rings))
    return rows, M.describe_blocks(rows, centroids)


def clustered(n, seed, spread=0.15, width=16, centres=12):
    draw = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(centres, width))
    return middle[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, width))


@pytest.mark.parametrize("seed, width, rings, rounds", [(1, 16, 4, (1, 4)), (2, 3, 1, (1,)), (3, 16, 3, ()), (4, 2, 2, (2, 2, 2))])
def test_equal_to_brute_force(spark, seed, width, rings, rounds):
    draw = np.random.default_rng(seed)
    corpus = list(enumerate(np.round(clustered(150, seed, 0.4, width, 5), 2)))
    # A third are copies, some are zero, one has no vector; norms differ widely.
    corpus += [(1000 + i, corpus[0][1]) for i in range(70)] + [(2000, np.zeros(width)), (2001, None)]
    corpus += [(3000 + i, v * draw.choice([0.01, 30])) for i, (_, v) in enumerate(corpus[:20])]
    queries = [(i, np.round(v, 2)) for i, v in enumerate(clustered(25, seed + 50, 0.8, width, 5))] + [(99, np.zeros(width))]
    rows, blocks = blocks_of(frame(spark, corpus), 6, rings)
    found, report = M.topk_many(frame(spark, queries, "query_id"), rows, blocks, 6, rounds=rounds)
    assert rows_of(found) == brute(queries, corpus, 6)
    assert [r["round"] for r in report] == list(range(1, len(rounds) + 2))


def test_most_pairs_are_never_compared(spark, monkeypatch):
    """And blocks are split: no task sees more than its slots of a cell however hot."""
    monkeypatch.setattr(S, "CORPUS_BLOCK", 100)
    monkeypatch.setattr(S, "QUERY_BLOCK", 50)
    corpus = list(enumerate(clustered(4000, 5)))
    queries = list(enumerate(clustered(600, 6)))
    rows, blocks = blocks_of(frame(spark, corpus), 12)
    found, report = M.topk_many(frame(spark, queries, "query_id"), rows, blocks, 5)
    assert rows_of(found) == brute(queries, corpus, 5)
    assert sum(r["pairs"] for r in report) < 0.2 * len(corpus) * len(queries)


def test_nothing_to_search(spark):
    corpus, queries = frame(spark, list(enumerate(clustered(30, 1)))), frame(spark, [(1, np.ones(16)), (2, None)], "query_id")
    rows, blocks = blocks_of(corpus, 2)
    assert {r.query_id for r in M.topk_many(queries, rows, blocks, 3)[0].collect()} == {1}
    assert M.topk_many(queries.limit(0), rows, blocks, 3)[0].count() == 0
    assert M.topk_many(queries, rows.limit(0), blocks.limit(0), 3)[0].count() == 0
    few = M.topk_many(queries, rows, blocks, 50)[0]
    assert few.count() == 30


def test_visits_go_in_groups_and_shuffle_no_copies(spark, monkeypatch):
    """Queries are sent in groups, neither they nor the rows are copied for each block, and scores go on from round to round."""
    monkeypatch.setattr(S, "_blocks", None)
    monkeypatch.setattr(M, "MAX_SENT_QUERIES", 60)
    corpus, queries = list(enumerate(clustered(900, 5, 1.5))), list(enumerate(clustered(150, 6, 1.5)))
    rows, blocks = blocks_of(frame(spark, corpus), 8)
    found, report = M.topk_many(frame(spark, queries, "query_id"), rows, blocks, 4)
    assert rows_of(found) == brute(queries, corpus, 4)
    assert all(set(r) == {"round", "queries", "pairs"} for r in report)


def arc(degrees):
    return np.stack([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))], axis=1)


def test_rows_of_a_block_are_skipped_by_tiles(spark, monkeypatch):
    """Two rings of 450 rows; a query at their border needs the nearest few degrees of the other ring, not all of it."""
    monkeypatch.setattr(M, "TILE_ROWS", 50, raising=False)
    corpus, queries = list(enumerate(arc(np.arange(900) / 10))), list(enumerate(arc(44.5 + np.arange(8) / 8)))
    centroids = spark.createDataFrame([(0, [1.0, 0.0])], "cell int, centroid array<double>")
    rows = cut_lineage(M.with_blocks(frame(spark, corpus).selectExpr("*", "0 AS cell"), centroids, 2))
    found, report = M.topk_many(frame(spark, queries, "query_id"), rows, M.describe_blocks(rows, centroids), 60, rounds=(1,))
    assert rows_of(found) == brute(queries, corpus, 60)
    assert [r["queries"] for r in report] == [8, 8]
    assert report[1]["pairs"] <= 8 * 150


def test_tiles_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE_ROWS", 7)
    rows, _ = blocks_of(frame(spark, list(enumerate(clustered(200, 3)))), 3)
    by_key = {r.id: r for r in rows.collect()}
    tiles = M._tiles(rows, "id", "embedding").collect()
    assert sorted(key for tile in tiles for key in tile["keys"]) == sorted(by_key)
    for tile in tiles:
        own = [by_key[key] for key in tile["keys"]]
        assert len(own) <= 7 and {r.block for r in own} == {tile.cell}
        assert (tile.low, tile.high) == (min(r.angle for r in own), max(r.angle for r in own))
        assert (tile.least, tile.most) == (min(r.norm for r in own), max(r.norm for r in own))
        assert np.array_equal(np.frombuffer(bytes(tile.v)).reshape(len(own), -1), [r.embedding for r in own])


def test_first_blocks_are_near(monkeypatch):
    """Those of the nearest cells, in the order in which all blocks would come."""
    draw = np.random.default_rng(3)
    middles, of = M._unit(draw.normal(size=(40, 3))), np.repeat(np.arange(40), draw.integers(1, 5, 40))
    low = draw.uniform(0, 0.4, len(of))
    blocks = {"towards": middles, "of": of, "rings": M._rings(of), "low": low, "high": low + 0.1}
    assert sorted(M._rings(of)[M._rings(of) >= 0]) == list(range(len(of)))
    queries = draw.normal(size=(30, 3))
    angles = np.arccos(np.clip(M._unit(queries) @ middles.T, -1, 1))[:, of]
    every = np.argsort(np.abs(angles - (blocks["low"] + blocks["high"]) / 2) + angles, axis=1, kind="stable")
    assert np.array_equal(M._likeliest(queries, blocks, 5), every[:, :5])
    monkeypatch.setattr(M, "NEAREST", 2)
    assert M._likeliest(queries, blocks, 5).shape == (30, 5)
    assert np.array_equal(np.sort(M._likeliest(queries, blocks, 500)), np.broadcast_to(np.arange(len(of)), (30, len(of))))


def test_hot_first_block_and_repeated_keys(spark, monkeypatch):
    """Most queries like one block first, so it is dealt over groups; two queries share a key, one has none."""
    monkeypatch.setattr(M, "MAX_SENT_QUERIES", 10)
    corpus = [(f"row {i:03d}", v) for i, v in enumerate(np.round(clustered(120, 2), 2))]
    queries = [(f"asked {i}", corpus[7][1]) for i in range(35)] + [("asked 1", corpus[90][1]), (None, corpus[50][1])]
    rows, blocks = blocks_of(spark.createDataFrame([(a, v.tolist()) for a, v in corpus], "id string, embedding array<float>"), 4)
    asked = spark.createDataFrame([(a, v.tolist()) for a, v in queries], "query_id string, embedding array<float>")
    found = M.topk_many(asked, rows, blocks, 3)[0].collect()
    single = [(key, v.astype(np.float32).astype(float)) for key, v in corpus]
    wanted = []
    for name in dict(queries):
        scored = sorted((-round(float(v.astype(np.float32).astype(float) @ w), 6), key) for own, v in queries if own == name for key, w in single)
        wanted += [(name, n + 1, key, -score) for n, (score, key) in enumerate(scored[:3])]
    order = lambda r: (r[0] or "", r[1])
    assert sorted(((r.query_id, r.rk, r.id, round(r.score, 6)) for r in found), key=order) == sorted(wanted, key=order)


def test_queries_of_one_key_share_the_score_to_beat():
    best = TopK(3, np.full(5, -np.inf))
    best.take(np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.arange(9), np.array([0.9, 0.5, 0.1, 0.8, 0.7, 0.6, 0.4, 0.3, 0.2]))
    assert M._floors(best, pa.array(["a", "b", "b", "c", None])).tolist() == [0.1, 0.6, 0.6, 0.2, -np.inf]
    assert M._floors(best, pa.array(["a", "a", "b", "c", "b"])).tolist() == [0.7, 0.7, -np.inf, 0.2, -np.inf]
    assert M._floors(best, pa.array(["a", "b", "c", "d", None])).tolist() == best.floor.tolist()


@pytest.mark.parametrize("k, kind", [(1, np.float32), (4, np.float64)])
def test_a_tile_gives_what_sorting_all_gives(k, kind):
    draw = np.random.default_rng(k)
    rows, asked = draw.integers(-2, 3, (400, 6)).astype(kind), draw.integers(-2, 3, (50, 6)).astype(kind)
    keys, floors = draw.permutation(400), np.where(np.arange(50) < 10, -np.inf, -3.0)
    best = TopK(k, floors)
    for start in range(0, 400, 40):
        best.offer_tile(np.arange(0, 50, 1 + start % 80 // 40), Asked(asked), rows[start : start + 40], keys[start : start + 40])
    seen = np.arange(400) // 40 % 2 == 0
    for n in range(50):
        here = seen if n % 2 else np.ones(400, bool)
        scored = sorted(zip(-(rows[here] @ asked[n]), keys[here].tolist(), strict=True))
        wanted = [(-s, key) for s, key in scored if -s >= floors[n]][:k]
        assert list(zip(best.score[n, : best.held[n]], best.key[n, : best.held[n]], strict=True)) == wanted


# ---- codes -----------------------------------------------------------------


def test_tables_add_up_to_products_with_decoded_vectors():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(300, 10))
    book = C.Codebook(draw.normal(size=(3, 17, 4)))
    codes = book.encode(rows)
    decoded = np.concatenate([book.parts[j][codes[:, j]] for j in range(3)], axis=1)[:, :10]
    queries = draw.normal(size=(5, 10))
    assert np.allclose(C.scores_of(book.tables(queries), codes), queries @ decoded.T)
    gaps = ((book.cut(rows)[:, :, None, :] - book.parts[None]) ** 2).sum(-1)
    assert np.array_equal(codes, gaps.argmin(-1))


@pytest.mark.parametrize("data", ["clusters", "sphere"])
def test_recall_and_size(spark, data):
    draw = np.random.default_rng(4)
    vectors = clustered(3000, 7, 0.5, 32, 40) if data == "clusters" else draw.normal(size=(3000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    corpus = frame(spark, list(enumerate(vectors)))
    queries = frame(spark, [(i, v) for i, v in enumerate(vectors[::60])], "query_id")
    book = C.train_codebook(corpus, sample=1500)
    codes = cut_lineage(C.with_codes(corpus, book))
    assert codes.selectExpr("max(octet_length(code)) AS n").first().n * 10 <= 8 * 32
    near = C.topk_compressed(queries, codes, corpus, book, 10, 200, buckets=None)
    exact = cut_lineage(S.topk(queries, corpus, 10))
    shares = [r.recall for r in S.recall(near, exact, "query_id", "id").collect()]
    assert np.mean(shares) >= 0.9
    true = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(true.get((r.query_id, r.id), r.score) - r.score) < 1e-6 for r in near.collect())


def test_codes_by_bucket_groups_of_queries_and_odd_rows(spark, monkeypatch):
    vectors = clustered(200, 9, 0.5, 6, 4)
    corpus = frame(spark, [*enumerate(vectors), (500, None)]).selectExpr("*", "cast(id % 3 AS int) AS bucket")
    queries = frame(spark, [(1, vectors[5]), (2, vectors[50]), (3, None), (4, vectors[150])], "query_id")
    book = C.train_codebook(corpus)
    codes = cut_lineage(C.with_codes(corpus, book).select("id", "code", "bucket"))
    wanted = brute([(1, vectors[5]), (2, vectors[50]), (4, vectors[150])], list(enumerate(vectors)), 4)
    assert rows_of(C.topk_compressed(queries, codes, corpus, book, 4, 200)) == wanted
    monkeypatch.setattr(C, "MAX_SENT_QUERIES", 1)
    assert rows_of(C.topk_compressed(queries, codes, corpus, book, 4, 200)) == wanted
    with pytest.raises(ValueError, match="survivors"):
        C.topk_compressed(queries, codes, corpus, book, 4, 3)
    none = corpus.limit(0)
    empty = C.train_codebook(none)
    assert C.topk_compressed(queries, C.with_codes(none, empty).select("id", "code", "bucket"), none, empty, 4).count() == 0
