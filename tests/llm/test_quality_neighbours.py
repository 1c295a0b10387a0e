from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from answerloom.llm import quality_neighbours as Q
from answerloom.llm.queries import op13_quality_neighbours

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = op13_quality_neighbours(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    held = found.where("held_out").join(labels, "doc_id").where("quality is not null").toPandas()
    assert len(held) > 100
    good, junk = held[held.quality == 1], held[held.quality == 0]
    order = np.array([(a > b) + (a == b) / 2 for a in good.score for b in junk.score])
    assert order.mean() > 0.99
    assert (good.predicted == 1).mean() > 0.98 and (junk.predicted == 0).mean() > 0.9


def test_scores_do_not_look_at_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    turned = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).withColumn("quality", 1 - F.col("quality"))
    one, two = Q.fit(docs, learn), Q.fit(docs.drop("lang", "source"), learn.unionByName(turned.where("false")))
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.labels, two.labels)


def _slow_counts(text):
    """Words in their order and runs of three kinds, counted one by one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = [int(Q._KINDS[b]) for b in data]
    triples = Counter(zip(kinds, kinds[1:], kinds[2:]))
    words = [w.lower() for w in data.split()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    near = sum(words[i] == words[i - lag] for lag in (2, 3, 4) for i in range(lag, len(words)))
    return triples, words, same, near


def test_counts_equal_plain_loops():
    texts = ["a", "", None, "A a  a\tb", "x y x y x", "Ünï ünï Ünï", "!!! *** |", "one\ntwo one", "  lead", "end  ", "a b c a"]
    found = Q.term_counts(texts)
    for text, row in zip(texts, found):
        triples, words, same, near = _slow_counts(text)
        spread = row[Q.WORDS : Q.WORDS + Q.TRIPLES].reshape(Q.N_KINDS, Q.N_KINDS, Q.N_KINDS)
        assert {tuple(map(int, at)): int(spread[tuple(at)]) for at in np.argwhere(spread)} == dict(triples)
        assert row[: Q.WORDS].sum() == len(words) and (row[Q.SAME], row[Q.NEAR]) == (same, near)
        assert sorted(row[: Q.WORDS][row[: Q.WORDS] > 0].astype(int)) == sorted(Counter(words).values())
    alone = np.concatenate([Q.term_counts([text]) for text in texts])
    assert np.array_equal(alone, found)


def test_long_texts_are_counted_whole():
    text = "alpha beta " * 200_000
    row = Q.term_counts([text])[0]
    assert row[: Q.WORDS].sum() == 400_000 and len(text) > 2 * Q.PIECE
    assert Q.term_counts(["x" * (3 * Q.PIECE)])[0, : Q.WORDS].sum() >= 1


def test_votes_equal_all_cosines_sorted():
    draw = np.random.default_rng(3)
    counts = draw.poisson(0.3, (80, Q.TERMS)).astype(np.float32)
    rarity = np.ones(Q.TERMS, np.float32)
    basis = Q.latent_basis(Q._weighed(counts, rarity), 12)
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-3)
    bare = Q.Model(rarity, basis, np.zeros((0, 12), np.float32), np.zeros(0), 0.25, 7)
    vectors, labels = bare.place(counts[:60]), (np.arange(60) % 3 > 0).astype(float)
    model = Q.Model(rarity, basis, vectors, labels, 0.25, 7)
    for row, score in zip(bare.place(counts[60:]), model.score(counts[60:])):
        cosines = [round(float(np.float32(c)), 5) for c in np.round(row @ vectors.T, 5)]
        least = sorted(cosines, reverse=True)[6]
        voting = [(c, y) for c, y in zip(cosines, labels) if c >= least and c > 0]
        assert abs(score - sum(c * y for c, y in voting) / sum(c for c, _ in voting)) < 1e-4
    assert model.score(np.zeros((1, Q.TERMS), np.float32))[0] == 0.25


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    model = Q.fit(awkward, labels)
    assert len(model.labels) == 3 and model.prior == 2 / 3
    found = Q.score_texts(awkward, model, awkward.columns)
    assert found.columns == [*awkward.columns, "_score"]
    rows = found.collect()
    assert len(rows) == awkward.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert {r["_score"] for r in rows if r.doc_id in (3, 4)} == {model.prior}
    assert Q.score_texts(nothing, model, ["doc_id"]).count() == 0
    none = Q.fit(awkward, labels.where("false"))
    assert {r.s for r in Q.score_texts(awkward, none, ["doc_id"], name="s").collect()} == {0.5}
    empty = Q.fit(nothing, labels)
    assert len(empty.labels) == 0
