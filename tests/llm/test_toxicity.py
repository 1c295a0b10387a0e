from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import toxicity as X
from answerloom.llm.queries import op1_toxicity


@pytest.fixture(scope="module")
def model(spark):
    clean = "the weather is nice in this town and the garden path is worth a walk".split()
    rude = ["idiot", "moron", "worthless", "stupid", "trash"]
    rows = [(i, " ".join(clean[i % 7 :] + ([rude[i % 5]] if i % 2 else []))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    return X.fit(docs, labels)


@pytest.mark.parametrize(
    "written,word",
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("w.o.r.t.h.l.e.s.s", "worthless"),
     ("stuuuupid", "stupid"), ("$tupid!!!", "stupid"), ("7r@sh,", "trash"), ("(m o r o n)", "moron"), ("IDIIIOT", "idiot")],
)
def test_restores_words(model, written, word):
    words = X.Restorer(model.costs).words(f"this {written} is here")
    assert word in words and "here" in words
    assert model.score(words) > 0.5


@pytest.mark.parametrize(
    "written,word",
    [("iddiott", "idiot"), ("stuupiid!", "stupid"), ("$ t u p i d", "stupid"), ("m 0 r @ n, tr@sh", "trash"), ("i d ! o t", "idiot"),
     ("i    d    i    o    t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("m\no\nr\no\nn", "moron"), ("a i d i o t !", "idiot"), ("i~d~i~o~t", "idiot")],
)
def test_restores_doubled_and_spaced_words(model, written, word):
    words = X.Restorer(model.costs).words(f"this {written} is here")
    assert word in words and "here" in words
    assert model.score(words) > 0.5


def test_doubled_words_stay_as_written(model):
    assert {"all", "letters", "happy"} <= X.Restorer(model.costs).words("all letters, happy")


def test_clean_text_stays_clean(model):
    read = X.Restorer(model.costs).words
    assert model.score(read("the garden is nice, version 2.0 costs $5 and 1,000 came.")) < 0.5
    assert model.score(read("")) < 0.5 and model.score(read(None)) < 0.5


def test_viterbi_finds_the_cheapest_reading(model):
    """All readings of short tokens, tried one by one."""
    costs = model.costs

    def price(said):
        total = 0.0
        for word in said.split(" "):
            coded = [0, 0, *(X._symbol(c) for c in word), 0]
            total += sum(costs[a][b][c] for a, b, c in zip(coded, coded[1:], coded[2:], strict=False))
        return total

    for token in ["1d10t", "m0r", "a11", "st*p"]:
        readings = {}
        for path in itertools.product(*X._arcs(token)):
            said = "".join(letter for letter, _ in path)
            if said and said == " ".join(said.split()):
                readings[said] = min(readings.get(said, np.inf), price(said) + sum(cost for _, cost in path))
        assert X.decode(token, costs.tolist()) == min((c, s) for s, c in readings.items())[1]


def test_held_out_documents(spark):
    found = op1_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    rows = found.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in rows}
    assert share[0] < 0.01 and share[1] > 0.8  # some rows labelled toxic hold nothing but junk
    assert found.count() == 10_000


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (1, 1)], "doc_id bigint, toxic int")
    rows = X.score_texts(awkward, X.fit(awkward, labels), "text", ["doc_id", "score"]).collect()
    assert len(rows) == awkward.count() and rows[0].asDict().keys() == {"doc_id", "score", "_score"}
    assert all(0 <= r["_score"] <= 1 for r in rows)
    none = X.fit(nothing, labels.limit(0))
    assert [r.score for r in X.score_texts(awkward.limit(1), none, "text", ["doc_id"]).collect()][0] < 0.5
    assert X.score_texts(nothing, none, "text", ["doc_id"]).collect() == []
