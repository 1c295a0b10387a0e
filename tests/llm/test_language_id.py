from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import language_id as L
from answerloom.llm.queries import op9_language_id


def test_held_out_accuracy(spark):
    found = op9_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 40])
def test_codewords_are_apart(n):
    code = L.code_matrix(n)
    assert code.shape[0] == n
    if n > 1:
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else code.shape[1] // 4)
    if n > 7:
        assert code.shape[1] == 10 * int(np.ceil(np.log2(n)))


def test_a_wrong_bit_is_corrected():
    code = L.code_matrix(4)
    model = L.Model(("a", "b", "c", "d"), code, np.zeros((1, 1)), np.ones(code.shape[1]))
    for row in range(4):
        margins = 3.0 * code[row].astype(float)
        margins[2] *= -1
        best, score, doubt = L._decode(margins[None, :], model)
        assert best[0] == row and 0 < score[0] <= 1
    assert L._decode(np.zeros((1, code.shape[1])), model)[2][0]


def test_awkward_rows(spark, awkward, nothing):
    model = L.fit(awkward)
    assert model.languages == ("de", "en", "fr")
    found, lang, score, doubt = L.identify(awkward, model)
    rows = found.select("doc_id", lang.alias("l"), score.alias("s"), doubt.alias("d")).collect()
    assert len(rows) == awkward.count()
    assert all(r.l == "und" and r.s == 0 and r.d for r in rows if r.doc_id in (3, 4, 5))
    assert {r.l for r in rows if r.doc_id in (1, 2)} == {"en"} and all(0 <= r.s <= 1 for r in rows)
    assert L.fit(nothing) is None
    none = L.identify(awkward, None)
    assert {r[0] for r in none[0].select(none[1]).collect()} == {"und"}
    assert L.identify(nothing, model)[0].collect() == []
