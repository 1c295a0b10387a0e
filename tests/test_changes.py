from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pytest

from answerloom.functions.models import map_model_once
from answerloom.operators.index_log import IndexLog
from answerloom.session import new_folder as fresh_folder
from answerloom.streaming.changes import follow_files

PAGE = "<html><body><h1>T{0}</h1><p>One sentence here. Another {0}.</p></body></html>"


def test_changed_and_removed_files(spark, tmp_path):
    """No stale chunk is left, and nothing is embedded that did not change."""
    seen = spark.sparkContext.accumulator(0)

    def model():
        def encode(texts):
            seen.add(len(texts))
            return np.ones((len(texts), 2))

        return encode

    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    places = {name: folder / name for name in ("a.html", "b.html", "sub/c.html", "d.html")}
    for name, place in places.items():
        place.write_text(PAGE.format(name))
    log, ledger = IndexLog(fresh_folder(spark, "log"), buckets=3), fresh_folder(spark, "ledger")
    follow = lambda: follow_files(spark, str(folder), log, ledger, size=4, overlap=0, model=model, dim=2)

    def chunks():
        return sorted((Path(r.source).name, r.content) for r in log.live(spark).collect())

    first = follow()
    assert (first.added, first.changed, first.removed, first.version) == (4, 0, 0, 1)
    before, calls = chunks(), seen.value
    assert {name for name, _ in before} == {"a.html", "b.html", "c.html", "d.html"} and calls == len(before)
    again = follow()
    assert (again.added, again.changed, again.removed, again.version) == (0, 0, 0, 1) and seen.value == calls

    places["a.html"].write_text(PAGE.format("changed"))
    os.utime(places["a.html"], (2e9, 2e9))
    os.utime(places["d.html"], (2e9, 2e9))  # touched, not changed
    places["b.html"].unlink()
    (folder / "old.html").write_text(PAGE.format("old"))
    os.utime(folder / "old.html", (1e9, 1e9))  # new here, but older than all others
    second = follow()
    assert (second.added, second.changed, second.removed, second.version) == (1, 2, 1, 2)
    after = chunks()
    assert {name for name, _ in after} == {"a.html", "c.html", "d.html", "old.html"}
    assert [c for c in after if c[0] in ("c.html", "d.html")] == [c for c in before if c[0] in ("c.html", "d.html")]
    assert any("changed" in text for name, text in after if name == "a.html")
    assert not any("a.html" in text for _, text in after)
    assert seen.value - calls == sum(name in ("a.html", "old.html") for name, _ in after) - sum(
        c in before for c in after if c[0] == "a.html"
    )
    rest = log.entries(spark).where("version = 2 and kind = 'delta'").selectExpr("sum(rows) AS n").first().n
    assert rest == seen.value - calls
    follow()
    assert chunks() == after


def test_index_must_keep_the_source(spark, tmp_path):
    with pytest.raises(ValueError, match="source"):
        follow_files(spark, str(tmp_path), IndexLog(fresh_folder(spark, "log"), columns=("doc_id",)), fresh_folder(spark, "ledger"))


def test_a_prompt_is_answered_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def answer(prompts):
            calls.add(len(prompts))
            return [p.upper() for p in prompts]

        return answer

    answers = fresh_folder(spark, "answers")
    frame = lambda rows: spark.createDataFrame(rows, "id int, p string").repartition(3)
    one = map_model_once(frame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")]), "p", model, answers)
    assert sorted(map(tuple, one.collect())) == [(1, "a", "A"), (2, "b", "B"), (3, "a", "A"), (4, None, None), (5, "", "")]
    assert calls.value == 3
    two = map_model_once(frame([(1, "b"), (2, "c")] + [(9, "a")] * 50), "p", model, answers)
    assert {(r.p, r.answer) for r in two.collect()} == {("a", "A"), ("b", "B"), ("c", "C")} and two.count() == 52
    assert calls.value == 4
    map_model_once(frame([(1, "a")]), "p", model, answers, alias="other").collect()
    assert calls.value == 5
    assert map_model_once(frame([]), "p", model, answers).count() == 0
