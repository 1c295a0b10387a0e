from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from answerloom.operators import evaluation as E
from answerloom.operators import tables as Q
from answerloom.operators.projections import map_columns


def test_functions_by_pattern(spark):
    Q.register_functions(
        spark,
        {"times(a DOUBLE, b DOUBLE)": "a * b", "upto(n INT) TABLE(x INT)": "SELECT explode(sequence(1, n))"},
    )
    assert spark.range(1).select(Q.call_function("times", F.lit(49), F.lit(9))).first()[0] == 441.0
    assert [r.x for r in spark.sql("SELECT x FROM upto(3)").collect()] == [1, 2, 3]
    assert Q.find_functions(spark, "tim*") == ["times"]
    assert Q.find_functions(spark, "nothing*") == []


def test_markdown_tables(spark):
    text = "Result:\n\n| a | b |\n| --- | :-: |\n| 1 | x y |\n|2|  |\n| 3 |\n\nend"
    df = spark.createDataFrame([(1, text), (2, "no table"), (3, "|only|\n|--|"), (4, None)], "i int, t string")
    got = Q.markdown_to_rows(df, "t", ["i"]).orderBy("i", "row_ix").collect()
    assert [(r.i, r.row_ix, r.names, r.cells) for r in got] == [
        (1, 0, ["a", "b"], ["1", "x y"]),
        (1, 1, ["a", "b"], ["2", ""]),
        (1, 2, ["a", "b"], ["3", None]),
    ]


def test_cells_survive_there_and_back(spark):
    values = ["x|y, z", "a\nb\r\n", " edge ", "&#124; & &amp;#32;", "back\\", "", " ", "\\|"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, `a|b` string")
    text = Q.rows_to_markdown(df, df.columns, ["i"])
    lines = Q.rows_to_lines(df, df.columns, ["i"])
    assert [r.line_ix for r in lines.orderBy("line_ix").collect()] == list(range(len(values) + 2))
    for rows in (Q.markdown_to_rows(text, "markdown", []), Q.lines_to_rows(lines)):
        got = Q.row_cells(rows).orderBy("row_ix", "col_ix").collect()
        assert [(r.row_ix, r.col_ix, r.column, r.cell) for r in got] == [
            x for i, v in enumerate(values) for x in ((i, 0, "i", str(i)), (i, 1, "a|b", v))
        ]


def test_columns_may_share_a_name(spark):
    df = spark.createDataFrame([("| a | a |\n| 1 | 2 \\| 3 |",)], "t string")
    rows = Q.markdown_to_rows(df, "t", [])
    assert [tuple(r) for r in Q.row_cells(rows).collect()] == [(0, 0, "a", "1"), (0, 1, "a", "2 | 3")]
    assert rows.select(Q.rows_to_json()).first()[0] == '{"a":"1"}'
    assert rows.select(Q.cell_named("a"), Q.cell_named("b")).first()[:] == ("1", None)


def test_text_tables_of_any_size(spark):
    rows = Q.lines_to_rows(Q.rows_to_lines(spark.range(30_000).repartition(5), ["id"], ["id"]))
    assert rows.where("cells[0] <> string(row_ix)").count() == 0 and rows.count() == 30_000
    empty = Q.rows_to_markdown(spark.range(0), ["id"], ["id"]).first()[0]
    assert empty == "| id |\n| --- |"
    assert Q.lines_to_rows(Q.rows_to_lines(spark.range(0), ["id"], ["id"])).count() == 0


def test_ask_table(spark):
    accounts = spark.createDataFrame([("PERU", 2), ("CHAD", 1)], "nation string, n long")
    registry = {"accounts": Q.CuratedQuery("Accounts per country", ["accounts"], accounts, ["nation"])}
    questions = spark.createDataFrame(
        [("show me total bank accounts for each country",), ("and the weather?",)], "question string"
    )
    got = {r.question: (r.entry, r.response) for r in Q.ask_table(questions, registry).collect()}
    assert got == {
        "show me total bank accounts for each country": (
            "accounts",
            "Accounts per country\n| nation | n |\n| --- | --- |\n| CHAD | 1 |\n| PERU | 2 |",
        ),
        "and the weather?": (None, "no curated query"),
    }
    with pytest.raises(ValueError):
        Q.ask_table(questions, {})


def test_latest_version_compares_numbers(spark):
    versions = spark.createDataFrame(
        [("m", "9"), ("m", "10"), ("m", "x"), ("low", "0"), ("bad", "x")], "name string, version string"
    )
    names = spark.createDataFrame([("m",), ("low",), ("bad",), ("none",)], "name string")
    got = {r.name: r.latest for r in E.latest_version(names, versions).collect()}
    assert got == {"m": 10, "low": 1, "bad": 1, "none": 1}


def test_eval_set_and_metrics(spark):
    documents = spark.createDataFrame(
        [(i, f"First {i}. Second.", f"u{i}") for i in range(40)], "id long, content string, doc_uri string"
    )
    evals = E.make_eval_set(documents, num_evals=5)
    rows = evals.collect()
    drawn = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:5]
    assert [r.expected_source for r in rows] == drawn
    assert all(r.question == f"First {r.expected_source}." for r in rows)
    assert rows == E.make_eval_set(documents.repartition(7), num_evals=5).collect()
    first, second = rows[0], rows[1]
    hits = spark.createDataFrame(
        [(first.eval_id, 1, first.expected_source), (second.eval_id, 2, second.expected_source),
         (second.eval_id, 1, -1)],
        "query_id string, rk long, id long",
    )
    score = E.score_run(E.evaluate(evals, hits)).first()
    assert (score.n_questions, score.hit_rate, score.mrr) == (5, 0.4, 0.3)


def test_observed_steps(spark):
    record = E.RunRecord("run1")
    df = record.observed(spark.range(5), "read")
    df = record.observed(
        df.withColumn("error", F.when(F.col("id") > 2, "bad")).where("id > 0"), "check", "error"
    )
    df.collect()
    assert [tuple(r) for r in record.as_rows(spark).collect()] == [
        ("run1", 0, "read", 5, 0), ("run1", 1, "check", 4, 2)
    ]


def test_missing_columns_are_an_error(spark):
    df = spark.range(1)
    assert map_columns(df, key="id").columns == ["key"]
    with pytest.raises(ValueError, match="url"):
        map_columns(df, doc_uri="url")
