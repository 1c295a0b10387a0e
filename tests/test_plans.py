from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from answerloom.config import Settings
from answerloom.functions import models
from answerloom.functions.embedding import embed
from answerloom.functions.prompts import QA_PROMPT, placeholders, render_prompt, routing_prompt
from answerloom.operators import routing as R
from answerloom.plans.answering import NO_QUESTION, answer_questions, guarded_answers
from answerloom.operators.tables import register_functions
from answerloom.plans.routed import four_way, three_way
from answerloom.plans.turn import function_tool, run_tool_calls


def test_render_prompt(spark):
    df = spark.createDataFrame([("q", None, 3)], "a string, b string, n int")
    prompt = render_prompt("{{x}} {a}-{b}-{n}-{a}", a="a", b="b", n="n")
    assert df.select(prompt).first()[0] == "{x} q--3-q"
    assert placeholders(QA_PROMPT) == ["summaries", "question"]
    with pytest.raises(ValueError, match="question"):
        render_prompt(QA_PROMPT, summaries="a")


def test_routing_prompt(spark):
    agents = spark.createDataFrame(
        [("tables", "finance"), ("documents", "how-to guides")], "name string, description string"
    )
    row = routing_prompt(agents).first()
    assert "about how-to guides then call the router with `documents`\n- If the user is asking about finance" in row.prompt
    assert row.choices == "should be one of: documents,tables"


def test_models(spark):
    df = spark.createDataFrame([("a b. c",), (None,)], "p string").coalesce(1)
    models.register_model("counting", lambda: lambda prompts: [str(len(p)) for p in prompts])
    answers = models.map_model(df, "p", "counting").collect()
    assert [r.answer for r in answers] == ["6", None]
    assert [r.summary for r in models.summarize(df, "p").collect()] == ["a b.", None]
    assert models.summarize(df, "p", "counting").first().summary == str(len("Summarize: a b. c"))
    with pytest.raises(ValueError, match="no model"):
        models.apply_model(F.col("p"), "unheard of")


def test_extractive_model_reads_every_passage(spark):
    def prompt(*passages):
        context = "".join(f"Passage: {p}\n" for p in passages)
        return (QA_PROMPT.format(summaries=context, question="Why? Because."),)

    df = spark.createDataFrame(
        [
            prompt("One two. Three."),
            prompt("no stop", "next. Because. Why? Because. one"),
            prompt("no stop"),
            prompt(),
            prompt("Far off. Then Why? it", "Question:\nWhy? Because. Passage: of a kind"),
            (None,),
        ],
        "p string",
    )
    got = [r[0] for r in df.coalesce(1).select(models.apply_model(F.col("p"))).collect()]
    assert got == ["One two.", "Because.", "no stop", "", "Because.", None]


def test_covering_model_reads_the_whole_text(spark):
    long = "One two. " * 20_000 + "three four five. Six six six six."
    df = spark.createDataFrame([(long,), ("",), ("Do this: a: b c. d",)], "p string").coalesce(1)
    got = [r[0] for r in df.select(models.apply_model(F.col("p"), "covering")).collect()]
    assert got == ["three four five.", "", "a: b c."]


def test_answers_with_sources_and_errors(spark):
    chunks = spark.createDataFrame(
        [
            (1, "u1", "Keys are added in the settings page. Mail jo@x.org for help."),
            (2, "u2", "Bonuses are paid twice."),
            (3, None, "Unrelated text entirely."),
        ],
        "id long, source string, content string",
    ).withColumn("embedding", embed("content"))
    messages = spark.createDataFrame(
        [
            (1, 0, "user", "hello"),
            (1, 1, "assistant", "hi"),
            (1, 2, "user", "how are keys added in the settings"),
            (2, 0, "assistant", "welcome"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    conversations = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    answers = answer_questions(conversations, messages, chunks, 2)
    got = {r.conv_id: r for r in guarded_answers(answers).collect()}
    assert got[1].answer == "Keys are added in the settings page."
    assert got[1].sources[0] == "u1" and len(got[1].sources) == 2 and got[1].error is None
    assert got[1].passed and got[1].message == "No PII detected"
    for missing in (2, 3):
        assert got[missing].error == NO_QUESTION
        assert got[missing].answer is None and got[missing].question is None


def test_routes(spark):
    rules = Settings().route_rules
    df = spark.createDataFrame(
        [
            ("Show me the accounts, please!",),
            ("Is there a marketing report?",),
            ("Write PYTHON code",),
            ("accounts in python",),
            ("hello",),
            ("",),
            (None,),
        ],
        "question string",
    )
    routed = R.classify_route(df, "question", rules, Settings().routes)
    assert [r.route for r in routed.collect()] == [
        "tables", "dashboards", "code", "tables", "general", "general", "general"
    ]
    shouting = R.classify_route(df, "question", rules, ["x"], "d", classifier=lambda q: F.lit(" X\n"))
    assert {r.route for r in shouting.collect()} == {"x"}


def test_four_and_three_way(spark):
    df = spark.createDataFrame(
        [(1, "Any code? Yes."), (2, "accounts"), (3, "hm")], "i int, question string"
    )
    got = {
        r.i: (r.route, r.answer, r.summary)
        for r in four_way(df, Settings().route_rules, F.lit("42 rows. Done.")).collect()
    }
    assert got == {
        1: ("code", "Any code?", "Any code?"),
        2: ("tables", "42 rows. Done.", "42 rows."),
        3: ("general", "hm", "hm"),
    }
    models.register_model("tagging", lambda: lambda prompts: [p.split()[0] for p in prompts])
    modelled = {
        r.i: (r.answer, r.summary)
        for r in four_way(df, Settings().route_rules, F.lit("T"), "tagging").collect()
    }
    assert modelled == {1: ("You", "Summarize:"), 2: ("T", "Summarize:"), 3: ("Give", "Summarize:")}
    three = three_way(df, (("catalog", ("accounts",)),), {"catalog": F.lit("c"), "dashboards": F.lit("d")})
    assert {r.i: r.answer for r in three.collect()} == {
        1: "I am unable to route that question", 2: "c", 3: "I am unable to route that question"
    }


def test_dispatch_and_trace(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "i int, route string")
    out = R.dispatch(
        df,
        "route",
        {"a": lambda d: d.withColumn("x", F.lit(1)), "b": lambda d: d.withColumn("x", F.lit(2))},
        default="b",
        then=lambda d: d.withColumn("y", F.col("x") * 10),
    )
    assert sorted((r.i, r.y) for r in out.collect()) == [(1, 10), (2, 20), (3, 20), (4, 20)]
    with pytest.raises(ValueError):
        R.dispatch(df, "route", {}, "a")
    said = R.dispatch_columns("route", {"a": F.lit("x")}, F.lit("other"))
    assert [r[0] for r in df.orderBy("i").select(said).collect()] == ["x", "other", "other", "other"]


def test_registry(spark):
    agents = spark.createDataFrame(
        [("tables", ["ask"]), ("documents", ["search", "read"]), ("none", [])],
        "name string, tools array<string>",
    )
    assert R.agent_names(agents) == ["tables", "documents", "none"]
    assert sorted(r.tool for r in R.agent_tools(agents).collect()) == ["ask", "read", "search"]


def test_tool_calls_run_as_rows(spark):
    register_functions(spark, {"add_up(a DOUBLE, b DOUBLE)": "a + b"})
    call = "struct<id: string, name: string, args: map<string,string>>"
    schema = f"conv_id long, turn long, role string, text string, name string, tool_calls array<{call}>"
    add = ("c1", "add_up", {"a": "1.5", "b": "2"})
    rows = [
        (1, 0, "user", "q", None, None),
        (1, 1, "assistant", None, "functions", [add, ("c2", "lost", {}), ("c3", None, None), add]),
        (2, 0, "assistant", "x", "router", [("c4", "route", {"choice": "tables"})]),
        (3, 0, "assistant", "x", "tables", []),
        (4, 0, "assistant", "x", "functions", [("c5", "add_up", {"a": "no number"})]),
        (5, 0, "assistant", "x", "functions", [add]),
        (5, 1, "user", "stop", None, None),
    ]
    messages = spark.createDataFrame(rows, schema)
    after = run_tool_calls(messages, {"add_up": function_tool("add_up", ["a", "b"])}).collect()
    assert len(after) == len(rows) + 5
    added = sorted((r.conv_id, r.turn, r.name, r.text) for r in after if r.role == "tool" and r.name)
    assert added == [
        (1, 2, "add_up", "3.5"),
        (1, 3, "lost", "There is no tool lost"),
        (1, 5, "add_up", "3.5"),
        (4, 1, "add_up", None),
    ]
    assert [(r.turn, r.text) for r in after if r.role == "tool" and r.name is None] == [(4, "There is no tool NULL")]
