"""Route every conversation's question, answer it and summarise the answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.models import BatchModel, apply_model, summarize
from answerloom.functions.prompts import (
    ANALYST_PROMPT,
    CODE_PROMPT,
    GENERAL_PROMPT,
    UNROUTED_ANSWER,
    render_prompt,
)
from answerloom.operators.routing import Rules, classify_route, dispatch_columns

FOUR_ROUTES = ("code", "general", "tables", "dashboards")
THREE_ROUTES = ("dashboards", "catalog", "general")


def four_way(
    questions: DataFrame,
    rules: Rules,
    table_answers: Column | str,
    model: str | BatchModel = "covering",
    text: str = "question",
) -> DataFrame:
    """``route, prompt, answer, summary`` added to the questions.

    Code, dashboard and general questions become prompts for the model; table
    questions take the given answer. Every branch is an expression, so the
    questions are read once. The model answers the prompts and sums up the answers.
    """
    routed = classify_route(questions, text, rules, FOUR_ROUTES)
    prompts = {
        "code": render_prompt(CODE_PROMPT, input=text),
        "general": render_prompt(GENERAL_PROMPT, input=text),
        "dashboards": render_prompt(ANALYST_PROMPT, input=text),
    }
    prompted = routed.withColumn("prompt", dispatch_columns("route", prompts))
    table_answer = F.col(table_answers) if isinstance(table_answers, str) else table_answers
    modelled = apply_model(F.col("prompt"), model)
    answered = prompted.withColumn(
        "answer",
        dispatch_columns(
            "route",
            {"code": modelled, "general": modelled, "dashboards": modelled, "tables": table_answer},
        ),
    )
    return summarize(answered, "answer", model)


def three_way(
    questions: DataFrame,
    rules: Rules,
    handlers: Mapping[str, Column],
    text: str = "question",
    routes: Sequence[str] = THREE_ROUTES,
) -> DataFrame:
    """``route, answer``: given handlers for two routes, a fixed reply otherwise."""
    routed = classify_route(questions, text, rules, routes)
    return routed.withColumn(
        "answer", dispatch_columns("route", {**handlers, "general": F.lit(UNROUTED_ANSWER)})
    )
