"""Prompt templates and their rendering as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column

# Prompts and formats whose wording is part of the results.
PASSAGE_TEMPLATE = "Passage: {chunk_text}\n"
CODE_PROMPT = (
    "You are a software engineer. Answer this question with step by steps details : {input}"
)
ANALYST_PROMPT = (
    "You are a Business Analyst. Answer this question with step by steps details : {input}"
)
GENERAL_PROMPT = "Give a general and concise answer to the question: {input}"
SUMMARY_PROMPT = "Summarize: {input}"
UNROUTED_ANSWER = "I am unable to route that question"
ROUTING_LINE = "- If the user is asking about {description} then call the router with `{name}`"

# Our own wording, written for the operators that fill in the placeholders and read the replies.
ROUTING_PROMPT = (
    "Choices, one a line:\n"
    "{criteria}\n"
    "Reply with one tool call whose argument `choice` is one of these names."
)
QA_PROMPT = (
    "The best passages come first. Pick the sentence of a passage that says most about the question.\n\n"
    "Passages:\n{summaries}\nQuestion:\n{question}\n\nAnswer:"
)
DOCUMENTS_PROMPT = (
    "`{tool_name}` returns rows of `rk`, `source`, `content` and `score`, best first. "
    "Quote a sentence of `content` and name its `source`."
)
TABLES_PROMPT = (
    "`{tool_name}` takes a map with the key `question` and returns a heading and a text table. "
    "Pass both on unchanged."
)
FUNCTIONS_PROMPT = (
    "`{tool_name}` takes a map of argument names to numbers in text form and returns one number. "
    "Say that number."
)


def placeholders(template: str) -> list[str]:
    """Placeholder names in order of appearance."""
    return [name for _, name, _, _ in Formatter().parse(template) if name is not None]


def render_prompt(template: str, **values: Column | str) -> Column:
    """``template`` with its placeholders filled from columns.

    The template is taken apart once on the driver; the rows see one
    ``concat``. NULL values fill in as the empty string.
    """
    unknown = [name for name in placeholders(template) if name not in values]
    if unknown:
        raise ValueError(f"no value for placeholders {unknown}")
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(as_column(values[name]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def routing_prompt(agents: DataFrame) -> DataFrame:
    """One row: the routing prompt over ``agents(name, description)``.

    ``choices`` lists the names the router may answer with. A registry is a
    handful of rows, so one ordered string aggregate is enough.
    """
    line = render_prompt(ROUTING_LINE, name="name", description="description")
    gathered = agents.select("name", line.alias("line")).agg(
        F.expr("listagg(line, '\n') within group (order by name)").alias("criteria"),
        F.expr("listagg(name, ',') within group (order by name)").alias("choices"),
    )
    return gathered.select(
        render_prompt(ROUTING_PROMPT, criteria="criteria").alias("prompt"),
        F.concat(F.lit("should be one of: "), F.coalesce("choices", F.lit(""))).alias("choices"),
    )
