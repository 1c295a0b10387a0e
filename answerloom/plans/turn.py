"""One turn of every conversation: prompt, route, run tools, answer, guard, append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.models import BatchModel
from answerloom.functions.pii import pii_verdict
from answerloom.functions.prompts import (
    DOCUMENTS_PROMPT,
    FUNCTIONS_PROMPT,
    TABLES_PROMPT,
    UNROUTED_ANSWER,
    render_prompt,
)
from answerloom.functions.text import sentences
from answerloom.operators.grounding import grounded_sentences
from answerloom.operators.guards import (
    BANNED_TOPICS,
    Lexicon,
    apply_guards,
    grounding_verdicts,
    topic_verdict,
    verdict_rows,
)
from answerloom.operators.messages import (
    ASSISTANT,
    ROUTER,
    TOOL,
    USER,
    append_messages,
    filter_out_routes,
    last_message,
    with_system_prompt,
)
from answerloom.operators.routing import Handler, Rules, classify_route, dispatch, dispatch_columns
from answerloom.operators.tables import CuratedQuery, ask_table, call_function
from answerloom.plans.answering import answer_questions
from answerloom.session import cut_lineage

ROUTES = ("documents", "tables", "general")
POST_GUARDS = {
    "documents": ("pii_guard", "topic_guard", "grounding_guard"),
    "tables": ("pii_guard", "topic_guard"),
}
AGENT_PROMPTS = {
    "documents": DOCUMENTS_PROMPT,
    "tables": TABLES_PROMPT,
    "functions": FUNCTIONS_PROMPT,
}
NO_TOOL = "There is no tool "


def answer_turn(
    messages: DataFrame,
    index: DataFrame,
    curated: Mapping[str, CuratedQuery],
    rules: Rules,
    *,
    k: int = 5,
    banned: Lexicon = BANNED_TOPICS,
    post_guards: Mapping[str, Sequence[str]] = POST_GUARDS,
    model: str | BatchModel = "extractive",
) -> DataFrame:
    """The conversations with an answer to their last question appended.

    Answers carry the name of the agent that gave them. ``post_guards`` names the guards of each
    agent; an answer that fails one is followed by the guards' message.
    """
    history = filter_out_routes(messages)
    asked = last_message(history, USER).select("conv_id", F.col("text").alias("question"))
    routed = classify_route(asked, "question", rules, ROUTES)

    no_context = F.lit(None).cast("string").alias("context")
    questions = history.join(routed.where("route = 'documents'"), "conv_id", "left_semi")
    from_documents = answer_questions(
        routed.where("route = 'documents'"), questions, index, k, model=model
    ).select("conv_id", F.lit("documents").alias("name"), F.col("answer").alias("text"), "context")
    from_tables = ask_table(routed.where("route = 'tables'"), curated).select(
        "conv_id", F.lit("tables").alias("name"), F.col("response").alias("text"), no_context
    )
    unrouted = routed.where("route = 'general'").select(
        "conv_id", F.lit("general").alias("name"), F.lit(UNROUTED_ANSWER).alias("text"), no_context
    )
    # Written once: appending and guarding both read the answers, and neither
    # should search or call a model again.
    answers = cut_lineage(
        from_documents.unionByName(from_tables).unionByName(unrouted).select(
            "conv_id",
            F.lit(0).cast(messages.schema["turn"].dataType).alias("turn"),
            F.lit(ASSISTANT).alias("role"),
            "text",
            "name",
            "context",
        )
    )
    verdicts = _verdicts(answers, banned, post_guards)
    return apply_guards(append_messages(history, answers.drop("context")), verdicts)


def _verdicts(
    answers: DataFrame, banned: Lexicon, post_guards: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``conv_id, guard, passed, message`` of every guard an answer's agent has."""

    def of_agents(guard: str) -> Column:
        return F.col("name").isin([agent for agent, guards in post_guards.items() if guard in guards])

    guards = {"pii_guard": pii_verdict("text"), "topic_guard": topic_verdict("text", banned)}
    judged = answers.select(
        "conv_id", *[F.when(of_agents(guard), verdict).alias(guard) for guard, verdict in guards.items()]
    )
    verdicts = verdict_rows(judged, "conv_id", **{guard: F.col(guard) for guard in guards})
    held = answers.where(of_agents("grounding_guard"))
    checked = grounded_sentences(
        sentences(held, "text", ["conv_id"]),
        held.select("conv_id", F.col("context").alias("text")),
        pool="conv_id",
    )
    grounded = grounding_verdicts(checked, "conv_id").select(
        "conv_id", F.lit("grounding_guard").alias("guard"), "passed", "message"
    )
    return verdicts.unionByName(grounded)


def with_agent_prompts(messages: DataFrame, rules: Rules, tools: Mapping[str, str]) -> DataFrame:
    """The conversations with the prompt of the agent their last question goes to put before them.

    ``tools`` names the tool of each agent. A question for no agent gets no prompt.
    """
    asked = last_message(messages, USER).select("conv_id", F.col("text").alias("question"))
    routed = classify_route(asked, "question", rules, list(AGENT_PROMPTS))
    prompts = {
        agent: render_prompt(template, tool_name=F.lit(tools[agent]))
        for agent, template in AGENT_PROMPTS.items()
        if agent in tools
    }
    return with_system_prompt(
        messages, routed.select("conv_id", dispatch_columns("route", prompts).alias("prompt"))
    )


def run_tool_calls(messages: DataFrame, tools: Mapping[str, Handler]) -> DataFrame:
    """The conversations with the results of their last message's tool calls appended.

    Every call is a row ``conv_id, turn, tool, call_id, args`` with its place as ``turn``; the
    handler of its tool adds ``text``. A call of a tool that is not there is answered by saying
    so. The router's calls name an agent and are left to ``next_step``.
    """
    last = messages.groupBy("conv_id").agg(
        F.max_by(F.struct("role", "name", "tool_calls"), "turn").alias("m")
    )
    calling = (F.col("m.role") == ASSISTANT) & ~F.col("m.name").eqNullSafe(ROUTER)
    # Written once, since each tool picks its calls from them.
    calls = cut_lineage(
        last.where(calling)
        .select("conv_id", F.posexplode("m.tool_calls").alias("turn", "call"))
        .select(
            "conv_id",
            F.col("turn").cast(messages.schema["turn"].dataType).alias("turn"),
            F.col("call.name").alias("tool"),
            F.col("call.id").alias("call_id"),
            F.col("call.args").alias("args"),
        )
    )
    wanted = ["conv_id", "turn", "tool", "text"]

    def result(handler: Handler) -> Handler:
        return lambda rows: handler(rows).select(*wanted)

    def unknown(rows: DataFrame) -> DataFrame:
        return rows.withColumn("text", F.concat(F.lit(NO_TOOL), F.coalesce("tool", F.lit("NULL"))))

    handlers = {name: result(handler) for name, handler in tools.items()}
    found = dispatch(calls, "tool", {**handlers, NO_TOOL: result(unknown)}, default=NO_TOOL)
    return append_messages(
        messages,
        found.select("conv_id", "turn", F.lit(TOOL).alias("role"), "text", F.col("tool").alias("name")),
    )


def function_tool(name: str, arguments: Sequence[str]) -> Handler:
    """A registered function of numbers as a tool: arguments by name, in text form."""
    values = [F.try_element_at("args", F.lit(a)).try_cast("double") for a in arguments]
    return lambda calls: calls.withColumn("text", call_function(name, *values).cast("string"))


def table_tool(curated: Mapping[str, CuratedQuery]) -> Handler:
    """The curated queries as a tool with the argument ``question``."""

    def answer(calls: DataFrame) -> DataFrame:
        asked = calls.withColumn("question", F.try_element_at("args", F.lit("question")))
        return ask_table(asked, curated).withColumnRenamed("response", "text")

    return answer
