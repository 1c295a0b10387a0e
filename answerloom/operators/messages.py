"""Operators over conversations in long form: one row per message.

The columns are ``conv_id, turn, role, text`` and, where agents take part,
``name`` and ``tool_calls``. ``tool_calls`` is NULL where a message has none
and empty where the list is present but empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerloom.functions.columns import as_column

TOOL_CALLS = "array<struct<id: string, name: string, args: map<string,string>>>"
MESSAGE = f"struct<role: string, content: string, name: string, tool_calls: {TOOL_CALLS}>"

USER, ASSISTANT, SYSTEM, TOOL = "user", "assistant", "system", "tool"
END, ROUTER, TOOLS = "END", "router", "tools"

# Turns per bucket when positions within a conversation are numbered.
TURN_BUCKET = 4096


# ---- parsing ---------------------------------------------------------------


def parse_payload(payload: Column | str) -> Column:
    """Request JSON to an array of messages; NULL for any other shape.

    Accepted are ``{"messages": [...]}``, a list of messages and one message. A
    message is ``{"role", "content"}`` or ``{"type", "data": {"content"}}``; tool calls stand in
    either place, and a message that has some needs no content.
    """
    value = F.try_parse_json(as_column(payload))
    kind = F.schema_of_variant(value)
    listed = f"array<{_WIRE}>"
    whole = F.try_variant_get(value, "$", listed)
    inner = F.try_variant_get(value, "$.messages", listed)
    single = F.array(F.try_variant_get(value, "$", _WIRE))
    messages = (
        F.when(kind.startswith("ARRAY"), whole)
        .when(kind.startswith("OBJECT") & F.try_variant_get(value, "$.messages", "variant").isNotNull(), inner)
        .when(kind.startswith("OBJECT"), single)
    )
    messages = F.transform(messages, _from_wire)
    complete = F.forall(
        messages,
        lambda m: m["role"].isNotNull()
        & (m["content"].isNotNull() | (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)),
    )
    return F.when(complete, messages)


_WIRE = (
    "struct<role: string, content: string, name: string, type: string, "
    f"data: struct<content: string, name: string, tool_calls: {TOOL_CALLS}>, tool_calls: {TOOL_CALLS}>"
)
_TYPE_ROLES = {"human": USER, "ai": ASSISTANT, "system": SYSTEM, "tool": TOOL}


def _from_wire(message: Column) -> Column:
    roles = F.create_map(*[F.lit(x) for pair in _TYPE_ROLES.items() for x in pair])
    return F.struct(
        F.coalesce(message["role"], F.try_element_at(roles, message["type"])).alias("role"),
        F.coalesce(message["content"], message["data"]["content"]).alias("content"),
        F.coalesce(message["name"], message["data"]["name"]).alias("name"),
        F.coalesce(message["tool_calls"], message["data"]["tool_calls"]).alias("tool_calls"),
    )


def last_of(messages: Column | str, role: str | None = None) -> Column:
    """The last message of an array, of one role if given; NULL if there is none."""
    found = as_column(messages)
    if role is not None:
        found = F.filter(found, lambda m: m["role"] == role)
    return F.try_element_at(found, F.lit(-1))


# ---- picking messages ------------------------------------------------------


def last_message(messages: DataFrame, role: str | None = None) -> DataFrame:
    """``conv_id, turn, text`` of the last message, of one role if given.

    A maximum with partial aggregation: at most one row per conversation and
    task is shuffled, however long a conversation is.
    """
    kept = messages if role is None else messages.where(F.col("role") == role)
    return kept.groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text")
    )


def latest_content(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Text of the last message per conversation, ``""`` where there is none."""
    return conversations.select("conv_id").join(
        last_message(messages).drop("turn"), "conv_id", "left"
    ).select("conv_id", F.coalesce("text", F.lit("")).alias("text"))


def first_message(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """``conv_id, role, text, error`` of the first message per conversation."""
    first = messages.groupBy("conv_id").agg(
        F.min_by(F.struct("role", "text"), "turn").alias("first")
    )
    return conversations.select("conv_id").join(first, "conv_id", "left").select(
        "conv_id",
        "first.role",
        "first.text",
        F.when(F.col("first").isNull(), "No messages found in payload").alias("error"),
    )


# ---- building conversations ------------------------------------------------


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """History followed by ``new``, numbered on from the last turn.

    The order of ``new`` is its own ``turn``, unique within a conversation.
    Positions are counted per bucket of turns first and shifted by the rows in
    the buckets before, so no task sorts a whole conversation.
    """
    bucketed = new.withColumn("_bucket", F.floor(F.col("turn") / TURN_BUCKET))
    ahead = (
        bucketed.groupBy("conv_id", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_ahead",
            F.sum("_rows").over(Window.partitionBy("conv_id").orderBy("_bucket")) - F.col("_rows"),
        )
        .drop("_rows")
    )
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    place = F.row_number().over(Window.partitionBy("conv_id", "_bucket").orderBy("turn"))
    numbered = (
        bucketed.withColumn("_place", place)
        .join(ahead, ["conv_id", "_bucket"])
        .join(last, "conv_id", "left")
        .withColumn(
            "turn", F.coalesce("_last", F.lit(-1).cast("bigint")) + F.col("_ahead") + F.col("_place")
        )
    )
    return history.unionByName(numbered.select(*new.columns), allowMissingColumns=True)


def with_system_prompt(messages: DataFrame, prompts: DataFrame) -> DataFrame:
    """Put ``prompts(conv_id, prompt)`` before the conversations that have one."""
    system = prompts.where("prompt IS NOT NULL").select(
        "conv_id",
        F.lit(-1).cast(messages.schema["turn"].dataType).alias("turn"),
        F.lit(SYSTEM).alias("role"),
        F.col("prompt").alias("text"),
    )
    return messages.unionByName(system, allowMissingColumns=True)


def add_name(message: Column | str, name: Column | str) -> Column:
    return as_column(message).withField("name", as_column(name))


def remove_name(message: Column | str) -> Column:
    return as_column(message).withField("name", F.lit(None).cast("string"))


def get_name(message: Column | str) -> Column:
    return as_column(message).getField("name")


# ---- tool calls and control flow -------------------------------------------


def is_tool_call(tool_calls: Column | str = "tool_calls") -> Column:
    return as_column(tool_calls).isNotNull()


def filter_out_routes(messages: DataFrame) -> DataFrame:
    """Drop the router's tool calls; its other messages stay."""
    routed = is_tool_call() & F.col("name").eqNullSafe(ROUTER)
    return messages.where(~routed)


def next_step(messages: DataFrame, agent_names: Sequence[str]) -> DataFrame:
    """``conv_id, step, error``: where each conversation goes next.

    An answer without tool calls ends it. The router's call names the next
    agent; other calls go to the tools. Whatever else comes last returns to
    the agent that spoke last, or to the router.
    """
    known = [*agent_names, *([] if ROUTER in agent_names else [ROUTER])]
    message = F.struct("role", "name", "tool_calls")
    last_and_author = messages.groupBy("conv_id").agg(
        F.max_by(message, "turn").alias("last"),
        F.max_by(F.struct("name"), F.when(F.col("role") == ASSISTANT, F.col("turn"))).alias("ai"),
    )
    calls = F.col("last.tool_calls")
    answered = F.col("last.role") == ASSISTANT
    calling = answered & (F.coalesce(F.size(calls), F.lit(0)) > 0)
    routing = calling & F.col("last.name").eqNullSafe(ROUTER)
    choice = F.try_element_at(calls[0]["args"], F.lit("choice"))
    error = (
        F.when(routing & (F.size(calls) > 1), "Too many tools")
        .when(routing & ~F.coalesce(choice.isin(known), F.lit(False)),
              F.concat(F.lit("Unknown choice "), F.coalesce(choice, F.lit("NULL"))))
    )
    step = (
        F.when(answered & ~calling, END)
        .when(routing, choice)
        .when(calling, TOOLS)
        .when(F.col("ai.name").isin(known), F.col("ai.name"))
        .otherwise(ROUTER)
    )
    return last_and_author.select(
        "conv_id", F.when(error.isNull(), step).alias("step"), error.alias("error")
    )
