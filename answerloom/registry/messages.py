"""Checked queries: conversations, routing, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.prompts import (
    ANALYST_PROMPT,
    CODE_PROMPT,
    GENERAL_PROMPT,
    UNROUTED_ANSWER,
    render_prompt,
    routing_prompt,
)
from answerloom.operators import messages as M
from answerloom.operators import routing as R
from answerloom.plans.routed import four_way, three_way
from answerloom.registry import _sql
from answerloom.registry._base import query
from answerloom.session import new_folder
from answerloom.sources import scan, stream_scan
from answerloom.streaming.memory import conversation_memory, recall_threads, remember

# The prose of the tables is invented, so the rules use its frequent words.
RULES = (("code", ("der", "die")), ("tables", ("the",)), ("dashboards", ("que", "la")))
THREE_RULES = (("dashboards", ("the",)), ("catalog", ("que", "la")))

_AGENT_MESSAGES = """
    agent_messages AS (
      SELECT conv_id, turn, role, text,
             CASE WHEN role = 'assistant' THEN
               CASE (conv_id + turn) % 3 WHEN 0 THEN 'router' WHEN 1 THEN 'documents' ELSE 'tables' END
             END AS name,
             CASE WHEN role = 'assistant' THEN
               CASE length(text) % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END
             END AS n_calls,
             CASE length(text) % 3 WHEN 0 THEN 'documents' WHEN 1 THEN 'tables' ELSE 'nobody' END AS choice
      FROM conversations
    )"""


def agent_messages(spark: SparkSession, directory: str) -> DataFrame:
    """Conversations with author names and tool calls made up from their rows."""
    size = F.length("text")
    choice = (
        F.when(size % 3 == 0, "documents").when(size % 3 == 1, "tables").otherwise("nobody")
    )
    call = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.lit("route").alias("name"),
        F.create_map(F.lit("choice"), choice).alias("args"),
    )
    author = (
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "router")
        .when((F.col("conv_id") + F.col("turn")) % 3 == 1, "documents")
        .otherwise("tables")
    )
    calls = (
        F.when(size % 4 == 1, F.array().cast(M.TOOL_CALLS))
        .when(size % 4 == 2, F.array(call))
        .when(size % 4 == 3, F.array(call, call))
    )
    spoken = F.col("role") == "assistant"
    return scan(spark, directory, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(spoken, author).alias("name"),
        F.when(spoken, calls).cast(M.TOOL_CALLS).alias("tool_calls"),
    )


def conversation_ids(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id").distinct()


@query(
    "parse_payloads",
    "SELECT conv_id, turn, 0::BIGINT AS ix, role, text AS content FROM conversations WHERE turn <> 4",
)
def parse_payloads(spark: SparkSession, directory: str) -> DataFrame:
    """Each message as a request of one of four shapes, or as broken JSON."""
    message = F.struct("role", F.col("text").alias("content"))
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    typed = F.struct(
        F.coalesce(kind, "role").alias("type"), F.struct(F.col("text").alias("content")).alias("data")
    )
    payload = (
        F.when(F.col("turn") % 8 == 0, F.to_json(F.struct(F.array(message).alias("messages"))))
        .when(F.col("turn") % 8 == 1, F.to_json(F.array(message)))
        .when(F.col("turn") % 8 == 2, F.to_json(message))
        .when(F.col("turn") % 8 == 3, F.to_json(F.array(typed)))
        .when(F.col("turn") == 4, F.concat(F.lit('{"messages": ['), F.to_json(message)))
        .otherwise(F.to_json(F.struct(F.array(typed).alias("messages"))))
    )
    parsed = scan(spark, directory, "conversations").select(
        "conv_id", "turn", F.posexplode(M.parse_payload(payload)).alias("ix", "m")
    )
    return parsed.select("conv_id", "turn", F.col("ix").cast("bigint").alias("ix"), "m.role", "m.content")


def _last_sql(where: str) -> str:
    return (
        "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text "
        f"FROM conversations {where} GROUP BY conv_id"
    )


@query("last_human_message", _last_sql("WHERE role = 'user'"))
def last_human_message(spark: SparkSession, directory: str) -> DataFrame:
    return M.last_message(scan(spark, directory, "conversations"), M.USER)


@query("last_ai_message", _last_sql("WHERE role = 'assistant'"))
def last_ai_message(spark: SparkSession, directory: str) -> DataFrame:
    return M.last_message(scan(spark, directory, "conversations"), M.ASSISTANT)


@query(
    "latest_content",
    """SELECT c.conv_id, coalesce(m.text, '') AS text
       FROM (SELECT DISTINCT conv_id FROM conversations) c
       LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations
                  WHERE role = 'assistant' GROUP BY conv_id) m USING (conv_id)""",
)
def latest_content(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    return M.latest_content(conversation_ids(messages), messages.where("role = 'assistant'"))


@query(
    "first_messages",
    """SELECT c.conv_id, m.role, m.text,
              CASE WHEN m.conv_id IS NULL THEN 'No messages found in payload' END AS error
       FROM (SELECT DISTINCT conv_id FROM conversations) c
       LEFT JOIN (SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text
                  FROM conversations WHERE role <> 'user' GROUP BY conv_id) m USING (conv_id)""",
)
def first_messages(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    return M.first_message(conversation_ids(messages), messages.where("role <> 'user'"))


@query(
    "append_messages",
    """WITH history AS (SELECT * FROM conversations WHERE role = 'user'),
        last AS (SELECT conv_id, max(turn) AS t FROM history GROUP BY conv_id)
       SELECT conv_id, turn, role, text FROM history
       UNION ALL
       SELECT n.conv_id,
              coalesce(l.t, -1) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS turn,
              n.role, n.text
       FROM conversations n LEFT JOIN last l ON l.conv_id = n.conv_id WHERE n.role <> 'user'""",
)
def append_messages(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    return M.append_messages(messages.where("role = 'user'"), messages.where("role <> 'user'"))


@query(
    "system_prompts",
    """SELECT conv_id, turn, role, text FROM conversations
       UNION ALL
       SELECT conv_id, -1, 'system', 'Answer in ' || count(*) || ' turns.' FROM conversations
       GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0""",
)
def system_prompts(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    prompt = render_prompt("Answer in {n} turns.", n="n")
    prompts = (
        messages.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "system").alias("s"))
        .select("conv_id", F.when(F.col("s") == 0, prompt).alias("prompt"))
    )
    return M.with_system_prompt(messages, prompts)


@query(
    "message_names",
    f"""WITH {_AGENT_MESSAGES}
        SELECT conv_id, turn, name AS before, coalesce(name, role) AS added, NULL::VARCHAR AS removed
        FROM agent_messages""",
)
def message_names(spark: SparkSession, directory: str) -> DataFrame:
    message = F.struct("role", F.col("text").alias("content"), "name", "tool_calls")
    named = agent_messages(spark, directory).withColumn("m", message)
    added = M.add_name("m", F.coalesce("name", "role"))
    return named.select(
        "conv_id",
        "turn",
        M.get_name("m").alias("before"),
        M.get_name(added).alias("added"),
        M.get_name(M.remove_name(added)).alias("removed"),
    )


@query(
    "without_routes",
    f"""WITH {_AGENT_MESSAGES}
        SELECT conv_id, turn, name, n_calls::BIGINT AS n_calls FROM agent_messages
        WHERE NOT (n_calls IS NOT NULL AND coalesce(name, '') = 'router')""",
)
def without_routes(spark: SparkSession, directory: str) -> DataFrame:
    kept = M.filter_out_routes(agent_messages(spark, directory))
    n_calls = F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls")).cast("bigint")
    return kept.select("conv_id", "turn", "name", n_calls.alias("n_calls"))


@query(
    "next_steps",
    f"""WITH {_AGENT_MESSAGES},
        last AS (
          SELECT conv_id, arg_max(role, turn) AS role, arg_max(coalesce(name, ''), turn) AS name,
                 arg_max(coalesce(n_calls, 0), turn) AS calls, arg_max(choice, turn) AS choice,
                 arg_max(coalesce(name, ''), turn) FILTER (WHERE role = 'assistant') AS author
          FROM agent_messages GROUP BY conv_id)
        SELECT conv_id,
          CASE WHEN role = 'assistant' AND calls = 0 THEN 'END'
               WHEN role = 'assistant' AND name = 'router' THEN
                 CASE WHEN calls = 1 AND choice <> 'nobody' THEN choice END
               WHEN role = 'assistant' THEN 'tools'
               WHEN author IN ('documents', 'tables', 'router') THEN author
               ELSE 'router' END AS step,
          CASE WHEN role = 'assistant' AND calls > 1 AND name = 'router' THEN 'Too many tools'
               WHEN role = 'assistant' AND calls = 1 AND name = 'router' AND choice = 'nobody'
                 THEN 'Unknown choice nobody' END AS error
        FROM last""",
)
def next_steps(spark: SparkSession, directory: str) -> DataFrame:
    return M.next_step(agent_messages(spark, directory), ["documents", "tables"])


@query(
    "conversation_memory",
    """SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n_messages,
              max(turn) OVER (PARTITION BY conv_id) AS last_turn
       FROM conversations""",
)
def memory(spark: SparkSession, directory: str) -> DataFrame:
    """The messages are taken in by a stream, and by a second run of it that finds nothing new."""
    path, checkpoint = new_folder(spark, "memory"), new_folder(spark, "memory-checkpoint")
    for _ in range(2):
        remember(stream_scan(spark, directory, "conversations"), path, checkpoint)
    return conversation_memory(spark.read.parquet(path))


@query(
    "recalled_threads",
    """SELECT conv_id, turn, role, text FROM conversations
       WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def recalled_threads(spark: SparkSession, directory: str) -> DataFrame:
    """Whole threads of the conversations with a system message."""
    messages = scan(spark, directory, "conversations")
    return recall_threads(messages, messages.where("role = 'system'"))


# ---- routing ---------------------------------------------------------------


def _rule_sql(rules, text: str = "text") -> str:
    words = rf"list_transform({_sql.tokens(text)}, lambda w: regexp_replace(w, '^\W+|\W+$', '', 'g'))"
    cases = " ".join(
        f"WHEN list_has_any({words}, [{', '.join(repr(k) for k in keywords)}]) THEN '{route}'"
        for route, keywords in rules
    )
    return f"CASE {cases} ELSE 'general' END"


_QUESTIONS = (
    "question AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations "
    "WHERE role = 'user' GROUP BY conv_id)"
)


def questions(spark: SparkSession, directory: str) -> DataFrame:
    asked = M.last_message(scan(spark, directory, "conversations"), M.USER)
    return asked.select("conv_id", F.col("text").alias("question"))


@query(
    "classified_questions",
    f"WITH {_QUESTIONS} SELECT conv_id, text AS question, {_rule_sql(RULES)} AS route FROM question",
)
def classified_questions(spark: SparkSession, directory: str) -> DataFrame:
    return R.classify_route(
        questions(spark, directory), "question", RULES, ("code", "general", "tables", "dashboards")
    )


@query(
    "normalised_routes",
    """SELECT conv_id, turn, CASE WHEN lower(trim(answer, ' ' || chr(10))) IN ('user', 'system')
              THEN lower(trim(answer, ' ' || chr(10))) ELSE 'general' END AS route
       FROM (SELECT conv_id, turn, ' ' || upper(role) || chr(10) AS answer FROM conversations)""",
)
def normalised_routes(spark: SparkSession, directory: str) -> DataFrame:
    answered = F.concat(F.lit(" "), F.upper("role"), F.lit("\n"))
    return scan(spark, directory, "conversations").select(
        "conv_id", "turn", R.normal_route(answered, ("user", "system"), "general").alias("route")
    )


@query(
    "dispatched_questions",
    f"""WITH {_QUESTIONS}, routed AS (SELECT conv_id, text, {_rule_sql(RULES)} AS route FROM question)
        SELECT conv_id, route, CASE route WHEN 'code' THEN 'def ' || text WHEN 'tables' THEN reverse(text)
               WHEN 'dashboards' THEN lower(text) ELSE '{UNROUTED_ANSWER}' END || '!' AS answer
        FROM routed""",
)
def dispatched_questions(spark: SparkSession, directory: str) -> DataFrame:
    routed = R.classify_route(
        questions(spark, directory), "question", RULES, ("code", "general", "tables", "dashboards")
    )

    def answering(answer):
        return lambda df: df.select("conv_id", "route", answer.alias("answer"))

    return R.dispatch(
        routed,
        "route",
        {
            "code": answering(F.concat(F.lit("def "), "question")),
            "tables": answering(F.reverse("question")),
            "dashboards": answering(F.lower("question")),
            "general": answering(F.lit(UNROUTED_ANSWER)),
        },
        default="general",
        then=lambda df: df.withColumn("answer", F.concat("answer", F.lit("!"))),
    )


@query(
    "four_way_routing",
    f"""WITH {_QUESTIONS}, routed AS (SELECT conv_id, text, {_rule_sql(RULES)} AS route FROM question)
        SELECT conv_id, route,
          CASE route WHEN 'code' THEN replace('{CODE_PROMPT}', '{{input}}', text)
                     WHEN 'dashboards' THEN replace('{ANALYST_PROMPT}', '{{input}}', text)
                     WHEN 'general' THEN replace('{GENERAL_PROMPT}', '{{input}}', text) END AS prompt,
          answer, {_sql.covering('answer')} AS summary
        FROM (SELECT *, CASE route WHEN 'tables' THEN 'Rows: ' || length(text) ELSE {_sql.covering('text')} END AS answer
              FROM routed)""",
)
def four_way_routing(spark: SparkSession, directory: str) -> DataFrame:
    from_table = F.concat(F.lit("Rows: "), F.length("question"))
    routed = four_way(questions(spark, directory), RULES, from_table)
    return routed.select("conv_id", "route", "prompt", "answer", "summary")


@query(
    "three_way_routing",
    f"""WITH {_QUESTIONS}, routed AS (SELECT conv_id, text, {_rule_sql(THREE_RULES)} AS route FROM question)
        SELECT conv_id, route, CASE route WHEN 'general' THEN '{UNROUTED_ANSWER}'
               ELSE route || ': ' || text END AS answer FROM routed""",
)
def three_way_routing(spark: SparkSession, directory: str) -> DataFrame:
    handlers = {
        name: F.concat(F.lit(f"{name}: "), F.col("question")) for name in ("dashboards", "catalog")
    }
    routed = three_way(questions(spark, directory), THREE_RULES, handlers)
    return routed.select("conv_id", "route", "answer")


@query(
    "step_trace",
    """WITH step AS (
          SELECT conv_id, turn, 0 AS step, 'router' AS node, 0 AS ix, role AS message FROM conversations
          UNION ALL SELECT conv_id, turn, 1, 'agent', 0, role FROM conversations
          UNION ALL SELECT conv_id, turn, 1, 'agent', 1, text FROM conversations)
       SELECT conv_id, turn, step::BIGINT AS step, node, ix::BIGINT AS ix, message FROM step""",
)
def step_trace(spark: SparkSession, directory: str) -> DataFrame:
    def step(node, *messages):
        return F.struct(F.lit(node).alias("node"), F.array(*messages).alias("messages"))

    steps = F.array(step("router", "role"), step("agent", "role", "text"))
    updates = scan(spark, directory, "conversations").withColumn("steps", steps)
    return R.step_trace(updates, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.col("step").cast("bigint").alias("step"),
        "node",
        F.col("ix").cast("bigint").alias("ix"),
        "message",
    )


def agents(spark: SparkSession, directory: str) -> DataFrame:
    """A registry from the tables: regions as agents, their nations as tools."""
    region, nation = scan(spark, directory, "region"), scan(spark, directory, "nation")
    named = F.array_sort(F.collect_list("n_name"))
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("name"))
        .agg(named.alias("tools"))
        .withColumn("description", F.array_join("tools", ", "))
    )


_AGENTS = """agent AS (
      SELECT r_name AS name, list(n_name ORDER BY n_name) AS tools,
             string_agg(n_name, ', ' ORDER BY n_name) AS description
      FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"""


@query(
    "routing_prompt",
    f"""WITH {_AGENTS}
        SELECT 'Choices, one a line:' || chr(10)
          || string_agg('- If the user is asking about ' || description || ' then call the router with `'
                        || name || '`', chr(10) ORDER BY name)
          || chr(10) || 'Reply with one tool call whose argument `choice` is one of these names.' AS prompt,
          'should be one of: ' || string_agg(name, ',' ORDER BY name) AS choices
        FROM agent""",
)
def agents_prompt(spark: SparkSession, directory: str) -> DataFrame:
    return routing_prompt(agents(spark, directory))


@query(
    "agent_tools",
    f"""WITH {_AGENTS}
        SELECT name, (generate_subscripts(tools, 1) - 1)::BIGINT AS tool_ix, unnest(tools) AS tool FROM agent""",
)
def agent_tools(spark: SparkSession, directory: str) -> DataFrame:
    tools = R.agent_tools(agents(spark, directory))
    return tools.withColumn("tool_ix", F.col("tool_ix").cast("bigint"))


@query(
    "rendered_prompts",
    """SELECT conv_id, turn, 'You are ' || role || '. Turn ' || turn || ': ' || text || '{}' AS prompt
       FROM conversations""",
)
def rendered_prompts(spark: SparkSession, directory: str) -> DataFrame:
    prompt = render_prompt("You are {who}. Turn {n}: {input}{{}}", who="role", n="turn", input="text")
    return scan(spark, directory, "conversations").select("conv_id", "turn", prompt.alias("prompt"))
