"""Checked queries: answering, models, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.embedding import embed
from answerloom.functions.models import map_model, map_model_once, summarize
from answerloom.functions.prompts import UNROUTED_ANSWER
from answerloom.functions.text import sentences
from answerloom.operators import evaluation as E
from answerloom.operators.grounding import grounded_sentences
from answerloom.operators.messages import TOOL_CALLS, USER, last_message
from answerloom.operators.search import topk
from answerloom.operators.tables import CuratedQuery, count_documents, register_functions
from answerloom.plans.answering import (
    answer_from_hits,
    answer_questions,
    guarded_answers,
    stuff_context,
)
from answerloom.plans.turn import (
    answer_turn,
    function_tool,
    run_tool_calls,
    table_tool,
    with_agent_prompts,
)
from answerloom.registry import _kept, _sql
from answerloom.registry._base import query
from answerloom.registry.guards import LEXICON, grounding_sql, pii_list_sql, topic_sql
from answerloom.registry.messages import (
    _AGENT_MESSAGES,
    _QUESTIONS,
    _rule_sql,
    agent_messages,
    conversation_ids,
)
from answerloom.registry.search import (
    CHUNK_KEY_SQL,
    as_queries,
    vectors_of,
)
from answerloom.session import cut_lineage, new_folder
from answerloom.sources import scan

_ANSWERED = f"""
    {_sql.chunks('documents', 'doc_id', 'text')},
    keyed AS (SELECT {CHUNK_KEY_SQL} AS id, d.source, c.content
              FROM chunk c JOIN documents d ON d.doc_id = c.key),
    {_QUESTIONS},
    {_sql.embedded('corpus', 'keyed', 'id', 'content')},
    {_sql.embedded('asked', 'question', 'conv_id', 'text')},
    {_sql.ranked('asked', 'corpus', 5)},
    passage AS (SELECT query, rk, content AS text FROM hits JOIN keyed ON keyed.id = hits.key),
    wanted AS (SELECT conv_id AS query, text AS question FROM question),
    {_sql.best_sentences('best', 'passage', 'wanted')},
    stuffed AS (
      SELECT query AS conv_id, string_agg('Passage: ' || content || chr(10), '' ORDER BY rk) AS context,
             string_agg(source, ',' ORDER BY rk) AS sources, coalesce(any_value(best.answer), '') AS answer
      FROM hits JOIN keyed ON keyed.id = hits.key LEFT JOIN best USING (query) GROUP BY query
    )"""


@query(
    "answer_questions",
    f"""WITH RECURSIVE {_ANSWERED},
        judged AS (
          SELECT c.conv_id, q.text AS question, s.answer, s.sources,
                 CASE WHEN q.conv_id IS NULL THEN 'No Human Message found in messages' END AS error,
                 {pii_list_sql("coalesce(s.answer, '')")} AS found
          FROM (SELECT DISTINCT conv_id FROM conversations) c
          LEFT JOIN question q USING (conv_id) LEFT JOIN stuffed s USING (conv_id))
        SELECT conv_id, question, answer, sources, error, len(found) = 0 AS passed,
               CASE WHEN len(found) > 0 THEN 'PII detected: ' || array_to_string(found, ', ')
                    ELSE 'No PII detected' END AS message
        FROM judged""",
)
def answered(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    answers = answer_questions(
        conversation_ids(messages), messages, _kept.chunk_index(spark, directory).live(spark), 5
    )
    return guarded_answers(answers).select(
        "conv_id",
        "question",
        "answer",
        F.array_join("sources", ",").alias("sources"),
        "error",
        "passed",
        "message",
    )


@query(
    "stuffed_context",
    f"""WITH RECURSIVE {_ANSWERED} SELECT conv_id, context, sources FROM stuffed""",
)
def stuffed_context(spark: SparkSession, directory: str) -> DataFrame:
    asked = last_message(scan(spark, directory, "conversations"), USER)
    queries = asked.select(F.col("conv_id").alias("query_id"), embed("text").alias("embedding"))
    hits = topk(queries, _kept.chunk_index(spark, directory).live(spark), 5, columns=["content", "source"])
    stuffed = stuff_context(hits)
    return stuffed.select(
        F.col("query_id").alias("conv_id"), "context", F.array_join("sources", ",").alias("sources")
    )


def echo():
    """A batch model for the check: the prompt and its length."""
    return lambda prompts: [f"<{prompt}> ({len(prompt)})" for prompt in prompts]


@query(
    "model_in_batches",
    "SELECT conv_id, turn, '<' || text || '> (' || length(text) || ')' AS answer FROM conversations",
)
def model_in_batches(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    return map_model(messages, "text", echo).select("conv_id", "turn", "answer")


@query(
    "model_called_once",
    """SELECT conv_id, turn, '<' || text || '> (' || length(text) || ')' AS answer,
              (SELECT count(DISTINCT text) FROM conversations) AS calls FROM conversations""",
)
def model_called_once(spark: SparkSession, directory: str) -> DataFrame:
    """Two runs over the conversations, with one call for each distinct text in all."""
    messages, answers = scan(spark, directory, "conversations"), new_folder(spark, "answers")
    map_model_once(messages.where("turn < 2"), "text", echo, answers, alias="echo")
    answered = map_model_once(messages, "text", echo, answers, alias="echo")
    calls = spark.read.parquet(answers).count()
    return answered.select("conv_id", "turn", "answer", F.lit(calls).cast("bigint").alias("calls"))


@query("summaries", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_sql.covering('text')} END AS summary FROM documents")
def summaries(spark: SparkSession, directory: str) -> DataFrame:
    return summarize(scan(spark, directory, "documents", spread=True), "text").select("doc_id", "summary")


_TURN_RULES = (("documents", ("que", "la")), ("tables", ("the",)))


@query(
    "conversation_turn",
    f"""WITH RECURSIVE {_AGENT_MESSAGES},
        {_ANSWERED},
        history AS (
          SELECT conv_id, turn, role, text, name FROM agent_messages
          WHERE NOT (n_calls IS NOT NULL AND coalesce(name, '') = 'router')),
        routed AS (SELECT conv_id, text AS question, {_rule_sql(_TURN_RULES)} AS route FROM question),
        languages AS (
          SELECT 'Documents per language' || chr(10) || '| lang | n_docs |' || chr(10) || '| --- | --- |' || chr(10)
            || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS response
          FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang
                UNION ALL SELECT 'all', count(*) FROM documents)),
        answered AS (
          SELECT conv_id, route AS name,
                 CASE route WHEN 'documents' THEN answer WHEN 'tables' THEN (SELECT response FROM languages)
                            ELSE '{UNROUTED_ANSWER}' END AS text
          FROM routed LEFT JOIN stuffed USING (conv_id)),
        guarded AS (SELECT conv_id, name, text FROM answered WHERE name <> 'general'),
        {topic_sql('guarded', 'conv_id', 'text')},
        failed AS (
          SELECT conv_id, name, concat_ws('; ',
            CASE WHEN len(found) > 0 THEN 'PII detected: ' || array_to_string(found, ', ') END,
            'The text contains the following banned topics: [' || topics || ']') AS reasons
          FROM (SELECT *, {pii_list_sql('text')} AS found FROM guarded LEFT JOIN banned USING (conv_id))
          WHERE len(found) > 0 OR topics IS NOT NULL),
        last AS (SELECT conv_id, max(turn) AS turn FROM history GROUP BY conv_id)
        SELECT conv_id, turn, role, text, name FROM history
        UNION ALL
        SELECT conv_id, turn + 1, 'assistant', text, name FROM answered JOIN last USING (conv_id)
        UNION ALL
        SELECT conv_id, turn + 2, 'assistant', 'Guard failed - ' || reasons, name
        FROM failed JOIN last USING (conv_id)""",
)
def conversation_turn(spark: SparkSession, directory: str) -> DataFrame:
    documents = scan(spark, directory, "documents")
    curated = {
        "languages": CuratedQuery(
            "Documents per language", ("the",), count_documents(documents), ["lang"]
        )
    }
    index = _kept.chunk_index(spark, directory).live(spark)
    turn = answer_turn(
        agent_messages(spark, directory), index, curated, _TURN_RULES, banned=LEXICON
    )
    return turn.select("conv_id", "turn", "role", "text", "name")


@query(
    "agent_prompts",
    f"""WITH {_QUESTIONS},
        routed AS (SELECT conv_id, {_rule_sql(_TURN_RULES)} AS route FROM question)
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT conv_id, -1, 'system', CASE route
          WHEN 'documents' THEN '`search` returns rows of `rk`, `source`, `content` and `score`, best first. '
            || 'Quote a sentence of `content` and name its `source`.'
          ELSE '`ask_table` takes a map with the key `question` and returns a heading and a text table. '
            || 'Pass both on unchanged.' END
        FROM routed WHERE route <> 'general'""",
)
def agent_prompts(spark: SparkSession, directory: str) -> DataFrame:
    tools = {"documents": "search", "tables": "ask_table", "functions": "area"}
    return with_agent_prompts(scan(spark, directory, "conversations"), _TURN_RULES, tools)


@query(
    "tool_turn",
    """WITH last AS (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
                     FROM conversations GROUP BY conv_id),
        calling AS (SELECT * FROM last WHERE role = 'assistant'),
        languages AS (
          SELECT 'Documents per language' || chr(10) || '| lang | n_docs |' || chr(10) || '| --- | --- |' || chr(10)
            || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS response
          FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang
                UNION ALL SELECT 'all', count(*) FROM documents))
        SELECT conv_id, turn, role, text,
               CASE WHEN role = 'assistant' THEN 'functions' END AS name FROM conversations
        UNION ALL
        SELECT conv_id, turn + 1, 'tool', (length(text) * 2 + turn)::VARCHAR, 'area' FROM calling
        UNION ALL
        SELECT conv_id, turn + 2, 'tool', response, 'ask_table' FROM calling, languages
        UNION ALL
        SELECT conv_id, turn + 3, 'tool', 'There is no tool nothing', 'nothing' FROM calling""",
)
def tool_turn(spark: SparkSession, directory: str) -> DataFrame:
    """Every answer calls a function, the tables and a tool that is not there; the last ones are run."""

    def call(name: str, **args: Column) -> Column:
        pairs = [x for key, value in args.items() for x in (F.lit(key), value.cast("string"))]
        return F.struct(
            F.concat_ws("-", "conv_id", "turn", F.lit(name)).alias("id"),
            F.lit(name).alias("name"),
            F.create_map(*pairs).alias("args"),
        )

    calls = F.array(
        call("area", a=F.length("text"), b=F.col("turn")),
        call("ask_table", question=F.lit("How many documents has each language?")),
        call("nothing", a=F.col("turn")),
    )
    spoken = F.col("role") == "assistant"
    messages = scan(spark, directory, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(spoken, "functions").alias("name"),
        F.when(spoken, calls).cast(TOOL_CALLS).alias("tool_calls"),
    )
    register_functions(spark, {"area(a DOUBLE, b DOUBLE) RETURNS BIGINT": "CAST(a * 2 + b AS BIGINT)"})
    curated = {
        "languages": CuratedQuery(
            "Documents per language",
            ("language",),
            count_documents(scan(spark, directory, "documents")),
            ["lang"],
        )
    }
    tools = {"area": function_tool("area", ["a", "b"]), "ask_table": table_tool(curated)}
    return run_tool_calls(messages, tools).drop("tool_calls")


# ---- evaluation ------------------------------------------------------------

_EVALS = f"""
    evals AS (
      SELECT md5(doc_id::VARCHAR) AS eval_id, {_sql.first_sentence('text')} AS question,
             doc_id AS expected_source, text AS expected_text
      FROM documents ORDER BY 1 LIMIT 25)"""


def eval_set(spark: SparkSession, directory: str) -> DataFrame:
    documents = scan(spark, directory, "documents", spread=True)
    return E.make_eval_set(documents, "doc_id", "text", "source")


@query("eval_set", f"WITH {_EVALS} SELECT * FROM evals")
def evaluation_set(spark: SparkSession, directory: str) -> DataFrame:
    return eval_set(spark, directory)


_EVALUATED = f"""
    {_EVALS},
    {_sql.embedded('corpus', 'documents', 'doc_id', 'text')},
    {_sql.embedded('asked', 'evals', 'eval_id', 'question')},
    {_sql.ranked('asked', 'corpus', 5)},
    evaluated AS (
      SELECT e.eval_id, h.rk, CASE WHEN h.rk IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS hit,
             coalesce(1.0::DOUBLE / h.rk, 0.0) AS reciprocal_rank
      FROM evals e LEFT JOIN hits h ON h.query = e.eval_id AND h.key = e.expected_source)"""


def _evaluated(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    evals = cut_lineage(eval_set(spark, directory))
    corpus = _kept.document_index(spark, directory).live(spark)
    asked = evals.select(F.col("eval_id").alias("query_id"), embed("question").alias("embedding"))
    hits = cut_lineage(topk(asked, corpus, 5, columns=["content", "source"]))
    return evals, hits, E.evaluate(evals, hits)


@query(
    "evaluated_questions",
    f"""WITH {_EVALUATED}
        SELECT eval_id, rk, hit, round(reciprocal_rank, 6) AS reciprocal_rank FROM evaluated""",
)
def evaluated_questions(spark: SparkSession, directory: str) -> DataFrame:
    _, _, evaluated = _evaluated(spark, directory)
    return evaluated.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(
    "run_score",
    f"""WITH {_EVALUATED}
        , passage AS (SELECT query, rk, text FROM hits JOIN documents ON doc_id = hits.key),
        wanted AS (SELECT eval_id AS query, question FROM evals),
        {_sql.best_sentences('best', 'passage', 'wanted')},
        sentence AS (
          SELECT query AS pool, sentence_ix, sentence, query || '-' || sentence_ix AS sid
          FROM (SELECT query, generate_subscripts(ss, 1) AS sentence_ix, unnest(ss) AS sentence
                FROM (SELECT query, {_sql.sentence_list('answer')} AS ss FROM best))),
        source AS (SELECT expected_source AS src, eval_id AS pool, expected_text AS text FROM evals),
        {grounding_sql('pool', 'sentence', 'source')}
        SELECT count(*) AS n_questions, round(avg(hit), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr,
               (SELECT round(avg(CASE WHEN sid IN (SELECT sid FROM borne) THEN 0.0::DOUBLE ELSE 1.0 END), 6)
                FROM sentence) AS ungrounded_share
        FROM evaluated""",
)
def run_score(spark: SparkSession, directory: str) -> DataFrame:
    """The questions are answered and the answers' sentences held against the expected documents."""
    evals, hits, evaluated = _evaluated(spark, directory)
    questions = evals.select(F.col("eval_id").alias("query_id"), "question")
    answers = answer_from_hits(questions, hits)
    checked = grounded_sentences(
        sentences(answers, "answer", ["query_id"]),
        evals.select(F.col("eval_id").alias("query_id"), F.col("expected_text").alias("text")),
        pool="query_id",
    )
    return E.score_run(evaluated, checked)


@query(
    "run_record",
    """SELECT 'documents' AS run_id, 0 AS step_ix, 'read' AS step, count(*) AS rows, 0::BIGINT AS errors FROM documents
       UNION ALL
       SELECT 'documents', 1, 'label', count(*), count(*) FILTER (WHERE quality IS NULL)
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def run_record(spark: SparkSession, directory: str) -> DataFrame:
    """Rows and errors of two steps, counted while the rows pass; documents without a label are errors."""
    record = E.RunRecord("documents")
    read = record.observed(scan(spark, directory, "documents").select("doc_id"), "read")
    labels = scan(spark, directory, "labels").select("doc_id", "quality")
    labelled = read.join(labels, "doc_id", "left").withColumn(
        "error", F.when(F.col("quality").isNull(), "no label")
    )
    record.observed(labelled, "label", "error").write.format("noop").mode("overwrite").save()
    return record.as_rows(spark)


_VERSION = "CASE WHEN p_size % 7 = 0 THEN p_type ELSE p_size::VARCHAR END"


@query(
    "latest_versions",
    f"""SELECT p_brand AS name, greatest(1, coalesce(max(try_cast({_VERSION} AS BIGINT)), 1))::BIGINT AS latest
        FROM part GROUP BY p_brand
        UNION ALL SELECT DISTINCT p_type, 1::BIGINT FROM part""",
)
def latest_versions(spark: SparkSession, directory: str) -> DataFrame:
    part = scan(spark, directory, "part")
    version = F.when(F.col("p_size") % 7 == 0, F.col("p_type")).otherwise(
        F.col("p_size").cast("string")
    )
    versions = part.select(F.col("p_brand").alias("name"), version.alias("version"))
    names = part.select(F.col("p_brand").alias("name")).union(part.select("p_type"))
    return E.latest_version(names, versions)


@query(
    "vector_hit_rate",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        ranked AS (
          SELECT q.vec_id AS query_id, q.label AS wanted, c.label,
                 row_number() OVER (PARTITION BY q.vec_id
                   ORDER BY round(list_inner_product(q.e, c.e), 6) DESC, c.vec_id) AS rk
          FROM v q, v c)
       SELECT wanted AS label, round(avg(CASE WHEN label = wanted THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision_at_5
       FROM ranked WHERE rk <= 5 GROUP BY wanted""",
)
def vector_hit_rate(spark: SparkSession, directory: str) -> DataFrame:
    vectors = vectors_of(spark, directory)
    hits = topk(as_queries(vectors), vectors, 5, key="vec_id", columns=["label"])
    wanted = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    same = (F.col("label") == F.col("wanted")).cast("double")
    return (
        hits.join(wanted, "query_id")
        .groupBy(F.col("wanted").alias("label"))
        .agg(F.round(F.avg(same), 6).alias("precision_at_5"))
    )
