"""Checked queries: personal data, topics, grounding, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.pii import (
    GIVEN_NAMES,
    detect_pii,
    pii_verdict,
)
from answerloom.functions.text import sentences
from answerloom.operators import guards as G
from answerloom.operators.grounding import check_answers, grounded_sentences
from answerloom.operators.messages import last_message
from answerloom.operators.topics import Topics, fit_topics, learned_scores, topic_model
from answerloom.registry import _sql
from answerloom.registry._base import query
from answerloom.sources import scan

# Five terms each, so that four of five is exactly the strict threshold of 0.8.
LEXICON = {
    "politics": ("the", "of", "and", "to", "in"),
    "sports": ("der", "die", "und", "in", "den"),
    "weather": ("que", "la", "de", "en", "el"),
}


_RUN = r"\b[A-Z][a-z]+\.?(?: [A-Z][\p{L}\p{N}_]*\.?)+"
_PERSON = r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?|" + "|".join(sorted(GIVEN_NAMES)) + r")(?: [A-Z][a-z]+)+\b"


# What each entity looks like, and the group that is the hit, in reporting order; written from the
# definition of the entities and not from the operator.
_ENTITIES = {
    "PERSON": (_PERSON, 0),
    "CREDIT_CARD": (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", 0),
    "PHONE_NUMBER": (r"[(]?\b\d{3}[)]?[ .-]\d{3}[ .-]\d{4}\b", 0),
    "IP_ADDRESS": (r"\b\d{1,3}[.]\d{1,3}[.]\d{1,3}[.]\d{1,3}\b", 0),
    "US_SSN": (r"\b\d{3}-\d\d-\d{4}\b", 0),
    "US_PASSPORT": (r"\b[A-Z]\d{8}\b", 0),
    "US_BANK_NUMBER": (r"\b(?i:account|acct|routing|bank|aba)\b[^\d\n]{0,24}(\d{8,17})\b", 1),
    "US_ITIN": (r"\b9\d\d-[5-9]\d-\d{4}\b", 0),
    "US_DRIVER_LICENSE": (
        r"\b(?i:drivers? licen[cs]e|driver's? licen[cs]e|driving licen[cs]e|dl)\b[^\d\n]{0,16}\b([A-Za-z]?\d{7,8})\b",
        1,
    ),
    "EMAIL_ADDRESS": (r"[\w.%+-]{1,64}@[A-Za-z\d.-]{1,255}[.][A-Za-z]{2,24}", 0),
    "CRYPTO": (r"\b(?:bc1|1|3)[1-9A-HJ-NP-Za-km-z]{25,39}\b", 0),
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hits_sql(entity: str, text: str) -> str:
    if entity == "PERSON":
        return (
            f"flatten(list_transform(regexp_extract_all({text}, {_quoted(_RUN)}), "
            f"lambda r: regexp_extract_all(r, {_quoted(_PERSON)})))"
        )
    pattern, group = _ENTITIES[entity]
    return f"regexp_extract_all({text}, {_quoted(pattern)}, {group})"


def pii_list_sql(text: str) -> str:
    """List with the entity's name once per hit."""
    parts = [
        f"list_transform({hits_sql(entity, text)}, lambda h: '{entity}')" for entity in _ENTITIES
    ]
    return f"flatten([{', '.join(parts)}])"


@query(
    "personal_data",
    " UNION ALL ".join(
        f"SELECT doc_id, '{entity}' AS entity, (generate_subscripts(h, 1) - 1)::BIGINT AS ix, unnest(h) AS hit "
        f"FROM (SELECT doc_id, {hits_sql(entity, 'text')} AS h FROM documents)"
        for entity in _ENTITIES
    ),
)
def personal_data(spark: SparkSession, directory: str) -> DataFrame:
    return detect_pii(scan(spark, directory, "documents", spread=True), "text", ["doc_id"])


@query(
    "personal_data_verdicts",
    f"""SELECT doc_id, len(found) = 0 AS passed,
               CASE WHEN len(found) > 0 THEN 'PII detected: ' || array_to_string(found, ', ')
                    ELSE 'No PII detected' END AS message
        FROM (SELECT doc_id, {pii_list_sql('text')} AS found FROM documents)""",
)
def personal_data_verdicts(spark: SparkSession, directory: str) -> DataFrame:
    verdict = pii_verdict("text")
    judged = scan(spark, directory, "documents", spread=True).select("doc_id", verdict.alias("v"))
    return judged.select("doc_id", "v.passed", "v.message")


def topic_sql(source: str, keys: str, text: str) -> str:
    terms = ", ".join(f"('{t}', '{w}')" for t, words in LEXICON.items() for w in words)
    return f"""
        lexicon(topic, term) AS (VALUES {terms}),
        present AS (SELECT DISTINCT {keys}, unnest({_sql.tokens(text)}) AS term FROM {source}),
        scored AS (SELECT {keys}, topic, count(*) / 5.0::DOUBLE AS score
                   FROM present JOIN lexicon USING (term) GROUP BY ALL),
        banned AS (SELECT {keys}, string_agg('''' || topic || '''', ', ' ORDER BY score DESC, topic) AS topics
                   FROM scored WHERE score > 0.8 GROUP BY ALL)"""


@query(
    "topic_scores",
    f"""WITH {topic_sql('documents', 'doc_id', 'text')}
        SELECT doc_id, topic, round(score, 6) AS score FROM scored""",
)
def topic_scores(spark: SparkSession, directory: str) -> DataFrame:
    scored = scan(spark, directory, "documents", spread=True).select(
        "doc_id", F.explode(G.topic_scores("text", LEXICON)).alias("s")
    )
    return scored.where("s.score > 0").select("doc_id", "s.topic", F.round("s.score", 6).alias("score"))


@query(
    "topic_verdicts",
    f"""WITH {topic_sql('documents', 'doc_id', 'text')}
        SELECT doc_id, topics IS NULL AS passed,
               'The text contains the following banned topics: [' || topics || ']' AS message
        FROM documents LEFT JOIN banned USING (doc_id)""",
)
def topic_verdicts(spark: SparkSession, directory: str) -> DataFrame:
    judged = scan(spark, directory, "documents", spread=True).select(
        "doc_id", G.topic_verdict("text", LEXICON).alias("v")
    )
    return judged.select("doc_id", "v.passed", "v.message")


_LEARNED = f"""
    marked AS (
      SELECT doc_id, 'junk' AS topic, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS has FROM labels WHERE quality IS NOT NULL
      UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 1 ELSE 0 END FROM labels WHERE toxic IS NOT NULL),
    sizes AS (SELECT topic, sum(has) AS yes, sum(1 - has) AS no FROM marked JOIN documents USING (doc_id) GROUP BY topic),
    word AS (SELECT doc_id, unnest(list_distinct({_sql.tokens('text')})) AS word FROM documents),
    counted AS (SELECT topic, word, sum(has) AS a, sum(1 - has) AS b FROM word JOIN marked USING (doc_id)
                GROUP BY ALL HAVING count(*) >= 5),
    weighed AS (SELECT topic, word, round(ln((a + 1) / (yes + 2)) - ln((b + 1) / (no + 2)), 9) AS weight
                FROM counted JOIN sizes USING (topic)),
    kept AS (SELECT * FROM weighed
             QUALIFY row_number() OVER (PARTITION BY topic ORDER BY abs(weight) DESC, word) <= 2000),
    told AS (SELECT doc_id, topic, sum(weight) AS told FROM word JOIN kept USING (word) GROUP BY ALL),
    scored AS (
      SELECT d.doc_id, s.topic, 1 / (1 + exp(-greatest(-500, least(500,
               round(ln((yes + 1) / (no + 1)), 9) + coalesce(told, 0))))) AS score
      FROM documents d CROSS JOIN sizes s LEFT JOIN told t ON t.doc_id = d.doc_id AND t.topic = s.topic)"""


def _learned(spark: SparkSession, directory: str) -> Topics:
    documents, labels = scan(spark, directory, "documents", spread=True), scan(spark, directory, "labels")
    return fit_topics(documents, labels, {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


@query("learned_topics", f"WITH {_LEARNED} SELECT doc_id, topic, round(score, 4) AS score FROM scored")
def learned_topics(spark: SparkSession, directory: str) -> DataFrame:
    """Two topics learned from the labels, scored on every document."""
    found = learned_scores(scan(spark, directory, "documents", spread=True), _learned(spark, directory))
    return found.withColumn("score", F.round("score", 4))


@query(
    "learned_topic_verdicts",
    f"""WITH {_LEARNED},
        found AS (SELECT doc_id, string_agg(topic, ',' ORDER BY topic) AS topics FROM scored WHERE score > 0.8 GROUP BY doc_id)
        SELECT doc_id, topics IS NULL AS passed, coalesce(topics, '') AS detail
        FROM documents LEFT JOIN found USING (doc_id)""",
)
def learned_topic_verdicts(spark: SparkSession, directory: str) -> DataFrame:
    """The topic guard with the learned scorer as its model."""
    model = topic_model(_learned(spark, directory))
    verdict = G.topic_verdict("text", ["junk", "toxic"], model=model)
    judged = scan(spark, directory, "documents", spread=True).select("doc_id", verdict.alias("v"))
    return judged.select("doc_id", "v.passed", F.array_join(F.array_sort("v.detail"), ",").alias("detail"))


def _grams(name: str, source: str, key: str, words: str, sizes: str) -> str:
    """CTE ``name(key, gram)``: distinct word grams of the given sizes."""
    return f"""
    {name} AS (
      SELECT DISTINCT {key}, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
            FROM (SELECT {key}, w, unnest({sizes}) AS n FROM (SELECT {key}, {words} AS w FROM {source}))))"""


def grounding_sql(pool: str, sentences_: str, sources: str) -> str:
    """CTEs ending in ``borne(sid)``; inputs have ``sid, pool, sentence`` and ``src, pool, text``."""
    join_pool = "AND a.pool = b.pool" if pool else ""
    return f"""
    {_grams('sentence_gram', sentences_, 'sid, pool', _sql.tokens('sentence'), '[least(3, len(w))]')},
    {_grams('source_gram', sources, 'src, pool', _sql.tokens('text'), '[1, 2, 3]')},
    sentence_size AS (SELECT sid, count(*) AS g FROM sentence_gram GROUP BY sid),
    borne AS (
      SELECT DISTINCT sid FROM (
        SELECT a.sid, b.src, count(*) AS matched
        FROM sentence_gram a JOIN source_gram b ON a.gram = b.gram {join_pool} GROUP BY ALL)
      JOIN sentence_size USING (sid) WHERE matched >= ceil(g * 0.8 - 1e-9))"""


@query(
    "grounded_sentences",
    f"""WITH sentence AS (
          SELECT item_id, sentence_ix, sentence, item_id || '-' || sentence_ix AS sid, 0 AS pool
          FROM (SELECT item_id, generate_subscripts(ss, 1) - 1 AS sentence_ix, unnest(ss) AS sentence
                FROM (SELECT item_id, {_sql.sentence_list('text')} AS ss FROM benchmark))),
        source AS (SELECT doc_id AS src, 0 AS pool, text FROM documents),
        {grounding_sql('', 'sentence', 'source')}
        SELECT item_id, sentence_ix::BIGINT AS sentence_ix, sentence, sid IN (SELECT sid FROM borne) AS grounded
        FROM sentence""",
)
def grounded_benchmark(spark: SparkSession, directory: str) -> DataFrame:
    asked = sentences(scan(spark, directory, "benchmark", spread=True), "text", ["item_id"])
    checked = grounded_sentences(asked, scan(spark, directory, "documents", spread=True).select("text"))
    return checked.withColumn("sentence_ix", F.col("sentence_ix").cast("bigint"))


_CHECKED = f"""
    sentence AS (
      SELECT item_id, sentence_ix, sentence, item_id AS pool,
             lpad(item_id::VARCHAR, 6, '0') || '-' || lpad(sentence_ix::VARCHAR, 6, '0') AS sid
      FROM (SELECT item_id, generate_subscripts(ss, 1) - 1 AS sentence_ix, unnest(ss) AS sentence
            FROM (SELECT item_id, {_sql.sentence_list('text')} AS ss FROM benchmark))),
    {_sql.embedded('asked', 'sentence', 'sid', 'sentence')},
    {_sql.embedded('corpus', 'documents', 'doc_id', 'text')},
    {_sql.ranked('asked', 'corpus', 5)},
    source AS (
      SELECT DISTINCT h.key AS src, s.pool, d.text
      FROM hits h JOIN sentence s ON s.sid = h.query JOIN documents d ON d.doc_id = h.key
      WHERE h.score > 0.6),
    {grounding_sql('pool', 'sentence', 'source')},
    checked AS (SELECT item_id, sentence_ix, sentence, sid IN (SELECT sid FROM borne) AS grounded FROM sentence)"""


def _checked(spark: SparkSession, directory: str) -> DataFrame:
    return check_answers(
        scan(spark, directory, "benchmark", spread=True),
        scan(spark, directory, "documents", spread=True),
        key="item_id",
        source_key="doc_id",
        source_text="text",
        min_score=0.6,
    )


@query(
    "checked_answers",
    f"""WITH {_CHECKED}
        SELECT item_id, sentence_ix::BIGINT AS sentence_ix, sentence, grounded FROM checked""",
)
def checked_answers(spark: SparkSession, directory: str) -> DataFrame:
    checked = _checked(spark, directory)
    return checked.withColumn("sentence_ix", F.col("sentence_ix").cast("bigint"))


@query(
    "grounding_verdicts",
    f"""WITH {_CHECKED}
        SELECT item_id, bool_and(grounded) AS passed,
          CASE WHEN NOT bool_and(grounded) THEN 'The following sentences are hallucinated: ['
            || string_agg('''' || sentence || '''', ', ' ORDER BY sentence_ix) FILTER (WHERE NOT grounded)
            || ']' END AS message
        FROM checked GROUP BY item_id""",
)
def grounding_verdicts(spark: SparkSession, directory: str) -> DataFrame:
    return G.grounding_verdicts(_checked(spark, directory), "item_id")


@query(
    "guarded_conversations",
    f"""WITH last AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text
                      FROM conversations GROUP BY conv_id),
        {topic_sql('last', 'conv_id', 'text')},
        judged AS (
          SELECT conv_id, turn, {pii_list_sql('text')} AS found, topics
          FROM last LEFT JOIN banned USING (conv_id)),
        failed AS (
          SELECT conv_id, turn, concat_ws('; ',
            CASE WHEN len(found) > 0 THEN 'PII detected: ' || array_to_string(found, ', ') END,
            'The text contains the following banned topics: [' || topics || ']') AS reasons
          FROM judged WHERE len(found) > 0 OR topics IS NOT NULL)
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT conv_id, turn + 1, 'assistant', 'Guard failed - ' || reasons FROM failed""",
)
def guarded_conversations(spark: SparkSession, directory: str) -> DataFrame:
    messages = scan(spark, directory, "conversations")
    last = last_message(messages).select(
        "conv_id", pii_verdict("text").alias("pii"), G.topic_verdict("text", LEXICON).alias("topic")
    )
    verdicts = G.verdict_rows(last, "conv_id", pii_guard=F.col("pii"), topic_guard=F.col("topic"))
    return G.apply_guards(messages, verdicts)
