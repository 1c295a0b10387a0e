"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import (
    collocations,
    decontamination,
    language_id,
    mixing,
    pii_surrogates,
    quality_neighbours,
    secret_scan,
    sharding,
    simhash_dedup,
    token_alignment,
    toxicity,
    url_filter,
    winnowing,
)
from answerloom.llm._common import fold_of
from answerloom.sources.tables import scan

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """Score of every document, learned from the labels of those whose fold is not 0."""
    documents = scan(spark, directory, "documents")
    model = toxicity.fit(documents, scan(spark, directory, "labels").where(fold_of("doc_id", 5) != 0))
    return toxicity.score_texts(documents, model, "text", ["doc_id"]).select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Words taken of every document by the mix."""
    return mixing.mix_counts(scan(spark, directory, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
),
steps AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0)) / sum(weight) OVER onward AS level
  FROM s
  WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
water AS (
  SELECT min(level) AS level FROM (
    SELECT level FROM steps WHERE source_size * 3 > level * weight ORDER BY source_size / weight, source LIMIT 1)
),
t AS (
  SELECT source, source_size, CAST(least(source_size * 3.0, coalesce(level * weight, source_size * 3.0)) AS DOUBLE) AS target
  FROM s, water
),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM t
),
k AS (
  SELECT d.source, key, sum(size) AS size,
         any_value(CAST(floor(target - whole * source_size + 1e-6) AS BIGINT)) AS due,
         sum(sum(size)) OVER (PARTITION BY d.source ORDER BY key) AS upto
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source GROUP BY d.source, key
),
g AS (
  SELECT source, any_value(due) - coalesce(max(upto) FILTER (upto <= due), 0) AS gap FROM k GROUP BY source
),
extra AS (
  SELECT source, key FROM (
    SELECT k.source, key, row_number() OVER (PARTITION BY k.source ORDER BY abs(size - gap), key) AS place
    FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
    WHERE upto > due AND size > 0 AND abs(size - gap) < gap)
  WHERE place = 1
)
SELECT d.doc_id, d.size, w.source_size, w.target,
       CAST(d.size * (whole + CASE WHEN k.upto <= k.due OR extra.key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
LEFT JOIN extra ON d.source IS NOT DISTINCT FROM extra.source AND d.key = extra.key
"""


def op3_simhash_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(scan(spark, directory, "documents"))


def op4_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Verdict on every page; listed are the pages of some hosts."""
    pages = scan(spark, directory, "pages")
    return url_filter.judge(pages, url_filter.listed_hosts(pages))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS asked
  FROM pages
),
c AS (
  SELECT *, list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|\z)')) AS own
  FROM p
),
u AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '')
           || regexp_replace(regexp_replace(path, '\.html?\z', ''), '/+\z', '')
           || CASE WHEN len(own) > 0 THEN '?' || array_to_string(own, '&') ELSE '' END END AS canonical
  FROM c
),
listed AS (
  SELECT DISTINCT canonical FROM u
  WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'casino-win', 'cheap-pills', 'free-bets'])
),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM u
)
SELECT page_id, host, path, rule, listed.canonical IS NOT NULL AS listed,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed ON ruled.canonical = listed.canonical
"""


def op5_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and where it is."""
    documents, benchmark = scan(spark, directory, "documents"), scan(spark, directory, "benchmark")
    return decontamination.find_passages(documents, benchmark, ["doc_id"])


def op6_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Secrets in every document, the three kinds asked for counted and digested."""
    found = secret_scan.scan_secrets(scan(spark, directory, "documents"))
    kinds = [rule.kind for rule in secret_scan.BASE]
    of = lambda *names: F.filter("secrets", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in kinds),
        F.sha2(secret_scan.as_text(of(*kinds)).cast("binary"), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("secrets")).alias("spans"),
    )


OP6_SQL = r"""
WITH rules(kind, rank, pattern) AS (VALUES
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'),
  ('hex', 2, '[0-9a-f]{24,}'),
  ('github', 3, '(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}'),
  ('slack', 4, 'xox[a-bprs]-[A-Za-z0-9-]{10,}'),
  ('stripe', 5, '(rk|sk)_live_[A-Za-z0-9]{24,}'),
  ('google', 6, 'AIza[A-Za-z0-9_-]{35}'),
  ('private_key', 7, '-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----'),
  ('jwt', 8, 'eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+')
),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT row, kind, rank, pattern, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps
  FROM d, rules
),
one AS (
  SELECT row, kind, rank, pattern, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0
),
placed AS (
  SELECT row, kind, rank, hits[i] AS hit,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
         CASE WHEN kind = 'assign'
              THEN length(regexp_extract(hits[i], '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2))
              ELSE length(hits[i]) END AS weight
  FROM one
),
good AS (
  SELECT row, kind, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS span
  FROM placed
  WHERE weight >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 ELSE 1 END
),
t AS (
  SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM good GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (row)
"""


#: Where a session names the secret that surrogates are made with; without one a new secret is drawn.
SURROGATE_KEY = "spark.answerloom.surrogate.key"


def op7_pii_surrogates(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with its personal data replaced."""
    key = spark.conf.get(SURROGATE_KEY, None) or secrets.token_hex(16)
    return pii_surrogates.replace_entities(scan(spark, directory, "documents"), key)


def op8_winnowing(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnowing.compare_edited(scan(spark, directory, "documents"))


def op9_language_id(spark: SparkSession, directory: str) -> DataFrame:
    """Language of every document, learned from those whose fold is not 2."""
    documents = scan(spark, directory, "documents")
    model = language_id.fit(documents.where(fold_of("doc_id", 4) != 2))
    found, lang, score, ambiguous = language_id.identify(documents, model, carry=["doc_id"])
    return found.select(
        "doc_id",
        (fold_of("doc_id", 4) == 2).alias("held_out"),
        lang.alias("lang_pred"),
        score.alias("score"),
        ambiguous.alias("ambiguous"),
    )


def op10_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(scan(spark, directory, "documents"))


def op11_collocations(spark: SparkSession, directory: str) -> DataFrame:
    """The best phrases of each language, by the lowest score of their cuts in two."""
    return collocations.mine(scan(spark, directory, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 6) sizes(k) WHERE len(words) >= k
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
cut AS (
  SELECT c.*, j AS k, array_to_string(words[1:j], ' ') AS first, array_to_string(words[j + 1:size], ' ') AS rest
  FROM c, range(1, 5) cuts(j) WHERE j < size
),
scored AS (
  SELECT cut.lang, cut.phrase, cut.size, a, cut.k, l.f AS l, r.f AS r, n,
         CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = first JOIN f r ON r.lang = cut.lang AND r.phrase = rest
  JOIN n ON n.lang = cut.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = lowest.lang AND c.size > lowest.size AND 100 * c.a >= 100 * lowest.a
      AND contains(' ' || c.phrase || ' ', ' ' || lowest.phrase || ' '))
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


#: Where the public vocabularies are.
TOKENIZERS = "/opt/tokenizers"


def op12_token_alignment(spark: SparkSession, directory: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with corpus-wide link counts."""
    files = token_alignment.Vocabularies.read(f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    found = token_alignment.align(scan(spark, directory, "documents"), files, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_quality_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of every document, by votes of labelled documents whose fold is not 0."""
    documents = scan(spark, directory, "documents")
    model = quality_neighbours.fit(documents, scan(spark, directory, "labels").where(fold_of("doc_id", 5) != 0))
    return quality_neighbours.score_texts(documents, model, ["doc_id"]).select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_winnowing": op8_winnowing,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_neighbours": op13_quality_neighbours,
}

SQL: dict[str, str] = {
    "op2_mix_sources": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op6_secret_scan": OP6_SQL,
    "op11_collocations": OP11_SQL,
}
