"""From raw documents to shards: language, copies, benchmark passages, mix, shards.

Every stage takes the rows its predecessor kept. ``run`` writes each stage's rows to the shared
checkpoint folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerloom.llm import decontamination, language_id, mixing, sharding, simhash_dedup
from answerloom.llm._common import fold_of
from answerloom.session import cut_lineage
from answerloom.sources.tables import scan

#: Texts whose language is decided with less than this share of the evidence are rejected.
LEAST_SCORE = 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told; texts without a letter and undecided ones go.

    If no row has a language to learn from, nothing can be told and every row stays.
    """
    model = language_id.fit(docs.where(fold_of("doc_id", 4) != 2))
    if model is None:
        return docs
    found, lang, score, _ = language_id.identify(docs, model)
    kept = found.where((lang != language_id.UNDETERMINED) & (score >= LEAST_SCORE))
    return kept.select(*(f"`{name}`" for name in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return simhash_dedup.keep_one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found."""
    return decontamination.drop_contaminated(docs, scan(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = scan(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints by XXH64 and a learned model are not SQL; the stages are tested by brute force.
ORACLE_SQL = None
