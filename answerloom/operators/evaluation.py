"""Evaluation sets, retrieval metrics, versions and run records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.text import first_sentence


def make_eval_set(
    documents: DataFrame,
    key: str = "id",
    text: str = "content",
    uri: str = "doc_uri",
    num_evals: int = 25,
) -> DataFrame:
    """Up to ``num_evals`` questions, drawn from all documents.

    The offline question is a document's first sentence. Documents are drawn
    in the order of a hash of their key, the same on every run; each task keeps
    ``num_evals`` rows at most.
    """
    keyed = documents.select(key, text, uri).withColumn("eval_id", F.md5(F.col(key).cast("string")))
    picked = keyed.orderBy("eval_id", key)
    return picked.limit(num_evals).select(
        "eval_id",
        first_sentence(text).alias("question"),
        F.col(key).alias("expected_source"),
        F.col(text).alias("expected_text"),
    )


def evaluate(
    evals: DataFrame, hits: DataFrame, key: str = "id", query_key: str = "query_id"
) -> DataFrame:
    """Per question: ``rk`` of the expected source, hit and reciprocal rank."""
    expected = evals.select(
        F.col("eval_id").alias("_eval"), F.col("expected_source").alias("_expected"), "eval_id"
    )
    matched = (
        expected.join(
            hits.select(query_key, F.col(key).alias("_found"), "rk"),
            (F.col("_eval") == F.col(query_key)) & (F.col("_expected") == F.col("_found")),
            "left",
        )
        .groupBy("eval_id")
        .agg(F.min("rk").alias("rk"))
    )
    return matched.select(
        "eval_id",
        "rk",
        F.col("rk").isNotNull().cast("double").alias("hit"),
        F.coalesce(1.0 / F.col("rk"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def score_run(evaluated: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """One row of metrics: questions, hit rate, MRR, share of ungrounded sentences."""
    summary = evaluated.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.round(F.avg("hit"), 6).alias("hit_rate"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
    )
    if checked is None:
        return summary
    ungrounded = checked.agg(
        F.round(F.avg((~F.col("grounded")).cast("double")), 6).alias("ungrounded_share")
    )
    # Two rows, each with its own columns filled, folded into one.
    both = summary.unionByName(ungrounded, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def latest_version(
    names: DataFrame, versions: DataFrame, name: str = "name", version: str = "version"
) -> DataFrame:
    """``name, latest``: the largest version as a number, never below 1."""
    newest = versions.groupBy(name).agg(
        F.max(F.col(version).try_cast("bigint")).alias("newest")
    )
    return names.select(name).distinct().join(newest, name, "left").select(
        name,
        F.greatest(F.lit(1).cast("bigint"), F.coalesce("newest", F.lit(1))).alias("latest"),
    )


@dataclass
class RunRecord:
    """Row and error counts per step, gathered while the steps run."""

    run_id: str
    steps: list[tuple[str, Observation]] = field(default_factory=list)

    def observed(self, df: DataFrame, step: str, error: str | None = None) -> DataFrame:
        """Count the rows of ``df`` as they pass; no job of its own."""
        observation = Observation(f"{self.run_id}:{step}:{len(self.steps)}")
        failing = F.col(error).isNotNull() if error else F.lit(False)
        self.steps.append((step, observation))
        return df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(failing.cast("bigint")), F.lit(0)).alias("errors"),
        )

    def as_rows(self, spark: SparkSession) -> DataFrame:
        """One row per step. Call it after the action, else it waits for one."""
        rows = [
            (self.run_id, ix, step, seen.get["rows"], seen.get["errors"])
            for ix, (step, seen) in enumerate(self.steps)
        ]
        return spark.createDataFrame(
            rows, "run_id string, step_ix int, step string, rows bigint, errors bigint"
        )
