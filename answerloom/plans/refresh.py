"""From files to a searchable index, and from the chunk table to a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.config import Settings
from answerloom.functions.embedding import EmbeddingModel
from answerloom.functions.models import BatchModel
from answerloom.functions.text import sentences
from answerloom.operators.evaluation import evaluate, make_eval_set, score_run
from answerloom.operators.grounding import grounded_sentences
from answerloom.operators.index import sync_index, write_index
from answerloom.operators.search import assign_cells
from answerloom.plans.answering import answer_from_hits, retrieve
from answerloom.sources import ensure_chunk_table, overwrite_table
from answerloom.streaming.ingest import run_chunk_job, run_ingest_job


def refresh_chunks(
    spark: SparkSession, settings: Settings, files: str, checkpoints: str
) -> DataFrame:
    """Take in the files that are new under ``files``; returns the chunk table."""
    name = ensure_chunk_table(spark, settings.database, settings.chunk_table)
    run_ingest_job(spark, files, settings.raw_table, f"{checkpoints}/{settings.raw_table}")
    run_chunk_job(
        spark,
        settings.raw_table,
        settings.chunk_table,
        f"{checkpoints}/{settings.chunk_table}",
        settings.chunk_size,
        settings.chunk_overlap,
        settings.arrow_batch_rows,
    )
    return spark.table(name)


def refresh_index(
    chunks: DataFrame,
    settings: Settings,
    path: str,
    previous: str | None = None,
    *,
    centroids: DataFrame | None = None,
    model: EmbeddingModel | None = None,
) -> DataFrame:
    """Write the next version of the index to ``path`` and read it back.

    Only texts that are not in the ``previous`` version are embedded. With
    centroids the version is partitioned by cell for approximate search.
    """
    spark = chunks.sparkSession
    version = sync_index(
        chunks,
        None if previous is None else spark.read.parquet(previous),
        key=settings.key_column,
        text=settings.text_column,
        columns=(settings.uri_column,),
        model=model,
        dim=settings.embedding_dim,
    )
    if centroids is not None:
        version = assign_cells(version, centroids)
    write_index(spark, version, path, None if centroids is None else "cell")
    return spark.read.parquet(path)


def write_eval_set(documents: DataFrame, settings: Settings) -> DataFrame:
    """Make the evaluation set and replace the evaluation table by it."""
    evals = make_eval_set(
        documents,
        settings.key_column,
        settings.text_column,
        settings.uri_column,
        settings.eval_questions,
    )
    overwrite_table(evals, settings.eval_table)
    return documents.sparkSession.table(settings.eval_table)


def evaluate_retrieval(
    evals: DataFrame,
    index: DataFrame,
    settings: Settings,
    *,
    centroids: DataFrame | None = None,
    model: EmbeddingModel | None = None,
    answerer: str | BatchModel = "extractive",
) -> DataFrame:
    """One row of metrics for an index and its answers over an evaluation set.

    The questions are answered from what was found, and each sentence of an answer is held
    against the document it should come from. An answer from the wrong passages is not borne out.
    """
    questions = evals.select(F.col("eval_id").alias("query_id"), "question")
    hits = retrieve(
        questions,
        index,
        settings.k,
        [settings.text_column, settings.uri_column],
        centroids=centroids,
        nprobe=settings.nprobe,
        model=model,
    )
    answers = answer_from_hits(
        questions, hits, text=settings.text_column, uri=settings.uri_column, model=answerer
    )
    checked = grounded_sentences(
        sentences(answers, "answer", ["query_id"]),
        evals.select(F.col("eval_id").alias("query_id"), F.col("expected_text").alias("text")),
        pool="query_id",
    )
    return score_run(evaluate(evals, hits, settings.key_column), checked)
