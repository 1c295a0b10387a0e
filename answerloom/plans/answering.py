"""Questions from conversations, answered from retrieved passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.embedding import EmbeddingModel, embed
from answerloom.functions.models import BatchModel, apply_model
from answerloom.functions.pii import pii_verdict
from answerloom.functions.prompts import PASSAGE_TEMPLATE, QA_PROMPT, render_prompt
from answerloom.operators.messages import USER, last_message
from answerloom.operators.search import topk, topk_ann

NO_QUESTION = "No Human Message found in messages"


def stuff_context(
    hits: DataFrame,
    query_key: str = "query_id",
    text: str = "content",
    uri: str = "source",
    template: str = PASSAGE_TEMPLATE,
) -> DataFrame:
    """``query_key, context, sources``: the passages of a query in rank order.

    At most ``k`` passages meet per query, so the lists stay short.
    """
    gathered = hits.groupBy(query_key).agg(
        F.sort_array(F.collect_list(F.struct("rk", text, uri))).alias("p")
    )
    passage = F.transform("p", lambda p: render_prompt(template, chunk_text=p[text]))
    return gathered.select(
        query_key,
        F.array_join(passage, "").alias("context"),
        F.transform("p", lambda p: p[uri].cast("string")).alias("sources"),
    )


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    k: int,
    columns: Sequence[str],
    *,
    centroids: DataFrame | None = None,
    nprobe: int = 3,
    where: Column | str | None = None,
    model: EmbeddingModel | None = None,
    query_key: str = "query_id",
    text: str = "question",
) -> DataFrame:
    """Top ``k`` of ``index`` per question; approximate if centroids are given."""
    asked = questions.where(F.col(text).isNotNull()).select(
        query_key, embed(text, model).alias("embedding")
    )
    if centroids is None:
        return topk(asked, index, k, query_key=query_key, columns=columns, where=where)
    return topk_ann(
        asked, index, centroids, k, nprobe, query_key=query_key, columns=columns, where=where
    )


def answer_from_hits(
    questions: DataFrame,
    hits: DataFrame,
    *,
    query_key: str = "query_id",
    text: str = "content",
    uri: str = "source",
    model: str | BatchModel = "extractive",
) -> DataFrame:
    """``query_key, question, context, answer, sources`` for each question, by the answering prompt.

    A NULL question has a NULL answer. The model sees all passages of a question.
    """
    prompt = render_prompt(QA_PROMPT, summaries="context", question="question")
    return (
        questions.select(query_key, "question")
        .join(stuff_context(hits, query_key, text, uri), query_key, "left")
        .withColumn("prompt", F.when(F.col("question").isNotNull(), prompt))
        .select(
            query_key,
            "question",
            "context",
            apply_model(F.col("prompt"), model).alias("answer"),
            "sources",
        )
    )


def answer_questions(
    conversations: DataFrame,
    messages: DataFrame,
    index: DataFrame,
    k: int = 5,
    *,
    centroids: DataFrame | None = None,
    nprobe: int = 3,
    model: str | BatchModel = "extractive",
    embedding_model: EmbeddingModel | None = None,
) -> DataFrame:
    """``conv_id, question, context, answer, sources, error`` per conversation.

    ``index`` has ``id, source, content, embedding``. A conversation without a
    question gets an ``error`` and does not stop the job.
    """
    asked = last_message(messages, USER).select("conv_id", F.col("text").alias("question"))
    hits = retrieve(
        asked,
        index,
        k,
        ["content", "source"],
        centroids=centroids,
        nprobe=nprobe,
        model=embedding_model,
        query_key="conv_id",
    )
    every = conversations.select("conv_id").join(asked, "conv_id", "left")
    answered = answer_from_hits(every, hits, query_key="conv_id", model=model)
    return answered.withColumn("error", F.when(F.col("question").isNull(), NO_QUESTION))


def guarded_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Add the personal-data verdict on each answer: ``passed, message``."""
    return (
        answers.withColumn("_verdict", pii_verdict(F.coalesce(answer, F.lit(""))))
        .withColumn("passed", F.col("_verdict.passed"))
        .withColumn("message", F.col("_verdict.message"))
        .drop("_verdict")
    )
