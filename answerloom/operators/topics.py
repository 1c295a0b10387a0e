"""Topics learned from labelled texts: one classifier for each, fitted by counting.

A topic's score is the chance that a text has it, by the words that are in the text. The weight of
a word is the log of how much more often labelled texts with the topic hold it than those without,
so fitting is one aggregate over (topic, word) and any number of topics is fitted at once.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.text import token_array
from answerloom.operators.guards import TopicModel
from answerloom.session import cut_lineage

#: Words of fewer labelled texts tell nothing, and each topic keeps its most telling words only.
LEAST_TEXTS = 5
WORDS = 2_000
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


@dataclass(frozen=True)
class Topics:
    """``weights``: ``topic, word, weight``, at most ``WORDS`` a topic; ``biases``: ``topic, bias``."""

    weights: DataFrame
    biases: DataFrame


def fit_topics(
    texts: DataFrame,
    labels: DataFrame,
    topics: Mapping[str, Column],
    *,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST_TEXTS,
    words: int = WORDS,
) -> Topics:
    """Classifiers of ``topics``, each a condition on a row of ``labels``; NULL leaves the row out.

    ``labels`` has the texts' ``key``. Words count once a text. One text more of each kind is counted
    for every word, so no chance is 0.
    """
    if not topics:
        raise ValueError("topics must not be empty")
    said = F.array(*(F.struct(F.lit(name).alias("topic"), told.alias("has")) for name, told in topics.items()))
    marked = labels.select(F.col(key).alias("key"), F.inline(said)).where(F.col("has").isNotNull())
    has = F.col("has").cast("int")
    sizes = cut_lineage(marked.join(texts.select(F.col(key).alias("key")), "key").groupBy("topic").agg(F.sum(has).alias("with"), F.sum(1 - has).alias("without")))
    held = texts.select(F.col(key).alias("key"), F.explode(F.array_distinct(token_array(text))).alias("word"))
    counted = held.join(marked, "key").groupBy("topic", "word").agg(F.sum(has).alias("a"), F.sum(1 - has).alias("b"))
    weight = F.log((F.col("a") + 1) / (F.col("with") + 2)) - F.log((F.col("b") + 1) / (F.col("without") + 2))
    weighed = counted.where(F.col("a") + F.col("b") >= least).join(sizes, "topic").withColumn("weight", F.round(weight, 9))
    telling = Window.partitionBy("topic").orderBy(F.abs("weight").desc(), "word")
    kept = weighed.withColumn("place", F.row_number().over(telling)).where(F.col("place") <= words)
    bias = F.round(F.log((F.col("with") + 1) / (F.col("without") + 1)), 9)
    return Topics(cut_lineage(kept.select("topic", "word", "weight")), sizes.select("topic", bias.alias("bias")))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))


def learned_scores(df: DataFrame, topics: Topics, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, topic, score`` for every row and topic, by a join of words with weights.

    A text without a known word has each topic's share among the labelled texts.
    """
    held = df.select(key, F.explode(F.array_distinct(token_array(text))).alias("word"))
    told = held.join(topics.weights, "word").groupBy(key, "topic").agg(F.sum("weight").alias("told"))
    # One row a topic: few, and sent with the rows as one array.
    biases = topics.biases.orderBy("topic").collect()
    if not biases:
        return df.select(key, F.lit("").alias("topic"), F.lit(0.0).alias("score")).limit(0)
    rows = F.array(*(F.struct(F.lit(r["topic"]).alias("topic"), F.lit(float(r["bias"])).alias("bias")) for r in biases))
    odds = F.col("bias") + F.coalesce("told", F.lit(0.0))
    return df.select(key, F.inline(rows)).join(told, [key, "topic"], "left").select(key, "topic", _chance(odds).alias("score"))


def topic_model(topics: Topics) -> TopicModel:
    """The same scores as a model for the topic guard; at most ``WORDS`` weights a topic are sent."""
    weights: dict[str, list[tuple[str, float]]] = {}
    for row in topics.weights.collect():
        weights.setdefault(row["word"], []).append((row["topic"], row["weight"]))
    biases = {r["topic"]: float(r["bias"]) for r in topics.biases.collect()}

    def load():
        def score(texts: Sequence[str], names: Sequence[str]) -> list[list[float]]:
            found = []
            for text in texts:
                odds = {name: biases[name] for name in names}
                for word in set(BLANKS.split(text.lower())):
                    for topic, weight in weights.get(word, ()):
                        if topic in odds:
                            odds[topic] += weight
                found.append([float(1 / (1 + np.exp(-np.clip(odds[name], -500, 500)))) for name in names])
            return found

        return score

    return load
