"""Models by alias, and the functions that apply them to a column of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column, let
from answerloom.functions.prompts import SUMMARY_PROMPT, render_prompt
from answerloom.functions.text import sentence_array, token_array
from answerloom.session import cut_lineage, folder_exists

# A batch model is loaded by a function without arguments, once per task, and
# then maps prompts to answers. A column model is an expression.
Answerer = Callable[[Sequence[str]], Sequence[str]]
BatchModel = Callable[[], Answerer]
ColumnModel = Callable[[Column], Column]

_BATCH_MODELS: dict[str, BatchModel] = {}
_COLUMN_MODELS: dict[str, ColumnModel] = {}

# Where the passages and the question stand in the prompt for questions and answers.
ASKED = r"(?s)\nPassages:\n(.*)\nQuestion:\n(.*?)\n\nAnswer:\z"
PASSAGE_START = r"(?m)^Passage: "


def register_model(alias: str, model: BatchModel) -> None:
    """Make a batch model known under ``alias``, on the driver."""
    _BATCH_MODELS[alias] = model


def best_sentence(sentences: Column, score: Callable[[Column], Column]) -> Column:
    """The sentence whose distinct words score best; of equal ones the first; ``""`` if there is none."""

    def scored(sentence: Column, place: Column) -> Column:
        points = let(F.array_distinct(token_array(sentence)), score)
        return F.struct(points.alias("points"), (-place).alias("place"), sentence.alias("sentence"))

    def best(found: Column) -> Column:
        first = F.array_max(F.transform(found, scored))["sentence"]
        return F.when(found.isNotNull(), F.coalesce(first, F.lit("")))

    return let(sentences, best)


def extractive(prompt: Column) -> Column:
    """Of all sentences of all passages the one most like the question, by the Dice overlap of their words."""
    passages = F.split(F.regexp_extract(prompt, ASKED, 1), PASSAGE_START)
    every = F.flatten(F.transform(passages, sentence_array))
    question = F.array_distinct(token_array(F.regexp_extract(prompt, ASKED, 2)))

    def best(asked: Column) -> Column:
        def alike(words: Column) -> Column:
            return 2.0 * F.size(F.array_intersect(words, asked)) / (F.size(words) + F.size(asked))

        return best_sentence(every, alike)

    return let(question, best)


def covering(prompt: Column) -> Column:
    """Of what follows the prompt's first colon, the sentence with the most distinct words."""
    colon = F.instr(prompt, ": ")
    start = F.when(colon > 0, colon + 2).otherwise(1)
    return best_sentence(sentence_array(F.substring(prompt, start, F.length(prompt))), F.size)


_COLUMN_MODELS["extractive"] = extractive
_COLUMN_MODELS["covering"] = covering


def apply_model(prompt: Column, model: str | BatchModel = "extractive") -> Column:
    """The model's answer to a prompt column; NULL prompts stay NULL.

    A batch model is declared nondeterministic, so that no plan calls it twice
    for a row.
    """
    if isinstance(model, str):
        if model in _COLUMN_MODELS:
            return _COLUMN_MODELS[model](prompt)
        if model not in _BATCH_MODELS:
            known = sorted({*_COLUMN_MODELS, *_BATCH_MODELS})
            raise ValueError(f"no model {model!r}; known are {known}")
        model = _BATCH_MODELS[model]
    load = model

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = load()
        for batch in batches:
            asked = batch.notna().to_numpy()
            out = pd.Series([None] * len(batch), dtype=object)
            if asked.any():
                out[asked] = list(answer(batch[asked].tolist()))
            yield out

    return answers.asNondeterministic()(prompt)


def map_model(
    df: DataFrame,
    prompt: str,
    model: str | BatchModel = "extractive",
    output: str = "answer",
) -> DataFrame:
    """Add the model's answer to every row."""
    return df.withColumn(output, apply_model(F.col(prompt), model))


def map_model_once(
    df: DataFrame,
    prompt: str,
    model: str | BatchModel,
    answers: str,
    *,
    alias: str = "",
    output: str = "answer",
) -> DataFrame:
    """:func:`map_model` that asks for each distinct prompt once, ever.

    Answers are kept in the folder ``answers`` by a hash of prompt and ``alias`` (which names the
    model and its settings); prompts that have none yet are answered and appended before
    anything is returned. Rows that share a prompt, in this run or a later one, share its answer.
    A run that was lost half-way has appended nothing and is repeated.
    """
    spark = df.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{alias}\x00"), F.col(prompt)).cast("binary"), 256)
    schema = "_digest string, _answer string"
    kept = folder_exists(spark, answers)
    asked = df.where(F.col(prompt).isNotNull()).select(digest.alias("_digest"), F.col(prompt).alias("_prompt"))
    new = asked.groupBy("_digest").agg(F.min("_prompt").alias("_prompt"))
    if kept:
        new = new.join(spark.read.schema(schema).parquet(answers), "_digest", "left_anti")
    made = map_model(cut_lineage(new), "_prompt", model, "_answer").select("_digest", "_answer")
    made.write.mode("append").parquet(answers)
    known = spark.read.schema(schema).parquet(answers)
    return (
        df.withColumn("_digest", digest)
        .join(known.withColumnRenamed("_answer", output), "_digest", "left")
        .drop("_digest")
    )


def summarize(
    df: DataFrame, text: str, model: str | BatchModel = "covering", output: str = "summary"
) -> DataFrame:
    """Add a summary, by the summary prompt; NULL texts have none.

    The offline default reads the whole text and picks the sentence that covers
    most of its words.
    """
    prompt = F.when(as_column(text).isNotNull(), render_prompt(SUMMARY_PROMPT, input=text))
    return df.withColumn(output, apply_model(prompt, model))
