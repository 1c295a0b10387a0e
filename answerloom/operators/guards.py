"""Guard verdicts and what they do to a conversation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column, let
from answerloom.functions.text import token_array
from answerloom.operators.messages import append_messages

Lexicon = Mapping[str, Sequence[str]]
# A topic model is loaded by a function without arguments, once per task; from texts and the names of
# topics it makes a list of scores, one a topic and from 0 to 1, for each text.
TopicModel = Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[Sequence[float]]]]

# The topic that is banned unless others are named, and the terms that tell it.
BANNED_TOPICS: Lexicon = {
    "politics": ("campaign", "election", "government", "minister", "parliament", "party", "vote")
}


def topic_scores(text: Column | str, lexicon: Lexicon) -> Column:
    """``array<struct<score, topic>>``: share of each topic's terms in the text."""
    if not lexicon or not all(lexicon.values()):
        raise ValueError("topics must not be empty")
    known = {topic: sorted({term.lower() for term in terms}) for topic, terms in lexicon.items()}

    def scores(words: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    (
                        F.size(F.array_intersect(F.array(*[F.lit(t) for t in terms]), words))
                        / F.lit(len(terms))
                    ).alias("score"),
                    F.lit(topic).alias("topic"),
                )
                for topic, terms in known.items()
            ]
        )

    return let(F.array_distinct(token_array(text)), scores)


def model_topic_scores(text: Column | str, topics: Sequence[str], model: TopicModel) -> Column:
    """``array<struct<score, topic>>`` by a model that scores each topic by itself; NULL of a NULL text.

    The model is loaded once a task. It is declared nondeterministic, so no plan calls it twice for a row.
    """
    if not topics:
        raise ValueError("topics must not be empty")
    names = list(topics)

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model()
        for batch in batches:
            known = batch.notna().to_numpy()
            out: list[list[float] | None] = [None] * len(batch)
            if known.any():
                for place, row in zip(known.nonzero()[0], score(batch[known].tolist(), names), strict=True):
                    out[place] = [float(x) for x in row]
            yield pd.Series(out, dtype=object)

    told = F.array(*map(F.lit, names))
    return F.zip_with(
        scored.asNondeterministic()(as_column(text)), told, lambda score, topic: F.struct(score.alias("score"), topic.alias("topic"))
    )


def detect_topics(
    text: Column | str, lexicon: Lexicon | Sequence[str], threshold: float = 0.8, model: TopicModel | None = None
) -> Column:
    """Topics scoring above ``threshold``, best first, then by name.

    Without a ``model`` the share of a topic's terms is its score; with one only the topics' names are used.
    """
    scores = topic_scores(text, lexicon) if model is None else model_topic_scores(text, list(lexicon), model)
    found = F.filter(scores, lambda s: s["score"] > threshold)
    keyed = F.transform(
        found, lambda s: F.struct((-s["score"]).alias("o"), s["topic"].alias("topic"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["topic"])


def quoted_list(values: Column) -> Column:
    """``['a', 'b']``"""
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def topic_verdict(
    text: Column | str, lexicon: Lexicon | Sequence[str], threshold: float = 0.8, model: TopicModel | None = None
) -> Column:
    """``struct<passed, message, detail>`` for banned topics."""

    def verdict(found: Column) -> Column:
        message = F.when(
            F.size(found) > 0,
            F.concat(F.lit("The text contains the following banned topics: "), quoted_list(found)),
        )
        return F.struct(
            (F.size(found) == 0).alias("passed"), message.alias("message"), found.alias("detail")
        )

    return let(detect_topics(text, lexicon, threshold, model), verdict)


def grounding_verdicts(checked: DataFrame, key: str) -> DataFrame:
    """``key, passed, message`` from sentences marked by ``grounded``.

    Lists an answer's failing sentences in order, so a row is as long as the
    answer it is about.
    """
    failing = F.transform(
        F.sort_array(
            F.collect_list(F.when(~F.col("grounded"), F.struct("sentence_ix", "sentence")))
        ),
        lambda s: s["sentence"],
    )
    return checked.groupBy(key).agg(failing.alias("failing")).select(
        key,
        (F.size("failing") == 0).alias("passed"),
        F.when(
            F.size("failing") > 0,
            F.concat(F.lit("The following sentences are hallucinated: "), quoted_list(F.col("failing"))),
        ).alias("message"),
    )


def apply_guards(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Append ``Guard failed - r1; r2`` to conversations that failed a guard.

    ``verdicts`` has ``conv_id, guard, passed, message`` about the last message
    of a conversation, one row per guard. The new message carries the name of
    the message it is about; conversations that pass stay as they are.
    """
    named = "name" in messages.columns
    reasons = (
        verdicts.where(~F.col("passed"))
        .groupBy("conv_id")
        .agg(F.expr("listagg(message, '; ') within group (order by guard)").alias("reasons"))
    )
    author = F.max_by("name", "turn") if named else F.lit(None).cast("string")
    last = messages.groupBy("conv_id").agg(author.alias("name"))
    notes = reasons.join(last, "conv_id", "left").select(
        "conv_id",
        F.lit(0).cast(messages.schema["turn"].dataType).alias("turn"),
        F.lit("assistant").alias("role"),
        F.concat(F.lit("Guard failed - "), F.col("reasons")).alias("text"),
        *(["name"] if named else []),
    )
    return append_messages(messages, notes)


def verdict_rows(df: DataFrame, key: str, **guards: Column) -> DataFrame:
    """``key, guard, passed, message`` rows from verdict structs per guard."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("guard"),
                as_column(verdict)["passed"].alias("passed"),
                as_column(verdict)["message"].alias("message"),
            )
            for name, verdict in guards.items()
        ]
    )
    return df.select(key, F.explode(rows).alias("v")).select(key, "v.*")
