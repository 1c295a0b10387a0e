"""Which sentences of an answer its sources bear out.

A sentence is borne out if one source contains at least ``threshold`` of its
distinct word n-grams (a shorter sentence is a single gram of its own length).

Comparing every sentence with every source is avoided. With ``g`` grams of
which ``need`` must match, a source that qualifies contains at least one of any
``g - need + 1`` of them, so only a sentence's rarest grams look for sources;
frequent grams take part in the final count only. Copies of a sentence or of a
source are compared once. The sources of a gram that very many hold are cut
into slots by a hash: a first slot settles sentences that many sources repeat,
and only those still open meet the others, slot by slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerloom.functions.columns import as_column, let
from answerloom.functions.embedding import EmbeddingModel, embed
from answerloom.functions.text import sentences, token_array
from answerloom.operators.search import relevant_sources
from answerloom.session import cut_and_measure, cut_lineage

# A pair model is loaded by a function without arguments, once per task, and then scores sentences
# against sources, from 0 to 1.
PairModel = Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]]

MIN_SHARE = 0.8
#: Sources of a gram that are held against a sentence together.
SLOT = 2_000
#: Parts that the sources of a sentence are dealt into while they are counted, once they are very many.
SPREAD = 32


def gram_hashes(text: Column | str, lengths: list[int], whole: bool = False) -> Column:
    """Distinct word n-grams of the given lengths, as 64-bit hashes.

    Words are hashed once and a gram is a hash of its words' hashes, so no gram is ever a string.
    With ``whole``, a text shorter than the one length given is its own gram.
    """

    def of_length(words: Column, length: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - length + 1, F.lit(0)))
        # By element: a slice per position would copy the text each time.
        return F.transform(
            starts, lambda word, i: F.xxhash64(word, *[F.get(words, i + j) for j in range(1, length)])
        )

    def grams(words: Column) -> Column:
        if not whole:
            none = F.array().cast("array<bigint>")
            return F.flatten(F.array(none, *[of_length(words, length) for length in lengths]))
        found = of_length(words, lengths[0])
        for shorter in range(1, lengths[0]):
            found = F.when(F.size(words) == shorter, of_length(words, shorter)).otherwise(found)
        return found

    hashed = F.transform(token_array(text), lambda word: F.xxhash64(word))
    return F.array_distinct(let(hashed, grams))


def _tagged(identity: Column, grams: Column, words: Column | None = None) -> Column:
    """Grams with the id of their text; with ``words``, their length, also with it and their number."""

    def tag(both: Column) -> Column:
        every = both["grams"]

        def row(gram: Column) -> Column:
            fields = [both["id"].alias("id"), gram.alias("gram")]
            if words is not None:
                fields += [both["words"].alias("words"), F.size(every).alias("size")]
            return F.struct(*fields)

        return F.transform(every, row)

    fields = [identity.alias("id"), grams.alias("grams")]
    return let(F.struct(*fields, *([] if words is None else [words.alias("words")])), tag)


def grounded_sentences(
    asked: DataFrame,
    sources: DataFrame,
    *,
    sentence: str = "sentence",
    text: str = "text",
    pool: str | None = None,
    n: int = 3,
    threshold: float = MIN_SHARE,
) -> DataFrame:
    """``asked`` with a column ``grounded``.

    ``pool`` names a column of both sides; a sentence is then compared with the
    sources of its own pool only. Without sources nothing is grounded.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    place = F.col(pool) if pool else F.lit(0)
    sentence_id = F.unhex(
        F.md5(F.concat_ws("\x01", place.cast("string"), F.lower(as_column(sentence))))
    )
    length = F.least(F.lit(n), F.size(token_array(sentence)))
    # Ids go through the explode with the grams: as columns beside it they would
    # be computed again for every gram, from a text carried along with each.
    # At most n lengths, most often the one.
    wanted, seen = cut_and_measure(
        asked.select(
            place.alias("pool"),
            F.explode(
                _tagged(sentence_id, gram_hashes(sentence, [n], whole=True), length)
            ).alias("g"),
        )
        .select("pool", F.col("g.id").alias("sid"), "g.gram", "g.words", "g.size")
        .distinct()
        .withColumn("need", F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9))),
        lengths=F.collect_set("words"),
    )
    held = cut_lineage(
        sources.select(
            place.alias("pool"),
            F.explode(
                _tagged(F.unhex(F.md5(F.lower(as_column(text)))), gram_hashes(text, sorted(seen["lengths"])))
            ).alias("g"),
        )
        .select("pool", F.col("g.id").alias("source"), "g.gram")
        .join(wanted.select("pool", "gram").distinct(), ["pool", "gram"], "left_semi")
        .distinct()
    )
    frequency = held.groupBy("pool", "gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("sid").orderBy(F.coalesce("df", F.lit(0)), "gram")
    rare, most = cut_and_measure(
        wanted.join(frequency, ["pool", "gram"], "left")
        .withColumn("nth", F.row_number().over(rarest))
        .where("nth <= size - need + 1 AND df IS NOT NULL")
        .select("pool", "sid", "need", "gram", "df"),
        open=F.coalesce(F.max(F.when(F.col("need") > 1, F.col("df"))), F.lit(0)),
    )
    # One match is enough for these; there is nothing left to count.
    settled = rare.where("need = 1").select("sid").distinct()
    open_ = rare.where("need > 1")
    if most["open"] <= SLOT:
        pairs = open_.join(held, ["pool", "gram"]).select("pool", "sid", "source").distinct()
        found = settled.union(_covered(pairs, wanted, held)).distinct()
    else:
        slots = F.ceil(F.col("df") / SLOT).cast("bigint")
        posted = slotted(held, open_.select("pool", "gram", slots.alias("slots")).distinct())
        first = open_.join(posted.where("slot = 0"), ["pool", "gram"]).select("pool", "sid", "source").distinct()
        tried = cut_lineage(_covered(first, wanted, held))
        others = F.explode(F.sequence(F.lit(1).cast("bigint"), slots - 1)).alias("slot")
        left = open_.where(slots > 1).join(tried, "sid", "left_anti").select("pool", "sid", "gram", others)
        pairs = left.join(posted, ["pool", "gram", "slot"]).select("pool", "sid", "source").distinct()
        found = settled.union(tried).union(_covered(pairs, wanted, held, SPREAD)).distinct()
    return (
        asked.withColumn("_sid", sentence_id)
        .join(found.withColumnRenamed("sid", "_sid").withColumn("grounded", F.lit(True)), "_sid", "left")
        .drop("_sid")
        .withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    )


def slotted(held: DataFrame, grams: DataFrame) -> DataFrame:
    """``held`` with the ``slot`` of each source among those of its gram; ``grams`` has the number of slots."""
    slot = F.expr("pmod(xxhash64(source), slots)")
    return held.join(grams, ["pool", "gram"]).select("pool", "gram", "source", slot.alias("slot"))


def _covered(pairs: DataFrame, wanted: DataFrame, held: DataFrame, spread: int = 1) -> DataFrame:
    """``sid`` of the sentences that one of the paired sources covers.

    With ``spread`` the pairs of a sentence are dealt into so many parts by their source.
    """
    grams = wanted.select("sid", "need", "gram").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(spread)).cast("int"))
    return (
        dealt.join(grams, ["sid", "part"])
        .join(held, ["pool", "gram", "source"])
        .groupBy("sid", "source")
        .agg(F.count(F.lit(1)).alias("matched"), F.first("need").alias("need"))
        .where("matched >= need")
        .select("sid")
        .distinct()
    )


def entailed_sentences(
    asked: DataFrame,
    sources: DataFrame,
    model: PairModel,
    *,
    pool: str,
    sentence: str = "sentence",
    text: str = "text",
    threshold: float = MIN_SHARE,
) -> DataFrame:
    """``asked`` with ``grounded``: whether a model says that a source of the sentence's pool entails it.

    Any score above ``threshold`` will do. The model is loaded once a task and gets lists of sentences
    and of sources; equal pairs are scored once. Pools are the few sources of one answer.
    """
    lower = asked.select(pool, F.col(sentence).alias("_said")).distinct()
    pairs = lower.join(sources.select(pool, F.col(text).alias("_source")).distinct(), pool)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model()
        for said, source in batches:
            known = (said.notna() & source.notna()).to_numpy()
            out = np.full(len(said), np.nan)
            if known.any():
                out[known] = np.asarray(score(said[known].tolist(), source[known].tolist()), float)
            yield pd.Series(out)

    best = pairs.select(pool, "_said", scored.asNondeterministic()("_said", "_source").alias("_score"))
    found = best.groupBy(pool, "_said").agg(F.max(F.nanvl("_score", F.lit(None))).alias("_score"))
    verdict = F.coalesce(F.col("_score") > threshold, F.lit(False))
    return (
        asked.withColumn("_said", F.col(sentence))
        .join(found, [pool, "_said"], "left")
        .withColumn("grounded", verdict)
        .select(*asked.columns, "grounded")
    )


def check_answers(
    answers: DataFrame,
    sources: DataFrame,
    *,
    key: str = "answer_id",
    text: str = "text",
    source_key: str = "id",
    source_text: str = "content",
    model: EmbeddingModel | None = None,
    k: int = 5,
    min_score: float = 0.8,
    n: int = 3,
    threshold: float = MIN_SHARE,
    entails: PairModel | None = None,
) -> DataFrame:
    """Sentences of the answers with ``grounded``: ``key, sentence_ix, sentence``.

    Each sentence gathers its most similar sources; those of all sentences of
    an answer are pooled, and any of them may bear out any sentence: by shared
    word n-grams, or by the model ``entails``.
    """
    asked = sentences(answers, text, [key])
    embedded = asked.select(
        key,
        F.concat_ws("\x01", F.col(key).cast("string"), "sentence_ix").alias("query_id"),
        embed("sentence", model).alias("embedding"),
    )
    corpus = sources.select(
        F.col(source_key).alias("id"),
        F.col(source_text).alias("source_text"),
        embed(source_text, model).alias("embedding"),
    )
    hits = relevant_sources(embedded, corpus, k, min_score)
    pooled = (
        hits.join(embedded.select("query_id", key), "query_id")
        .select(key, "id")
        .distinct()
        .join(corpus.select("id", "source_text"), "id")
    )
    if entails is not None:
        return entailed_sentences(asked, pooled, entails, pool=key, text="source_text", threshold=threshold)
    return grounded_sentences(
        asked, pooled, text="source_text", pool=key, n=n, threshold=threshold
    )
