"""Mix sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
#: Hex digits of the drawing key that one round of the cut's search looks at, and the rounds.
DIGITS = 2
ROUNDS = 3
#: A cut after every key.
ALL = "g"


def word_count(text: Column) -> Column:
    """How many runs of characters other than ASCII blanks a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A source as a text that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def drawing_key(doc_id: Column, seed: str = SEED) -> Column:
    """The seeded order in which a source's documents are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, in the order of ``source_key``, which is unique.

    The rows are sorted by range and numbered within their range, and the ranges before it are
    added, so no task gets all of them.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        sizes.repartitionByRange(parts, "source_key").withColumn("part", F.spark_partition_id())
    )
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("source_key")) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(before), "part")
        .select(*sizes.columns, (F.col("within") + F.coalesce("before", F.lit(0))).alias("rank"))
    )


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to sources with ``source_key``, ``source_size`` and ``weight``.

    All sizes together are shared out by weight. A source whose share is above ``max_epochs``
    times its size is clamped there and the excess goes to the others by weight, again and again
    until none is above. A round is one aggregate over the sources; what it returns to the driver
    are three numbers. If all are clamped, the rest stays unused.
    """
    cap = F.col("source_size") * float(max_epochs)
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        found = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if found["n"] == clamped or not found["open"]:
            break
        clamped, level = found["n"], (total - found["taken"]) / found["open"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level or 0.0))))


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``cut`` and ``filler``: documents with a key up to the one or equal to the other get one more repetition.

    ``sources`` has ``source_key``, ``source_size`` and ``left``, the words to draw. The cut is searched digit by
    digit: a round sums sizes by source and the next digits of the key, finds where the running
    sum passes what is to be drawn, and goes on below these digits. Each round pre-aggregates, so
    a source of any share of the rows is summed by all tasks; the running sum of a source has at
    most 256 rows. After the last round only the few keys that share all digits are looked at one
    by one. What is then still missing is filled by the undrawn key whose size comes nearest, if
    any comes nearer than none. Equal keys are drawn together. A remainder that a round meets
    exactly goes on as 0, so the cut ends before the next key that has words; a source of which
    all words are to be drawn has no such key and is cut after every key.
    """
    state = sources.where("left > 0").select("source_key", F.lit("").alias("prefix"), "left")
    for depth in range(ROUNDS):
        digits = F.substring("key", depth * DIGITS + 1, DIGITS)
        sums = (
            rows.join(state, "source_key")
            .where(F.col("key").startswith(F.col("prefix")))
            .groupBy("source_key", "prefix", "left", digits.alias("digits"))
            .agg(F.sum("size").alias("size"))
        )
        order = Window.partitionBy("source_key").orderBy("digits")
        running = sums.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") > F.col("left"))
        below = F.struct(
            F.concat("prefix", "digits").alias("prefix"),
            (F.col("left") - (F.col("upto") - F.col("size"))).alias("left"),
        )
        state = cut_lineage(
            running.groupBy("source_key").agg(F.min_by(below, "digits").alias("next")).select("source_key", "next.*")
        )
    keys = (
        rows.join(state, "source_key")
        .where(F.col("key").startswith(F.col("prefix")))
        .groupBy("source_key", "prefix", "left", "key")
        .agg(F.sum("size").alias("size"))
    )
    running = keys.withColumn("upto", F.sum("size").over(Window.partitionBy("source_key").orderBy("key")))
    drawn = F.col("upto") <= F.col("left")
    last = cut_lineage(
        running.groupBy("source_key", "prefix", "left")
        .agg(F.max(F.when(drawn, F.col("key"))).alias("key"), F.max(F.when(drawn, F.col("upto"))).alias("upto"))
        .select(
            "source_key",
            F.coalesce("key", "prefix").alias("cut"),
            (F.col("left") - F.coalesce("upto", F.lit(0))).alias("gap"),
        )
    )
    short = F.abs(F.col("size") - F.col("gap"))
    filler = (
        rows.join(last, "source_key")
        .where((F.col("key") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
        .groupBy("source_key", "key", "gap")
        .agg(F.sum("size").alias("size"))
        .where(short < F.col("gap"))
        .groupBy("source_key")
        .agg(F.min(F.struct(short.alias("short"), "key")).alias("best"))
        .select("source_key", F.col("best.key").alias("filler"))
    )
    return (
        sources.join(last.select("source_key", "cut"), "source_key", "left")
        .join(filler, "source_key", "left")
        .withColumn("cut", F.when((F.col("left") > 0) & (F.col("left") >= F.col("source_size")), ALL).otherwise(F.coalesce("cut", F.lit(""))))
        .withColumn("filler", F.coalesce("filler", F.lit("")))
    )


def plan(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """A row for each source: ``source_key``, ``source_size``, ``target``, ``whole``, ``cut``, ``filler``.

    ``rows`` has ``source_key``, ``key`` and ``size``. Sources in code point order get
    ``weights`` in turn. ``whole`` is how often every document of the source is taken, and those
    with a key up to ``cut`` or equal to ``filler`` once more.
    """
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    pattern = F.array(*(F.lit(int(w)) for w in weights))
    weighed = ranked_sources(sizes).withColumn(
        "weight", F.element_at(pattern, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = (
        water_fill(cut_lineage(weighed), max_epochs)
        .withColumn("whole", F.floor(ratio + F.lit(1e-12)))
        .withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(1e-6)))
    )
    found = _cuts(rows, cut_lineage(filled))
    return cut_lineage(found.select("source_key", "source_size", "target", "whole", "cut", "filler"))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        word_count(F.col(text)).alias("size"),
        source_key(F.col(source)).alias("source_key"),
        drawing_key(F.col(doc_id)).alias("key"),
    )


def repetitions() -> Column:
    """How often a document is taken, from its ``key`` and its source's plan."""
    drawn = (F.col("key") <= F.col("cut")) | (F.col("key") == F.col("filler"))
    return F.col("whole") + F.when(drawn, 1).otherwise(0)


def mix_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for each row of ``docs``.

    A null source is a source of its own, last in order; null and blank texts have size 0 and
    take nothing. Rows with equal ids are drawn together, so reruns and repeated rows agree. An
    empty table gives an empty result; other columns are not looked at.
    """
    rows = cut_lineage(_keyed(docs, doc_id, text, source))
    return rows.join(plan(rows, weights, max_epochs), "source_key").select(
        F.col("doc_id").alias(doc_id),
        "size",
        "source_size",
        "target",
        (F.col("size") * repetitions()).cast("bigint").alias("taken"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Only the plan, a row for each source, is joined to the texts.
    """
    found = plan(cut_lineage(_keyed(docs, doc_id, text, source)), weights, max_epochs)
    columns = list(docs.columns)
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        source_key(F.col(f"`{source}`")).alias("source_key"),
        drawing_key(F.col(f"`{doc_id}`")).alias("key"),
    )
    return (
        packed.join(found, "source_key")
        .withColumn("times", repetitions().cast("int"))
        .where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
        .select("row.*")
    )
