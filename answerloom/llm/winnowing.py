"""Document fingerprints by winnowing the hashes of adjacent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.columns import let
from answerloom.session import cut_lineage

#: Words in a gram.
GRAM = 3
#: Grams in a window, a power of two. Any stretch of GRAM + WINDOW - 1 equal words shares a hash.
WINDOW = 8
#: The low bits of a packed gram hold its position, counted down so that of equal hashes the
#: rightmost is the least; the high bits hold the hash.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Blocks of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Chinese characters):
#: every character is a word of its own. Texts without a character from the first of them on are
#: not searched for them.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
BEYOND = r"[^\x00-\u0dff]"
BUCKETS_PER_PARTITION = 4


def _grams(text: Column, gram: int) -> Column:
    """The packed hashes of every ``gram`` adjacent words; a shorter text is one gram."""
    between = rf"(?<=[{UNSPACED}])(?=[^ ])|(?<=[^ ])(?=[{UNSPACED}])"
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    said = let(plain, lambda t: F.when(t.rlike(BEYOND), F.regexp_replace(t, F.lit(between), F.lit(" "))).otherwise(t))
    words = F.split(said, " ")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def roll(a: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(a) - gram), lambda i: F.xxhash64(*(F.get(a, i + j) for j in range(gram))))
        return F.when(F.size(a) < gram, F.array(F.xxhash64(a))).otherwise(every)

    high = F.lit(~PLACES)
    return F.transform(let(hashes, roll), lambda h, i: h.bitwiseAND(high).bitwiseOR((F.lit(PLACES) - i).cast("bigint")))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Packed grams: the least of every window of ``window`` grams, rightmost of equal ones, in order.

    Minima of windows twice as long come from two neighbouring windows, so a window of eight
    takes three passes. A text with fewer grams than a window is one window.
    """

    def minima(a: Column) -> Column:
        now, width = a, 1
        while width < window:
            now = let(now, lambda m, width=width: F.zip_with(m, F.slice(m, F.lit(width + 1), F.size(m)), lambda x, y: F.least(x, y)))
            width *= 2
        return F.array_distinct(F.slice(now, F.lit(1), F.greatest(F.size(a) - (window - 1), F.lit(1))))

    return let(_grams(text, gram), minima)


def hashes_of(packed: Column) -> Column:
    """The set of hashes of a fingerprint."""
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, PLACE_BITS)))


def as_text(packed: Column) -> Column:
    """``hash:position`` of each selected gram, the position counted in words from 0."""
    mask = F.lit((1 << (64 - PLACE_BITS)) - 1)

    def one(p: Column) -> Column:
        place = F.lit(PLACES) - p.bitwiseAND(F.lit(PLACES))
        return F.concat(F.lower(F.hex(F.shiftright(p, PLACE_BITS).bitwiseAND(mask))), F.lit(":"), place.cast("string"))

    return F.array_join(F.transform(packed, one), ",")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    return F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above ``value``; a null value has none below it.

    Two levels are searched, so a row looks at about twice the root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[at : at + step] for at in range(0, len(bounds), step)]
    tops = F.from_json(F.lit(str([row[0] for row in rows])), "array<bigint>")
    every = F.from_json(F.lit(str(rows)), "array<array<bigint>>")
    below = lambda of: F.size(F.filter(of, lambda b: b <= value))
    return let(below(tops), lambda row: F.when(row == 0, 0).otherwise((row - 1) * step + below(F.element_at(every, row))))


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``text``, ``packed``, ``next_text``, ``next_packed``: each row and the one after it.

    Rows are ordered by id, null first, then by a hash of the text; after the last comes the
    first. The bounds of some ranges of ids are found from ids alone, a row goes to its range's
    bucket, and the first row of each range goes to the bucket before as well, so texts are
    shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
    )
    parts = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(doc_id).alias("id")).repartitionByRange(parts, "id")
    found = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("low")).collect()
    bounds = sorted({r["low"] for r in found if r["low"] is not None})[1:]
    placed = rows.withColumn("bucket", _bucket(F.col("id"), bounds))
    order = F.struct("id", "tie")
    firsts = placed.select("bucket", "id", "tie").groupBy("bucket").agg(F.min(order).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return placed.select("id", "text", winnow(F.col("text")).alias("packed"), F.col("text").alias("next_text"), winnow(F.col("text")).alias("next_packed"))
    before = [firsts[ix - 1]["bucket"] for ix in range(len(firsts))]
    guests = spark.createDataFrame(
        [(f["first"]["id"], f["first"]["tie"], b) for f, b in zip(firsts, before, strict=True)], "id bigint, tie bigint, to int"
    )
    same = rows["id"].eqNullSafe(guests["id"]) & (rows["tie"] == guests["tie"])
    visiting = (
        rows.join(F.broadcast(guests), same)
        .select(rows["id"], rows["text"], rows["tie"], F.col("to").alias("bucket"))
        .dropDuplicates(["id", "tie"])
        .withColumn("guest", F.lit(1))
    )
    near = Window.partitionBy("bucket").orderBy("guest", "id", "tie")
    return (
        placed.select("id", "text", "tie", "bucket", F.lit(0).alias("guest"))
        .union(visiting.select("id", "text", "tie", "bucket", "guest"))
        .repartition("bucket")
        .withColumn("packed", winnow(F.col("text")))
        .withColumn("next_text", F.lead("text").over(near))
        .withColumn("next_packed", F.lead("packed").over(near))
        .where("guest = 0")
        .select("id", "text", "packed", "next_text", "next_packed")
    )


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last half replaced by as much of the next document's
    beginning. Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts count as empty; an empty
    text has one gram, so two empty texts are alike. A lone document is its own next one. Ids are
    integers; an empty table gives an empty result; other columns are not read.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = (
        with_next(docs, doc_id, text)
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn(
            "edited",
            F.concat(
                F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                F.substring(F.col("next_text"), F.lit(1), half),
            ),
        )
        .withColumn("edited_packed", winnow(F.col("edited")))
        .withColumn("own", hashes_of(F.col("packed")))
    )
    return pairs.select(
        F.col("id").alias(doc_id),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes_of(F.col("edited_packed"))).alias("near_edited"),
        likeness(F.col("own"), hashes_of(F.col("next_packed"))).alias("near_next"),
    )
