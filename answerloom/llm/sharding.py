"""Shards of even size that keep linked documents together, by balanced label propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.session import cut_lineage

SHARDS = 16
#: Rounds of moves at most; they end as soon as no row finds a better shard with room.
ROUNDS = 12
#: Links of this share of a shard or more are placed one by one, at most ``shards`` times so many.
LARGE = 1_024
SEED = "shard"


def _draw(*parts: Column | str) -> Column:
    """A number from 0 to 1 drawn from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _move(now: DataFrame, members: DataFrame, shards: int, room: int, step: int, counts: dict[int, int]) -> DataFrame:
    """One round: linked rows ask for the shard most of their neighbours are in and some may go.

    ``members`` has ``row`` and ``link``; rows with a link in common are neighbours. Neighbours
    are counted by link and shard, so a link of any number of rows is a few counts. Requests are
    summed by pair of shards; as many rows may change places between two shards as ask for it in
    both directions, and what room a shard has left is shared out over those who ask. Which rows
    go is drawn by a hash, so nothing is ranked. A row asks only for a shard with more of its
    neighbours than its own, and for a full one only if all that are better are full.
    """
    placed = members.join(now, "row")
    held = placed.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    votes = (
        placed.select("link", "row", F.col("shard").alias("own"))
        .join(held, "link")
        .groupBy("row", "own", "shard")
        .agg(F.sum("n").alias("n"), F.min("link").alias("link"))
    )
    open_ = F.col("shard").isin([s for s in range(shards) if counts.get(s, 0) < room])
    here = F.coalesce(F.max(F.when(F.col("shard") == F.col("own"), F.col("n"))), F.lit(0))
    choice = F.struct(open_.alias("open"), "n", F.xxhash64("link", "shard").alias("tie"), "shard")
    wanted = votes.groupBy("row", "own").agg(here.alias("here"), F.collect_list(F.when(F.col("shard") != F.col("own"), choice)).alias("others"))
    better = F.array_max(F.filter("others", lambda o: o["n"] > F.col("here")))
    asked = cut_lineage(wanted.select("row", "own", better["shard"].alias("to")).where("to IS NOT NULL"))
    flows = {(r["own"], r["to"]): r["n"] for r in asked.groupBy("own", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not flows:
        return now
    into = {t: sum(n for (_, b), n in flows.items() if b == t) for t in range(shards)}
    chances = []
    for (own, to), n in sorted(flows.items()):
        swap = min(n, flows.get((to, own), 0))
        gap = max(0, room - counts.get(to, 0))
        # What the draw may exceed its mean by is kept free.
        free = max(0, gap - math.isqrt(9 * gap)) * n / into[to]
        chances.append((own, to, min(1.0, (swap + free) / n)))
    if not any(chance for _, _, chance in chances):
        return now
    spark = now.sparkSession
    allowed = spark.createDataFrame(chances, "own int, to int, chance double")
    goes = (
        asked.join(F.broadcast(allowed), ["own", "to"])
        .where(_draw("row", F.lit(f"{SEED}{step}")) < F.col("chance"))
        .select("row", "to")
    )
    return now.join(goes, "row", "left").select("row", F.coalesce("to", "shard").alias("shard"))


def _sizes(now: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}


def _shared(members: DataFrame) -> DataFrame:
    """Members of links that more than one row has."""
    links = members.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(cut_lineage(links.select("link")), "link", "left_semi")


def pack(sizes: list[tuple[int, int]], rooms: dict[int, int]) -> list[tuple[int, int, int]]:
    """``link``, shard and rows for links with their sizes, largest first; ``rooms`` is what shards have left.

    A link goes whole to the shard it fills best. One that no shard holds takes the emptiest
    shards, as few as hold it, evenly; which of its rows go where is drawn, so what the draw may
    miss by is kept free.
    """
    made = []
    for link, n in sizes:
        fitting = [s for s, room in rooms.items() if room >= n]
        if fitting:
            parts = [(min(fitting, key=lambda s: (rooms[s], s)), n)]
        else:
            emptiest = sorted(rooms, key=lambda s: (-rooms[s], s))
            few = next((k for k in range(1, len(rooms) + 1) if sum(rooms[s] for s in emptiest[:k]) >= n), len(rooms))
            left, parts = n, []
            for at, s in enumerate(reversed(emptiest[:few])):
                take = min(rooms[s], -(-left // (few - at))) if at < few - 1 else left
                parts.append((s, take))
                left -= take
        for s, take in parts:
            rooms[s] -= take if len(parts) == 1 else min(rooms[s], take + math.isqrt(16 * take))
            if take:
                made.append((link, s, take))
    return made


def _start(linked: DataFrame, total: int, shards: int) -> DataFrame:
    """``row``, ``shard``: whole links by their counts, large ones packed, the others drawn by the room that is left."""
    sizes = cut_lineage(linked.groupBy("link").agg(F.count(F.lit(1)).alias("n")))
    homes = linked.join(sizes, "link").groupBy("row").agg(F.max(F.struct("n", "link")).alias("home")).select("row", "home.link")
    rooms = dict.fromkeys(range(shards), total // shards)
    least = max(2, total // (shards * LARGE))
    # At most ``shards * LARGE`` links are that large.
    large = [(r["link"], r["n"]) for r in sizes.where(F.col("n") >= least).orderBy(F.desc("n"), "link").collect()]
    ranges, upto = [], {}
    counts = dict(large)
    for link, shard, n in pack(large, rooms):
        low = upto.get(link, 0)
        upto[link] = low + n
        ranges.append((link, low / counts[link], 2.0 if upto[link] == counts[link] else upto[link] / counts[link], shard))
    spark = linked.sparkSession
    plan = F.broadcast(spark.createDataFrame(ranges, "link bigint, low double, high double, to int"))
    drawn, left = _draw("link", F.lit(SEED)), max(1, sum(max(0, room) for room in rooms.values()))
    other, passed = F.lit(shards - 1), 0
    bounds = []
    for shard in range(shards):
        passed += max(0, rooms[shard])
        bounds.append((passed / left, shard))
    for bound, shard in reversed(bounds[:-1]):
        other = F.when(drawn < bound, F.lit(shard)).otherwise(other)
    share = _draw("row", F.lit(f"{SEED}-part"))
    placed = homes.withColumn("share", share).join(plan, "link", "left")
    return placed.where("low IS NULL OR (share >= low AND share < high)").select("row", F.coalesce("to", other).cast("int").alias("shard"))


def propagate(linked: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``row``, ``shard`` for rows with neighbours: links placed whole, then rounds of moves under quotas.

    ``linked`` has ``row`` and ``link``. A shard may hold its even part of all ``total`` rows, so
    linked rows may fill it: rows without neighbours go where there is room afterwards.
    """
    if linked.isEmpty():
        return linked.select("row", F.lit(0).alias("shard"))
    now = cut_lineage(_start(linked, total, shards))
    for step in range(rounds):
        moved = _move(now, linked, shards, total // shards, step, _sizes(now))
        if moved is now:
            break
        now = cut_lineage(moved)
    return now


def _ranks(placed: DataFrame) -> DataFrame:
    """Add ``rank`` within the shard, from 0, by ``late`` and then by a hash of the row.

    Two levels of buckets of the hash are counted, and a row adds what lies before its bucket to
    its place in it, so a window holds at most some hundred counts or one bucket's rows.
    """
    drawn = F.pmod(F.xxhash64("row", F.lit("rank")), F.lit(1 << 20))
    marked = placed.withColumn("a", (F.col("late") * 256 + F.floor(drawn / 4096)).cast("int")).withColumn(
        "b", F.pmod(F.floor(drawn / 16), F.lit(256)).cast("int")
    )
    leaves = cut_lineage(marked.groupBy("shard", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    before = (Window.unboundedPreceding, -1)
    upper = leaves.groupBy("shard", "a").agg(F.sum("n").alias("n")).select(
        "shard", "a",
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("a").rowsBetween(*before)), F.lit(0)).alias("upper"),
    )
    lower = leaves.select(
        "shard", "a", "b",
        F.coalesce(F.sum("n").over(Window.partitionBy("shard", "a").orderBy("b").rowsBetween(*before)), F.lit(0)).alias("lower"),
    )
    starts = lower.join(upper, ["shard", "a"]).select("shard", "a", "b", (F.col("lower") + F.col("upper")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "a", "b").orderBy("row")) - 1
    return (
        marked.withColumn("within", within)
        .join(starts, ["shard", "a", "b"])
        .withColumn("rank", F.col("start") + F.col("within"))
        .drop("a", "b", "within", "start")
    )


def even_out(rows: DataFrame, placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row``, ``shard``, ``slot``: counts at most one apart, slots without gaps.

    Rows that are not in ``placed`` start in a drawn shard. A shard above its quota gives up its
    first rows, unplaced ones before placed ones, and shards below theirs take them in turn. From
    the shards' counts alone it is known how many go where, so a row needs its rank and nothing
    else.
    """
    start = (F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(shards))).cast("int")
    now = cut_lineage(
        rows.select("row").join(placed, "row", "left").select(
            "row", F.coalesce("shard", start).alias("shard"), F.col("shard").isNotNull().cast("int").alias("late")
        )
    )
    counts = _sizes(now)
    total = sum(counts.values())
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    ranked = _ranks(now)
    given = taken = 0
    gives, takes = [], []
    for s in range(shards):
        extra = counts.get(s, 0) - quota[s]
        gives.append((s, max(extra, 0), given))
        given += max(extra, 0)
        if extra < 0:
            takes.append((s, taken, taken - extra, counts.get(s, 0)))
            taken -= extra
    spark = now.sparkSession
    out = F.broadcast(spark.createDataFrame(gives, "shard int, extra bigint, first bigint"))
    numbered = ranked.join(out, "shard").withColumn(
        "number", F.when(F.col("rank") < F.col("extra"), F.col("first") + F.col("rank"))
    )
    to, slot = F.col("shard"), F.col("rank") - F.col("extra")
    for s, low, high, there in takes:
        here = (F.col("number") >= low) & (F.col("number") < high)
        to = F.when(here, F.lit(s)).otherwise(to)
        slot = F.when(here, F.col("number") - low + there).otherwise(slot)
    return numbered.select("row", to.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def shard_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for each row.

    The law is ``rows``: counts of shards are at most one apart. Rows with equal texts are linked
    and kept together as far as the quotas allow; null and empty texts are linked among their
    own. Repeated rows are rows like any other. An empty table gives an empty result; other
    columns are not looked at. Texts leave the scan as a size, a checksum and a digest.
    """
    narrow = cut_lineage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.md5(F.col(text).cast("binary"))).alias("link"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    linked = cut_lineage(_shared(narrow.select("row", "link")))
    placed = propagate(linked, narrow.count(), shards, rounds)
    return narrow.join(even_out(narrow, placed, shards), "row").select(
        F.col("doc_id").alias(doc_id),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
