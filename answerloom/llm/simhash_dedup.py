"""SimHash fingerprints and all links within a few bits, by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm._common import free_name, map_texts
from answerloom.llm._components import components
from answerloom.session import cut_lineage

SHINGLE_WORDS = 4
RADIUS = 4
TILE = 8192
SEED = 42
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text; 0 if it is null or has no word.

    ``bytes.split`` cuts at exactly the six blanks of ASCII.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    stops = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprints(
    docs: DataFrame, text: str, carry: list[str], name: str = "fp", words: int = SHINGLE_WORDS
) -> DataFrame:
    """``carry`` and the fingerprint of each text as a signed long."""
    return map_texts(
        docs,
        text,
        carry,
        [T.StructField(name, T.LongType())],
        lambda texts: [[_signed(fingerprint(t, words)) for t in texts]],
    )


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _part(fp: Column, shift: int, bits: int) -> Column:
    """The population count of some bits of a fingerprint."""
    return F.bit_count(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1)))


def _tiles(fps: DataFrame, tile: int) -> DataFrame:
    """Fingerprints packed into arrays of about ``tile``, each of one cell of population counts.

    A cell is a pair of population counts, of the low and the high half. Cells of more than
    ``tile`` fingerprints are told apart by the counts of their quarters too, and what is still
    larger is dealt over several tiles by a hash. The tables of counts have at most 33^2 and
    17^4 rows, whatever the input, so they may be broadcast.
    """
    fp = F.col("fp")
    marked = fps.select(
        "fp",
        _part(fp, 0, 32).alias("lo"),
        _part(fp, 32, 32).alias("hi"),
        _part(fp, 0, 16).alias("q0"),
        _part(fp, 32, 16).alias("q2"),
    )
    fine = cut_lineage(marked.groupBy("lo", "hi", "q0", "q2").agg(F.count(F.lit(1)).alias("n_fine")))
    cells = fine.groupBy("lo", "hi").agg(F.sum("n_fine").alias("n_cell"))
    large = F.col("n_cell") > tile
    rows = F.when(large, F.col("n_fine")).otherwise(F.col("n_cell"))
    return (
        marked.join(F.broadcast(cells), ["lo", "hi"])
        .join(F.broadcast(fine), ["lo", "hi", "q0", "q2"])
        .select(
            "fp",
            "lo",
            "hi",
            F.when(large, F.col("q0")).otherwise(-1).alias("q0"),
            F.when(large, F.col("q2")).otherwise(-1).alias("q2"),
            F.pmod(F.xxhash64("fp"), F.ceil(rows / tile)).alias("salt"),
        )
        .groupBy("lo", "hi", "q0", "q2", "salt")
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("tile", F.xxhash64("lo", "hi", "q0", "q2", "salt"))
    )


def _near_tiles(tiles: DataFrame, radius: int) -> DataFrame:
    """Ids of tile pairs whose population counts allow a distance within ``radius``."""
    ids = tiles.drop("fps")
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
    left = ids.select(*(F.col(c).alias(f"{c}_a") for c in ids.columns)).withColumn(
        "step", F.explode(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in steps)))
    )
    right = ids.select(*(F.col(c).alias(f"{c}_b") for c in ids.columns))
    quarters = sum(
        (
            F.abs(F.col(f"{q}_a") - F.col(f"{q}_b"))
            + F.abs(F.col(f"{h}_a") - F.col(f"{q}_a") - F.col(f"{h}_b") + F.col(f"{q}_b"))
            for q, h in (("q0", "lo"), ("q2", "hi"))
        ),
        F.lit(0),
    )
    return (
        left.withColumn("lo_to", F.col("lo_a") + F.col("step.lo"))
        .withColumn("hi_to", F.col("hi_a") + F.col("step.hi"))
        .join(right, (F.col("lo_to") == F.col("lo_b")) & (F.col("hi_to") == F.col("hi_b")))
        .where("tile_a <= tile_b")
        .where((F.col("q0_a") < 0) | (F.col("q0_b") < 0) | (quarters <= radius))
        .select("tile_a", "tile_b")
    )


def _settle(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of linked positions; every position then points at its smallest one."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, shorter := parent[parent]):
            parent = shorter


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, rows: int = 256) -> list[tuple[int, int]]:
    """Edges that connect what links within ``radius`` connect: fewer than fingerprints given.

    ``right`` is None for a tile against itself. A block of rows is compared at a time.
    """
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    every = left if right is None else np.concatenate((left, right))
    parent = np.arange(len(every))
    for at in range(0, len(left), rows):
        start = at if right is None else 0
        apart = np.bitwise_count(left[at : at + rows, None] ^ other[None, start:])
        i, j = np.nonzero(apart <= radius)
        i, j = i + at, j + start + shift
        if right is None:
            above = j > i
            i, j = i[above], j[above]
        if len(i):
            parent = _settle(parent, i, j)
    moved = np.nonzero(parent != np.arange(len(every)))[0]
    return list(zip(every[moved].view(np.int64).tolist(), every[parent[moved]].view(np.int64).tolist(), strict=True))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
            same = np.equal(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for row in range(batch.num_rows):
                left, right = (v[o[row] : o[row + 1]] for o, v in sides)
                found = forest(left, None if same[row] else right, radius)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``a``, ``b`` of distinct fingerprints, which connect all that differ in ``radius`` bits or fewer.

    Every pair of fingerprints is compared by exclusive-or and bit count, except where the
    population counts of the two tiles differ by more than the radius. Of a group whose members
    are all linked only a spanning forest for each tile pair goes on.
    """
    tiles = cut_lineage(_tiles(fps, tile))
    pairs = (
        _near_tiles(tiles, radius)
        .join(tiles.select(F.col("tile").alias("tile_b"), F.col("fps").alias("fps_b")), "tile_b")
        .join(tiles.select(F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a")), "tile_a")
        .select("tile_a", "tile_b", "fps_a", "fps_b")
    )
    return pairs.mapInArrow(_compare(radius), "a bigint, b bigint")


def classes(
    rows: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """``fp``, ``component_id`` (the smallest id reachable) for each fingerprint of ``rows``."""
    least = cut_lineage(rows.groupBy("fp").agg(F.min(doc_id).alias("least_id")))
    joined = components(links(least.select("fp"), radius, tile))
    labelled = cut_lineage(
        least.join(joined, least["fp"] == joined["node"], "left").select(
            "fp", "least_id", F.coalesce("component", "fp").alias("label")
        )
    )
    smallest = cut_lineage(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")))
    return labelled.join(smallest, "label").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with
    equal texts fall into one class; repeated rows stay repeated. The smallest id of a class
    ignores null ids. An empty table gives an empty result; other columns are not looked at.
    """
    rows = cut_lineage(with_fingerprints(docs, text, [doc_id], free_name([doc_id], "fp"), words))
    if rows.columns[1] != "fp":
        raise ValueError("the id column may not be called fp")
    return rows.join(classes(rows, doc_id, radius), "fp").select(
        doc_id, hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, with all columns of ``docs``.

    It is the row with the smallest id, and among several of that id the one whose text has the
    smallest hash. Repeated rows leave one.
    """
    held = free_name(docs.columns, "held")
    of_id = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-"))
    marked = docs.withColumn(held, F.concat_ws(":", of_id, F.hex(F.xxhash64(F.col(f"`{text}`")))))
    rows = cut_lineage(
        with_fingerprints(marked.select(doc_id, text, held), text, [doc_id, held], "fp")
    )
    if {doc_id.lower(), held.lower()} & {"fp", "component_id"}:
        raise ValueError("the id column may not be called fp or component_id")
    order = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.col(held).alias("held"))
    first = (
        rows.join(classes(rows, doc_id), "fp")
        .withColumn("label", F.coalesce(F.col("component_id").cast("string"), F.hex("fp")))
        .groupBy("label", F.col("component_id").isNull().alias("nameless"))
        .agg(F.min(order).alias("first"))
        .select(F.col("first.held").alias(held))
        .distinct()
    )
    return marked.join(first, held, "left_semi").dropDuplicates([held]).select(*(f"`{c}`" for c in docs.columns))
