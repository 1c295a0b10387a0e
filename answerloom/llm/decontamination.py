"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm._common import free_name
from answerloom.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts of a Jaccard similarity of 0.8 differ in 10 of 64 bits on average, 15 hold all but a few percent.
RADIUS = 15
#: Blocks of a fingerprint by which windows and items meet.
BLOCKS = 4
WORD = re.compile(r"\w+")
#: Bits of the filter of benchmark shingles, whatever their number: 8 MB on each executor.
FILTER_BITS = 1 << 26
MEMO = 1 << 19
#: Longer words are hashed each time, so the words that are kept are few bytes.
KEPT = 64


class _Hashes(dict):
    """Word hashes; emptied when it holds ``MEMO`` words, none of more than ``KEPT`` characters."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        if len(word) <= KEPT:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


def _shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """A mixed hash of every ``words`` adjacent words."""
    n = len(hashes) - words + 1
    found = np.zeros(n, np.uint64)
    for ix in range(words):
        found = (found + hashes[ix : ix + n]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def _simhashes(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles at ``starts``; a bit is 1 if over half have it."""
    first, last = int(starts.min()), int(starts.max()) + size
    bits = np.unpackbits(shingles[first:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upto = np.concatenate((np.zeros((1, 64), np.int32), bits.cumsum(axis=0, dtype=np.int32)))
    counts = upto[starts - first + size] - upto[starts - first]
    return np.packbits(counts * 2 > size, axis=1, bitorder="little").view("<u8")[:, 0].view(np.int64)


def _hashed(words: list[str], memo: _Hashes) -> np.ndarray:
    return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def shingle_count(words: int) -> tuple[int, int]:
    """Words in a shingle and shingles in a text of ``words`` words; a shorter text is one shingle."""
    width = min(SHINGLE_WORDS, words)
    return width, words - width + 1


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Hashes()
    for batch in batches:
        sizes, prints, joined, shingles = [], [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            if not words:
                sizes.append(0), prints.append(0), joined.append(""), shingles.append([])
                continue
            width, count = shingle_count(len(words))
            hashes = _shingle_hashes(_hashed(words, memo), width)
            sizes.append(len(words)), joined.append(" ".join(words))
            prints.append(int(_simhashes(hashes, np.array([0]), count)[0]))
            shingles.append(hashes.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()),
             pa.array(joined, pa.string()), pa.array(shingles, pa.list_(pa.int64()))],
            ["item_id", "n_words", "fp", "words", "shingles"],
        )


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for two hashes of every benchmark shingle; its size does not depend on their number."""
    hashed = items.select(F.explode("shingles").alias("h"))
    places = hashed.select(
        F.explode(F.array(*(F.pmod(F.shiftright("h", s), F.lit(FILTER_BITS)) for s in (0, 32)))).alias("at")
    )
    words = (
        places.groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
        .toArrow()
    )
    found = np.zeros(FILTER_BITS // 64, np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint64)


def _known(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which shingles may be a benchmark's; no benchmark shingle is missed."""
    found = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes.view(np.int64) >> shift) & (FILTER_BITS - 1)
        found &= ((filter_words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return found


def item_windows(
    words: list[str], sizes: list[int], filter_words: np.ndarray, similarity: float, memo: _Hashes
) -> Iterator[tuple[int, int, int]]:
    """``start``, ``n_words``, fingerprint of a document's windows of the items' sizes.

    Items longer than the document are compared with all of it, as one window. A window that
    shares too few shingles with all items together to be as similar as ``similarity`` to any of
    them is not fingerprinted: of m and n shingles at least (m+n)t/(1+t) must be shared.
    """
    if not words:
        return
    hashes = _hashed(words, memo)
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    at = bisect_right(sizes, len(words))
    wanted = [(size, size) for size in sizes[:at]]
    if at < len(sizes) and len(words) >= SHINGLE_WORDS and len(words) not in sizes[:at][-1:]:
        wanted.append((len(words), sizes[at]))
    for size, of_item in wanted:
        width, count = shingle_count(size)
        need = int(np.ceil((2 * count + of_item - size) * similarity / (1 + similarity) - 1e-9))
        if need > count:
            continue
        if width not in by_width:
            shingles = _shingle_hashes(hashes, width)
            by_width[width] = shingles, np.concatenate(([0], _known(filter_words, shingles).cumsum()))
        shingles, upto = by_width[width]
        if not upto[-1]:
            continue
        starts = np.nonzero(upto[count:] - upto[: len(upto) - count] >= need)[0]
        if len(starts):
            for start, fp in zip(starts.tolist(), _simhashes(shingles, starts, count).tolist(), strict=True):
                yield start, size, fp


def _windows(docs: DataFrame, text: str, keys: list[str], items: DataFrame, similarity: float) -> DataFrame:
    """Windows of ``docs`` with ``keys``, ``start``, ``n_words``, ``fp``, ``words``, ``whole`` (all of the document)."""
    sizes = sorted(r["n_words"] for r in items.where("n_words > 0").select("n_words").distinct().collect())
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((sizes, _filter(items)))
    made = docs.select(*keys, text).schema
    head = ", ".join(f"`{k}` {made[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, known = shared.value
        memo = _Hashes()
        for batch in batches:
            rows, starts, counts, prints, joined, whole = [], [], [], [], [], []
            for row, one in enumerate(batch.column(len(keys)).to_pylist()):
                words = words_of(one)
                for start, size, fp in item_windows(words, lengths, known, similarity, memo):
                    rows.append(row), starts.append(start), counts.append(size), prints.append(fp)
                    joined.append(" ".join(words[start : start + size])), whole.append(size == len(words))
            if rows:
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(ix).take(taken) for ix in range(len(keys))), pa.array(starts, pa.int32()),
                     pa.array(counts, pa.int32()), pa.array(prints, pa.int64()), pa.array(joined, pa.string()), pa.array(whole, pa.bool_())],
                    [*keys, "start", "n_words", "fp", "words", "whole"],
                )

    return docs.select(*keys, text).mapInArrow(run, f"{head}, start int, n_words int, fp bigint, words string, whole boolean")


def _sized(df: DataFrame, name: str, key: str, similarity: float, whole: Column, steps: int) -> DataFrame:
    """``name`` and ``fp`` of ``key`` under each ``n_words`` by which ``hamming_pairs`` is to find them.

    Besides their own size, rows that are ``whole`` come under ``steps`` steps of shingle counts,
    written below 0. A step is a factor of 1/t, so a document whose shingles are at least a share t
    of an item's is on the item's step or on the one before.
    """
    step = F.floor(F.log(F.col("n_words") - (SHINGLE_WORDS - 1.0)) / F.log(F.lit(1 / max(similarity - 1e-6, 1e-9)))).cast("int")
    own = F.array("n_words")
    more = F.array("n_words", *(-1 - step - ix for ix in range(steps)))
    sizes = F.when(whole & (F.col("n_words") >= SHINGLE_WORDS), more).otherwise(own)
    return df.select(F.col(key).alias(name), "fp", F.explode(sizes).alias("n_words"))


def _blocks(count: int = BLOCKS) -> list[tuple[int, int]]:
    """Shift and width of the blocks that the 64 bits are cut into."""
    edges = [64 * ix // count for ix in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _changes(width: int, most: int) -> list[int]:
    """All patterns of up to ``most`` bits of a block."""
    return [sum(1 << bit for bit in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def hamming_candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Windows and items of one size that are near in one block at least; each pair once for each such block.

    The 64 bits are cut into four blocks. Of ``radius`` differing bits one block has at most a
    quarter, so an item is listed under every value that near to each of its blocks (697 of 65,536
    for 15 bits), and a window joins by its own four values: no pair within the radius is missed,
    and about four in a hundred of the others come along.
    """
    blocks, most = _blocks(), radius // BLOCKS

    def value(a: int, n: int) -> Column:
        return F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1))

    def near(ix: int, a: int, n: int) -> Column:
        changes = F.expr(f"array({', '.join(f'{change}L' for change in _changes(n, most))})")
        return F.transform(changes, lambda change: F.struct(F.lit(ix).alias("block"), value(a, n).bitwiseXOR(change).alias("value")))

    own = F.array(*(F.struct(F.lit(ix).alias("block"), value(a, n).alias("value")) for ix, (a, n) in enumerate(blocks)))
    every = F.flatten(F.array(*(near(ix, a, n) for ix, (a, n) in enumerate(blocks))))
    listed = lambda df, name, found: df.select(name, F.col("fp").alias(f"fp_{name}"), "n_words", F.inline(found))
    return listed(windows, "window", own).join(listed(items, "item_id", every), ["n_words", "block", "value"])


def hamming_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``window``, ``item_id``, ``bits``: all pairs of one size whose fingerprints differ in ``radius`` bits or fewer.

    A pair is kept at the first block in which it is near, so it comes once.
    """
    apart = F.col("fp_window").bitwiseXOR(F.col("fp_item_id"))
    first = reduce(
        lambda rest, found: F.when(F.bit_count(apart.bitwiseAND(F.lit(_mask(*found[1])))) <= radius // BLOCKS, found[0]).otherwise(rest),
        reversed(list(enumerate(_blocks()))),
        F.lit(-1),
    )
    return (
        hamming_candidates(windows, items, radius)
        .where((F.bit_count(apart) <= radius) & (F.col("block") == first))
        .select("window", "item_id", F.bit_count(apart).alias("bits"))
    )


def _mask(shift: int, width: int) -> int:
    value = ((1 << width) - 1) << shift
    return value - (1 << 64) if value >= 1 << 63 else value


def similarity_of(left: str, right: str) -> float:
    """Weighted Jaccard similarity of the shingles, a shingle weighing as often as it occurs."""
    sides = []
    for joined in (left, right):
        words = joined.split(" ")
        width, count = shingle_count(len(words))
        sides.append(Counter(tuple(words[ix : ix + width]) for ix in range(count)))
    shared = sum((sides[0] & sides[1]).values())
    return shared / (sum(map(Counter.total, sides)) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        found = [similarity_of(a, b) for a, b in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(found, pa.float64())], [*batch.schema.names[:-2], "similarity"]
        )


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keys: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``keys``, ``item_id``, ``similarity``, ``start``, ``n_words``, ``bits``: the best window for each pair.

    An item is compared with the windows of its size, or with the whole of a document that is
    shorter. The best window is the most similar, then the first. Rows with equal keys are one document;
    keys and ids of items may be null. Null or wordless texts and items match nothing, an item of fewer than five
    words is one shingle, items with equal texts are all found, and empty tables give an empty
    result. Other columns are not looked at. Documents stay where they are: only windows that
    may match are written and joined.
    """
    items = cut_lineage(
        benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).mapInArrow(
            _item_rows,
            f"item_id {benchmark.schema[item_id].dataType.simpleString()}, "
            "n_words int, fp bigint, words string, shingles array<bigint>",
        ).withColumn("item", F.monotonically_increasing_id())
    ).where("n_words > 0")
    windows = cut_lineage(
        _windows(docs, text, keys, items, similarity).withColumn("window", F.monotonically_increasing_id())
    )
    pairs = hamming_pairs(
        _sized(windows, "window", "window", similarity, F.col("whole"), 2),
        _sized(items, "item_id", "item", similarity, F.lit(True), 1),
        radius,
    ).withColumnRenamed("item_id", "item")
    texts = items.select("item", "item_id", F.col("n_words").alias("item_size"), F.col("words").alias("item_words"))
    compared = (
        pairs.join(windows.select(*keys, "start", "n_words", "window", "words"), "window")
        .join(texts, "item")
        .where("item_size >= n_words")
        .select(*keys, "item_id", "start", "n_words", "bits", "words", "item_words")
    )
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in compared.schema.fields[:-2])
    order = F.struct((-F.col("similarity")).alias("worse"), "start", "n_words", "bits")
    return (
        compared.mapInArrow(_verify, f"{head}, similarity double")
        .where(F.col("similarity") >= similarity)
        .groupBy(*keys, "item_id")
        .agg(F.min(order).alias("best"))
        .select(*keys, "item_id", (-F.col("best.worse")).alias("similarity"), "best.start", "best.n_words", "best.bits")
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns.

    A row is told by its id and a hash of its text, so rows that share an id are judged apart.
    """
    held = free_name(docs.columns, "held")
    of_id = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-"))
    marked = docs.withColumn(held, F.concat_ws(":", of_id, F.hex(F.xxhash64(F.col(f"`{text}`")))))
    found = find_passages(marked, benchmark, [held], text, radius=radius, similarity=similarity)
    bad = cut_lineage(found.select(held).distinct())
    return marked.join(bad, held, "left_anti").select(*(f"`{c}`" for c in docs.columns))
