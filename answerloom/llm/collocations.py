"""Phrases whose words stand together more often than their parts would by chance.

Phrases are counted in counting quotient filters (:mod:`answerloom.llm._quotient`). A phrase that occurs
often enough has no word and no pair of words that occurs less. So only words that do get an id, and
all others end a phrase; pairs are counted first, and longer phrases only where a Bloom filter of
the frequent pairs, which has no false negatives, lets all their pairs pass. Each block of texts
counts its own phrases; its filter is cut into shards by the phrases' permuted ids, which spreads
them evenly, and the filters of a shard are merged.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm._blocks import cut_blocks
from answerloom.llm._quotient import Packing, merge_filters, ordered, permute, restore, write_filter
from answerloom.session import cut_lineage

LEAST = 100
LONGEST = 5
BEST = 2_000
UNKNOWN = "und"
#: Bytes of text in a block, and counted phrases (repeats included) that a shard is made for.
BLOCK = 6 << 20
SHARD = 4_000_000
#: Word ids are ranks in so many hash buckets, so no task numbers a whole vocabulary.
BUCKETS = 64
#: Up to so many frequent words (at most 32 MB) are sent to all tasks; more are joined by a shuffle.
SENT_WORDS, SENT_BYTES = 500_000, 32 << 20
#: Bits of the filter of frequent pairs, whatever their number: 8 MB in each task.
PAIR_BITS = 26
#: Upper-case ASCII letters are lowered, and signs that end a piece become one of them.
ENDS = b".,;:!?\n\v\f\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"." * len(ENDS))

_CODED = "block bigint, lang string, word string, code int, n bigint, stream binary, size int"
_FILTERS = "shard bigint, lang string, n int, filter binary"


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order; ``.`` between pieces and texts."""
    return b".".join(texts).translate(_TABLE).replace(b".", b" . ").split()


def _coded(block: pa.Table) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """For each language of a block its distinct words, and its text as places among them, -1 between pieces."""
    held: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(block["lang"].to_pylist(), block["text"].to_pylist(), strict=True):
        if text:
            held[lang].append(text.encode("utf-8"))
    for lang in sorted(held):
        # The sign between pieces comes first, so that it has the code 0.
        coded = pa.array([b".", *words_of(held.pop(lang))], pa.binary()).dictionary_encode()
        yield lang, coded.dictionary[1:].cast(pa.string()), coded.indices.to_numpy()[1:].astype(np.int32) - 1


def _count_words(limit: int):
    """``lang``, ``word``, ``n`` of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in cut_blocks(batches, "text", limit):
            for lang, words, stream in _coded(block):
                counts = np.bincount(stream[stream >= 0], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts, pa.int64())], ["lang", "word", "n"])

    return run


def _code(limit: int):
    """A block's words as codes: for each language a stream, with -1 between pieces, and its dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"block": pa.int64(), "lang": pa.string(), "word": pa.string(), "code": pa.int32(), "n": pa.int64(), "stream": pa.binary(), "size": pa.int32()}

        def rows(size: int, columns: dict) -> pa.RecordBatch:
            made = [columns.get(name, pa.nulls(size, kind)) for name, kind in kinds.items()]
            made = [c if isinstance(c, pa.Array) else pa.array([c] * size, kind) for c, kind in zip(made, kinds.values(), strict=True)]
            return pa.RecordBatch.from_arrays(made, list(kinds))

        for number, block in cut_blocks(batches, "text", limit):
            for lang, words, stream in _coded(block):
                packed = pa.compress(stream.tobytes(), "zstd", asbytes=True)
                yield rows(1, {"block": number, "lang": lang, "stream": packed, "size": len(stream)})
                yield rows(len(words), {"block": number, "lang": lang, "word": words, "code": pa.array(np.arange(len(words), dtype=np.int32))})

    return run


def count_phrases(
    ids: np.ndarray, longest: int, allow: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For two ids and more, the distinct runs of ``ids`` that hold no -1, and their counts.

    ``allow`` tells which pairs longer runs may hold. A run is told by its beginning's number and
    its last id, so longer runs cost no more to compare.
    """
    known = ids >= 0
    distinct, last = np.unique(ids, return_inverse=True)
    number, whole, pairs = last.astype(np.int64), known, known[1:]
    for n in range(2, longest + 1):
        whole = whole[:-1] & pairs[n - 2 :]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        keys = number[at] * len(distinct) + last[at + n - 1]
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        first = np.flatnonzero(new)
        grams = ids[at[order[first]][:, None] + np.arange(n)]
        yield grams, np.diff(first, append=len(at))
        number = np.zeros(len(whole), np.int64)
        number[at[order]] = np.cumsum(new) - 1
        if n == 2:
            passed = np.ones(len(grams), bool) if allow is None else allow(grams)
            whole = whole.copy()
            whole[at] = passed[number[at]]
            pairs = whole


class PairFilter:
    """A Bloom filter of pairs of ids of one language each: two bits a pair, as words of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(lang: str, grams: np.ndarray, bits: int = PAIR_BITS) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of each pair."""
        mixed = (grams[:, 0].astype(np.uint64) << np.uint64(32)) ^ grams[:, 1].astype(np.uint64)
        mixed = (mixed ^ np.uint64(zlib.crc32(lang.encode()))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mask = np.uint64((1 << bits) - 1)
        return mixed & mask, (mixed >> np.uint64(32)) & mask

    def holds(self, lang: str, grams: np.ndarray) -> np.ndarray:
        found = np.ones(len(grams), bool)
        for place in self.places(lang, grams):
            found &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return found

    @classmethod
    def of(cls, phrases: DataFrame) -> PairFilter:
        """The pairs among ``phrases`` (``lang, ids``), put together by Spark; the driver gets the bits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lang in set(langs):
                    grams = np.array([i for i, of in zip(ids, langs, strict=True) if of == lang])
                    place = np.concatenate(cls.places(lang, grams))
                    bit = (np.uint64(1) << (place & np.uint64(63))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["slot", "bits"])

        slots = phrases.select("lang", "ids").mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(1 << (PAIR_BITS - 6), np.uint64)
        bits[slots["slot"].to_numpy()] = slots["bits"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(bits)


@dataclass(frozen=True)
class Counting:
    """What a task needs to make filters of the phrases of some lengths."""

    width: int
    shard_bits: int
    shortest: int
    longest: int
    pairs: PairFilter | None = None

    def filters(self, lang: str, ids: np.ndarray) -> Iterator[tuple[int, str, int, bytes]]:
        """``shard, lang, n, filter`` of the phrases of a language's stream of ids."""
        allow = None if self.pairs is None else lambda grams: self.pairs.holds(lang, grams)
        for grams, counts in count_phrases(ids, self.longest, allow):
            if grams.shape[1] < self.shortest:
                continue
            packing = Packing(grams.shape[1], self.width, self.shard_bits)
            limbs, counts = ordered(packing.pack(permute(grams, self.width)), counts)
            shards = packing.shards(limbs[0])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                shard = int(shards[start])
                yield shard, lang, packing.n, write_filter(packing, shard, [limb[start:end] for limb in limbs], counts[start:end])


def _as_arrow(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
    return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names=["shard", "lang", "n", "filter"])


def _count_texts(counting, words, limit: int):
    """Filters of each block of texts; the frequent words came with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in cut_blocks(batches, "text", limit):
            for lang, distinct, stream in _coded(block):
                known = words.value.get(lang)
                if known is None:
                    continue
                place = pc.fill_null(pc.index_in(distinct, value_set=known[0]), -1).to_numpy()
                ids = np.append(np.where(place >= 0, known[1][place], -1), -1)  # the last place is that of code -1
                yield from _as_arrow(list(counting.value.filters(lang, ids[stream]))).to_batches()

    return run


def _count_block(counting):
    """Filters of a block's phrases, from its streams and the ids of its frequent words."""

    def run(streams: pa.Table, words: pa.Table) -> pa.Table:
        of = np.array(words["in"].to_pylist(), object)
        codes, numbers, rows = words["code"].to_numpy(), words["id"].to_numpy(), []
        for lang, stream, size in zip(*(streams[name].to_pylist() for name in ("lang", "stream", "size")), strict=True):
            text = np.frombuffer(pa.decompress(stream, 4 * size, "zstd", asbytes=True), np.int32)
            here = of == lang
            ids = np.full(int(text.max(initial=-1)) + 2, -1, np.int64)
            ids[codes[here]] = numbers[here]
            rows += counting.value.filters(lang, ids[text])
        return _as_arrow(rows)

    return run


def _merge_shard(width: int, shard_bits: int, least: int):
    """Phrases of a shard that occur ``least`` times or more."""

    def run(filters: pa.Table) -> pa.Table:
        held: dict[tuple[str, int], list[bytes]] = defaultdict(list)
        for lang, n, data in zip(*(filters[name].to_pylist() for name in ("lang", "n", "filter")), strict=True):
            held[lang, n].append(data)
        shard = filters["shard"][0].as_py()
        langs, phrases, sums = [], [], []
        for lang, n in sorted(held):
            packing = Packing(n, width, shard_bits)
            limbs, counts = merge_filters(packing, shard, held.pop((lang, n)))
            often = counts >= least
            grams = restore(packing.unpack([limb[often] for limb in limbs]), width)
            langs += [lang] * len(grams)
            phrases += grams.tolist()
            sums += counts[often].tolist()
        return pa.table(
            {"lang": pa.array(langs, pa.string()), "ids": pa.array(phrases, pa.list_(pa.int64())), "a": pa.array(sums, pa.int64())}
        )

    return run


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))``, exact as long as both products have 38 digits at most."""
    whole = lambda column: column.cast("decimal(20,0)")
    above = whole(F.lit(1000)) * whole(a) * whole(n)
    return F.call_function("div", above.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, shard: int = SHARD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``lang, word, id, n``) and phrases (``lang, ids, a``) that occur ``least`` times, and all words' number (``lang, total``)."""
    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    counted = cut_lineage(
        source.mapInArrow(_count_words(block), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
    place = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("word"))
    frequent = counted.where(F.col("n") >= least).withColumn("bucket", bucket)
    words = cut_lineage(frequent.select("lang", "word", ((place - 1).cast("bigint") * BUCKETS + F.col("bucket")).alias("id"), "n"))
    known = words.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("id"), F.lit(0)).alias("last"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0)).alias("bytes"),
    ).first()
    width = max(1, int(known["last"]).bit_length())
    if width > 32:
        raise ValueError("more than 2^32 frequent words in one language")
    shard_bits = max(0, int(known["all"] // shard).bit_length())
    small = known["n"] <= SENT_WORDS and known["bytes"] <= SENT_BYTES
    if small:
        table = words.select("lang", "word", "id").toArrow()
        langs = {}
        for name in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], name))
            langs[name] = own["word"].combine_chunks(), own["id"].to_numpy()
        sent = spark.sparkContext.broadcast(langs)
    else:
        coded = cut_lineage(source.mapInArrow(_code(block), _CODED))
        entries = coded.where("word is not null").select(F.col("block").alias("of_block"), "lang", "word", "code")
        ids = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).select("of_block", F.col("lang").alias("in"), "code", "id")
        streams = coded.where("stream is not null").select("block", "lang", "stream", "size")

    def counts(shortest: int, longest: int, pairs: PairFilter | None = None) -> DataFrame:
        """Phrases of these lengths that occur often enough."""
        counting = spark.sparkContext.broadcast(Counting(width, shard_bits, shortest, longest, pairs))
        if small:
            filters = source.mapInArrow(_count_texts(counting, sent, block), _FILTERS)
        else:
            filters = streams.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(_count_block(counting), _FILTERS)
        merged = filters.groupBy("shard").applyInArrow(_merge_shard(width, shard_bits, least), "lang string, ids array<bigint>, a bigint")
        return cut_lineage(merged)

    pairs = counts(2, min(2, longest))
    if longest < 3:
        return words, pairs, totals
    return words, pairs.unionByName(counts(3, longest, PairFilter.of(pairs))), totals


def mine(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    best: int = BEST,
    share: int = 100,
    **sizes: int,
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line breaks, and these into
    words at blanks and tabs. A phrase is two to ``longest`` words of a piece, ``a`` its occurrences,
    overlapping ones included, ``n`` the language's words. Each of its cuts in two has the score
    ``floor(1000 * a * n / (l * r))``, where ``l`` and ``r`` count the two parts; the lowest counts, and
    of equal ones the earliest. Phrases of fewer than ``least`` occurrences are no candidates, and those
    within a longer one that occurs ``share`` percent as often or more are dropped. Ties of score go
    to the higher ``a``, then to the phrase first in byte order.

    A null language counts as ``und``, a null text as empty; texts without a word count nowhere,
    repeated rows each time. An empty table gives no rows. Other columns are not looked at. Words,
    phrases and texts may be of any length.
    """
    words, phrases, totals = phrase_counts(docs, text, lang, least, longest, **sizes)
    size = F.size("ids")
    parts = phrases.unionByName(words.select("lang", F.array("id").alias("ids"), F.col("n").alias("a")))
    cuts = phrases.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("ids").alias(side), F.col("a").alias(name)), ["lang", side])
    scored = cuts.join(totals, "lang").withColumn("score", cut_score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("cut"))
    # A phrase is no rarer than a longer one around it, so those one word longer tell for all.
    longer = phrases.where(size > 2)
    within = [longer.select("lang", F.slice("ids", at, size - 1).alias("ids"), "a") for at in (1, 2)]
    around = reduce(DataFrame.unionByName, within).groupBy("lang", "ids").agg(F.max("a").alias("around"))
    kept = lowest.join(around, ["lang", "ids"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < share * F.col("cut.a"))
    )
    # Only phrases that may be among the best are spelled: ties with the last are kept for now.
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("cut.a").desc())
    near = cut_lineage(kept.withColumn("place", F.rank().over(order)).where(F.col("place") <= best).select("lang", "ids", "cut.*"))
    spelled = (
        near.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
        .join(words.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "ids")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
