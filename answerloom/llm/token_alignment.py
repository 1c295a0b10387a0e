"""Tokens of two tokenizers aligned by the bytes they cover, as Arrow columns.

A block of texts is cut into tokens by both; the token lists are flattened, and segmented sums of the
tokens' byte lengths give each token the place in its document where it ends. A full outer join of
both sides on (document, end) has one row for each stretch of bytes that no token's end divides: the
next end of either side names the token that covers it, so every row is a link, and rows found on
both sides end a group. Links are counted in each block by ``Table.group_by``; Spark adds the counts
up over the corpus and sends what it found back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm._blocks import cut_blocks
from answerloom.llm._common import free_name
from answerloom.session import cut_lineage

#: Bytes of text in a block. A longer document is a block of its own.
BLOCK = 1 << 20
#: Fixed value: how the byte-level vocabulary cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank at either end or beside other white space: such texts are not cut at blanks.
TOUCHY = r"(?:^|[\s\p{Z}\x0b\x{85}\x{1c}-\x{1f}]) | (?:$|[\s\p{Z}\x0b\x{85}\x{1c}-\x{1f}])"
#: White space inside a word.
WHITE = r"[\s\p{Z}\x0b\x{85}\x{1c}-\x{1f}]"
SPACE = "▁"


@dataclass(frozen=True)
class Vocabularies:
    """The two tokenizer files: ``first`` a byte-level BPE as JSON, ``second`` a piece model."""

    first: bytes
    second: bytes

    @classmethod
    def read(cls, first: str, second: str) -> Vocabularies:
        """Files of a few MB, read by the driver, so executors need no copy of their own."""
        return cls(Path(first).read_bytes(), Path(second).read_bytes())


def _byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte, by their rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + ix): b for ix, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, with the bytes and byte lengths of their tokens as Arrow arrays."""

    def __init__(self, files: Vocabularies):
        import sentencepiece

        model = json.loads(files.first)["model"]
        byte_of = _byte_of()
        spelled = {ix: bytes(byte_of[c] for c in token) for token, ix in model["vocab"].items()}
        self._first = self._by_rank(model, spelled)
        self._slow, self._json = None, files.first.decode()
        self._newline = next(ix for ix, token in spelled.items() if token == b"\n")
        pieces = sentencepiece.SentencePieceProcessor(model_proto=files.second)
        self._second = pieces
        names = [pieces.id_to_piece(ix) for ix in range(pieces.get_piece_size())]
        plain = [
            bytes([int(name[3:5], 16)]) if pieces.is_byte(ix) else name.replace(SPACE, " ").encode()
            for ix, name in enumerate(names)
        ]
        #: Pieces do not run on over a blank, so that words can be encoded one by one.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in names)
        self.bytes_of = (
            pa.array([spelled.get(ix, b"") for ix in range(max(spelled) + 1)], pa.large_binary()),
            pa.array(plain, pa.large_binary()),
        )
        self.lengths = tuple(pc.binary_length(spelling) for spelling in self.bytes_of)
        self.digits = tuple(pa.array([str(ix) for ix in range(len(spelling))], pa.large_string()) for spelling in self.bytes_of)

    @staticmethod
    def _by_rank(model: dict, spelled: dict[int, bytes]):
        """An encoder that merges by rank, the same as by the list of merges if that is in order of ids.

        None where it is not, or where the vocabulary has tokens that no merge makes.
        """
        import tiktoken

        made = [model["vocab"].get("".join(pair if isinstance(pair, list) else pair.split(" "))) for pair in model["merges"]]
        if any(ix is None for ix in made) or made != sorted(made) or len(made) + 256 != len(spelled):
            return None
        ranks = {token: ix for ix, token in spelled.items()}
        return tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> list[int]:
        """The file's own encoder."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._json)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def _one(self, text: str) -> list[int]:
        if self._first is None:
            return self._whole(text)
        try:
            return self._first.encode_ordinary(text)
        except BaseException as refused:  # noqa: BLE001 - the encoder's panic on huge runs of white space is no Exception
            if isinstance(refused, (KeyboardInterrupt, SystemExit)):
                raise
            return self._whole(text)

    def first(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text with a blank before it; strings of special tokens are plain text.

        Texts without white space are encoded in one go, a line each: the vocabulary cuts at the
        line's end and before the blank, so its tokens are those of the text alone.
        """
        lone = pc.match_substring_regex(texts, WHITE).to_numpy(zero_copy_only=False)
        if self._first is None:
            lone[:] = True
        lines = texts.filter(pa.array(~lone)).to_pylist()
        ids = np.array(self._one("".join(f" {line}\n" for line in lines)) if lines else [], np.int32)
        at_end = ids == self._newline
        sizes = np.zeros(len(texts), np.int64)
        ends = np.flatnonzero(at_end) - np.arange(len(lines))
        sizes[~lone] = np.diff(ends, prepend=0)
        others = [self._one(" " + text) for text in texts.filter(pa.array(lone)).to_pylist()]
        sizes[lone] = [len(found) for found in others]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(offsets[-1], np.int32)
        of_lone = np.repeat(lone, sizes)
        flat[~of_lone] = ids[~at_end]
        flat[of_lone] = np.fromiter((ix for found in others for ix in found), np.int32)
        return pa.LargeListArray.from_arrays(offsets, flat)

    def second(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text; the model adds the blank before it."""
        return pa.array(self._second.encode(texts.to_pylist(), num_threads=1), pa.large_list(pa.int32()))


_LOADED: dict[Vocabularies, Tokenizers] = {}


def load(files: Vocabularies) -> Tokenizers:
    """The tokenizers of ``files``, made once in a worker."""
    if files not in _LOADED:
        _LOADED.clear()
        _LOADED[files] = Tokenizers(files)
    return _LOADED[files]


def _flat(chunked) -> pa.Array:
    found = chunked.combine_chunks() if isinstance(chunked, pa.ChunkedArray) else chunked
    return found


@dataclass
class Side:
    """One tokenizer's tokens of a block: ids, the row each is of, the byte of its row where it ends."""

    ids: pa.Array
    rows: np.ndarray
    ends: np.ndarray
    totals: np.ndarray
    joined: memoryview
    bases: np.ndarray

    def only(self, good: np.ndarray) -> Side:
        """The tokens of the rows that are ``good``."""
        keep = good[self.rows]
        if keep.all():
            return self
        return Side(self.ids.filter(pa.array(keep)), self.rows[keep], self.ends[keep], self.totals, self.joined, self.bases)


def _side(units: pa.DictionaryArray, unit_rows: pa.Array, made: pa.LargeListArray, tokens: Tokenizers, which: int, rows: int) -> Side:
    """Tokens of every unit (a word, or a text that is not cut), laid end to end."""
    lists = made.take(units.indices)
    ids = pc.list_flatten(lists)
    at = unit_rows.take(pc.list_parent_indices(lists)).to_numpy(zero_copy_only=False)
    sizes = tokens.lengths[which].take(ids)
    sums = pc.cumulative_sum(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.searchsorted(at, np.arange(rows + 1))
    before = np.concatenate([[0], sums])[edges]
    bases = before[:-1]
    joined = tokens.bytes_of[which].take(ids).buffers()[2]
    return Side(ids, at, sums - bases[at], np.diff(before), memoryview(joined or b""), bases)


@dataclass
class Aligned:
    """A block's alignment; ``order`` is the block's row that each row here was."""

    order: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    links: pa.Array
    ids: tuple[pa.Array, pa.Array]


def _spelled_alike(texts: pa.Array, sides: Sequence[Side]) -> np.ndarray:
    """Which rows' tokens, joined, are a blank and the text on both sides."""
    wanted = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    lengths = pc.binary_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64)
    data = memoryview(wanted.buffers()[2] or b"")
    bases = np.concatenate([[0], np.cumsum(lengths)])
    good = np.ones(len(texts), bool)
    for side in sides:
        good &= side.totals == lengths
        if good.all() and side.joined[: bases[-1]] == data[: bases[-1]]:
            continue
        for ix in np.flatnonzero(good):
            good[ix] = side.joined[side.bases[ix] : side.bases[ix] + lengths[ix]] == data[bases[ix] : bases[ix + 1]]
    return good


def align_block(texts: pa.Array, tokens: Tokenizers, groups: bool = True) -> Aligned:
    """Groups and links of each text. Links are ids as ``a * size of B + b``, in the order of rows and bytes."""
    rows = len(texts)
    filled = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
    touchy = pc.and_(filled, pc.fill_null(pc.match_substring_regex(texts, TOUCHY), False))
    if not tokens.by_word:
        touchy = filled
    kind = np.select([touchy.to_numpy(zero_copy_only=False), filled.to_numpy(zero_copy_only=False)], [1, 0], 2)
    order = np.argsort(kind, kind="stable")
    cut, whole = int((kind == 0).sum()), int((kind == 1).sum())
    used = texts.take(pa.array(order[: cut + whole])).cast(pa.large_string())
    parts = pc.split_pattern(used.slice(0, cut), " ")
    units = pa.concat_arrays([pc.list_flatten(parts).cast(pa.large_string()), used.slice(cut)])
    unit_rows = pa.concat_arrays([pc.list_parent_indices(parts).cast(pa.int64()), pa.array(np.arange(cut, cut + whole))])
    coded = units.dictionary_encode()
    a = _side(coded, unit_rows, tokens.first(coded.dictionary), tokens, 0, cut + whole)
    b = _side(coded, unit_rows, tokens.second(coded.dictionary), tokens, 1, cut + whole)
    good = _spelled_alike(used, (a, b))
    a, b = a.only(good), b.only(good)

    # The last byte of a document ends a token on both sides, so nothing is filled over a border.
    span = int(max(a.totals.max(initial=0), b.totals.max(initial=0))) + 1
    left = pa.table({"key": a.rows * span + a.ends, "a": np.arange(len(a.rows))})
    right = pa.table({"key": b.rows * span + b.ends, "b": np.arange(len(b.rows))})
    met = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key")
    place_a, place_b, key = _flat(met["a"]), _flat(met["b"]), _flat(met["key"]).to_numpy(zero_copy_only=False)
    both = np.asarray(pc.and_(pc.is_valid(place_a), pc.is_valid(place_b)))
    row = key // span
    id_a = a.ids.take(pc.fill_null_backward(place_a)).cast(pa.int64())
    id_b = b.ids.take(pc.fill_null_backward(place_b)).cast(pa.int64())
    links = pc.add(pc.multiply(id_a, len(tokens.bytes_of[1])), id_b)
    count = lambda at: np.bincount(at, minlength=rows).astype(np.int64)
    n_groups = count(row[both])
    said = [""] * rows
    if groups and len(row):
        ends = pa.array(both)
        sides = []
        for place, side, digits in ((place_a, a, tokens.digits[0]), (place_b, b, tokens.digits[1])):
            offsets = np.concatenate([[0], place.filter(ends).to_numpy(zero_copy_only=False) + 1]).astype(np.int64)
            sides.append(pc.binary_join(pa.LargeListArray.from_arrays(offsets, digits.take(side.ids)), pa.scalar(",", pa.large_string())))
        pairs = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
        of_rows = np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int64)
        said = pc.binary_join(pa.LargeListArray.from_arrays(of_rows, pairs), pa.scalar(";", pa.large_string())).to_pylist()
    return Aligned(order, count(a.rows), count(b.rows), n_groups, count(row), said, links, (id_a, id_b))


def _partial(links: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each link, and link and count of each code; frequent links have small codes."""
    coded = links.dictionary_encode()
    counts = pa.table({"code": coded.indices}).group_by("code", use_threads=False).aggregate([([], "count_all")])
    counts = counts.sort_by([("count_all", "descending"), ("code", "ascending")])
    first = counts["code"].to_numpy()
    rank = np.empty(len(first), np.uint32)
    rank[first] = np.arange(len(first), dtype=np.uint32)
    return rank[coded.indices.to_numpy()], coded.dictionary.to_numpy()[first], counts["count_all"].to_numpy()


def _found_in_blocks(files, carry: int, digest: bool, limit: int):
    """Rows of documents, with their links in the codes of their block, and of each block's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        tokens = load(files.value)
        for number, block in cut_blocks(batches, "text", limit):
            found = align_block(_flat(block["text"]), tokens)
            codes, links, counts = _partial(found.links)
            at = np.concatenate([[0], np.cumsum(found.n_links)])
            packed = [
                pa.compress(codes[start:end].tobytes(), "zstd", asbytes=True) if end > start else None
                for start, end in zip(at[:-1], at[1:], strict=True)
            ]
            said = found.groups
            if digest:
                said = [hashlib.sha256(groups.encode()).hexdigest() if groups else "" for groups in said]
            rows = len(packed)
            ordered = block.select([f"c{ix}" for ix in range(carry)]).take(pa.array(found.order))
            made = {name: _flat(ordered[name]) for name in ordered.column_names}
            made |= {name: pa.array(getattr(found, name)) for name in ("n_a", "n_b", "n_groups", "n_links")}
            made |= {"groups": pa.array(said, pa.string()), "block": pa.array([number] * rows, pa.int64())}
            made |= {"links": pa.array(packed, pa.binary())}
            made |= {"link": pa.nulls(rows, pa.int64()), "code": pa.nulls(rows, pa.int32()), "n": pa.nulls(rows, pa.int64())}
            yield pa.RecordBatch.from_pydict(made)
            here = len(links)
            entries = {name: pa.nulls(here, column.type) for name, column in made.items()}
            entries["block"] = pa.array([number] * here, pa.int64())
            entries |= {"link": pa.array(links), "code": pa.array(np.arange(here, dtype=np.int32)), "n": pa.array(counts)}
            yield pa.RecordBatch.from_pydict(entries)

    return run


def _finish(carry: int):
    """Sums over the links of a block's documents, from what is known of each of the block's codes."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        codes = known["code"].to_numpy()
        counts, best = np.zeros((2, int(codes.max(initial=-1)) + 1), np.int64)
        counts[codes], best[codes] = known["n"].to_numpy(), known["best"].to_numpy()
        sums = np.zeros((2, rows.num_rows), np.int64)
        for ix, (packed, n) in enumerate(zip(rows["links"].to_pylist(), rows["n_links"].to_pylist(), strict=True)):
            if n:
                at = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint32)
                sums[:, ix] = best[at].sum(), counts[at].sum()
        kept = [f"c{ix}" for ix in range(carry)] + ["n_a", "n_b", "n_groups", "n_links"]
        made = {name: rows[name] for name in kept} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table(made | {"groups": rows["groups"]})

    return run


def align(
    docs: DataFrame,
    files: Vocabularies,
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    digest: bool = False,
    limit: int = BLOCK,
) -> DataFrame:
    """``carry``, token counts, and how both tokenizers' tokens group and link in each text.

    ``n_a`` and ``n_b`` tokens, ``n_groups`` groups between byte offsets where tokens of both end,
    ``n_links`` pairs of tokens whose bytes overlap; ``n_best`` of them have the highest count among
    their second token's links in the whole corpus (ties included), ``count_sum`` adds up all their
    counts. ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``, with ``digest`` as its SHA-256.

    Null and empty texts, and those that the tokens of either side do not spell, have zeros and an
    empty ``groups`` and count nowhere. Every row is kept, repeats and null ids included; an empty table
    gives an empty one. Texts are never cut short: a long one is a block of its own. Names that
    clash with ``carry`` get underscores in front.

    What is shuffled: each block's distinct links and, compressed to little more than a byte a link, the
    links of its documents. A link that every text has comes once from each block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)
    kept = [docs.schema[name] for name in carry]
    own = [T.StructField(f"c{ix}", field.dataType) for ix, field in enumerate(kept)]
    longs = lambda *names: [T.StructField(name, T.LongType()) for name in names]
    said = T.StructField("groups", T.StringType())
    fields = [*own, *longs("n_a", "n_b", "n_groups", "n_links"), said, *longs("block")]
    fields += [T.StructField("links", T.BinaryType()), *longs("link"), T.StructField("code", T.IntegerType()), *longs("n")]
    source = docs.select(*(F.col(f"`{name}`").alias(f"c{ix}") for ix, name in enumerate(carry)), F.col(f"`{text}`").alias("text"))
    found = cut_lineage(source.mapInArrow(_found_in_blocks(shared, len(kept), digest, limit), T.StructType(fields)))

    entries = found.where("link is not null").select("block", "code", "link", "n")
    sizes = entries.groupBy("link").agg(F.sum("n").alias("n"))
    second = F.col("link") % F.lit(second_size(files))
    tops = sizes.groupBy(second.alias("second")).agg(F.max("n").alias("top"))
    known = sizes.withColumn("second", second).join(tops, "second").select("link", "n", (F.col("n") == F.col("top")).alias("best"))
    learned = entries.select(F.col("block").alias("of_block"), "code", "link").join(known, "link").drop("link")
    rows = found.where("link is null").drop("link", "code", "n")
    schema = T.StructType([*own, *longs("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), said])
    done = rows.groupBy("block").cogroup(learned.groupBy("of_block")).applyInArrow(_finish(len(kept)), schema)
    made = [*carry]
    for name in done.columns[len(kept) :]:
        made.append(free_name(made, name))
    return done.toDF(*made)


def second_size(files: Vocabularies) -> int:
    """Number of ids of the second tokenizer."""
    return len(load(files).bytes_of[1])
