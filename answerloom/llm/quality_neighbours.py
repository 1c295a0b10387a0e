"""Quality of texts by votes of their nearest labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm._common import free_name
from answerloom.session import cut_lineage

#: Labelled documents of each class that the space and the votes are made of, at most about so many.
PER_CLASS = 1_500
LATENT = 32
NEIGHBOURS = 15
#: Buckets that words are hashed to.
WORDS = 1_024
#: Kinds of bytes whose runs of three are terms.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n\v\f", b".", b",;:", b"!?", b"'\"()-", b"|/\\<>=_")
N_KINDS = len(KINDS) + 2
TRIPLES = N_KINDS**3
#: After the words and triples: a word that is the one before, or one of the three before that.
SAME, NEAR = WORDS + TRIPLES, WORDS + TRIPLES + 1
TERMS = WORDS + TRIPLES + 2
#: Texts are counted in pieces of so many bytes, cut at white space, and so many rows at a time.
PIECE, ROWS = 1 << 20, 512
FACTOR = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, lower case and whiteness of each byte; bytes of letters beyond ASCII are a kind, other signs one."""
    kinds = np.full(256, len(KINDS), np.int32)
    for ix, members in enumerate(KINDS):
        kinds[list(members)] = ix
    kinds[128:] = len(KINDS) + 1
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    white = np.zeros(256, bool)
    white[list(b" \t\r\n\v\f")] = True
    return kinds, low, white


_KINDS, _LOW, _WHITE = _tables()


def _powers(factor: int) -> np.ndarray:
    """Powers of ``factor`` modulo 2^64, one for each byte of a piece."""
    row = np.full(PIECE, factor, np.uint64)
    row[0] = 1
    return np.cumprod(row, dtype=np.uint64)


_POWERS, _INVERSE = _powers(FACTOR), _powers(pow(FACTOR, -1, 1 << 64))


def _count(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How often each term is in each of the pieces that ``edges`` cut ``data`` into."""
    rows = len(edges) - 1
    found = np.zeros((rows, TERMS), np.float32)
    if not len(data):
        return found
    of = np.repeat(np.arange(rows), np.diff(edges))
    kinds = _KINDS[data]
    if len(data) > 2:
        whole = of[2:] == of[:-2]
        triple = (kinds[:-2] * N_KINDS + kinds[1:-1]) * N_KINDS + kinds[2:]
        counts = np.bincount(of[2:][whole] * TRIPLES + triple[whole], minlength=rows * TRIPLES)
        found[:, WORDS : WORDS + TRIPLES] = counts.reshape(rows, TRIPLES)
    inside = ~_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (of[1:] != of[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (of[1:] != of[:-1])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return found
    # A word's hash is its stretch of the running sum, moved back to the sum's beginning.
    sums = np.cumsum((_LOW[data] + np.uint64(1)) * _POWERS[: len(data)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = (sums[ends] - before) * _INVERSE[starts]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
    at = of[starts]
    found[:, :WORDS] = np.bincount(at * WORDS + buckets, minlength=rows * WORDS).reshape(rows, WORDS)
    for lag in (1, 2, 3, 4):
        again = (hashes[lag:] == hashes[:-lag]) & (at[lag:] == at[:-lag])
        found[:, SAME if lag == 1 else NEAR] += np.bincount(at[lag:][again], minlength=rows)
    return found


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of ``PIECE`` bytes at most, cut at white space where there is any."""
    while len(text) > PIECE:
        at = max(text.rfind(sign, 0, PIECE) for sign in (b" ", b"\n")) + 1 or PIECE
        yield text[:at]
        text = text[at:]
    yield text


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Terms of each text: hashed words, triples of kinds of bytes, repeated words. Null counts as empty."""
    found = np.zeros((len(texts), TERMS), np.float32)
    held: list[bytes] = []
    rows: list[int] = []

    def flush() -> None:
        edges = np.concatenate([[0], np.cumsum([len(piece) for piece in held])]).astype(np.int64)
        np.add.at(found, rows, _count(np.frombuffer(b"".join(held), np.uint8), edges))
        held.clear()
        rows.clear()

    size = 0
    for ix, text in enumerate(texts):
        for piece in _pieces((text or "").encode("utf-8", "surrogatepass")):
            if held and size + len(piece) > PIECE:
                flush()
                size = 0
            held.append(piece)
            rows.append(ix)
            size += len(piece)
    if held:
        flush()
    return found


def _weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Damped counts times rarity, each of the two kinds of terms at unit length."""
    found = np.log1p(counts) * rarity
    for part in (slice(0, WORDS), slice(WORDS, TERMS)):
        size = np.linalg.norm(found[:, part], axis=1, keepdims=True)
        found[:, part] /= np.maximum(size, 1e-12)
    return found


@dataclass(frozen=True)
class Model:
    """Rarity of terms, the latent space, and the labelled vectors in it, at unit length."""

    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Vectors of unit length, or of zeros where there is no term."""
        found = _weighed(counts, self.rarity) @ self.basis
        size = np.linalg.norm(found, axis=1, keepdims=True)
        return np.where(size > 1e-9, found / np.maximum(size, 1e-9), 0).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The labels of the nearest vectors, weighed by their cosines.

        Cosines are compared on five places and all that tie with the last neighbour vote, so the
        order of vectors decides nothing. Without a vector nearby the score is the share of label 1.
        """
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = np.round(self.place(counts) @ self.vectors.T, 5)
        k = min(self.neighbours, len(self.labels))
        least = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        votes = np.where((near >= least) & (near > 0), near, 0).astype(np.float64)
        total = votes.sum(axis=1)
        return np.where(total > 0, votes @ self.labels / np.maximum(total, 1e-12), self.prior)


def _blocks(texts: list[str | None]) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), ROWS):
        yield term_counts(texts[at : at + ROWS])


def _documents_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's texts each term is; the last number counts the texts."""
    found = np.zeros(TERMS + 1, np.int64)
    for batch in batches:
        for counts in _blocks(batch.column(0).to_pylist()):
            found[:-1] += (counts > 0).sum(axis=0)
            found[-1] += len(counts)
    seen = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(found[seen])], ["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            counts = term_counts(part.column(0).to_pylist())
            terms = [np.flatnonzero(row) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array([row[seen] for row, seen in zip(counts, terms, strict=True)], pa.list_(pa.float32())),
                    part.column(1),
                ],
                ["terms", "counts", "label"],
            )


def latent_basis(rows: np.ndarray, width: int, seed: int = 7, steps: int = 4) -> np.ndarray:
    """The first right singular vectors of ``rows``, by a seeded range finder with power steps."""
    width = min(width, *rows.shape)
    if not width:
        return np.zeros((rows.shape[1], 1), np.float32)
    found = rows.T @ (rows @ np.random.default_rng(seed).standard_normal((rows.shape[1], min(width + 10, *rows.shape))).astype(rows.dtype))
    for _ in range(steps):
        found = rows.T @ (rows @ np.linalg.qr(found)[0])
    space = np.linalg.qr(found)[0]
    turned = np.linalg.svd(rows @ space, full_matrices=False)[2]
    return np.ascontiguousarray((space @ turned.T)[:, :width], np.float32)


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = PER_CLASS,
    latent: int = LATENT,
    neighbours: int = NEIGHBOURS,
) -> Model:
    """Rarity of terms over all ``docs``; space and voters from about ``per_class`` labelled ones a class.

    ``labelled`` has the id and ``label`` (more than 0 counts as 1); rows without a label are left
    out, and of several labels of an id the highest counts. Voters are drawn by a hash of the id. A
    class of fewer rows gives all of them. The driver holds the drawn rows' terms, ``2 * per_class``
    rows of at most ``TERMS`` numbers, and the tasks get as many vectors of ``latent`` numbers. Without
    labelled rows every score is 0.5.
    """
    made = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_documents_of_terms, "term int, n bigint")
    seen = np.zeros(TERMS + 1)
    for row in made.groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[row["term"]] = row["n"]
    rarity = (1 + np.log((1 + seen[-1]) / (1 + seen[:-1]))).astype(np.float32)

    said = labelled.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("label"))
    said = said.where("label is not null and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in said.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, min(1.0, per_class / n)).otherwise(share)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(f"`{text}`").alias("text"))
    # Repeated rows of an id would vote more than once.
    sample = rows.join(F.broadcast(said.where(drawn < share)), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.first("label").alias("label")
    )
    found = cut_lineage(sample.select("text", "label").mapInArrow(_sparse, "terms array<int>, counts array<float>, label int")).toArrow()
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    terms, numbers = found.column("terms").combine_chunks(), found.column("counts").combine_chunks()
    at = np.repeat(np.arange(found.num_rows), np.diff(terms.offsets.to_numpy())) if found.num_rows else np.zeros(0, int)
    counts[at, terms.flatten().to_numpy()] = numbers.flatten().to_numpy()
    labels = found.column("label").to_numpy().astype(np.float64)
    basis = latent_basis(_weighed(counts, rarity), latent)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    model = Model(rarity, basis, np.zeros((0, basis.shape[1]), np.float32), labels[:0], prior, neighbours)
    return Model(rarity, basis, model.place(counts), labels, prior, neighbours)


def score_texts(docs: DataFrame, model: Model, carry: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``carry`` and the score of each text, from 0 to 1, higher for label 1.

    Texts without a term, null ones included, get the share of label 1 among the labelled rows. Rows
    are neither moved nor dropped, repeats included. Each block of documents is multiplied with all
    voters. The name of the score gets underscores in front if it clashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(carry, name)
    schema = T.StructType([docs.schema[kept] for kept in carry] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = shared.value.score(term_counts(part.column(len(carry)).to_pylist()))
                kept = [part.column(ix) for ix in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*carry, name])

    taken = [F.col(f"`{kept}`") for kept in carry]
    return docs.select(*taken, F.col(f"`{text}`").alias(free_name(carry, "text_"))).mapInArrow(run, schema)
