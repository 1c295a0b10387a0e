"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.llm._common import free_name, map_texts

UNDETERMINED = "und"
#: Hashed n-grams are counted in so many buckets.
BUCKETS = 1 << 14
#: The classifiers learn from about so many labelled documents of each language, whole texts.
PER_LANGUAGE = 2000
#: Up to so many languages get every distinct split as a bit; more get random codewords.
EXHAUSTIVE = 7
#: A decision is ambiguous if the second codeword's mean loss is this close to the first's.
MARGIN = 0.05
SHARPNESS = 4.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(text: str | None) -> np.ndarray:
    """Buckets of the two- and three-letter grams of a text, lower-cased, words framed by blanks."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    framed = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint64)
    blank = framed == 32
    framed = framed[~(blank & np.concatenate(([False], blank[:-1])))]
    a, b, c = framed[:-2], framed[1:-1], framed[2:]
    pairs = (framed[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (framed[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    triples = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    mixed = np.concatenate((pairs, triples + np.uint64(1)))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(50)).astype(np.int64)


def code_matrix(languages: int, seed: int = 42) -> np.ndarray:
    """Codewords, a row of -1 and 1 for each language.

    Few languages get the exhaustive code, all ways to split them in two. More get the widest
    apart of some random codes with a length in proportion to the logarithm of their number.
    """
    if languages == 1:
        return np.ones((1, 1), np.int8)
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (languages - 1))
        bits = (splits[None, :] >> np.arange(languages)[:, None]) & 1
        return (1 - 2 * bits).astype(np.int8)
    length, draw, best = 10 * math.ceil(math.log2(languages)), np.random.default_rng(seed), None
    for _ in range(50):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, length))
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        nearest = (same - 2 * length * np.eye(languages, dtype=np.int32)).max()
        if best is None or nearest < best[0]:
            best = (nearest, code)
    return best[1]


@dataclass(frozen=True)
class Model:
    """Languages in code point order, their codewords, a weight for each bucket and bit, a weight for each bit."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def _bit_margins(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The classifiers' answers for rows of bucket counts: log odds over the root of the number of n-grams."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return counts @ weights / np.sqrt(total)


def _decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by the bits' weighted logistic loss, its share of the evidence, ambiguity."""
    signed = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0.0, -signed) * model.trust).sum(axis=2) / model.trust.sum()
    order = np.sort(loss, axis=1)
    least = order[:, 0]
    share = np.exp(-SHARPNESS * (loss - least[:, None]))
    score = 1.0 / share.sum(axis=1)
    second = order[:, 1] if loss.shape[1] > 1 else least + 1.0
    return loss.argmin(axis=1), score, second - least < MARGIN


def _count_grams(text: str, lang: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for one, language in zip(texts, langs, strict=True):
                if language not in found:
                    found[language] = np.zeros(buckets, np.int64)
                found[language] += np.bincount(_grams(one), minlength=buckets)
        for language, counts in found.items():
            used = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
                ["lang", "bucket", "n"],
            )

    return run


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model | None:
    """Fit the binary classifiers; None if no row has a language.

    About ``per_language`` rows of each language, picked by a hash of the id, are counted whole.
    What reaches the driver is a count for each language and bucket, so its size is bounded by
    the number of languages. A bit's classifier is the log odds of an n-gram between the
    languages on its two sides, each language counting alike; its weight is how well it tells
    the learned languages apart.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    drawn = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    shares = rows.sparkSession.createDataFrame(
        [(name, min(1.0, per_language / n)) for name, n in sizes.items()], "lang string, share double"
    )
    sample = rows.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select("text", "lang")
    counted = (
        sample.mapInArrow(_count_grams("text", "lang", BUCKETS), "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = tuple(sorted(sizes, key=lambda name: name.encode()))
    counts = np.zeros((len(languages), BUCKETS))
    place = {name: ix for ix, name in enumerate(languages)}
    at = np.array([place[name] for name in counted.column("lang").to_pylist()], np.int64)
    counts[at, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    shared = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = code_matrix(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        up = code[:, bit] > 0
        if up.all() or not up.any():
            continue
        weights[:, bit] = np.log(shared[up].mean(axis=0)) - np.log(shared[~up].mean(axis=0))
    own = (shared @ weights) * code
    trust = np.maximum(own.min(axis=0), 0.05)
    return Model(languages, code, weights, trust)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and ambiguity of each text."""
    langs, scores, doubts = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if model is None:
        return langs, scores, doubts
    for at in range(0, len(texts), 256):
        grams = [_grams(one) for one in texts[at : at + 256]]
        known = [ix for ix, found in enumerate(grams) if len(found)]
        if not known:
            continue
        counts = np.stack([np.bincount(grams[ix], minlength=BUCKETS) for ix in known]).astype(np.float64)
        best, score, doubt = _decode(_bit_margins(counts, model.weights), model)
        for ix, b, s, d in zip(known, best, score, doubt, strict=True):
            langs[at + ix], scores[at + ix], doubts[at + ix] = model.languages[b], float(s), bool(d)
    return langs, scores, doubts


def identify(
    docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None
) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` (or its ``carry`` columns) with language, score and ambiguity, and these three columns.

    A text that is null or without letters is ``und`` with score 0 and ambiguous, and so is every
    text if the model learned no language. Equal losses go to the language first in code point
    order. Rows are kept as they are, repeats included; names that clash get underscores in front.
    """
    kept = list(docs.columns) if carry is None else carry
    names = [free_name(kept, name) for name in ("lang_pred", "score", "ambiguous")]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = map_texts(
        docs,
        text,
        kept,
        [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)],
        lambda texts: predict(texts, shared.value),
    )
    return (made, *(F.col(name) for name in names))
