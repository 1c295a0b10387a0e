"""Text to unit vectors, with a model of the caller's choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column

# Encoders take texts and return one row of numbers per text. A model is a
# function without arguments that loads its encoder, called once per task.
Encoder = Callable[[Sequence[str]], np.ndarray]
EmbeddingModel = Callable[[], Encoder]

_REMEMBERED_TOKENS = 200_000
#: Texts that a model gets at a time; a batch of long ones is never held as Python strings at once.
TEXTS = 256


def hashed_words(dim: int = 64) -> EmbeddingModel:
    """Offline default: counts of words hashed into ``dim`` buckets, unit length.

    A word's bucket is the number in the first eight hex digits of its MD5,
    modulo ``dim``, which any SQL engine can reproduce.
    """

    class Buckets(dict):
        """Buckets of words; those that are not known yet are looked up by the dictionary itself."""

        def __missing__(self, word: bytes) -> int:
            if len(self) >= _REMEMBERED_TOKENS:
                self.clear()
            self[word] = found = int(md5(word).hexdigest()[:8], 16) % dim
            return found

    def load() -> Encoder:
        bucket = Buckets().__getitem__

        def encode(texts: Sequence[str]) -> np.ndarray:
            counts = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                # Bytes are split at ASCII blanks only.
                words = text.encode().split()
                if words:
                    counts[row] = np.bincount(np.fromiter(map(bucket, words), np.intp, len(words)), minlength=dim)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return np.divide(counts, norms, out=counts, where=norms > 0)

        return encode

    return load


def embed(text: Column | str, model: EmbeddingModel | None = None, dim: int = 64) -> Column:
    """``array<float>`` embedding of a text column, NULL for NULL text.

    Row-local: no shuffle, one model load per task, Arrow batches in between.
    Declared nondeterministic, which keeps the optimizer from copying the call
    into filters and so from running the model twice; filter before embedding.
    """
    load = model or hashed_words(dim)

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for batch in batches:
            parts = [np.zeros((0, 0), np.float32)]
            known = batch.is_valid().to_numpy(zero_copy_only=False)
            for start in range(0, len(batch), TEXTS):
                texts = batch.slice(start, TEXTS).drop_null().to_pylist()
                if texts:
                    parts.append(np.asarray(encode(texts), dtype=np.float32))
            width = parts[-1].shape[1]
            ends = np.cumsum(np.r_[0, np.where(known, width, 0)]).astype(np.int32)
            values = pa.array(np.concatenate([part.ravel() for part in parts]), pa.float32())
            yield pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~known))

    return vectors.asNondeterministic()(F.lower(as_column(text)))
