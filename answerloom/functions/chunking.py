"""Sentence-aware chunks with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The JVM pattern of functions.text, in Python's spelling.
_SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?:\s+|\Z)|\Z)", re.S | re.A)
_TOKEN = re.compile(r"\S+", re.A)
_BLANKS = " \t\n\r\f"
#: Texts that are split at a time.
TEXTS = 256


def _pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """Sentences as (tokens, text); an over-long one is cut at ``size`` tokens."""
    for match in _SENTENCE.finditer(text):
        sentence = match.group().rstrip(_BLANKS)
        tokens = _TOKEN.findall(sentence)
        if len(tokens) <= size:
            yield len(tokens), sentence
        else:
            for start in range(0, len(tokens), size):
                part = tokens[start : start + size]
                yield len(part), " ".join(part)


def split_text(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` tokens.

    A new chunk repeats the longest run of whole sentences at the end of the
    previous one that has at most ``overlap`` tokens, unless that would make
    the next sentence overflow.
    """
    chunks: list[str] = []
    held: list[tuple[int, str]] = []
    total = 0
    for count, piece in _pieces(text or "", size):
        if held and total + count > size:
            chunks.append(" ".join(p for _, p in held))
            repeated: list[tuple[int, str]] = []
            total = 0
            for earlier in reversed(held):
                if total + earlier[0] > overlap:
                    break
                repeated.append(earlier)
                total += earlier[0]
            held = repeated[::-1]
            if total + count > size:
                held, total = [], 0
        held.append((count, piece))
        total += count
    if held:
        chunks.append(" ".join(p for _, p in held))
    return chunks


def chunk_array(text: Column | str, size: int = 500, overlap: int = 10) -> Column:
    """``array<string>`` of chunks, computed in Arrow batches.

    Declared nondeterministic so that the optimizer does not split texts twice.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")

    @F.arrow_udf("array<string>")
    def chunks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # A part at a time: a batch of long texts is never held as Python strings at once.
            parts = [
                pa.array([split_text(text, size, overlap) for text in batch.slice(start, TEXTS).to_pylist()], pa.list_(pa.string()))
                for start in range(0, len(batch), TEXTS)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return chunks_of.asNondeterministic()(text)


def chunk_documents(
    df: DataFrame, text: str, keep: list[str], size: int = 500, overlap: int = 10
) -> DataFrame:
    """One row per chunk: the ``keep`` columns, ``chunk_ix`` and ``content``.

    Documents without a chunk (NULL or blank text) leave no row. Splitting is
    local to a row, so there is no shuffle.
    """
    chunks = chunk_array(text, size, overlap)
    return df.select(*keep, F.posexplode(chunks).alias("chunk_ix", "content"))
