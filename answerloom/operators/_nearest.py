"""Per-task arithmetic of the similarity search, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

# Score tiles hold at most this many numbers, whatever the batch sizes are.
TILE = 4_000_000
# A query's first rows give it a score to beat, the others are held against it in tiles that fit a cache.
FIRST = 2_048
CACHED = 1_000_000
# So often a query may come in a tile before what is left of its hits is sorted.
WAVES = 8


def matrix_of(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """A list column as rows of doubles, or of another kind; all lists must be equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) % rows or pa.compute.max(pa.compute.list_value_length(column)).as_py() != (
        len(values) // rows
    ):
        raise ValueError("vectors must all have the same length")
    return values.reshape(rows, -1).astype(kind)


def keys_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


class Asked:
    """Queries as tasks need them, made once: their vectors, also in single precision and at length one."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.short = vectors.astype(np.float32, copy=False)
        own = vectors.astype(np.float64)
        self.norms = np.linalg.norm(own, axis=1)
        self.unit = np.divide(own, self.norms[:, None], out=own, where=self.norms[:, None] > 0)


class TopK:
    """The best ``k`` (score, key) per query seen so far.

    Scores are compared rounded to six places and ties go to the smaller key,
    so the outcome does not depend on how rows are split over tasks. Products are
    taken in single precision first; what could reach the score to beat, with the
    greatest error of that added, is taken again in double. ``floors`` may give
    scores that ``k`` rows are known to reach; what lies below is not kept.
    """

    def __init__(self, k: int, floors: np.ndarray | None = None) -> None:
        self.k = k
        self.floor = np.zeros(0) if floors is None else np.where(np.isnan(floors), -np.inf, floors)
        self.key: np.ndarray | None = None
        self._room(len(self.floor))

    def _room(self, queries: int) -> None:
        """Rows for so many queries: their best scores and keys, in order, and how many they have."""
        self.score = np.zeros((queries, self.k))
        self.held = np.zeros(queries, dtype=np.int64)

    def _hold(self, queries: np.ndarray, keys: np.ndarray) -> None:
        """Make room for these queries, and for keys of this type."""
        more = int(queries.max()) + 1 - len(self.floor)
        if more > 0:
            more = max(more, len(self.floor))
            self.floor = np.concatenate([self.floor, np.full(more, -np.inf)])
            self.score = np.concatenate([self.score, np.zeros((more, self.k))])
            self.held = np.concatenate([self.held, np.zeros(more, dtype=np.int64)])
        if self.key is None:
            self.key = np.zeros((len(self.floor), self.k), dtype=keys.dtype)
        elif more > 0:
            self.key = np.concatenate([self.key, np.zeros((more, self.k), dtype=self.key.dtype)])
        if self.key.dtype != keys.dtype:
            self.key = self.key.astype(np.result_type(self.key.dtype, keys.dtype))

    def offer(self, queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, keys: np.ndarray):
        """Score ``vectors`` (row numbers ``queries``) against ``rows``."""
        if not len(keys) or not len(queries):
            return
        self._hold(queries, keys)
        fresh = np.isneginf(self.floor[queries])
        if fresh.any():
            few = slice(0, max(FIRST, self.k))
            self._offer_all(queries[fresh], vectors[fresh], rows[few], keys[few])
            self._offer_better(queries[fresh], vectors[fresh], rows[few.stop :], keys[few.stop :])
            queries, vectors = queries[~fresh], vectors[~fresh]
        self._offer_better(queries, vectors, rows, keys)

    def _offer_all(self, queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        step = max(1, TILE // len(keys))
        for start in range(0, len(queries), step):
            numbers = queries[start : start + step]
            self.offer_scores(numbers, vectors[start : start + step] @ rows.T, keys)

    def _offer_better(self, queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        """:meth:`offer` where nearly all products lie below the scores to beat."""
        if not len(keys) or not len(queries):
            return
        sizes = np.linalg.norm(vectors, axis=1) * np.linalg.norm(rows, axis=1).max()
        if not sizes.max() < 1e30:
            return self._offer_all(queries, vectors, rows, keys)
        error = sizes * (vectors.shape[1] + 8) * 2.0**-23 + 1e-30
        short, width = vectors.astype(np.float32), min(len(keys), FIRST)
        for left in range(0, len(keys), width):
            here, names = rows[left : left + width], keys[left : left + width]
            beside = here.astype(np.float32).T
            step = max(1, CACHED // len(names))
            for start in range(0, len(queries), step):
                part = slice(start, start + step)
                numbers = queries[part]
                cut = np.nextafter((self.floor[numbers] - 1e-6 - error[part]).astype(np.float32), np.float32(-np.inf))
                scores = short[part] @ beside
                hit = np.flatnonzero(scores.max(axis=1) >= cut)
                if len(hit):
                    at, row = np.nonzero(scores[hit] >= cut[hit, None])
                    at = hit[at]
                    exact = np.einsum("ij,ij->i", vectors[part][at], here[row])
                    self._merge(numbers[at], names[row], exact)

    def offer_tile(self, numbers: np.ndarray, asked: Asked, rows: np.ndarray, keys: np.ndarray) -> None:
        """:meth:`offer` the queries ``numbers`` of ``asked`` a few rows; only what is hit is taken in double."""
        if not len(keys) or not len(numbers):
            return
        self._hold(numbers, keys)
        fresh = np.isneginf(self.floor[numbers])
        size = np.linalg.norm(rows.astype(np.float64), axis=1).max()
        if fresh.any() or not asked.norms[numbers].max() * size < 1e30:
            some = numbers[fresh] if asked.norms[numbers].max() * size < 1e30 else numbers
            step = max(1, CACHED // len(keys))
            for start in range(0, len(some), step):
                part = some[start : start + step]
                self.offer_scores(part, asked.vectors[part].astype(np.float64) @ rows.T.astype(np.float64), keys)
            if len(some) == len(numbers):
                return
            numbers = numbers[~fresh]
        error = asked.norms[numbers] * size * (rows.shape[1] + 8) * 2.0**-23 + 1e-30
        cuts = np.nextafter((self.floor[numbers] - 1e-6 - error).astype(np.float32), np.float32(-np.inf))
        beside, step = rows.astype(np.float32, copy=False).T, max(1, CACHED // 2 // len(keys))
        scores = np.empty((min(step, len(numbers)), len(keys)), np.float32)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(numbers), step):
            part, cut = numbers[start : start + step], cuts[start : start + step]
            here = np.matmul(asked.short[part], beside, out=scores[: len(part)])
            hit = np.flatnonzero(here.max(axis=1) >= cut)
            if len(hit):
                at, row = np.nonzero(here[hit] >= cut[hit, None])
                hits.append((part[hit[at]], row))
        if hits:
            at, row = (np.concatenate(parts) for parts in zip(*hits, strict=True))
            exact = np.concatenate(
                [
                    np.einsum("ij,ij->i", asked.vectors[at[few : few + FIRST]], rows[row[few : few + FIRST]], dtype=np.float64)
                    for few in range(0, len(at), FIRST)
                ]
            )
            self._insert(at, keys[row], exact)

    def _insert(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """:meth:`_merge` where nearly every query comes once or twice and they come in order: no sorting."""
        for _ in range(WAVES):
            good = ~(np.round(score, 6) < self.floor[query])
            query, key, score = query[good], key[good], score[good]
            if not len(query):
                return
            first = np.r_[True, query[1:] != query[:-1]]
            self._insert_one(query[first], key[first], score[first])
            query, key, score = query[~first], key[~first], score[~first]
        if len(query):
            self._merge(query, key, score)

    def _insert_one(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """A new row for each of these queries, which differ."""
        held, places = self.held[query], np.arange(self.k)
        scores, keys, coarse = self.score[query], self.key[query], np.round(score, 6)[:, None]
        known, filled = np.round(scores, 6), places < held[:, None]
        before, (row, at) = filled & (known > coarse), np.nonzero(filled & (known == coarse))
        before[row, at] = keys[row, at] < key[row]
        place = before.sum(axis=1)[:, None]
        back = places - (places > place)
        moved, names = np.take_along_axis(scores, back, 1), np.take_along_axis(keys, back, 1)
        self.score[query] = np.where(places == place, score[:, None], moved)
        self.key[query] = np.where(places == place, key[:, None], names)
        self.held[query] = held = np.minimum(held + 1, self.k)
        full = query[held == self.k]
        self.floor[full] = np.maximum(self.floor[full], np.round(self.score[full, -1], 6))

    def take(self, numbers: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """What others found, each of it once."""
        self._hold(numbers, keys)
        self._merge(numbers, keys, scores)

    def offer_scores(self, numbers: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of the queries ``numbers`` (rows) and of ``keys`` (columns)."""
        if not scores.size:
            return
        self._hold(numbers, keys)
        floor = self.floor[numbers]
        kept = ~(scores < (floor - 1e-6)[:, None])
        fresh = np.flatnonzero(np.isneginf(floor))
        if len(fresh) and scores.shape[1] > self.k:
            coarse = np.round(scores[fresh], 6)
            cut = -np.partition(-coarse, self.k - 1, axis=1)[:, self.k - 1]
            kept[fresh] = coarse >= cut[:, None]
        at_query, at_row = np.nonzero(kept)
        self._merge(numbers[at_query], keys[at_row], scores[at_query, at_row])

    def _merge(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        coarse = np.round(score, 6)
        good = ~(coarse < self.floor[query])
        # Of equal scores only smaller keys than the last one's can still come in.
        full = good & (self.held[query] == self.k)
        good[full] = (coarse[full] > np.round(self.score[query[full], -1], 6)) | (key[full] < self.key[query[full], -1])
        if not good.any():
            return
        query, key, score = query[good], key[good], score[good]
        touched = np.unique(query)
        own, place = np.nonzero(np.arange(self.k) < self.held[touched][:, None])
        query = np.concatenate([touched[own], query])
        score = np.concatenate([self.score[touched[own], place], score])
        key = np.concatenate([self.key[touched[own], place], key])
        order = np.lexsort((key, -np.round(score, 6), query))
        query, key, score = query[order], key[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        count = np.diff(np.r_[first, len(query)])
        place = np.arange(len(query)) - np.repeat(first, count)
        best = place < self.k
        self.score[query[best], place[best]] = score[best]
        self.key[query[best], place[best]] = key[best]
        self.held[touched] = np.minimum(count, self.k)
        full = touched[self.held[touched] == self.k]
        self.floor[full] = np.maximum(self.floor[full], np.round(self.score[full, -1], 6))

    def batches(self, query_ids: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held.any():
            query, place = np.nonzero(np.arange(self.k) < self.held[:, None])
            columns = [pa.array(query_ids[query]), pa.array(self.key[query, place]), pa.array(self.score[query, place])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
