"""Approximate search over product-quantised codes, with exact scores for what survives.

A vector is cut into parts, and each part is replaced by the number of the nearest of up to 256 typical
ones, so a vector of 64 numbers is kept in 16 bytes. A query's product with a coded vector is a sum of
entries of a small table, one entry a part. Codes are scanned instead of vectors; vectors are read
only of the best rows of each query, which are ranked again by their true product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.operators._nearest import TILE, TopK, keys_of, matrix_of
from answerloom.operators.search import MAX_SENT_BYTES, MAX_SENT_QUERIES, rank_candidates
from answerloom.session import cut_and_measure, cut_lineage

#: Vectors that the typical parts are learned from, at most about so many.
SAMPLE = 16_384
CODES = 256
#: Numbers in a part.
PART = 4


@dataclass(frozen=True)
class Codebook:
    """``parts[j, c]`` is the typical part that code ``c`` stands for in place ``j``."""

    parts: np.ndarray

    @property
    def width(self) -> int:
        return self.parts.shape[0] * self.parts.shape[2]

    def cut(self, rows: np.ndarray) -> np.ndarray:
        """Rows as (row, place, number); the last part is filled up with zeros."""
        places, _, part = self.parts.shape
        filled = np.zeros((len(rows), places * part), np.float64)
        filled[:, : rows.shape[1]] = rows
        return filled.reshape(len(rows), places, part)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """The nearest typical part of each place; ties go to the smaller code."""
        cut = self.cut(rows)
        found = np.empty(cut.shape[:2], np.uint8)
        for place, typical in enumerate(self.parts):
            gaps = (typical * typical).sum(1)[None, :] - 2 * cut[:, place] @ typical.T
            found[:, place] = np.argmin(gaps, axis=1)
        return found

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of the queries' parts with all typical ones: (query, place, code)."""
        return np.einsum("qjp,jcp->qjc", self.cut(queries), self.parts)


def scores_of(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries: queries by coded rows."""
    found = np.zeros((len(tables), len(codes)))
    for place in range(tables.shape[1]):
        found += tables[:, place][:, codes[:, place]]
    return found


def train_codebook(corpus: DataFrame, key: str = "id", vector: str = "embedding", sample: int = SAMPLE, part: int = PART, steps: int = 12) -> Codebook:
    """Typical parts from about ``sample`` vectors, drawn by a hash of their keys.

    k-means for each place, beginning with rows spread over the sample. The driver holds the sample
    only. Without vectors there is one place of a single code.
    """
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    drawn = F.pmod(F.xxhash64("k", F.lit("codebook")), F.lit(1 << 30)) / float(1 << 30)
    table = rows.where(drawn < min(1.0, sample / max(1, n))).orderBy("k").limit(2 * sample).toArrow()
    vectors = matrix_of(table.column("v"))
    if not len(vectors):
        return Codebook(np.zeros((1, 1, part)))
    places = -(-vectors.shape[1] // part)
    cut = Codebook(np.zeros((places, 1, part))).cut(vectors)
    made = np.zeros((places, min(CODES, len(vectors)), part))
    for place in range(places):
        here = cut[:, place]
        typical = here[np.linspace(0, len(here) - 1, made.shape[1]).astype(int)].copy()
        for _ in range(steps):
            nearest = np.argmin((typical * typical).sum(1)[None, :] - 2 * here @ typical.T, axis=1)
            counts = np.bincount(nearest, minlength=len(typical))
            sums = np.stack([np.bincount(nearest, here[:, p], minlength=len(typical)) for p in range(part)], axis=1)
            typical = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], typical)
        made[place] = typical
    return Codebook(made)


def with_codes(index: DataFrame, codebook: Codebook, vector: str = "embedding", name: str = "code") -> DataFrame:
    """``index`` with the code of each vector, a byte for each part; NULL without a vector."""
    shared = index.sparkSession.sparkContext.broadcast(codebook)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.full(len(batch), None, dtype=object)
            known = batch.notna().to_numpy()
            if known.any():
                codes = shared.value.encode(np.stack(batch[known].to_numpy()).astype(np.float64))
                found[known] = [row.tobytes() for row in codes]
            yield pd.Series(found)

    return index.withColumn(name, encoded.asNondeterministic()(F.col(vector)))


def topk_compressed(
    queries: DataFrame,
    codes: DataFrame,
    vectors: DataFrame,
    codebook: Codebook,
    k: int = 5,
    survivors: int = 100,
    *,
    query_key: str = "query_id",
    key: str = "id",
    vector: str = "embedding",
    buckets: str | None = "bucket",
) -> DataFrame:
    """The best ``k`` of the ``survivors`` rows that the codes rank highest, by their true product.

    ``codes`` has ``key, code`` and is scanned whole; of ``vectors`` (``key, vector``) only what the
    survivors need is joined. With ``buckets``, a column of both by which they are stored, only the
    folders that hold a survivor are read. Few queries go to the codes at a time; more are sent in
    groups that fit, each group a scan of the codes.
    """
    if survivors < k:
        raise ValueError("survivors must be at least k")
    spark = queries.sparkSession
    asked, size = cut_and_measure(
        queries.where(F.col(vector).isNotNull()).select(query_key, F.col(vector).cast("array<double>").alias("q")),
        rows=F.count(F.lit(1)),
        bytes=F.coalesce(F.sum(F.size("q") * F.lit(8).cast("bigint") + F.octet_length(F.col(query_key).cast("string"))), F.lit(0)),
    )
    groups = max(1, -(-size["rows"] // MAX_SENT_QUERIES), -(-size["bytes"] // MAX_SENT_BYTES))
    carried = [name for name in (buckets,) if name is not None]
    coded = codes.where(F.col("code").isNotNull()).select(key, "code", *carried)
    found = None
    for group in range(groups):
        part = asked if groups == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(groups)) == group)
        scanned = _scan_codes(spark, part.toArrow(), coded, codebook, survivors, key, query_key)
        best = cut_lineage(rank_candidates(scanned, survivors, query_key, key).drop("rk"))
        found = best if found is None else found.unionByName(best)
    # Where the survivors lie is looked up among the codes, which are small.
    if buckets is None:
        rows = vectors.select(key, F.col(vector).alias("v"))
        placed = found
    else:
        placed = cut_lineage(found.join(coded.select(key, buckets), key))
        folders = sorted(r[0] for r in placed.select(buckets).distinct().collect())
        rows = vectors.where(F.col(buckets).isin(folders)).select(key, F.col(vector).alias("v"), buckets)
    true = F.aggregate(
        F.zip_with("q", F.col("v").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x
    )
    exact = placed.drop("score").join(rows, [key, *carried]).join(asked, query_key).select(query_key, key, true.alias("score"))
    return rank_candidates(exact, k, query_key, key)


def _scan_codes(spark: SparkSession, queries: pa.Table, codes: DataFrame, codebook: Codebook, keep: int, key: str, query_key: str) -> DataFrame:
    """Candidates ``query_key, key, score``: what each task found among its codes."""
    shared = spark.sparkContext.broadcast((keys_of(queries.column(0)), matrix_of(queries.column(1)), codebook))
    names = [query_key, key, "score"]
    schema = T.StructType(
        [
            T.StructField(query_key, _type_of(spark, queries.schema.field(0).type)),
            T.StructField(key, codes.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, book = shared.value
        best = TopK(keep)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            keys = keys_of(batch.column(0))
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(keys), -1)
            step = max(1, TILE // max(len(keys), book.parts.shape[0] * book.parts.shape[1]))
            for start in range(0, len(ids), step):
                numbers = np.arange(start, min(start + step, len(ids)))
                best.offer_scores(numbers, scores_of(book.tables(vectors[numbers]), rows), keys)
        yield from best.batches(ids, names)

    return codes.select(key, "code").mapInArrow(scan, schema)


def _type_of(spark: SparkSession, kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)
