"""Similarity search: exact, approximate and exact with pruning.

All three are one job shape. Every corpus row lies in a cell and every query
names the cells it wants; plain exact search has a single cell. A bounded set
of queries travels to the corpus, which is then scanned in place and reduced
to ``k`` rows per query and task before anything is shuffled. A larger set goes
in groups of that size, each a scan. Where no query may be sent, both sides are
joined on (cell, slot, slot), where the slots cut the two sides of a cell,
however hot, into blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from answerloom.functions.columns import as_column, ranked_score, require_columns
from answerloom.operators._nearest import CACHED, TopK, keys_of, matrix_of
from answerloom.session import cut_and_measure, cut_lineage, new_folder

MAX_SENT_QUERIES = 16_384
MAX_SENT_BYTES = 64 << 20
MAX_SENT_CELLS = 1 << 16
HANDFUL = 256
MERGE_GROUPS = 256
CORPUS_BLOCK = 20_000
QUERY_BLOCK = 4_096


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    *,
    query_key: str = "query_id",
    key: str = "id",
    vector: str = "embedding",
    where: Column | str | None = None,
    columns: Sequence[str] = (),
    max_sent_queries: int = MAX_SENT_QUERIES,
) -> DataFrame:
    """The ``k`` corpus rows with the largest dot product, per query.

    Returns ``query_key, rk, key, *columns, score``. ``where`` restricts the
    corpus before ranking. Ties on the rounded score go to the smaller key.
    """
    kept = corpus if where is None else corpus.where(where)
    found = _search(
        queries.select(query_key, F.col(vector).alias("q"), F.array(F.lit(0)).alias("cells")),
        kept.select(key, F.col(vector).alias("v"), F.lit(0).alias("cell")),
        k,
        query_key,
        key,
        max_sent_queries,
    )
    return _finish(found, kept, k, query_key, key, columns)


def topk_ann(
    queries: DataFrame,
    index: DataFrame,
    centroids: DataFrame,
    k: int = 5,
    nprobe: int = 3,
    *,
    query_key: str = "query_id",
    key: str = "id",
    vector: str = "embedding",
    where: Column | str | None = None,
    columns: Sequence[str] = (),
    max_sent_queries: int = MAX_SENT_QUERIES,
) -> DataFrame:
    """:func:`topk` over the ``nprobe`` cells nearest to each query.

    ``index`` carries the ``cell`` that :func:`assign_cells` gave its rows.
    """
    kept = index if where is None else index.where(where)
    probing = with_cells(queries.select(query_key, F.col(vector).alias("q")), centroids, "q", nprobe)
    found = _search(
        probing,
        kept.select(key, F.col(vector).alias("v"), "cell"),
        k,
        query_key,
        key,
        max_sent_queries,
    )
    return _finish(found, kept, k, query_key, key, columns)


def topk_pruned(
    queries: DataFrame,
    index: DataFrame,
    centroids: DataFrame,
    k: int = 5,
    *,
    query_key: str = "query_id",
    key: str = "id",
    vector: str = "embedding",
    columns: Sequence[str] = (),
    radii: DataFrame | None = None,
    max_sent_queries: int = MAX_SENT_QUERIES,
) -> DataFrame:
    """Exact :func:`topk` that skips cells which cannot hold a better row.

    A first search of the nearest cell gives each query a score to beat. No row
    of a cell scores above ``q.c + |q| * radius``, so cells whose bound lies
    below that score are left out of the second search. With more centroids than
    can be sent to every task nothing is pruned; the result is the same. ``radii`` (``cell, centroid,
    radius``) may come with a stored index, else the index is read once more to find them.
    """
    if not _few(centroids):
        return topk(
            queries, index, k, query_key=query_key, key=key, vector=vector, columns=columns,
            max_sent_queries=max_sent_queries,
        )
    first = topk_ann(
        queries, index, centroids, k, 1, query_key=query_key, key=key, vector=vector,
        max_sent_queries=max_sent_queries,
    )
    to_beat = (
        first.where(F.col("rk") == k)
        .groupBy(F.col(query_key).alias("beaten_key"))
        .agg(F.min("score").alias("floor"))
    )
    # Written once: an aggregate over the whole index that is read more than once.
    radii = cut_lineage(cell_radii(index, centroids, vector) if radii is None else radii)
    probing = (
        queries.select(query_key, F.col(vector).alias("q"))
        .join(to_beat, F.col(query_key) == F.col("beaten_key"), "left")
        .select(
            query_key,
            "q",
            _promising_cells("q", "floor", radii).alias("cells"),
        )
    )
    found = _search(
        probing,
        index.select(key, F.col(vector).alias("v"), "cell"),
        k,
        query_key,
        key,
        max_sent_queries,
    )
    return _finish(found, index, k, query_key, key, columns)


def relevant_sources(
    sentences: DataFrame,
    sources: DataFrame,
    k: int = 5,
    min_score: float = 0.8,
    *,
    query_key: str = "query_id",
    key: str = "id",
    vector: str = "embedding",
    columns: Sequence[str] = (),
) -> DataFrame:
    """Per sentence the top ``k`` sources, of which those above ``min_score``.

    Ranking comes first and the comparison is strict. A source that serves
    several sentences appears once for each.
    """
    hits = topk(
        sentences, sources, k, query_key=query_key, key=key, vector=vector, columns=columns
    )
    return hits.where(F.col("score") > min_score)


def pack_results(hits: DataFrame, query_key: str, columns: Sequence[str]) -> DataFrame:
    """One row per query with its results as an array of structs in rank order."""
    row = F.struct("rk", *columns, "score")
    return hits.groupBy(query_key).agg(F.sort_array(F.collect_list(row)).alias("results"))


def recall(approximate: DataFrame, exact: DataFrame, query_key: str, key: str) -> DataFrame:
    """Share of the exact results that the approximate search also found."""
    found = approximate.select(query_key, key, F.lit(1).alias("found"))
    return (
        exact.join(found, [query_key, key], "left")
        .groupBy(query_key)
        .agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    )


# ---- cells -----------------------------------------------------------------


def train_centroids(
    corpus: DataFrame, n_cells: int, vector: str = "embedding", seed: int = 7
) -> DataFrame:
    """``cell, centroid`` rows from k-means over all vectors of the corpus."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = corpus.where(F.col(vector).isNotNull())
    features = known.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, initSteps=2, maxIter=20).fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def label_centroids(corpus: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per label, on six places; the label is the cell."""
    means = (
        corpus.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
        .groupBy(label, "i")
        .agg(F.round(F.avg("x"), 6).alias("m"))
        .groupBy(F.col(label).cast("int").alias("cell"))
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias(
                "centroid"
            )
        )
    )
    return cut_lineage(means)


def _few(centroids: DataFrame) -> bool:
    """Whether the centroids may be sent to every task; their number and size are looked at first."""
    return _sent(centroids) is not None


def _sent(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells and their centroids on the driver, or None if they are too many.

    ``HANDFUL`` rows are always few; whether more are is counted before any is fetched.
    """
    known = centroids.select("cell", "centroid")
    table = known.limit(HANDFUL + 1).toArrow()
    if table.num_rows > MAX_SENT_CELLS:
        return None
    if table.num_rows > HANDFUL:
        size = known.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.size("centroid") * F.lit(8).cast("bigint")).alias("bytes"),
        ).first()
        if size["rows"] > MAX_SENT_CELLS or size["bytes"] > MAX_SENT_BYTES:
            return None
        table = known.toArrow()
    table = table.sort_by("cell")
    return keys_of(table.column("cell")).astype(np.int32), matrix_of(table.column("centroid"))


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their centroids, which must be few."""
    found = _sent(centroids)
    if found is None:
        raise ValueError("too many centroids to send to every task, use with_cells")
    return found


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, rows by centroids."""
    squares = (rows * rows).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :]
    return np.maximum(squares - 2 * rows @ centroids.T, 0.0)


def _smallest(gaps: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest numbers of each row, in order; ties go to the first."""
    if n == 1 and gaps.shape[1]:
        return np.argmin(gaps, axis=1)[:, None]
    return np.argsort(gaps, axis=1, kind="stable")[:, :n]


def _rows(series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def nearest_cells(vector: Column | str, centroids: DataFrame, nprobe: int = 1) -> Column:
    """The ``nprobe`` nearest cells, nearest first; ties go to the smaller cell.

    The centroids are sent to every task, so they must be few; :func:`with_cells` takes any number.
    """
    return _nearest(vector, centroids.sparkSession, _centroid_matrix(centroids), nprobe)


def _nearest(vector: Column | str, spark: SparkSession, centroids: tuple[np.ndarray, np.ndarray], nprobe: int) -> Column:
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cells, matrix = shared.value
        for batch in batches:
            out = np.full(len(batch), None, dtype=object)
            known = batch.notna().to_numpy()
            # A tile of distances at a time: a batch by all cells grows with the number of cells.
            positions, step = np.flatnonzero(known), max(1, CACHED // max(1, len(cells)))
            for start in range(0, len(positions), step):
                here = positions[start : start + step]
                gaps = np.round(_distances(_rows(batch.iloc[here]), matrix), 6)
                for position, row in zip(here, cells[_smallest(gaps, nprobe)], strict=True):
                    out[position] = row.tolist()
            yield pd.Series(out)

    return nearest.asNondeterministic()(as_column(vector))


def with_cells(
    df: DataFrame, centroids: DataFrame, vector: str = "embedding", nprobe: int = 1, name: str = "cells"
) -> DataFrame:
    """``df`` with the :func:`nearest_cells` of every row, of any number of centroids.

    More than can be sent to every task are searched like any large corpus, in blocks: the
    squared distance, negated, is a dot product of vectors that are two entries longer.
    """
    sent = _sent(centroids)
    if sent is not None:
        return df.withColumn(name, _nearest(vector, df.sparkSession, sent, nprobe))

    def square(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)

    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    own, other = F.col(vector).cast("array<double>"), F.col("centroid").cast("array<double>")
    asked = rows.where(own.isNotNull()).select(
        "_row",
        F.concat(F.transform(own, lambda x: 2 * x), F.array(-square(own), F.lit(-1.0))).alias("q"),
        F.array(F.lit(0)).alias("cells"),
    )
    known = centroids.select(
        F.col("cell").cast("int").alias("_cell"),
        F.concat(other, F.array(F.lit(1.0), square(other))).alias("v"),
        F.lit(0).alias("cell"),
    )
    schema = T.StructType(
        [T.StructField("_row", T.LongType()), T.StructField("_cell", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    near = _finish(_blocks(asked, known, nprobe, "_row", "_cell", schema), known, nprobe, "_row", "_cell", ())
    in_order = F.sort_array(F.collect_list(F.struct("rk", "_cell")))
    found = near.groupBy("_row").agg(F.transform(in_order, lambda hit: hit["_cell"]).alias("_found"))
    return (
        rows.join(found, "_row", "left")
        .withColumn(name, F.col("_found"))
        .drop("_row", "_found")
    )


def assign_cells(corpus: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add the nearest ``cell``. Write the result partitioned by it to prune scans."""
    found = with_cells(corpus, centroids, vector, 1, "_cells")
    return found.withColumn("cell", F.get("_cells", F.lit(0))).drop("_cells")


def cell_radii(index: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Centroids, few enough to send, with the distance of the farthest row of their cell."""
    shared = centroids.sparkSession.sparkContext.broadcast(_centroid_matrix(centroids))

    @F.pandas_udf("double")
    def distance(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        known, matrix = shared.value
        if not len(vectors):
            return pd.Series([], dtype=float)
        gap = _rows(vectors) - matrix[np.searchsorted(known, cells.to_numpy())]
        return pd.Series(np.sqrt((gap * gap).sum(1)))

    radii = index.groupBy("cell").agg(F.max(distance(vector, "cell")).alias("radius"))
    return centroids.join(radii, "cell")


def _promising_cells(vector: str, floor: str, radii: DataFrame) -> Column:
    """Cells whose bound reaches ``floor``; all of them where it is NULL."""
    table = radii.select("cell", "centroid", "radius").orderBy("cell").toArrow()
    shared = radii.sparkSession.sparkContext.broadcast(
        (
            keys_of(table.column("cell")).astype(np.int32),
            matrix_of(table.column("centroid")),
            keys_of(table.column("radius")),
        )
    )

    @F.pandas_udf("array<int>")
    def promising(vectors: pd.Series, floors: pd.Series) -> pd.Series:
        cells, matrix, radius = shared.value
        if not len(vectors):
            return pd.Series([], dtype=object)
        rows = _rows(vectors)
        norms = np.sqrt((rows * rows).sum(1))
        bound = rows @ matrix.T + norms[:, None] * radius[None, :]
        # 2e-6 covers the six places on which scores are compared.
        floor = floors.fillna(-np.inf).to_numpy()[:, None] - 2e-6
        return pd.Series([cells[row] for row in bound >= floor])

    return promising(as_column(vector), as_column(floor))


# ---- execution -------------------------------------------------------------


def _search(
    queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, max_sent: int
) -> DataFrame:
    """Candidates ``query_key, key, score`` that include every true result.

    The queries are written and their number and size looked at before any of them is sent.
    """
    if k < 1:
        raise ValueError("k must be positive")
    schema = T.StructType(
        [
            T.StructField(query_key, queries.schema[query_key].dataType),
            T.StructField(key, corpus.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    values = F.coalesce(F.sum(F.coalesce(F.size("q"), F.lit(0)) * 8), F.lit(0))
    others = F.coalesce(F.sum(F.octet_length(F.col(query_key).cast("string")) + F.size("cells") * 4), F.lit(0))
    asked, size = cut_and_measure(queries, rows=F.count(F.lit(1)), bytes=values + others)
    if size["rows"] <= max_sent and size["bytes"] <= MAX_SENT_BYTES:
        return _scan(_with_vector(asked.toArrow(), "q"), corpus, k, schema)[0]
    if max_sent < 1:
        return _blocks(asked, corpus, k, query_key, key, schema)
    groups = max(-(-size["rows"] // max_sent), -(-size["bytes"] // MAX_SENT_BYTES))
    return scan_in_groups(asked, groups, cut_lineage(corpus), k, query_key, key, schema)


def scan_in_groups(
    asked: DataFrame,
    groups: int,
    corpus: DataFrame,
    k: int,
    query_key: str,
    key: str,
    schema: T.StructType,
) -> DataFrame:
    """The best ``k`` of each query, found by a scan of the corpus for each group of queries.

    Neither side is shuffled, whatever their sizes; only what tasks found is. ``asked`` and ``corpus``
    must have been written.
    """
    found = new_folder(asked.sparkSession)
    for group in range(groups):
        part = asked if groups == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(groups)) == group)
        scanned, sent = _scan(_with_vector(part.toArrow(), "q"), corpus, k, schema)
        rank_candidates(scanned, k, query_key, key).select(*schema.names).write.mode("append").parquet(found)
        sent.destroy()
    return asked.sparkSession.read.schema(schema).parquet(found)


def _with_vector(rows: pa.Table | pa.RecordBatch, name: str) -> pa.Table | pa.RecordBatch:
    """Rows that have a vector. A filter in the plan could run a model twice."""
    present = pa.compute.is_valid(rows.column(name))
    return rows.filter(present)


def _by_cell(cells: pa.Array | pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The numbers of the queries that name a cell."""
    lists = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    if not len(lists):
        return {}
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
    named, numbers = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)
    order = np.argsort(named, kind="stable")
    known, first = np.unique(named[order], return_index=True)
    return dict(zip(known.tolist(), np.split(numbers[order], first[1:]), strict=False)) if len(known) else {}


def _scan(
    queries: pa.Table, corpus: DataFrame, k: int, schema: T.StructType
) -> tuple[DataFrame, Broadcast]:
    """Send the queries to the corpus: no shuffle of the corpus, no skew. Also returns what was sent."""
    ids = keys_of(queries.column(0))
    vectors = matrix_of(queries.column(1))
    by_cell = _by_cell(queries.column(2))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, vectors, by_cell))
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, by_cell = shared.value
        best = TopK(k)
        for batch in batches:
            batch = _with_vector(batch, "v")
            keys, rows, cells = keys_of(batch[0]), matrix_of(batch[1]), keys_of(batch[2])
            for cell in np.unique(cells):
                numbers = by_cell.get(int(cell))
                if numbers is not None:
                    here = cells == cell
                    best.offer(numbers, vectors[numbers], rows[here], keys[here])
        yield from best.batches(ids, names)

    probed = corpus.where(F.col("cell").isin(sorted(by_cell))) if by_cell else corpus.limit(0)
    return probed.mapInArrow(scan, schema), shared


def _blocks(
    queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, schema: T.StructType
) -> DataFrame:
    """Join bounded blocks of queries with bounded blocks of the corpus."""
    asked = queries.select(query_key, "q", F.explode("cells").alias("cell"))
    # One row per cell, written so that the planner knows its size.
    sizes = cut_lineage(
        corpus.groupBy("cell")
        .agg(F.ceil(F.count(F.lit(1)) / CORPUS_BLOCK).alias("c_slots"))
        .join(
            asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("q_slots")),
            "cell",
        )
    )
    slots = ["cell", "c_slot", "q_slot"]
    left = corpus.join(sizes, "cell").select(
        key,
        "v",
        "cell",
        F.expr(f"pmod(xxhash64(`{key}`), c_slots)").alias("c_slot"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_slots") - 1)).alias("q_slot"),
    )
    right = asked.join(sizes, "cell").select(
        query_key,
        "q",
        "cell",
        F.expr(f"pmod(xxhash64(`{query_key}`), q_slots)").alias("q_slot"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c_slots") - 1)).alias("c_slot"),
    )
    names = schema.names

    def best_of(rows: pa.Table, asked: pa.Table) -> pa.Table:
        best = TopK(k)
        rows, asked = _with_vector(rows, "v"), _with_vector(asked, "q")
        if rows.num_rows and asked.num_rows:
            best.offer(
                np.arange(asked.num_rows),
                matrix_of(asked.column("q")),
                matrix_of(rows.column("v")),
                keys_of(rows.column(key)),
            )
        batches = list(best.batches(keys_of(asked.column(query_key)), names))
        if batches:
            return pa.Table.from_batches(batches)
        return pa.table(
            {
                names[0]: asked.column(query_key).slice(0, 0),
                names[1]: rows.column(key).slice(0, 0),
                names[2]: pa.array([], pa.float64()),
            }
        )

    return left.groupBy(*slots).cogroup(right.groupBy(*slots)).applyInArrow(best_of, schema)


def rank_candidates(candidates: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """``query_key, rk, key, score``: the best ``k`` candidates of each query, ties to the smaller key."""
    best = [F.desc("score"), F.asc(key)]
    order = Window.partitionBy(query_key).orderBy(*best)
    grouped = Window.partitionBy(query_key, "_group").orderBy(*best)
    return (
        candidates.withColumn("score", ranked_score(F.col("score")))
        .withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
        .withColumn("rk", F.row_number().over(grouped))
        .where(F.col("rk") <= k)
        .withColumn("rk", F.row_number().over(order))
        .where(F.col("rk") <= k)
        .select(query_key, F.col("rk").cast("bigint").alias("rk"), key, "score")
    )


def _finish(
    candidates: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str,
    key: str,
    columns: Sequence[str],
) -> DataFrame:
    """Rank the candidates and fetch the requested columns of the winners.

    Candidates come from every task that read the corpus, so they are first cut to ``k`` within
    groups of tasks; a query's last window holds ``k`` rows of each group. Winners are written
    before they fetch columns: the planner then knows their size, and broadcasts them only if
    they are small.
    """
    ranked = rank_candidates(candidates, k, query_key, key)
    wanted = [name for name in columns if name != key]
    if not wanted:
        return ranked.select(query_key, "rk", key, "score")
    require_columns(corpus, wanted)
    return corpus.select(key, *wanted).join(cut_lineage(ranked), key).select(
        query_key, "rk", key, *wanted, "score"
    )
