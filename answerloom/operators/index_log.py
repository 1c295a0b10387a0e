"""A vector index kept as a log of changes: base files, changed rows, and keys that are gone.

A sync writes the rows whose text is new or changed and the keys that were changed or removed; all
else stays where it is. Readers put the parts together: a row is live unless its key is gone in a
later version. Every row lies in a bucket, the cell of its vector if the log has centroids, and
compaction rewrites only the buckets in which changes have piled up.

    path/base-<version>/bucket=<n>    rows as of that version, for the buckets it rewrote
    path/delta-<version>/bucket=<n>   rows that the version added or changed
    path/gone-<version>               keys that the version changed or removed
    path/radii-<version>              how far rows it wrote lie from their cell's centroid
    path/log/version=<n>              what the version wrote; written last, so half a version is none
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.functions.embedding import EmbeddingModel, embed
from answerloom.operators.index import content_hash, sync_actions
from answerloom.operators.search import assign_cells, cell_radii
from answerloom.session import cut_lineage, folder_exists, rename_folder

ENTRY = "kind string, folder string, bucket int, rows bigint"
CENTROID = "cell int, centroid array<double>"
#: Rows without a vector belong to no cell.
NO_CELL = -1


@dataclass(frozen=True)
class State:
    """What the log says of the latest version."""

    version: int
    schema: T.StructType | None
    #: Folders with the buckets that are read from them, and each bucket's base.
    parts: dict[str, list[int]]
    based: dict[int, int]
    #: Rows of each bucket, of its base and of its changes since.
    base_rows: dict[int, int]
    new_rows: dict[int, int]
    gone: list[str]
    radii: list[str]


@dataclass(frozen=True)
class IndexLog:
    """The log below ``path``. ``columns`` are kept beside key, text, hash and embedding.

    With ``text`` as None the source brings its vectors as ``embedding``, and their hash tells a change.
    """

    path: str
    key: str = "id"
    text: str | None = "content"
    columns: tuple[str, ...] = ("source",)
    buckets: int = 16

    # ---- what is there ---------------------------------------------------------

    def entries(self, spark: SparkSession) -> DataFrame:
        """``version, kind, folder, bucket, rows`` of everything that was written."""
        if not folder_exists(spark, f"{self.path}/log"):
            return spark.createDataFrame([], f"{ENTRY}, version int")
        return spark.read.schema(f"{ENTRY}, version int").parquet(f"{self.path}/log")

    def state(self, spark: SparkSession) -> State:
        """The driver gets a row for each bucket and folder that is still read, and none of the index."""
        own = Window.partitionBy("bucket")
        based = F.max(F.when(F.col("kind") == "base", F.col("version"))).over(own)
        used = (
            ((F.col("kind") == "base") & (F.col("version") == F.col("based")))
            | ((F.col("kind") == "delta") & (F.col("version") > F.coalesce("based", F.lit(0))))
            | ~F.col("kind").isin("base", "delta")
        )
        rows = sorted(self.entries(spark).withColumn("based", based).where(used).collect(), key=lambda r: (r["version"], r["bucket"] or 0))
        parts: dict[str, list[int]] = {}
        bases, base_rows, new_rows = {}, {}, {}
        for row in rows:
            bucket = row["bucket"]
            if row["kind"] in ("base", "delta"):
                parts.setdefault(row["folder"], []).append(bucket)
            if row["kind"] == "base":
                bases[bucket], base_rows[bucket] = row["version"], row["rows"]
            elif row["kind"] == "delta":
                new_rows[bucket] = new_rows.get(bucket, 0) + row["rows"]
        held = set(base_rows) | set(new_rows)
        # Rows of a base were live when it was made; keys that went before matter to older rows only.
        oldest = min((bases.get(bucket, 0) for bucket in held), default=0)
        folders = lambda kind: [r["folder"] for r in rows if r["kind"] == kind]
        schema = folders("schema")
        return State(
            version=max((r["version"] for r in rows), default=0),
            schema=T.StructType.fromJson(json.loads(schema[0])) if schema else None,
            parts=parts,
            based=bases,
            base_rows=base_rows,
            new_rows=new_rows,
            gone=[r["folder"] for r in rows if r["kind"] == "gone" and r["version"] > oldest],
            radii=folders("radii"),
        )

    def version(self, spark: SparkSession) -> int:
        """The latest version, 0 before the first."""
        return self.state(spark).version

    def centroids(self, spark: SparkSession) -> DataFrame | None:
        """The centroids of the cells, if rows lie in cells."""
        path = f"{self.path}/centroids"
        return spark.read.schema(CENTROID).parquet(path) if folder_exists(spark, path) else None

    def radii(self, spark: SparkSession) -> DataFrame | None:
        """Centroids with a radius that no live row of the cell exceeds; removed rows may make it too large."""
        centroids, folders = self.centroids(spark), self.state(spark).radii
        if centroids is None or not folders:
            return None
        known = spark.read.schema("cell int, radius double").parquet(*(f"{self.path}/{folder}" for folder in folders))
        return centroids.join(known.groupBy("cell").agg(F.max("radius").alias("radius")), "cell")

    def _rows(self, spark: SparkSession, state: State) -> DataFrame:
        """Rows of the files that are still read, those included whose key is gone by now."""
        read = [
            spark.read.schema(state.schema).parquet(f"{self.path}/{folder}").where(F.col("bucket").isin(buckets))
            for folder, buckets in state.parts.items()
        ]
        return reduce(DataFrame.union, read) if read else spark.createDataFrame([], state.schema)

    def _dead(self, spark: SparkSession, state: State) -> tuple[DataFrame, Column] | None:
        """Keys that are gone, and when a row is dead by them; None if none is."""
        if not state.gone:
            return None
        schema = T.StructType([T.StructField("_key", state.schema[self.key].dataType), T.StructField("_gone", T.IntegerType())])
        every = spark.read.schema(schema).parquet(*(f"{self.path}/{folder}" for folder in state.gone))
        last = every.groupBy("_key").agg(F.max("_gone").alias("_gone"))
        return last, (F.col(self.key) == F.col("_key")) & (F.col("_gone") > F.col("_version"))

    def live(self, spark: SparkSession, state: State | None = None) -> DataFrame:
        """The index as of the latest version: ``key, *columns, text, content_hash, embedding, bucket, cell``.

        ``cell`` is there if the log has centroids. A filter on ``bucket`` or ``cell`` reads only
        their folders, and columns that are not asked for are not read.
        """
        state = state or self.state(spark)
        if not state.version:
            raise ValueError(f"nothing was synced to {self.path} yet")
        rows, dead = self._rows(spark, state), self._dead(spark, state)
        kept = (rows if dead is None else rows.join(*dead, "left_anti")).drop("_version")
        return kept if not folder_exists(spark, f"{self.path}/centroids") else kept.withColumn("cell", F.col("bucket"))

    # ---- writing ---------------------------------------------------------------

    def sync(
        self,
        source: DataFrame,
        *,
        within: DataFrame | None = None,
        centroids: DataFrame | None = None,
        model: EmbeddingModel | None = None,
        dim: int = 64,
    ) -> int:
        """Bring the index in step with ``source``; returns the version.

        Keys and hashes of both sides are compared; only texts that are new or changed are read
        again, embedded and written. ``within`` has values of the first of ``columns``: then
        ``source`` is all there is of these, and other rows of the index stay as they are.
        ``centroids`` may be given to the first sync, whose rows then lie in cells. Without a change
        no version is made. A null key is no key and is left out.
        """
        spark = source.sparkSession
        source = source.where(F.col(self.key).isNotNull())
        state = self.state(spark)
        version = state.version + 1
        if version == 1:
            if centroids is not None:
                centroids.select(F.col("cell").cast("int"), F.col("centroid").cast("array<double>")).write.parquet(f"{self.path}/centroids")
            self._commit(spark, version, "base", self._hashed(source), None, model, dim)
            return version
        if centroids is not None:
            raise ValueError("centroids are fixed by the first sync")
        there = self.live(spark, state)
        if within is not None:
            there = there.join(within.select(self.columns[0]).distinct(), self.columns[0], "left_semi")
        actions = sync_actions(source, there.select(self.key, "content_hash"), self.key, self._told())
        todo = cut_lineage(actions.where("action <> 'keep'"))
        if todo.isEmpty():
            return state.version
        changed = todo.where("action <> 'delete'").select(F.col(self.key).alias("_key"))
        fresh = source.join(changed, F.col(self.key) == F.col("_key"), "left_semi")
        gone = todo.where("action <> 'insert'").select(F.col(self.key).alias("_key"), F.lit(version).alias("_gone"))
        self._commit(spark, version, "delta", self._hashed(fresh), gone, model, dim)
        return version

    def compact(self, spark: SparkSession, share: float = 0.2) -> int:
        """Rewrite the buckets whose changes are more than ``share`` of their base rows; returns the version.

        Each becomes one base again, without the rows that are gone; other buckets are not read.
        """
        state = self.state(spark)
        changes, dead = dict(state.new_rows), self._dead(spark, state)
        if dead is not None:
            # Only keys are read of rows that may be gone.
            gone = self._rows(spark, state).select(self.key, "_version", "bucket").join(*dead, "left_semi")
            for row in gone.groupBy("bucket").count().collect():
                changes[row["bucket"]] = changes.get(row["bucket"], 0) + row["count"]
        buckets = sorted(bucket for bucket, n in changes.items() if n > share * state.base_rows.get(bucket, 0))
        if not buckets:
            return state.version
        version = state.version + 1
        kept = self.live(spark, state).where(F.col("bucket").isin(buckets)).drop("cell").withColumn("_version", F.lit(version))
        self._write(kept, f"base-{version}")
        self._log(spark, version, [("base", f"base-{version}", kept.schema)], buckets)
        return version

    def _hashed(self, source: DataFrame) -> DataFrame:
        kept = [self.key, *self.columns, *([] if self.text is None else [self.text])]
        own = ["embedding"] if self.text is None else []
        return source.select(*kept, content_hash(self._told()).alias("content_hash"), *own)

    def _told(self) -> Column | str:
        """What is hashed to tell a change."""
        return F.col("embedding").cast("string") if self.text is None else self.text

    def _commit(self, spark, version: int, kind: str, rows: DataFrame, gone: DataFrame | None, model, dim: int) -> None:
        made = rows if self.text is None else rows.withColumn("embedding", embed(self.text, model, dim))
        made = made.withColumn("_version", F.lit(version))
        centroids = self.centroids(spark)
        if centroids is None:
            made = made.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        else:
            # A model runs once: it is declared nondeterministic, so no plan copies its call.
            placed = assign_cells(made, centroids)
            made = placed.withColumn("bucket", F.coalesce(F.col("cell").cast("int"), F.lit(NO_CELL))).drop("cell")
        folder = f"{kind}-{version}"
        self._write(made, folder)
        written = [(kind, folder, made.schema)]
        if version == 1:
            written.append(("schema", self._stored(made.schema).json(), None))
        if gone is not None:
            gone.write.parquet(f"{self.path}/gone-{version}")
            written.append(("gone", f"gone-{version}", None))
        if centroids is not None:
            here = spark.read.parquet(f"{self.path}/{folder}").where(F.col("bucket") != NO_CELL).withColumn("cell", F.col("bucket"))
            cell_radii(here, centroids).select("cell", "radius").write.parquet(f"{self.path}/radii-{version}")
            written.append(("radii", f"radii-{version}", None))
        self._log(spark, version, written)

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Rows by bucket. A bucket of very many rows is split over tasks, small ones share a task."""
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")

    @staticmethod
    def _stored(schema: T.StructType) -> T.StructType:
        """The schema as files have it, with the bucket of their folder."""
        kept = [T.StructField(f.name, f.dataType) for f in schema if f.name not in ("bucket", "cell")]
        return T.StructType([*kept, T.StructField("bucket", T.IntegerType())])

    def _log(self, spark: SparkSession, version: int, written: list[tuple], buckets: list[int] | None = None) -> None:
        """One row for each folder and bucket, put in place by a rename, so that two writers cannot both have the version."""
        parts = []
        for kind, folder, schema in written:
            if kind == "schema":
                found = spark.range(1).select(F.lit(None).cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("rows"))
            elif schema is None:
                found = spark.read.parquet(f"{self.path}/{folder}").agg(F.lit(None).cast("int").alias("bucket"), F.count(F.lit(1)).alias("rows"))
            else:
                found = spark.read.schema(self._stored(schema)).parquet(f"{self.path}/{folder}").groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
            parts.append(found.select(F.lit(kind).alias("kind"), F.lit(folder).alias("folder"), "bucket", F.col("rows")))
        entries = reduce(DataFrame.union, parts)
        if buckets:
            # Buckets that lost their last row are based anew as well.
            every = spark.createDataFrame([(bucket,) for bucket in buckets], "bucket int")
            empty = every.join(entries, "bucket", "left_anti")
            entries = entries.union(
                empty.select(F.lit("base"), F.lit(written[0][1]), "bucket", F.lit(0).cast("bigint"))
            )
        draft = f"{self.path}/draft-{version}"
        entries.coalesce(1).write.parquet(draft)
        if not rename_folder(spark, draft, f"{self.path}/log/version={version}"):
            raise RuntimeError(f"version {version} of {self.path} was written by another job")
