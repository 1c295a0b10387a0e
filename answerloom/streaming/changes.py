"""Files that are added, changed and removed, followed into a chunk index.

A file stream sees a path once and never again, so a changed file would go unnoticed and a removed
one leave its chunks behind. Here the folder is listed without reading it, the listing is held
against the ledger of the last run, and only files that differ are read, chunked and synced; of
those that are gone the chunks go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.embedding import EmbeddingModel
from answerloom.functions.text import mime_type
from answerloom.operators.index_log import IndexLog
from answerloom.session import cut_lineage, folder_exists, rename_folder
from answerloom.streaming.ingest import chunk_rows

LEDGER = "path string, modificationTime timestamp, length bigint, run int"


@dataclass(frozen=True)
class Run:
    """What a run found and made."""

    added: int
    changed: int
    removed: int
    version: int


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths, times and sizes of the files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length")


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The files of the last run that ended."""
    if not folder_exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    runs = spark.read.schema(LEDGER).parquet(ledger)
    last = runs.agg(F.max("run")).first()[0]
    return runs.where(F.col("run") == F.lit(-1 if last is None else last))


def follow_files(
    spark: SparkSession,
    path: str,
    log: IndexLog,
    ledger: str,
    *,
    size: int = 500,
    overlap: int = 10,
    model: EmbeddingModel | None = None,
    dim: int = 64,
) -> Run:
    """Bring the chunk index ``log`` in step with the files under ``path``.

    A file whose time or size differs from the ledger's is read again; chunks that come out the same
    keep their rows. The ledger of a run is written last, so a run that was lost is done again
    and finds its chunks in place. The index keeps ``source`` (the path) as its first column.
    """
    if log.columns[:1] != ("source",):
        raise ValueError("the index must keep `source` as its first column")
    now = cut_lineage(_listing(spark, path))
    known = _ledger(spark, ledger)
    before = known.select(
        F.col("path").alias("_path"), F.col("modificationTime").alias("_time"), F.col("length").alias("_length"), "run"
    )
    same = (F.col("modificationTime") == F.col("_time")) & (F.col("length") == F.col("_length"))
    change = (
        F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "removed").when(~same, "changed")
    )
    todo = cut_lineage(
        now.join(before, F.col("path") == F.col("_path"), "full_outer")
        .select(F.coalesce("path", "_path").alias("source"), change.alias("change"), "modificationTime")
        .where("change IS NOT NULL")
    )
    counts = {r["change"]: r["count"] for r in todo.groupBy("change").count().collect()}
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    if not counts and run > 1:
        return Run(0, 0, 0, log.version(spark))
    fresh = todo.where("change <> 'removed'")
    # The file source leaves older files unread by their time alone.
    since = fresh.agg(F.min("modificationTime")).first()[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = files.where(F.lit(False) if since is None else F.col("modificationTime") >= F.lit(since))
    raw = read.join(fresh.select(F.col("source").alias("path")), "path", "left_semi").withColumn("mime_type", mime_type("path"))
    wanted = dict.fromkeys(["id", *log.columns, "content"])
    version = log.sync(chunk_rows(raw, size, overlap).select(*wanted), within=todo.select("source"), model=model, dim=dim)
    draft = f"{ledger.rstrip('/')}-draft-{run}"
    now.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(draft)
    if not rename_folder(spark, draft, f"{ledger}/part={run}"):
        raise RuntimeError(f"run {run} of {ledger} was made by another job")
    return Run(counts.get("added", 0), counts.get("changed", 0), counts.get("removed", 0), version)
