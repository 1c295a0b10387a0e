"""Indexes that are kept between queries, as an application keeps them.

An index over a folder of tables is built when a query first asks for it and then read by all that
follow in the session. If the tables' files have changed in the meantime, it is synced: only what
changed is embedded and written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.chunking import chunk_documents
from answerloom.functions.embedding import embed
from answerloom.operators import search as S
from answerloom.operators.compressed import Codebook, train_codebook, with_codes
from answerloom.operators.index_log import IndexLog
from answerloom.operators.search_many import describe_blocks, with_blocks
from answerloom.session import cut_lineage, new_folder
from answerloom.sources import scan
from answerloom.sources.tables import table_stamp

#: Rows of a cell, about, and vectors that centroids are learned from, at most about so many.
CELL_ROWS = 2_000
SAMPLE = 50_000
SAMPLE_TASKS = 32


def _kept(spark: SparkSession, directory: str, name: str) -> dict:
    """What the session remembers of an index."""
    held = spark.sparkContext.__dict__.setdefault("_answerloom_kept", {})
    return held.setdefault((directory.rstrip("/"), name), {})


def chunks_of(spark: SparkSession, directory: str) -> DataFrame:
    """``id, doc_id, source, content`` of all documents' chunks."""
    chunks = chunk_documents(scan(spark, directory, "documents", spread=True), "text", ["doc_id", "source"])
    document = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    part = F.lpad(F.col("chunk_ix").cast("string"), 6, "0")
    return chunks.select(F.concat_ws("-", document, part).alias("id"), "doc_id", "source", "content")


def _synced(
    spark: SparkSession,
    directory: str,
    name: str,
    tables: tuple[str, ...],
    log: Callable[[str], IndexLog],
    source: Callable[[], DataFrame],
    centroids: Callable[[DataFrame], DataFrame],
) -> tuple[IndexLog, dict]:
    kept = _kept(spark, directory, name)
    stamp = tuple(table_stamp(spark, directory, table) for table in tables)
    if kept.get("stamp") != stamp:
        rows = source()
        if "log" not in kept:
            kept["log"] = log(new_folder(spark, name))
            kept["log"].sync(rows, centroids=centroids(rows))
        else:
            kept["log"].sync(rows)
        for made in ("blocks", "codes"):
            kept.pop(made, None)
        kept["stamp"] = stamp
    return kept["log"], kept


def _trained(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Centroids of about ``CELL_ROWS`` rows each, from a sample drawn by a hash of the keys.

    Only the sample is embedded here. Its vectors are dealt over a fixed number of tasks: each of them
    sends sums of every cell in every step of the training.
    """
    n = rows.count()
    drawn = F.pmod(F.xxhash64(key, F.lit("cells")), F.lit(1 << 30)) / float(1 << 30)
    drawn_rows = rows.where(drawn < min(1.0, SAMPLE / max(1, n)))
    sample = cut_lineage(drawn_rows.select(key, embed(text).alias("embedding")).repartition(SAMPLE_TASKS, key))
    cells = max(1, min(S.MAX_SENT_CELLS // 4, -(-n // CELL_ROWS)))
    return cut_lineage(S.train_centroids(sample, cells)) if cells > 1 else _middle(sample)


def _middle(rows: DataFrame) -> DataFrame:
    """One cell round the mean."""
    return S.label_centroids(rows.withColumn("_all", F.lit(0)), "_all")


def chunk_index(spark: SparkSession, directory: str) -> IndexLog:
    """All documents' chunks, embedded, by cells."""
    return _synced(
        spark,
        directory,
        "chunks",
        ("documents",),
        lambda path: IndexLog(path, columns=("doc_id", "source")),
        lambda: cut_lineage(chunks_of(spark, directory)),  # split once, read twice
        lambda rows: _trained(rows, "id", "content"),
    )[0]


def document_index(spark: SparkSession, directory: str) -> IndexLog:
    """All documents, embedded whole, by cells."""
    documents = lambda: scan(spark, directory, "documents", spread=True).select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("content")
    )
    return _synced(
        spark,
        directory,
        "documents",
        ("documents",),
        IndexLog,
        documents,
        lambda rows: _trained(rows, "id", "content"),
    )[0]


def vector_index(spark: SparkSession, directory: str) -> IndexLog:
    """The vectors of ``embeddings``, each label a cell round the mean of its vectors."""
    return _synced(
        spark,
        directory,
        "vectors",
        ("embeddings",),
        lambda path: IndexLog(path, key="vec_id", text=None, columns=("label",)),
        lambda: scan(spark, directory, "embeddings"),
        lambda rows: S.label_centroids(rows, "label"),
    )[0]


def document_blocks(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of :func:`document_index` in blocks, and the blocks' descriptions."""
    log = document_index(spark, directory)
    kept = _kept(spark, directory, "documents")
    if "blocks" not in kept:
        centroids = log.centroids(spark)
        rows = cut_lineage(with_blocks(log.live(spark).select("id", "embedding", "cell"), centroids))
        kept["blocks"] = rows, cut_lineage(describe_blocks(rows, centroids))
    return kept["blocks"]


def chunk_codes(spark: SparkSession, directory: str) -> tuple[DataFrame, Codebook]:
    """Codes of the vectors of :func:`chunk_index` (``id, code, bucket``), and what they stand for."""
    log = chunk_index(spark, directory)
    kept = _kept(spark, directory, "chunks")
    if "codes" not in kept:
        live = log.live(spark).select("id", "embedding", "bucket")
        book = train_codebook(live)
        kept["codes"] = cut_lineage(with_codes(live, book).select("id", "code", "bucket")), book
    return kept["codes"]
