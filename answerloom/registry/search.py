"""Checked queries: embedding, index, similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.config import Settings
from answerloom.functions.embedding import embed
from answerloom.functions.text import sentences
from answerloom.operators import search as S
from answerloom.operators.compressed import topk_compressed
from answerloom.operators.index import content_hash, sync_actions, sync_index
from answerloom.operators.index_log import IndexLog
from answerloom.operators.search_many import topk_many
from answerloom.plans.refresh import refresh_index
from answerloom.registry import _kept, _sql
from answerloom.registry._base import query
from answerloom.session import cut_lineage, new_folder
from answerloom.sources import scan

_VECTORS = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"

_PAIRS = f"""
    vectors AS ({_VECTORS}),
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS query_label,
             round(list_inner_product(q.v, c.v), 6) AS score
      FROM vectors q, vectors c
    )"""

_CELLS = f"""
    centroid AS (
      SELECT label AS cell, list(m ORDER BY i) AS c FROM (
        SELECT label, i, round(avg(x), 6) AS m FROM (
          SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM ({_VECTORS}))
        GROUP BY label, i)
      GROUP BY label
    ),
    near AS (
      SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS nth FROM (
        SELECT e.vec_id, c.cell, round(list_sum(list_transform(list_zip(e.v, c.c),
                 lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d
        FROM ({_VECTORS}) e, centroid c)
    )"""


def vectors_of(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory, "embeddings")


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding")


CHUNK_KEY_SQL = "lpad(key::VARCHAR, 12, '0') || '-' || lpad(chunk_ix::VARCHAR, 6, '0')"


def embedded_benchmark(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory, "benchmark", spread=True).select(
        F.col("item_id").alias("query_id"), embed("text").alias("embedding")
    )


@query(
    "embed_documents",
    f"""WITH {_sql.embedded('emb', 'documents', 'doc_id', 'text')}
        SELECT key AS doc_id, b AS bucket, round(v, 6) AS value FROM emb""",
)
def embed_documents(spark: SparkSession, directory: str) -> DataFrame:
    documents = scan(spark, directory, "documents", spread=True)
    return (
        documents.select("doc_id", F.posexplode(embed("text")).alias("bucket", "value"))
        .where("value != 0")
        .select(
            "doc_id",
            F.col("bucket").cast("bigint").alias("bucket"),
            F.round(F.col("value").cast("double"), 6).alias("value"),
        )
    )


@query(
    "topk_vectors",
    f"""WITH {_PAIRS}
        SELECT query_id, rk, vec_id, label, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM pairs)
        WHERE rk <= 5""",
)
def topk_vectors(spark: SparkSession, directory: str) -> DataFrame:
    vectors = vectors_of(spark, directory)
    return S.topk(as_queries(vectors), vectors, 5, key="vec_id", columns=["label"])


@query(
    "topk_chunks",
    f"""WITH RECURSIVE {_sql.chunks('documents', 'doc_id', 'text')},
        keyed AS (SELECT {CHUNK_KEY_SQL} AS id, content FROM chunk),
        {_sql.embedded('corpus', 'keyed', 'id', 'content')},
        {_sql.embedded('asked', 'benchmark', 'item_id', 'text')},
        {_sql.ranked('asked', 'corpus', 3)}
        SELECT query AS query_id, rk, id, content, score FROM hits JOIN keyed ON keyed.id = hits.key""",
)
def topk_chunks(spark: SparkSession, directory: str) -> DataFrame:
    index = _kept.chunk_index(spark, directory).live(spark)
    return S.topk(embedded_benchmark(spark, directory), index, 3, columns=["content"])


@query(
    "topk_filtered",
    f"""WITH {_PAIRS}, good AS (SELECT doc_id FROM labels WHERE quality = 1)
        SELECT query_id, rk, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk
          FROM pairs WHERE vec_id IN (SELECT doc_id FROM good))
        WHERE rk <= 3""",
)
def topk_filtered(spark: SparkSession, directory: str) -> DataFrame:
    quality = scan(spark, directory, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    vectors = vectors_of(spark, directory)
    corpus = vectors.join(quality, "vec_id", "left")
    return S.topk(as_queries(vectors), corpus, 3, key="vec_id", where="quality = 1")


@query(
    "nearest_cells",
    f"""WITH {_CELLS} SELECT vec_id, nth, cell FROM near WHERE nth <= 3""",
)
def nearest_cells(spark: SparkSession, directory: str) -> DataFrame:
    vectors = vectors_of(spark, directory)
    centroids = S.label_centroids(vectors, "label")
    cells = vectors.select(
        "vec_id", F.posexplode(S.nearest_cells("embedding", centroids, 3)).alias("nth", "cell")
    )
    return cells.select("vec_id", (F.col("nth") + 1).cast("bigint").alias("nth"), "cell")


@query(
    "topk_ann",
    f"""WITH {_CELLS}, {_PAIRS}
        SELECT query_id, rk, vec_id, label, score FROM (
          SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.vec_id) AS rk
          FROM pairs p
          JOIN near home ON home.vec_id = p.vec_id AND home.nth = 1
          JOIN near probe ON probe.vec_id = p.query_id AND probe.nth <= 3 AND probe.cell = home.cell)
        WHERE rk <= 5""",
)
def topk_ann(spark: SparkSession, directory: str) -> DataFrame:
    log = _kept.vector_index(spark, directory)
    asked = as_queries(vectors_of(spark, directory))
    return S.topk_ann(asked, log.live(spark), log.centroids(spark), 5, 3, key="vec_id", columns=["label"])


@query(
    "topk_pruned",
    f"""WITH {_PAIRS}
        SELECT query_id, rk, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM pairs)
        WHERE rk <= 5""",
)
def topk_pruned(spark: SparkSession, directory: str) -> DataFrame:
    log = _kept.vector_index(spark, directory)
    asked = as_queries(vectors_of(spark, directory))
    return S.topk_pruned(asked, log.live(spark), log.centroids(spark), 5, key="vec_id", radii=log.radii(spark))


@query(
    "ann_recall",
    f"""WITH {_CELLS}, {_PAIRS},
        exact AS (
          SELECT query_id, vec_id FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM pairs)
          WHERE rk <= 5),
        approximate AS (
          SELECT query_id, vec_id FROM (
            SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.vec_id) AS rk
            FROM pairs p
            JOIN near home ON home.vec_id = p.vec_id AND home.nth = 1
            JOIN near probe ON probe.vec_id = p.query_id AND probe.nth <= 3 AND probe.cell = home.cell)
          WHERE rk <= 5)
        SELECT e.query_id, round(avg(CASE WHEN a.vec_id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS recall
        FROM exact e LEFT JOIN approximate a USING (query_id, vec_id) GROUP BY e.query_id""",
)
def ann_recall(spark: SparkSession, directory: str) -> DataFrame:
    log, vectors = _kept.vector_index(spark, directory), vectors_of(spark, directory)
    exact = S.topk(as_queries(vectors), vectors, 5, key="vec_id")
    near = S.topk_ann(as_queries(vectors), log.live(spark), log.centroids(spark), 5, 3, key="vec_id")
    return S.recall(near, exact, "query_id", "vec_id").withColumn("recall", F.round("recall", 6))


@query(
    "packed_results",
    f"""WITH {_PAIRS}
        SELECT query_id, string_agg(rk || ':' || vec_id || ':' || label, ',' ORDER BY rk) AS results FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM pairs)
        WHERE rk <= 3 GROUP BY query_id""",
)
def packed_results(spark: SparkSession, directory: str) -> DataFrame:
    vectors = vectors_of(spark, directory)
    hits = S.topk(as_queries(vectors), vectors, 3, key="vec_id", columns=["label"])
    packed = S.pack_results(hits, "query_id", ["vec_id", "label"])
    line = F.transform("results", lambda r: F.concat_ws(":", r["rk"], r["vec_id"], r["label"]))
    return packed.select("query_id", F.array_join(line, ",").alias("results"))


def _relevant_sql(least: float) -> str:
    return f"""WITH RECURSIVE sentence AS (
          SELECT lpad(item_id::VARCHAR, 6, '0') || '-' || generate_subscripts(ss, 1) AS sid, unnest(ss) AS s
          FROM (SELECT item_id, {_sql.sentence_list('text')} AS ss FROM benchmark)),
        {_sql.embedded('asked', 'sentence', 'sid', 's')},
        {_sql.embedded('corpus', 'documents', 'doc_id', 'text')},
        {_sql.ranked('asked', 'corpus', 5)}
        SELECT query AS sentence_id, rk, key AS doc_id, score FROM hits WHERE score > {least}"""


def _relevant(spark: SparkSession, directory: str, least: float) -> DataFrame:
    asked = sentences(scan(spark, directory, "benchmark", spread=True), "text", ["item_id"]).select(
        F.concat_ws(
            "-", F.lpad(F.col("item_id").cast("string"), 6, "0"), (F.col("sentence_ix") + 1)
        ).alias("sentence_id"),
        embed("sentence").alias("embedding"),
    )
    sources = _kept.document_index(spark, directory).live(spark).withColumnRenamed("id", "doc_id")
    return S.relevant_sources(asked, sources, 5, least, query_key="sentence_id", key="doc_id")


@query("relevant_sources", _relevant_sql(0.5))
def relevant_sources(spark: SparkSession, directory: str) -> DataFrame:
    return _relevant(spark, directory, 0.5)


@query("most_relevant_sources", _relevant_sql(0.8))
def most_relevant_sources(spark: SparkSession, directory: str) -> DataFrame:
    """At the reference's threshold."""
    return _relevant(spark, directory, 0.8)


@query(
    "similar_documents",
    f"""WITH {_sql.embedded('corpus', 'documents', 'doc_id', 'text')},
        {_sql.ranked('corpus', 'corpus', 3)}
        SELECT query AS query_id, rk, key AS id, score FROM hits""",
)
def similar_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's most similar ones, itself included: many queries against many rows, by blocks and bounds."""
    rows, blocks = _kept.document_blocks(spark, directory)
    return topk_many(rows.select(F.col("id").alias("query_id"), "embedding"), rows, blocks, 3)[0]


@query("similar_documents_work")
def similar_documents_work(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of vectors that each round of :func:`similar_documents` compared, beside all there are."""
    rows, blocks = _kept.document_blocks(spark, directory)
    _, report = topk_many(rows.select(F.col("id").alias("query_id"), "embedding"), rows, blocks, 3)
    n = rows.count()
    return spark.createDataFrame(
        [(r["round"], r["queries"], r["pairs"], n * n) for r in report], "round int, queries bigint, pairs bigint, all_pairs bigint"
    )


def _compressed(spark: SparkSession, directory: str, k: int, survivors: int) -> DataFrame:
    codes, book = _kept.chunk_codes(spark, directory)
    index = _kept.chunk_index(spark, directory).live(spark)
    return topk_compressed(embedded_benchmark(spark, directory), codes, index, book, k, survivors)


@query("topk_compressed")
def compressed_search(spark: SparkSession, directory: str) -> DataFrame:
    """The best chunks of each benchmark item by codes of 16 bytes; the best hundred are ranked again."""
    return _compressed(spark, directory, 5, 100)


@query(
    "compressed_recall",
    "SELECT count(*) AS queries, true AS nine_tenths_found, true AS tenth_read FROM benchmark",
)
def compressed_recall(spark: SparkSession, directory: str) -> DataFrame:
    """Whether nine tenths of the exact results are found, by codes of a tenth of the vectors' bytes."""
    index = _kept.chunk_index(spark, directory).live(spark)
    exact = cut_lineage(S.topk(embedded_benchmark(spark, directory), index, 5))
    found = S.recall(_compressed(spark, directory, 5, 100), exact, "query_id", "id")
    codes = _kept.chunk_codes(spark, directory)[0].agg(F.sum(F.octet_length("code"))).first()[0] or 0
    vectors = index.agg(F.sum(F.size("embedding") * 4)).first()[0] or 0
    return found.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("nine_tenths_found")).withColumn(
        "tenth_read", F.lit(codes * 10 <= vectors)
    )


def _changed_log(spark: SparkSession, directory: str, compacted: bool) -> IndexLog:
    """An index of older documents, brought in step with newer ones; some are new, changed and gone."""
    documents = scan(spark, directory, "documents", spread=True).select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), "lang"
    )
    older = F.when(F.col("lang") == "es", F.concat("content", F.lit("."))).otherwise(F.col("content"))
    log = IndexLog(new_folder(spark, "log"))
    log.sync(documents.where("lang <> 'fr'").withColumn("content", older))
    log.sync(documents.where("lang <> 'de'"))
    if compacted:
        log.compact(spark, 0.0)
    return log


@query(
    "index_log_rows",
    """SELECT 1 AS version, 'base' AS kind, count(*) AS rows FROM documents WHERE lang <> 'fr'
       UNION ALL SELECT 2, 'delta', count(*) FROM documents WHERE lang IN ('fr', 'es')
       UNION ALL SELECT 2, 'gone', count(*) FROM documents WHERE lang IN ('de', 'es')
       UNION ALL SELECT 3, 'base', count(*) FROM documents WHERE lang <> 'de'""",
)
def index_log_rows(spark: SparkSession, directory: str) -> DataFrame:
    """What each version wrote: all at first, then what changed, then the buckets that compaction took."""
    written = _changed_log(spark, directory, True).entries(spark).where("kind <> 'schema'")
    return written.groupBy("version", "kind").agg(F.sum("rows").alias("rows"))


def _log_search_sql() -> str:
    return f"""WITH wanted AS (SELECT * FROM documents WHERE lang <> 'de'),
        {_sql.embedded('corpus', 'wanted', 'doc_id', 'text')},
        {_sql.embedded('asked', 'benchmark', 'item_id', 'text')},
        {_sql.ranked('asked', 'corpus', 3)}
        SELECT query AS query_id, rk, key AS id, d.source, md5(d.text) AS content_hash, score
        FROM hits JOIN wanted d ON d.doc_id = hits.key"""


@query("index_log_search", _log_search_sql())
def index_log_search(spark: SparkSession, directory: str) -> DataFrame:
    """Search over base, changes and keys that are gone, read together."""
    live = _changed_log(spark, directory, False).live(spark)
    return S.topk(embedded_benchmark(spark, directory), live, 3, columns=["source", "content_hash"])


@query("index_log_compacted", _log_search_sql())
def index_log_compacted(spark: SparkSession, directory: str) -> DataFrame:
    """The same after compaction."""
    live = _changed_log(spark, directory, True).live(spark)
    return S.topk(embedded_benchmark(spark, directory), live, 3, columns=["source", "content_hash"])


@query(
    "index_sync_actions",
    """WITH source AS (
          SELECT doc_id AS id, md5(text) AS h FROM documents WHERE lang <> 'de'),
        indexed AS (
          SELECT doc_id AS id, md5(CASE WHEN lang = 'es' THEN text || '.' ELSE text END) AS h
          FROM documents WHERE lang <> 'fr')
        SELECT coalesce(s.id, i.id) AS id,
               CASE WHEN i.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'delete'
                    WHEN s.h = i.h THEN 'keep' ELSE 'update' END AS action
        FROM source s FULL JOIN indexed i ON i.id = s.id""",
)
def index_sync_actions(spark: SparkSession, directory: str) -> DataFrame:
    documents = scan(spark, directory, "documents", spread=True).select(F.col("doc_id").alias("id"), "text", "lang")
    older = F.when(F.col("lang") == "es", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    indexed = documents.where("lang <> 'fr'").select("id", content_hash(older).alias("content_hash"))
    return sync_actions(documents.where("lang <> 'de'"), indexed, key="id", text="text")


@query(
    "index_sync",
    """WITH source AS (SELECT doc_id AS id, source, md5(text) AS h FROM documents WHERE lang <> 'de'),
        indexed AS (
          SELECT doc_id AS id, md5(CASE WHEN lang = 'es' THEN text || '.' ELSE text END) AS h
          FROM documents WHERE lang <> 'fr')
        SELECT s.id, s.source, s.h AS content_hash, i.id IS NOT NULL AS kept
        FROM source s LEFT JOIN indexed i ON i.id = s.id AND i.h = s.h""",
)
def index_sync(spark: SparkSession, directory: str) -> DataFrame:
    documents = scan(spark, directory, "documents", spread=True).select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), "lang"
    )
    older = F.when(F.col("lang") == "es", F.concat("content", F.lit("."))).otherwise(F.col("content"))
    # A marked vector shows which embeddings were carried over.
    indexed = documents.where("lang <> 'fr'").select(
        "id",
        content_hash(older).alias("content_hash"),
        F.array(F.lit(-1.0).cast("float")).alias("embedding"),
    )
    synced = sync_index(documents.where("lang <> 'de'"), indexed)
    return synced.select("id", "source", "content_hash", (F.col("embedding")[0] == -1).alias("kept"))


@query(
    "topk_stored",
    f"""WITH RECURSIVE {_sql.chunks('documents', 'doc_id', 'text')},
        keyed AS (SELECT {CHUNK_KEY_SQL} AS id, content FROM chunk),
        {_sql.embedded('corpus', 'keyed', 'id', 'content')},
        {_sql.embedded('asked', 'benchmark', 'item_id', 'text')},
        {_sql.ranked('asked', 'corpus', 3)}
        SELECT query AS query_id, rk, id, content, score FROM hits JOIN keyed ON keyed.id = hits.key""",
)
def topk_stored(spark: SparkSession, directory: str) -> DataFrame:
    """An index written by cells, its k-means centroids; with all cells probed nothing is missed."""
    chunks = cut_lineage(_kept.chunks_of(spark, directory).select("id", "source", "content"))
    settings, first_path = Settings(), new_folder(spark, "index")
    first = refresh_index(chunks, settings, first_path)
    centroids = cut_lineage(S.train_centroids(first, 8))
    index = refresh_index(
        first.select("id", "source", "content"), settings, new_folder(spark, "index"), first_path, centroids=centroids
    )
    return S.topk_ann(embedded_benchmark(spark, directory), index, centroids, 3, nprobe=8, columns=["content"])
