"""Checked queries: scans, projections, parsing, chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.chunking import chunk_documents
from answerloom.functions.text import (
    decode_references,
    html_to_text,
    mime_type,
    sentences,
    token_count,
)
from answerloom.operators.projections import head_by, map_columns
from answerloom.registry import _sql
from answerloom.registry._base import query
from answerloom.session import cut_lineage, new_folder
from answerloom.sources import append_rows, ensure_chunk_table, overwrite_table, read_files_stream, scan
from answerloom.streaming.ingest import append_files, rejected_rows, run_chunk_job


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


def _html_sql(column: str) -> str:
    """The text of a page, step by step as it is defined; the pages hold four character references."""
    text = _replaced(column, (r"(?s)<!--.*?-->", "' '"))
    for part in ("head", "script", "style", "nav", "noscript", "template"):
        text = _replaced(text, (rf"(?is)<{part}\b[^>]*>.*?</{part}\s*>", "' '"))
    text = _replaced(text, (r"\s+", "' '"))
    for level in range(1, 7):
        text = _replaced(text, (rf"(?i)<h{level}\b[^>]*>", f"chr(10) || chr(10) || '{'#' * level} '"))
    blocks = "p|div|article|section|header|footer|main|aside|ul|ol|table|blockquote|pre|form|body|html|h[1-6]"
    text = _replaced(
        text,
        (r"(?i)<li\b[^>]*>", "chr(10) || '- '"),
        (r"(?i)<tr\b[^>]*>", "chr(10) || '| '"),
        (r"(?i)</t[dh]\s*>", "' | '"),
        (r"(?i)<br\b[^>]*>", "chr(10)"),
        (rf"(?i)</?(?:{blocks})\b[^>]*>", "chr(10) || chr(10)"),
        (r"</?[A-Za-z!][^>]*>", "''"),
    )
    for reference, code in (("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)):
        text = f"replace({text}, '&{reference};', chr({code}))"
    text = _replaced(text, (r"[ \t\r\f]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"))
    return f"trim({text}, {_sql.BLANKS})"


@query(
    "scan_tables",
    "SELECT 'documents' AS name, count(*) AS n_rows, sum(len(text))::BIGINT AS n_chars FROM documents "
    "UNION ALL SELECT 'pages', count(*), sum(len(html))::BIGINT FROM pages "
    "UNION ALL SELECT 'conversations', count(*), sum(len(text))::BIGINT FROM conversations "
    "UNION ALL SELECT 'benchmark', count(*), sum(len(text))::BIGINT FROM benchmark",
)
def scan_tables(spark: SparkSession, directory: str) -> DataFrame:
    parts = [
        scan(spark, directory, name).agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.length(text)).alias("n_chars"),
        )
        for name, text in (
            ("documents", "text"),
            ("pages", "html"),
            ("conversations", "text"),
            ("benchmark", "text"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "mime_type_of_pages",
    r"""SELECT page_id, url, CASE WHEN regexp_matches(url, '://[^/?#]+/[^?#]*[.]html?([?#]|\z)') THEN 'text/html' END AS mime_type
        FROM pages""",
)
def mime_type_of_pages(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory, "pages").select("page_id", "url", mime_type("url").alias("mime_type"))


_SUFFIXES = (".html", ".PDF?x=a.txt", ".tar.gz", ".unheard", "/", ".txt#y.pdf", "/.json", ".jpeg")


@query(
    "mime_types_by_suffix",
    """SELECT page_id, ['text/html', 'application/pdf', 'application/x-tar', NULL, NULL, 'text/plain', NULL,
                         'image/jpeg'][1 + page_id % 8] AS mime_type FROM pages""",
)
def mime_types_by_suffix(spark: SparkSession, directory: str) -> DataFrame:
    """Page addresses with endings of many kinds."""
    bare = F.regexp_replace("url", r"[?#].*", "")
    path = F.concat(bare, F.lit("x"), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % 8 + 1).cast("int")))
    return scan(spark, directory, "pages").select("page_id", mime_type(path).alias("mime_type"))


@query(
    "decoded_references",
    """SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')
              || ' — é &nobody; � &lt;' AS html FROM pages""",
)
def decoded_references(spark: SparkSession, directory: str) -> DataFrame:
    """The references of the pages, those by name partly made numbers, and some more."""
    html = F.col("html")
    for name, number in (("&copy;", "&#169;"), ("&middot;", "&#xB7;")):
        html = F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit(name), F.lit(number))).otherwise(html)
    more = F.concat(html, F.lit("&nbsp;&#8212;&#160;&eacute; &nobody; &#xD800; &amp;lt;"))
    return scan(spark, directory, "pages").select("page_id", decode_references(more).alias("html"))


@query("rename_and_prune", "SELECT url AS source, html AS content FROM pages")
def rename_and_prune(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory, "pages").selectExpr("url as source", "html as content")


@query("map_columns", "SELECT doc_id AS id, text AS content, source AS doc_uri, lang FROM documents")
def map_document_columns(spark: SparkSession, directory: str) -> DataFrame:
    documents = scan(spark, directory, "documents").drop("n_chars")
    return map_columns(documents, id="doc_id", content="text", doc_uri="source")


@query(
    "first_documents",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 500",
)
def first_documents(spark: SparkSession, directory: str) -> DataFrame:
    return head_by(scan(spark, directory, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 500)


@query("page_text", f"SELECT page_id, {_html_sql('html')} AS content FROM pages")
def page_text(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory, "pages", spread=True).select("page_id", html_to_text("html").alias("content"))


@query(
    "document_sentences",
    f"""SELECT doc_id, (generate_subscripts(ss, 1) - 1)::BIGINT AS sentence_ix, unnest(ss) AS sentence
        FROM (SELECT doc_id, {_sql.sentence_list('text')} AS ss FROM documents)""",
)
def document_sentences(spark: SparkSession, directory: str) -> DataFrame:
    found = sentences(scan(spark, directory, "documents", spread=True), "text", ["doc_id"])
    return found.withColumn("sentence_ix", F.col("sentence_ix").cast("bigint"))


@query(
    "document_chunks",
    f"""WITH RECURSIVE {_sql.chunks('documents', 'doc_id', 'text')}
        SELECT key AS doc_id, chunk_ix, content,
               len(regexp_extract_all(content, '\\S+'))::BIGINT AS n_tokens FROM chunk""",
)
def document_chunks(spark: SparkSession, directory: str) -> DataFrame:
    chunks = chunk_documents(scan(spark, directory, "documents", spread=True), "text", ["doc_id"])
    return chunks.select(
        "doc_id",
        F.col("chunk_ix").cast("bigint").alias("chunk_ix"),
        "content",
        token_count("content").alias("n_tokens"),
    )


@query(
    "page_chunks",
    f"""WITH RECURSIVE page AS (SELECT page_id, {_html_sql('html')} AS content FROM pages),
        {_sql.chunks('page', 'page_id', 'content', 100, 10)}
        SELECT p.url AS source, c.chunk_ix, c.content FROM chunk c JOIN pages p ON p.page_id = c.key""",
)
def page_chunks(spark: SparkSession, directory: str) -> DataFrame:
    parsed = scan(spark, directory, "pages", spread=True).select(
        F.col("url").alias("source"), html_to_text("html").alias("parsed")
    )
    chunks = chunk_documents(parsed, "parsed", ["source"], 100, 10)
    return chunks.withColumn("chunk_ix", F.col("chunk_ix").cast("bigint"))


# ---- incremental jobs --------------------------------------------------------


def _raw_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages as raw files: every third has content that is no HTML, no UTF-8 or NULL."""
    page = F.col("page_id")
    broken = (
        F.when(page % 9 == 0, F.encode("url", "UTF-8"))
        .when(page % 9 == 3, F.unhex(F.lit("FFFE3C703E")))
        .when(page % 9 == 6, F.lit(None).cast("binary"))
    )
    content = F.when(page % 3 != 0, F.encode("html", "UTF-8")).otherwise(broken)
    return scan(spark, directory, "pages").select(
        F.col("url").alias("path"), content.alias("content"), mime_type("url").alias("mime_type"), "page_id"
    )


@query(
    "ingested_pages",
    f"""WITH RECURSIVE page AS (SELECT page_id, {_html_sql('html')} AS content FROM pages WHERE page_id % 3 <> 0),
        {_sql.chunks('page', 'page_id', 'content', 100, 10)}
        SELECT p.url AS source, c.chunk_ix, c.content, NULL::VARCHAR AS reason
        FROM chunk c JOIN pages p ON p.page_id = c.key
        UNION ALL
        SELECT url, NULL, NULL, CASE page_id % 9 WHEN 0 THEN 'not HTML' WHEN 3 THEN 'not UTF-8' ELSE 'no content' END
        FROM pages WHERE page_id % 3 = 0""",
)
def ingested_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Raw rows come in twice and are chunked by a stream after each time; a third run finds nothing."""
    suffix = uuid.uuid4().hex
    raw, chunks, rejects = (f"answerloom_{name}_{suffix}" for name in ("raw", "chunks", "rejects"))
    pages, checkpoint = _raw_pages(spark, directory), new_folder(spark, "chunk-checkpoint")
    ensure_chunk_table(spark, spark.catalog.currentDatabase(), chunks)
    try:
        overwrite_table(pages.where("page_id % 2 = 0").drop("page_id"), raw)
        run_chunk_job(spark, raw, chunks, checkpoint, 100, 10, reject_table=rejects)
        append_rows(pages.where("page_id % 2 = 1").drop("page_id"), raw)
        for _ in range(2):
            run_chunk_job(spark, raw, chunks, checkpoint, 100, 10, reject_table=rejects)
        read = spark.table(chunks).select("source", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), "content")
        rejected = spark.table(rejects).select("source", "reason")
        return cut_lineage(read.unionByName(rejected, allowMissingColumns=True))
    finally:
        for table in (raw, chunks, rejects):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


@query(
    "rejected_pages",
    """SELECT url AS source, CASE page_id % 9 WHEN 0 THEN 'not HTML' WHEN 3 THEN 'not UTF-8' ELSE 'no content' END AS reason
       FROM pages WHERE page_id % 3 = 0""",
)
def rejected_pages(spark: SparkSession, directory: str) -> DataFrame:
    return rejected_rows(_raw_pages(spark, directory)).select("source", "reason")


@query("listed_files")
def listed_files(spark: SparkSession, directory: str) -> DataFrame:
    """The folder's files by a file stream, in two runs; only names and sizes are read."""
    path, checkpoint = new_folder(spark, "files"), new_folder(spark, "files-checkpoint")
    for _ in range(2):
        files = read_files_stream(spark, directory, "*.parquet", max_files=5)
        append_files(files.select("path", "length", mime_type("path").alias("mime_type")), path, checkpoint)
    return spark.read.parquet(path)
