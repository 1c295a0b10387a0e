"""Checked queries: curated questions, functions, table text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.operators import tables as Q
from answerloom.registry._base import query
from answerloom.registry.messages import _QUESTIONS, _rule_sql, questions
from answerloom.sources import local_rows, scan


@query(
    "count_documents",
    """SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang
       UNION ALL SELECT 'all', count(*) FROM documents""",
)
def count_documents(spark: SparkSession, directory: str) -> DataFrame:
    return Q.count_documents(scan(spark, directory, "documents"))


@query(
    "accounts_per_nation",
    """SELECT n_name AS nation, count(c_custkey) AS n_accounts,
              round(coalesce(sum(c_acctbal), 0), 2) AS total_balance
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def accounts_per_nation(spark: SparkSession, directory: str) -> DataFrame:
    return Q.accounts_per_nation(scan(spark, directory, "customer"), scan(spark, directory, "nation"))


@query(
    "orders_for_region",
    """SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY c_mktsegment""",
)
def orders_for_region(spark: SparkSession, directory: str) -> DataFrame:
    tables = [scan(spark, directory, name) for name in ("region", "nation", "customer", "orders")]
    result = Q.orders_for_region(*tables, name="ASIA")
    return result.select("segment", F.col("n_orders").cast("bigint").alias("n_orders"), "total_price")


@query(
    "segment_summary",
    """SELECT o_orderstatus AS status, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers,
              round(sum(o_totalprice), 2) AS total_price
       FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'
       GROUP BY o_orderstatus""",
)
def segment_summary(spark: SparkSession, directory: str) -> DataFrame:
    return Q.segment_summary(scan(spark, directory, "customer"), scan(spark, directory, "orders"), "MACHINERY")


_ASK_RULES = (("languages", ("the",)), ("priorities", ("der", "die")))


@query(
    "asked_tables",
    f"""WITH {_QUESTIONS},
        languages AS (
          SELECT 'Documents per language' || chr(10) || '| lang | n_docs |' || chr(10) || '| --- | --- |' || chr(10)
            || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS response
          FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang
                UNION ALL SELECT 'all', count(*) FROM documents)),
        priorities AS (
          SELECT 'Orders per priority' || chr(10) || '| priority | n_orders |' || chr(10) || '| --- | --- |' || chr(10)
            || string_agg('| ' || p || ' | ' || n || ' |', chr(10) ORDER BY p) AS response
          FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)),
        matched AS (SELECT conv_id, text AS question, {_rule_sql(_ASK_RULES)} AS entry FROM question)
        SELECT conv_id, question, nullif(entry, 'general') AS entry,
               CASE entry WHEN 'languages' THEN (SELECT response FROM languages)
                          WHEN 'priorities' THEN (SELECT response FROM priorities)
                          ELSE 'no curated query' END AS response
        FROM matched""",
)
def asked_tables(spark: SparkSession, directory: str) -> DataFrame:
    priorities = (
        scan(spark, directory, "orders")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    registry = {
        "languages": Q.CuratedQuery(
            "Documents per language",
            _ASK_RULES[0][1],
            Q.count_documents(scan(spark, directory, "documents")),
            ["lang"],
        ),
        "priorities": Q.CuratedQuery(
            "Orders per priority", _ASK_RULES[1][1], priorities, ["priority"]
        ),
    }
    return Q.ask_table(questions(spark, directory), registry)


@query(
    "function_calls",
    "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS product, "
    "round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
)
def function_calls(spark: SparkSession, directory: str) -> DataFrame:
    Q.register_functions(
        spark,
        {
            "mul(a DOUBLE, b DOUBLE)": "a * b",
            "net_price(price DOUBLE, discount DOUBLE)": "price * (1 - discount)",
        },
    )
    return scan(spark, directory, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(Q.call_function("mul", "l_quantity", "l_extendedprice"), 4).alias("product"),
        F.round(Q.call_function("net_price", "l_extendedprice", "l_discount"), 4).alias("net"),
    )


@query(
    "table_function_calls",
    """SELECT r_name AS region, count(*) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey
       GROUP BY r_name""",
)
def table_function_calls(spark: SparkSession, directory: str) -> DataFrame:
    scan(spark, directory, "nation").createOrReplaceTempView("answerloom_nation")
    scan(spark, directory, "region").createOrReplaceTempView("answerloom_region")
    Q.register_functions(
        spark,
        {
            "nations_of(key INT) TABLE(n_nations BIGINT)": "SELECT count(*) FROM answerloom_nation "
            "WHERE n_regionkey = key"
        },
    )
    return spark.sql(
        "SELECT r_name AS region, f.n_nations FROM answerloom_region, LATERAL nations_of(r_regionkey) f"
    )


@query(
    "nation_table_text",
    "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, "
    "(row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS row_ix FROM nation",
)
def nation_table_text(spark: SparkSession, directory: str) -> DataFrame:
    nation = scan(spark, directory, "nation")
    rows = Q.lines_to_rows(Q.rows_to_lines(nation, nation.columns, ["n_nationkey"]))
    return rows.select("row_ix", *[Q.cell_named(name).alias(name) for name in nation.columns])


@query(
    "order_table_text",
    """SELECT row_ix, col_ix, name AS "column", cell FROM (
         SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_ix,
                unnest([0, 1, 2]) AS col_ix, unnest(['o_orderkey', 'note', 'priority']) AS name,
                unnest([o_orderkey::VARCHAR, ' ' || o_orderstatus || '|a&#124;b' || chr(10) || o_custkey || ' ',
                        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END]) AS cell
         FROM orders)""",
)
def order_table_text(spark: SparkSession, directory: str) -> DataFrame:
    """Cells with bars, references, line breaks, blanks at their ends and NULL, there and back."""
    note = F.concat(F.lit(" "), "o_orderstatus", F.lit("|a&#124;b\n"), F.col("o_custkey").cast("string"), F.lit(" "))
    orders = scan(spark, directory, "orders").select(
        "o_orderkey",
        note.alias("note"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    lines = Q.rows_to_lines(orders, orders.columns, ["o_orderkey"])
    cells = Q.row_cells(Q.lines_to_rows(lines))
    return cells.withColumn("col_ix", F.col("col_ix").cast("int"))


@query(
    "documents_without_language",
    """WITH d AS (SELECT nullif(lang, 'fr') AS lang FROM documents)
       SELECT lang, count(*) AS n_docs FROM d GROUP BY lang UNION ALL SELECT 'all', count(*) FROM d""",
)
def documents_without_language(spark: SparkSession, directory: str) -> DataFrame:
    """One language made NULL is counted as NULL and apart from the total."""
    return Q.count_documents(
        scan(spark, directory, "documents").withColumn("lang", F.expr("nullif(lang, 'fr')"))
    )


@query(
    "documents_by_label",
    """SELECT label, count(doc_id) AS n_docs FROM (VALUES ('en', 'English'), ('de', 'German'), ('xx', 'none')) l(lang, label)
       LEFT JOIN documents USING (lang) GROUP BY label""",
)
def documents_by_label(spark: SparkSession, directory: str) -> DataFrame:
    """Rows given by the caller, met with a table that is counted first."""
    labels = local_rows(spark, [("en", "English"), ("de", "German"), ("xx", "none")], "lang string, label string")
    counts = scan(spark, directory, "documents").groupBy("lang").agg(F.count("doc_id").alias("n"))
    return labels.join(counts, "lang", "left").select("label", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query(
    "customer_table_text",
    """SELECT c_custkey, 0::BIGINT AS row_ix, c_name AS name, c_mktsegment AS segment,
              '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS json FROM customer""",
)
def customer_table_text(spark: SparkSession, directory: str) -> DataFrame:
    line = F.concat(
        F.lit("Customer:\n\n| name | segment |\n|:---|---:|\n| "), "c_name", F.lit("|"), "c_mktsegment", F.lit(" |\n")
    )
    texts = scan(spark, directory, "customer").select("c_custkey", line.alias("text"))
    rows = Q.markdown_to_rows(texts, "text", ["c_custkey"])
    return rows.select(
        "c_custkey",
        "row_ix",
        Q.cell_named("name").alias("name"),
        Q.cell_named("segment").alias("segment"),
        Q.rows_to_json().alias("json"),
    )
