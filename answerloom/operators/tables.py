"""Questions answered from tables: curated queries, functions, table text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.columns import as_column
from answerloom.operators.projections import numbered
from answerloom.operators.routing import keyword_route
from answerloom.session import cut_lineage

NO_CURATED_QUERY = "no curated query"
# What would break a line or a cell of a text table, and what it is written as; the ampersand first.
CELL_SIGNS = (("&", "&amp;"), ("|", "&#124;"), ("\n", "&#10;"), ("\r", "&#13;"))
EDGE_BLANK = "&#32;"


# ---- curated queries -------------------------------------------------------


def count_documents(documents: DataFrame) -> DataFrame:
    """How many rows of documentation there are, per language and in total.

    The total is the row ``all``; documents without a language are a row of their own, NULL.
    """
    counts = documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    # The total comes from the few per-language counts, not from a second scan.
    summed = counts.rollup("lang").agg(F.sum("n_docs").alias("n_docs"), F.grouping("lang").alias("_total"))
    return summed.select(F.when(F.col("_total") == 1, "all").otherwise(F.col("lang")).alias("lang"), "n_docs")


def accounts_per_nation(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Accounts and balances per country, countries without customers included."""
    per_key = customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")
    )
    return nation.join(per_key, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("nation"),
        F.coalesce("n", F.lit(0)).alias("n_accounts"),
        F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("total_balance"),
    )


def orders_for_region(
    region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame, name: str
) -> DataFrame:
    """Orders of one region by market segment.

    The region picks the buyers first, so orders of others meet no aggregate; sums are made per
    segment before anything but the join is shuffled.
    """
    places = nation.join(
        region.where(F.col("r_name") == name), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    )
    buyers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return (
        orders.select("o_custkey", "o_totalprice")
        .join(
            buyers.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
        )
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.round(F.sum("o_totalprice"), 2).alias("total_price"),
        )
    )


def segment_summary(customer: DataFrame, orders: DataFrame, segment: str) -> DataFrame:
    """Orders of one market segment by status.

    Orders of other segments go before anything is grouped. Grouping by buyer first makes the
    number of buyers a plain count.
    """
    buyers = customer.where(F.col("c_mktsegment") == segment).select("c_custkey")
    return (
        orders.select("o_custkey", "o_orderstatus", "o_totalprice")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .groupBy("o_custkey", F.col("o_orderstatus").alias("status"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"))
        .groupBy("status")
        .agg(
            F.sum("n").alias("n_orders"),
            F.count(F.lit(1)).alias("n_customers"),
            F.round(F.sum("price"), 2).alias("total_price"),
        )
    )


# ---- asking ----------------------------------------------------------------


@dataclass(frozen=True)
class CuratedQuery:
    """A question the tables can answer: words it is known by and its result."""

    description: str
    keywords: Sequence[str]
    result: DataFrame
    order_by: Sequence[str]


def ask_table(
    questions: DataFrame, registry: Mapping[str, CuratedQuery], text: str = "question"
) -> DataFrame:
    """Add ``entry`` and ``response`` (description, line break, result table).

    Each curated result is rendered once and joined to however many questions ask for it. The
    join is left to the planner, which knows how large the rendered texts are.
    """
    rules = [(name, curated.keywords) for name, curated in registry.items()]
    matched = questions.withColumn("entry", keyword_route(text, rules))
    rendered = None
    for name, curated in registry.items():
        table = rows_to_markdown(curated.result, curated.result.columns, curated.order_by)
        one = table.select(
            F.lit(name).alias("entry"),
            F.concat(F.lit(curated.description + "\n"), F.col("markdown")).alias("response"),
        )
        rendered = one if rendered is None else rendered.unionByName(one)
    if rendered is None:
        raise ValueError("the registry is empty")
    return matched.join(cut_lineage(rendered), "entry", "left").withColumn(
        "response", F.coalesce("response", F.lit(NO_CURATED_QUERY))
    )


# ---- functions -------------------------------------------------------------


def register_functions(spark: SparkSession, definitions: Mapping[str, str]) -> None:
    """Create SQL functions from ``{"mul(a DOUBLE, b DOUBLE)": "a * b"}``.

    A body that is a query makes a table function: write the signature as
    ``"f(n INT) TABLE(x INT)"``.
    """
    for signature, body in definitions.items():
        head, table, columns = signature.partition(" TABLE")
        returns = f" RETURNS TABLE{columns}" if table else ""
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head}{returns} RETURN {body}")


def find_functions(spark: SparkSession, pattern: str) -> list[str]:
    """Names of user functions like ``pattern`` (``*`` matches anything)."""
    rows = spark.sql(f"SHOW USER FUNCTIONS LIKE '{pattern}'").collect()
    return sorted(row[0].split(".")[-1] for row in rows)


def call_function(name: str, *arguments: Column | str) -> Column:
    """A registered function applied to columns."""
    return F.call_function(name, *[as_column(a) for a in arguments])


# ---- table text ------------------------------------------------------------


def _written(cell: Column) -> Column:
    """A value as the text of a cell: NULL is empty, and nothing in it ends the cell or the line."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    for sign, reference in CELL_SIGNS:
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return F.regexp_replace(text, r"\A | \z", EDGE_BLANK)


def _read(cell: Column) -> Column:
    text = F.replace(F.trim(cell), F.lit(EDGE_BLANK), F.lit(" "))
    for sign, reference in reversed(CELL_SIGNS):
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return text


def _cells(line: Column) -> Column:
    """The cells of a line; a bar behind a backslash, as other writers put it, is part of its cell."""
    kept = F.replace(line, F.lit("\\|"), F.lit("&#124;"))
    inner = F.regexp_replace(kept, r"^\s*\||\|\s*\z", "")
    return F.transform(F.split(inner, r"\|", -1), _read)


def _fitted(cells: Column, names: Column) -> Column:
    """As many cells as there are names: missing ones are NULL, further ones are cut."""
    padded = F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.size(names)))
    return F.slice(padded, F.lit(1), F.size(names))


def markdown_to_rows(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Rows of a markdown table: the ``keep`` columns, ``row_ix``, ``names``, ``cells``.

    ``names`` and ``cells`` are arrays of one length, by position, so columns may share a name.
    Lines without a bar are skipped; rows shorter than the header are filled up with NULL, longer
    ones cut.
    """
    lines = F.filter(F.split(as_column(text), "\n"), lambda line: line.contains("|"))
    header = _cells(F.try_element_at(lines, F.lit(1)))
    is_rule = F.try_element_at(lines, F.lit(2)).rlike(r"^[\s|:-]+$")
    data = F.slice(lines, F.when(is_rule, F.lit(3)).otherwise(F.lit(2)), F.size(lines) + 1)
    parsed = df.select(*keep, header.alias("names"), F.posexplode(data).alias("row_ix", "_line"))
    return parsed.select(
        *keep,
        F.col("row_ix").cast("bigint").alias("row_ix"),
        "names",
        _fitted(_cells(F.col("_line")), F.col("names")).alias("cells"),
    )


def row_cells(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: the ``keep`` columns, ``row_ix``, ``col_ix``, ``column``, ``cell``."""
    pairs = F.arrays_zip(F.col("names").alias("column"), F.col("cells").alias("cell"))
    placed = rows.select(*keep, "row_ix", F.posexplode(pairs).alias("col_ix", "_pair"))
    return placed.select(
        *keep, "row_ix", F.col("col_ix").cast("bigint").alias("col_ix"), "_pair.column", "_pair.cell"
    )


def cell_named(name: str) -> Column:
    """The first cell of that name in a row of :func:`markdown_to_rows`; NULL if there is none."""
    place = F.array_position("names", name)
    return F.when(place > 0, F.get("cells", (place - 1).cast("int")))


def rows_to_json(names: Column | str = "names", cells: Column | str = "cells") -> Column:
    """A row of :func:`markdown_to_rows` as a JSON object; of cells with one name the first counts."""
    names = as_column(names)
    entries = F.zip_with(names, as_column(cells), lambda n, c: F.struct(n.alias("key"), c.alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.to_json(F.map_from_entries(first))


def _header_lines(names: Sequence[str]) -> list[str]:
    written = [name.replace("&", "&amp;").replace("|", "&#124;") for name in names]
    return ["| " + " | ".join(written) + " |", "|" + "|".join(" --- " for _ in names) + "|"]


def _line(columns: Sequence[str]) -> Column:
    cells = F.concat_ws(" | ", *[_written(F.col(f"`{c}`")) for c in columns])
    return F.concat(F.lit("| "), cells, F.lit(" |"))


def rows_to_lines(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """A table as text in long form: ``line_ix``, ``line``, header and rule first.

    Of any number of rows; they are numbered by ranges, not in one task.
    """
    head = df.sparkSession.createDataFrame(
        list(enumerate(_header_lines(columns))), "line_ix bigint, line string"
    )
    rows = numbered(df.select(*dict.fromkeys([*columns, *order_by])), order_by, "_place")
    return head.unionByName(
        rows.select((F.col("_place") + len(_header_lines(columns))).alias("line_ix"), _line(columns).alias("line"))
    )


def lines_to_rows(lines: DataFrame) -> DataFrame:
    """The rows of a table in long form: ``row_ix``, ``names``, ``cells``; line 0 is the header."""
    header = lines.where("line_ix = 0").select(_cells(F.col("line")).alias("names")).first()
    names = F.array(*[F.lit(name) for name in header["names"]] if header else [])
    return lines.where("line_ix > 1").select(
        (F.col("line_ix") - 2).alias("row_ix"),
        names.alias("names"),
        _fitted(_cells(F.col("line")), names).alias("cells"),
    )


def rows_to_markdown(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row, ``markdown``: a whole result table as one text, in the given order.

    One text is one value, so this is for results that a person or a model is to read;
    :func:`rows_to_lines` writes tables of any size.
    """
    order = ", ".join(f"`{c}`" for c in order_by)
    head = "\n".join(_header_lines(columns))
    gathered = (
        df.select(*dict.fromkeys([*columns, *order_by]))
        .withColumn("_line", _line(columns))
        .agg(F.expr(f"listagg(_line, '\\n') within group (order by {order})").alias("_lines"))
    )
    text = F.concat(F.lit(head), F.coalesce(F.concat(F.lit("\n"), F.col("_lines")), F.lit("")))
    return gathered.select(text.alias("markdown"))
