"""Sections E11, H and I1 to I8: breakdowns, comparisons, contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orefold.operators import breakdown as B
from registry.views import rounded, sales_lines, sales_orders, sql, union_all

DIMENSIONS = ("product", "category", "region")
FILTERS = {"category": "a", "region": "F"}


def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.breakdown(sales_lines(spark, sf_dir), "product", "amount"))


def top_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.breakdown(sales_orders(spark, sf_dir), "category", "amount", limit=3))


def bottom_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    return rounded(B.breakdown(lines, "product", "quantity", limit=5, bottom=True))


def filtered_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.breakdown(sales_lines(spark, sf_dir), "product", "amount", 10, FILTERS))


def cross_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.cross_breakdown(sales_lines(spark, sf_dir), "region", "product", "amount"))


def cross_breakdown_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    return rounded(
        B.cross_breakdown(lines, "product", "region", "quantity", 50, {"category": "R"})
    )


def top_bottom_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.top_and_bottom(sales_lines(spark, sf_dir), "product", "amount"))


def filtered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.filtered_summary(sales_lines(spark, sf_dir), "amount", FILTERS))


def compare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["part 1", "Part 10", " part 100 "]
    return rounded(B.compare_values(sales_lines(spark, sf_dir), "product", names, "amount"))


def contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.contribution(sales_lines(spark, sf_dir), "product", "amount"))


def dimension_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    return rounded(B.dimension_contributions(lines, DIMENSIONS, "quantity"))


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.contributors(sales_lines(spark, sf_dir), DIMENSIONS, "amount"))


QUERIES = {
    "breakdown": breakdown,
    "top_breakdown": top_breakdown,
    "bottom_breakdown": bottom_breakdown,
    "filtered_breakdown": filtered_breakdown,
    "cross_breakdown": cross_breakdown,
    "cross_breakdown_filtered": cross_breakdown_filtered,
    "top_bottom_product": top_bottom_product,
    "filtered_summary": filtered_summary,
    "compare_values": compare_values,
    "contribution": contribution,
    "dimension_contributions": dimension_contributions,
    "contributors": contributors,
}


def _breakdown(
    view: str, dimension: str, metric: str, limit: int | None, where: str = "true", order: str = "DESC"
) -> str:
    cut = f"LIMIT {limit}" if limit else ""
    return f"""
        SELECT row_number() OVER (ORDER BY s {order}, value) AS rank, value,
               round(s + 1e-8, 4) AS amount, round(s / sum(s) OVER () * 100 + 1e-8, 4) AS share_pct
        FROM (SELECT {dimension} AS value, sum({metric}) AS s FROM {view}
              WHERE {where} GROUP BY {dimension})
        ORDER BY s {order}, value {cut}"""


def _cross(parent: str, child: str, metric: str, limit: int, where: str = "true") -> str:
    return f"""
        SELECT row_number() OVER (ORDER BY s DESC, parent, child) AS rank, parent, child,
               round(s + 1e-8, 4) AS amount,
               round(s / sum(s) OVER (PARTITION BY parent) * 100 + 1e-8, 4) AS parent_share_pct
        FROM (SELECT {parent} AS parent, {child} AS child, sum({metric}) AS s
              FROM sales_lines WHERE {where} GROUP BY ALL)
        ORDER BY s DESC, parent, child LIMIT {limit}"""


_WHERE = "lower(trim(category)) = 'a' AND lower(trim(region)) = 'f'"
_SUMMARY = """count(*) AS row_count, round(sum(amount) + 1e-8, 4) AS total, round(avg(amount) + 1e-8, 4) AS average,
              round(min(amount) + 1e-8, 4) AS minimum, round(max(amount) + 1e-8, 4) AS maximum"""


def contributions_sql(metric: str) -> str:
    return union_all(
        [
            f"""SELECT '{d}' AS dimension, {d} AS value, sum({metric}) AS s
                FROM sales_lines GROUP BY {d}"""
            for d in DIMENSIONS
        ]
    )


CONTRIBUTORS = """
    SELECT dimension, value, s, share FROM (
      SELECT *, s / sum(s) OVER (PARTITION BY dimension) * 100 AS share,
             row_number() OVER (PARTITION BY dimension ORDER BY s DESC, value) AS r
      FROM contributions)
    WHERE r = 1 ORDER BY share DESC, dimension LIMIT 5"""

ORACLE = {
    "breakdown": sql(_breakdown("sales_lines", "product", "amount", 10), "sales_lines"),
    "top_breakdown": sql(_breakdown("sales_orders", "category", "amount", 3), "sales_orders"),
    "bottom_breakdown": sql(
        _breakdown("sales_lines", "product", "quantity", 5, order="ASC"), "sales_lines"
    ),
    "filtered_breakdown": sql(
        _breakdown("sales_lines", "product", "amount", 10, _WHERE), "sales_lines"
    ),
    "cross_breakdown": sql(_cross("region", "product", "amount", 20), "sales_lines"),
    "cross_breakdown_filtered": sql(
        _cross("product", "region", "quantity", 50, "lower(trim(category)) = 'r'"), "sales_lines"
    ),
    "top_bottom_product": sql(
        f"""SELECT CASE rank WHEN 1 THEN 'TOP' ELSE 'BOTTOM' END AS position, value, amount,
                   share_pct
            FROM (SELECT *, max(rank) OVER () AS last
                  FROM ({_breakdown("sales_lines", "product", "amount", None)}))
            WHERE rank = 1 OR rank = last""",
        "sales_lines",
    ),
    "filtered_summary": sql(f"SELECT {_SUMMARY} FROM sales_lines WHERE {_WHERE}", "sales_lines"),
    "compare_values": sql(
        f"""SELECT 'product' AS dimension, product AS value, {_SUMMARY} FROM sales_lines
            WHERE product IN ('part 1', 'part 10', 'part 100') GROUP BY product""",
        "sales_lines",
    ),
    "contribution": sql(_breakdown("sales_lines", "product", "amount", None), "sales_lines"),
    "dimension_contributions": sql(
        "SELECT dimension, value, round(s + 1e-8, 4) AS amount FROM contributions",
        "sales_lines",
        contributions=contributions_sql("quantity"),
    ),
    "contributors": sql(
        f"""SELECT dimension, value, round(s + 1e-8, 4) AS amount, round(share + 1e-8, 4) AS share_pct
            FROM ({CONTRIBUTORS})""",
        "sales_lines",
        contributions=contributions_sql("amount"),
    ),
}
