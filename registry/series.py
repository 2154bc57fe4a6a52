"""Section F: monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orefold.operators import series as S
from registry.views import rounded, sales_lines, sales_orders, sql

MEASURES = ("amount", "quantity")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.monthly_series(sales_lines(spark, sf_dir), "transaction_date", MEASURES)


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lines(spark, sf_dir))


def growth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = S.add_growth(_lines(spark, sf_dir), MEASURES)
    kept = ["period"] + [f"{m}_{c}" for m in MEASURES for c in ("growth_pct", "trend")]
    return rounded(grown.select(*kept))


def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.monthly_series(sales_orders(spark, sf_dir), "order_date", ["amount"])
    grown = S.add_year_over_year(orders, ["amount"])
    return rounded(grown.select("period", "amount_yoy_growth_pct"))


def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trend_summary(S.add_growth(_lines(spark, sf_dir), MEASURES), MEASURES)


def filtered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.filtered_series(sales_lines(spark, sf_dir), {"region": "o"}, "quantity"))


def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = S.latest_period(S.add_growth(_lines(spark, sf_dir), ["amount"]))
    return rounded(latest.select("period", "row_count", "amount_growth_pct", "amount_trend"))


QUERIES = {
    "monthly_series": monthly_series,
    "growth_trend": growth_trend,
    "yoy_growth": yoy_growth,
    "trend_summary": trend_summary,
    "filtered_series": filtered_series,
    "latest_period": latest_period,
}

MONTHS = """
    SELECT strftime(transaction_date, '%Y-%m') AS period, count(*) AS row_count,
           sum(amount) AS amount_sum, avg(amount) AS amount_avg,
           sum(quantity) AS quantity_sum, avg(quantity) AS quantity_avg
    FROM sales_lines GROUP BY ALL"""


def _growth(measure: str) -> str:
    before = f"lag({measure}_sum) OVER (ORDER BY period)"
    return f"""CASE WHEN {before} <> 0
               THEN ({measure}_sum - {before}) / abs({before}) * 100 END"""


GROWN = f"""
    SELECT *, {_growth("amount")} AS amount_growth, {_growth("quantity")} AS quantity_growth
    FROM months"""
TREND = """CASE WHEN {0}_growth IS NULL THEN 'BASELINE' WHEN {0}_growth > 0 THEN 'UP'
                WHEN {0}_growth < 0 THEN 'DOWN' ELSE 'FLAT' END"""
_SUMMARY = """
    SELECT '{0}' AS measure, count(*) FILTER (WHERE {0}_growth > 0) AS rising,
           count(*) FILTER (WHERE {0}_growth < 0) AS falling, count({0}_growth) AS known,
           CASE WHEN count({0}_growth) = 0 THEN 'NO_DATA'
                WHEN rising > falling THEN 'UPWARD' WHEN rising < falling THEN 'DOWNWARD'
                ELSE 'MIXED' END AS trend FROM grown"""

ORACLE = {
    "monthly_series": sql(
        """SELECT period, CAST(period[1:4] AS INTEGER) AS year, CAST(period[6:7] AS INTEGER) AS month,
                  row_count, round(amount_sum + 1e-8, 4) AS amount_sum, round(amount_avg + 1e-8, 4) AS amount_avg,
                  round(quantity_sum + 1e-8, 4) AS quantity_sum, round(quantity_avg + 1e-8, 4) AS quantity_avg
           FROM months""",
        "sales_lines",
        months=MONTHS,
    ),
    "growth_trend": sql(
        f"""SELECT period, round(amount_growth + 1e-8, 4) AS amount_growth_pct,
                   {TREND.format("amount")} AS amount_trend,
                   round(quantity_growth + 1e-8, 4) AS quantity_growth_pct,
                   {TREND.format("quantity")} AS quantity_trend FROM grown""",
        "sales_lines",
        months=MONTHS,
        grown=GROWN,
    ),
    "yoy_growth": sql(
        """SELECT m.period, CASE WHEN y.s <> 0 THEN round((m.s - y.s) / abs(y.s) * 100 + 1e-8, 4) END
                  AS amount_yoy_growth_pct
           FROM months m LEFT JOIN months y ON y.d = m.d - INTERVAL 1 YEAR""",
        "sales_orders",
        months="""SELECT date_trunc('month', order_date) AS d,
                         strftime(order_date, '%Y-%m') AS period, sum(amount) AS s
                  FROM sales_orders GROUP BY ALL""",
    ),
    "trend_summary": sql(
        f"{_SUMMARY.format('amount')} UNION ALL {_SUMMARY.format('quantity')}",
        "sales_lines",
        months=MONTHS,
        grown=GROWN,
    ),
    "filtered_series": sql(
        """SELECT period, round(s + 1e-8, 4) AS metric,
                  CASE WHEN p <> 0 THEN round((s - p) / p * 100, 2) END AS growth_pct
           FROM (SELECT *, lag(s) OVER (ORDER BY period) AS p FROM
                 (SELECT strftime(transaction_date, '%Y-%m') AS period, sum(quantity) AS s
                  FROM sales_lines WHERE lower(trim(region)) = 'o' GROUP BY ALL))
           ORDER BY period DESC LIMIT 24""",
        "sales_lines",
    ),
    "latest_period": sql(
        f"""SELECT period, row_count, round(amount_growth + 1e-8, 4) AS amount_growth_pct,
                   {TREND.format("amount")} AS amount_trend
            FROM grown ORDER BY period DESC LIMIT 1""",
        "sales_lines",
        months=MONTHS,
        grown=GROWN,
    ),
}
