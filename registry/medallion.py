"""The whole flow from raw text to gold, with measures: each product of one run."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.plans.medallion import MedallionRun, run_table
from orefold.session import scratch_path
from registry.gold import _statistics
from registry.series import _SUMMARY, GROWN, TREND
from registry.views import priced_orders, rounded, sql


@lru_cache(4)
def _run_once(application: str, sf_dir: str) -> MedallionRun:
    spark = SparkSession.active()
    return run_table(priced_orders(spark, sf_dir), scratch_path(spark, "priced"))


def _product(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the run, which the queries of a session share."""
    run = _run_once(spark.conf.get("spark.app.id", ""), sf_dir)
    return spark.read.parquet(run.silver if name == "silver" else run.gold[name])


def medallion_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_product(spark, sf_dir, "silver"))


def medallion_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_product(spark, sf_dir, "analytics").drop("_gold_engine_version"))


def medallion_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_product(spark, sf_dir, "time_series"))


def medallion_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, "trends")


def medallion_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, "insights")


def medallion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product(spark, sf_dir, "decisions")


def medallion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score, gate and validation of the run as one row."""
    run = _run_once(spark.conf.get("spark.app.id", ""), sf_dir)
    return spark.range(1).select(
        F.lit(run.quality["row_count"]).cast("bigint").alias("row_count"),
        F.lit(run.quality["failed_checks"]).cast("bigint").alias("failed_checks"),
        F.lit(run.quality["status"]).alias("status"),
        F.lit(run.stopped_by is None).alias("finished"),
        F.lit(bool(run.validation["valid"])).alias("valid"),
    )


QUERIES = {
    "medallion_silver": medallion_silver,
    "medallion_analytics": medallion_analytics,
    "medallion_series": medallion_series,
    "medallion_trends": medallion_trends,
    "medallion_insights": medallion_insights,
    "medallion_decisions": medallion_decisions,
    "medallion_checks": medallion_checks,
}

_MEASURES = ("amount", "quantity")
_GROUPS = f"""
    SELECT status, category, count(*) AS row_count,
           sum(amount) AS amount_s, avg(amount) AS amount_a,
           sum(quantity) AS quantity_s, avg(quantity) AS quantity_a,
           count(DISTINCT moment) AS order_date_distinct_count,
           {_statistics("amount")}, {_statistics("quantity")}
    FROM priced_orders GROUP BY status, category"""


def _derived(m: str) -> str:
    share = f"{m}_s / sum({m}_s) OVER () * 100"
    rank = f"row_number() OVER (ORDER BY {m}_s DESC, status, category NULLS FIRST)"
    z = f"abs(({m}_a - avg({m}_a) OVER ()) / stddev_pop({m}_a) OVER ())"
    return f"""round({share} + 1e-8, 4) AS {m}_percentage,
        round({share} + 1e-8, 4) AS {m}_share_pct,
        CASE WHEN {m}_s >= sum({m}_s) OVER () / count(*) OVER () THEN 'HIGH' ELSE 'LOW'
        END AS {m}_performance, {rank} AS {m}_rank, {rank} <= 10 AS {m}_top_10,
        {rank} > count(*) OVER () - 10 AS {m}_bottom_10,
        round({z} + 1e-8, 4) AS {m}_z_score, {z} >= 2.0 AS {m}_anomaly"""


_MONTHS = """
    SELECT strftime(moment, '%Y-%m') AS period, count(*) AS row_count,
           sum(amount) AS amount_sum, avg(amount) AS amount_avg,
           sum(quantity) AS quantity_sum, avg(quantity) AS quantity_avg
    FROM priced_orders GROUP BY ALL"""


def _monthly(m: str) -> str:
    yoy = f"y.{m}_sum"
    return f"""round(g.{m}_sum + 1e-8, 4) AS {m}_sum, round(g.{m}_avg + 1e-8, 4) AS {m}_avg,
        round(g.{m}_growth + 1e-8, 4) AS {m}_growth_pct,
        {TREND.format("g." + m)} AS {m}_trend,
        CASE WHEN {yoy} <> 0 THEN round((g.{m}_sum - {yoy}) / abs({yoy}) * 100 + 1e-8, 4) END
        AS {m}_yoy_growth_pct"""


def _best(m: str) -> str:
    return f"""
        SELECT '{m}' AS measure, concat_ws(', ', 'status=' || status, 'category=' || category)
          || ' has the highest {m}_sum (' || printf('%.2f', CAST({m}_s AS DOUBLE)) || ').' AS insight
        FROM (SELECT * FROM groups_ ORDER BY {m}_s DESC, status, category NULLS FIRST LIMIT 1)"""


def _decided(m: str, high: str, low: str) -> str:
    return f"CASE WHEN {m}_a >= 60000 THEN {high} ELSE {low} END"


ORACLE = {
    "medallion_silver": sql(
        """SELECT order_id, customer_id, status, category, round(amount + 1e-8, 4) AS amount, quantity,
                  strftime(moment, '%Y-%m-%d %H:%M:%S') AS order_date FROM priced_orders""",
        "priced_orders",
    ),
    "medallion_analytics": sql(
        f"""SELECT * EXCLUDE (amount_s, amount_a, quantity_s, quantity_a),
                   {_derived("amount")}, {_derived("quantity")},
                   'PASS' AS _gold_quality_status, 'PASS' AS _reconciliation_status
            FROM groups_""",
        "priced_orders",
        groups_=_GROUPS,
    ),
    "medallion_series": sql(
        f"""SELECT g.period, CAST(g.period[1:4] AS INTEGER) AS year,
                   CAST(g.period[6:7] AS INTEGER) AS month, g.row_count,
                   {_monthly("amount")}, {_monthly("quantity")}
            FROM grown g LEFT JOIN months y ON y.period =
              CAST(CAST(g.period[1:4] AS INTEGER) - 1 AS VARCHAR) || g.period[5:7]""",
        "priced_orders",
        months=_MONTHS,
        grown=GROWN,
    ),
    "medallion_trends": sql(
        f"{_SUMMARY.format('amount')} UNION ALL {_SUMMARY.format('quantity')}",
        "priced_orders",
        months=_MONTHS,
        grown=GROWN,
    ),
    "medallion_insights": sql(
        f"SELECT * FROM ({_best('amount')}) UNION ALL SELECT * FROM ({_best('quantity')})",
        "priced_orders",
        groups_=_GROUPS,
    ),
    "medallion_decisions": sql(
        f"""SELECT status, category, row_count,
               {_decided("amount", "'HIGH AMOUNT'", "'NORMAL AMOUNT'")} || ' | ' ||
               {_decided("quantity", "'HIGH QUANTITY'", "'NORMAL QUANTITY'")} AS decision,
               {_decided("amount", "'Monitor amount trend'", "'No immediate action for amount'")}
               || ' | ' ||
               {_decided("quantity", "'Monitor quantity trend'", "'No immediate action for quantity'")}
               AS action FROM groups_""",
        "priced_orders",
        groups_=_GROUPS,
    ),
    "medallion_checks": sql(
        """SELECT count(*) AS row_count, CAST(1 AS BIGINT) AS failed_checks, 'FAIL' AS status,
                  true AS finished, true AS valid FROM priced_orders""",
        "priced_orders",
    ),
}
