"""Section J: signals and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import gold as G
from orefold.operators import quality as Q
from orefold.operators import series as S
from orefold.operators import signals as J
from orefold.operators.breakdown import contributors
from orefold.session import materialize
from registry.breakdowns import CONTRIBUTORS, DIMENSIONS, contributions_sql
from registry.series import GROWN, MONTHS
from registry.views import rounded, sales_lines, sql, table

MEASURES = ("amount", "quantity")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    stats = lines.groupBy("product").agg(
        F.count("*").alias("row_count"),
        F.avg("amount").alias("amount_avg"),
        F.avg("quantity").alias("quantity_avg"),
    )
    return J.decisions(stats, ["product"], MEASURES, threshold=40000)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    series = S.monthly_series(lines, "transaction_date", MEASURES)
    # A balance total that is negative for a nation makes the quality signal.
    balances = table(spark, sf_dir, "customer").select(
        "c_nationkey", F.least("c_acctbal", F.lit(0.0)).alias("balance")
    )
    gold = materialize(G.simple_aggregate(balances, "c_nationkey", "balance"))
    return J.signals(S.add_growth(series, MEASURES), Q.gold_quality(gold))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_signals(spark, sf_dir))


def signal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.signal_actions(_signals(spark, sf_dir)).select("action")


def signal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.signal_state(_signals(spark, sf_dir))


def reasoning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    strongest = contributors(sales_lines(spark, sf_dir), DIMENSIONS, "amount")
    return J.reasoning_summary(_signals(spark, sf_dir), strongest, "amount")


QUERIES = {
    "decisions": decisions,
    "signals": signals,
    "signal_actions": signal_actions,
    "signal_state": signal_state,
    "reasoning_summary": reasoning_summary,
}

_LATEST = """
    SELECT amount_growth AS g, quantity_growth AS v,
           CASE WHEN amount_growth > 0 THEN 'UP' WHEN amount_growth < 0 THEN 'DOWN' END AS t
    FROM grown ORDER BY period DESC LIMIT 1"""
_QUALITY = """
    SELECT CASE WHEN count(*) FILTER (WHERE s < 0) > 0 THEN 'WARN' ELSE 'PASS' END AS q
    FROM (SELECT sum(least(c_acctbal, 0.0)) AS s FROM customer GROUP BY c_nationkey)"""
_FOUND = """
    SELECT 1 AS n, 'GROWTH' AS type, CASE WHEN g >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
           'Revenue acceleration' AS title, g AS value, NULL AS state,
           printf('Latest amount growth is %.2f%%.', g) AS message,
           'Break down the latest revenue increase by city, category and product.' AS action
    FROM latest WHERE g > 10
    UNION ALL
    SELECT 2, 'DECLINE', CASE WHEN g <= -30 THEN 'HIGH' ELSE 'MEDIUM' END, 'Revenue decline', g,
           NULL, printf('Latest amount growth is %.2f%%.', g),
           'Investigate the latest revenue decline by business dimensions and data freshness.'
    FROM latest WHERE g < -10
    UNION ALL
    SELECT 3, 'TREND', CASE t WHEN 'DOWN' THEN 'MEDIUM' ELSE 'INFO' END, 'Amount trend ' || t,
           NULL, t, 'Latest amount trend is ' || t || '.',
           CASE t WHEN 'DOWN' THEN 'Review the declining trend and identify the dimensions contributing most to the drop.' END
    FROM latest WHERE t IS NOT NULL
    UNION ALL
    SELECT 4, 'VOLUME', CASE WHEN v < 0 THEN 'MEDIUM' ELSE 'INFO' END, 'Volume movement', v, NULL,
           printf('Latest quantity growth is %.2f%%.', v),
           CASE WHEN v < 0 THEN 'Check transaction-volume drivers and investigate periods with falling quantity.'
                ELSE 'Compare volume growth with revenue growth to validate business performance.' END
    FROM latest WHERE abs(v) >= 10
    UNION ALL
    SELECT 5, 'QUALITY', 'HIGH', 'Gold quality issue', NULL, q,
           'Gold quality status is ' || q || '.',
           'Review the Gold quality issue before using the output for downstream decisions.'
    FROM quality WHERE q <> 'PASS'"""


def _found(body: str) -> str:
    return sql(
        body,
        "sales_lines",
        months=MONTHS,
        grown=GROWN,
        latest=_LATEST,
        quality=_QUALITY,
        found=_FOUND,
        contributions=contributions_sql("amount"),
    )


ORACLE = {
    "decisions": sql(
        """SELECT product, count(*) AS row_count,
                  CASE WHEN avg(amount) >= 40000 THEN 'HIGH AMOUNT' ELSE 'NORMAL AMOUNT' END
                  || ' | ' || CASE WHEN avg(quantity) >= 40000 THEN 'HIGH QUANTITY'
                                   ELSE 'NORMAL QUANTITY' END AS decision,
                  CASE WHEN avg(amount) >= 40000 THEN 'Monitor amount trend'
                       ELSE 'No immediate action for amount' END
                  || ' | ' || CASE WHEN avg(quantity) >= 40000 THEN 'Monitor quantity trend'
                                   ELSE 'No immediate action for quantity' END AS action
           FROM sales_lines GROUP BY product""",
        "sales_lines",
    ),
    "signals": _found(
        """SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS position, type, severity,
                  title, round(value + 1e-8, 4) AS value, state, message FROM found"""
    ),
    "signal_actions": _found(
        """SELECT action FROM (SELECT action, min(n) AS n FROM found WHERE action IS NOT NULL
                               GROUP BY action ORDER BY 2 LIMIT 4)"""
    ),
    "signal_state": _found(
        """SELECT count(*) AS signals, count(*) FILTER (WHERE severity = 'HIGH') AS high,
                  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
                  CASE WHEN high > 0 THEN 'ACTION REQUIRED' WHEN medium > 0 THEN 'REVIEW'
                       ELSE 'MONITOR' END AS state FROM found"""
    ),
    "reasoning_summary": _found(
        f"""SELECT CASE WHEN g > 10 THEN printf('Latest business value increased by %.2f%%.', g)
                        WHEN g < -10 THEN printf('Latest business value changed by %.2f%%.', g)
                        WHEN t IS NOT NULL THEN 'Latest business trend is ' || t || '.'
                        ELSE 'No strong directional signal was detected.' END AS headline,
                   (SELECT 'The strongest visible contributor is ' || dimension || '=' || value
                           || printf(', representing %.2f%% of the available amount total.', share)
                    FROM ({CONTRIBUTORS}) ORDER BY share DESC, dimension LIMIT 1) AS contributor
            FROM latest"""
    ),
}
