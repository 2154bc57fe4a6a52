"""Sections E, G, H: grouped statistics, shares, anomalies, KPIs, ranks, insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import gold as G
from orefold.plans import gold as plan
from orefold.plans.medallion import run_table
from orefold.session import materialize, scratch_path
from registry.views import dirty_orders, rounded, sales_lines, sales_orders, sql, table

SEGMENT = ("category", "region")
MEASURES = ("amount", "quantity")


def simple_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return rounded(G.simple_aggregate(customers, "c_mktsegment", "c_acctbal"))


def gold_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.group_stats(sales_lines(spark, sf_dir), SEGMENT, MEASURES))


def gold_group_stats_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics however the rows lie in partitions."""
    lines = sales_lines(spark, sf_dir).repartition(16)
    return rounded(G.group_stats(lines, SEGMENT, MEASURES))


def gold_group_stats_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of a measure with ties and with infinities at both ends."""
    number = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("mode"),
        F.when(number == 1, float("inf"))
        .when((number == 2) & (F.col("l_quantity") > 25), float("-inf"))
        .otherwise(F.col("l_quantity"))
        .alias("value"),
    )
    stats = G.group_stats(lines, ["mode"], ["value"])
    return rounded(stats.drop("value_sum", "value_avg", "value_stddev"))


def gold_group_stats_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    return rounded(G.group_stats(lines, ["product"], ["quantity"]))


def gold_group_stats_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by a column with gaps, measuring text that partly does not parse."""
    return rounded(G.group_stats(dirty_orders(spark, sf_dir), ["category"], ["amount"]))


def gold_global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.group_stats(sales_lines(spark, sf_dir), [], MEASURES))


def gold_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    stats = G.group_stats(lines, SEGMENT, [], ["product", "order_id"])
    return stats


def gold_distinct_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = dirty_orders(spark, sf_dir)
    return G.distinct_counts(dirty, [], ["category", "customer_id", "order_date"])


def _written(
    spark: SparkSession, sf_dir: str, dimensions: Sequence[str], measures: Sequence[str]
) -> tuple[DataFrame, G.GoldTotals]:
    numbers = sales_lines(spark, sf_dir).select(*dimensions, *measures)
    sums = [F.sum(m).alias(f"{m}_sum") for m in measures]
    averages = [F.avg(m).alias(f"{m}_avg") for m in measures]
    grouped = numbers.groupBy(*dimensions).agg(
        F.count("*").alias("row_count"), *sums, *averages
    )
    gold = materialize(grouped)
    return gold, G.gold_totals(gold, measures)


def percentage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, totals = _written(spark, sf_dir, ["product"], MEASURES)
    shares = G.add_percentage_share(gold, MEASURES, totals)
    return rounded(shares.select("product", "amount_percentage", "quantity_percentage"))


def kpi_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, totals = _written(spark, sf_dir, ["product"], ["amount"])
    kpis = G.add_kpis(gold, ["amount"], totals)
    return rounded(kpis.select("product", "amount_share_pct", "amount_performance"))


def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, totals = _written(spark, sf_dir, ["product"], ["amount"])
    flagged = G.add_anomaly_flags(gold, ["amount"], totals)
    return rounded(flagged.select("product", "amount_z_score", "amount_anomaly"))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, totals = _written(spark, sf_dir, ["product", "category"], MEASURES)
    return rounded(G.add_rankings(gold, ["product", "category"], MEASURES, totals)).drop(
        "amount_avg", "quantity_avg"
    )


def performance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, totals = _written(spark, sf_dir, ["product"], ["amount"])
    return G.performance_counts(G.add_kpis(gold, ["amount"], totals), "amount")


def top_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _ = _written(spark, sf_dir, SEGMENT, ["amount"])
    return rounded(G.top_segment(gold, SEGMENT, "amount"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _ = _written(spark, sf_dir, ["product", "region"], MEASURES)
    return G.insights(gold, ["product", "region"], MEASURES)


def gold_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    layout = plan.GoldLayout(SEGMENT, MEASURES)
    gold, _, _ = plan.checked_analytics(lines, lines, layout)
    return rounded(G.gold_kpis(gold))


def gold_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = plan.GoldLayout(("status", "category"), ("amount",), ("customer_id",))
    gold = plan.analytics(sales_orders(spark, sf_dir), layout)
    return rounded(gold)


def medallion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text to silver and gold, read back from the written time series."""
    run = run_table(dirty_orders(spark, sf_dir), scratch_path(spark, "medallion"))
    return rounded(spark.read.parquet(run.gold["time_series"]))


QUERIES = {
    "simple_aggregate": simple_aggregate,
    "gold_group_stats": gold_group_stats,
    "gold_group_stats_spread": gold_group_stats_spread,
    "gold_group_stats_infinite": gold_group_stats_infinite,
    "gold_group_stats_by_product": gold_group_stats_by_product,
    "gold_group_stats_dirty": gold_group_stats_dirty,
    "gold_global_stats": gold_global_stats,
    "gold_distinct_counts": gold_distinct_counts,
    "gold_distinct_totals": gold_distinct_totals,
    "percentage_share": percentage_share,
    "kpi_performance": kpi_performance,
    "anomaly_flags": anomaly_flags,
    "ranking": ranking,
    "performance_counts": performance_counts,
    "top_segment": top_segment,
    "insights": insights,
    "gold_kpis": gold_kpis,
    "gold_analytics": gold_analytics,
    "medallion_run": medallion_run,
}


def _statistics(measure: str) -> str:
    return f"""
        round(sum({measure}) + 1e-8, 4) AS {measure}_sum, round(avg({measure}) + 1e-8, 4) AS {measure}_avg,
        round(min({measure}) + 1e-8, 4) AS {measure}_min, round(max({measure}) + 1e-8, 4) AS {measure}_max,
        round(stddev_pop({measure}) + 1e-8, 4) AS {measure}_stddev,
        round(median({measure}) + 1e-8, 4) AS {measure}_median,
        round(quantile_cont({measure}, 0.25) + 1e-8, 4) AS {measure}_p25,
        round(quantile_cont({measure}, 0.75) + 1e-8, 4) AS {measure}_p75,
        round(quantile_cont({measure}, 0.95) + 1e-8, 4) AS {measure}_p95"""


_GROUP_STATS = sql(
    f"""SELECT category, region, count(*) AS row_count, {_statistics("amount")},
               {_statistics("quantity")} FROM sales_lines GROUP BY category, region""",
    "sales_lines",
)
_INFINITE = """
    SELECT l_returnflag AS mode, CASE WHEN l_linenumber = 1 THEN CAST('inf' AS DOUBLE)
      WHEN l_linenumber = 2 AND l_quantity > 25 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity END AS x
    FROM lineitem"""
_PLACED = """
    SELECT mode, x, row_number() OVER (PARTITION BY mode ORDER BY x) - 1 AS r,
           count(*) OVER (PARTITION BY mode) - 1 AS n FROM infinite"""


def _percentile(p: float, name: str) -> str:
    low = f"max(CASE WHEN r = floor(n * {p}) THEN x END)"
    high = f"max(CASE WHEN r = ceil(n * {p}) THEN x END)"
    weight = f"(max(n) * {p} - floor(max(n) * {p}))"
    return f"""round(CASE WHEN {low} = {high} THEN {low}
        ELSE {low} + ({high} - {low}) * {weight} END + 1e-8, 4) AS value_{name}"""


_BY_PRODUCT = """
    SELECT product, count(*) AS row_count, sum(amount) AS amount_sum, avg(amount) AS amount_avg,
           sum(quantity) AS quantity_sum FROM sales_lines GROUP BY product"""
_LABELLED = """
    SELECT product, amount_sum / sum(amount_sum) OVER () * 100 AS share,
           CASE WHEN amount_avg > 0 THEN
             CASE WHEN amount_sum >= sum(amount_sum) OVER () / count(*) OVER () THEN 'HIGH'
                  ELSE 'LOW' END END AS label FROM by_product"""
_BY_PAIR = """
    SELECT product, category, count(*) AS row_count, sum(amount) AS amount_sum,
           sum(quantity) AS quantity_sum FROM sales_lines GROUP BY product, category"""
_RANKS = """
    SELECT *, count(*) OVER () AS n,
           row_number() OVER (ORDER BY amount_sum DESC, product, category) AS amount_rank,
           row_number() OVER (ORDER BY quantity_sum DESC, product, category) AS quantity_rank
    FROM by_pair"""
_INSIGHT = """
    SELECT '{0}' AS measure, 'product=' || product || ', region=' || region
           || ' has the highest {0}_sum (' || printf('%.2f', sum({0})) || ').' AS insight
    FROM sales_lines GROUP BY product, region ORDER BY sum({0}) DESC, product, region LIMIT 1"""
_ORDER_GROUPS = f"""
    SELECT status, category, count(*) AS row_count, sum(amount) AS s, avg(amount) AS a,
           count(DISTINCT customer_id) AS customer_id_distinct_count, {_statistics("amount")}
    FROM sales_orders GROUP BY status, category"""
_MONTHS = """
    SELECT strftime(d, '%Y-%m') AS period, CAST(year(d) AS INTEGER) AS year,
           CAST(month(d) AS INTEGER) AS month, count(*) AS row_count
    FROM (SELECT CASE WHEN regexp_matches(order_date, '^[0-9]{4}-') THEN strptime(order_date, '%Y-%m-%d')
                      WHEN regexp_matches(order_date, '^[0-9]{4}/') THEN strptime(order_date, '%Y/%m/%d')
                      WHEN contains(order_date, '-') THEN strptime(order_date, '%d-%m-%Y')
                      ELSE strptime(order_date, '%d/%m/%Y') END AS d FROM dirty_orders)
    GROUP BY ALL"""

ORACLE = {
    "simple_aggregate": """
        SELECT c_mktsegment, count(*) AS row_count, round(sum(c_acctbal) + 1e-8, 4) AS c_acctbal_sum,
               round(avg(c_acctbal) + 1e-8, 4) AS c_acctbal_avg FROM customer GROUP BY c_mktsegment""",
    "gold_group_stats": _GROUP_STATS,
    "gold_group_stats_spread": _GROUP_STATS,
    "gold_group_stats_infinite": sql(
        f"""SELECT mode, count(*) AS row_count, min(x) AS value_min, max(x) AS value_max,
                   {_percentile(0.5, "median")}, {_percentile(0.25, "p25")},
                   {_percentile(0.75, "p75")}, {_percentile(0.95, "p95")}
            FROM placed GROUP BY mode""",
        infinite=_INFINITE,
        placed=_PLACED,
    ),
    "gold_group_stats_by_product": sql(
        f"""SELECT product, count(*) AS row_count, {_statistics("quantity")}
            FROM sales_lines GROUP BY product""",
        "sales_lines",
    ),
    "gold_group_stats_dirty": sql(
        f"""SELECT category, count(*) AS row_count, {_statistics("amount")}
            FROM (SELECT category, try_cast(amount AS DOUBLE) AS amount FROM dirty_orders)
            GROUP BY category""",
        "dirty_orders",
    ),
    "gold_global_stats": sql(
        f"""SELECT count(*) AS row_count, {_statistics("amount")}, {_statistics("quantity")}
            FROM sales_lines""",
        "sales_lines",
    ),
    "gold_distinct_counts": sql(
        """SELECT category, region, count(*) AS row_count,
                  count(DISTINCT product) AS product_distinct_count,
                  count(DISTINCT order_id) AS order_id_distinct_count
           FROM sales_lines GROUP BY category, region""",
        "sales_lines",
    ),
    "gold_distinct_totals": sql(
        """SELECT count(DISTINCT nullif(category, '')) AS category_distinct_total,
                  count(DISTINCT customer_id) AS customer_id_distinct_total,
                  count(DISTINCT order_date) AS order_date_distinct_total FROM dirty_orders""",
        "dirty_orders",
    ),
    "percentage_share": sql(
        """SELECT product,
                  round(amount_sum / sum(amount_sum) OVER () * 100 + 1e-8, 4) AS amount_percentage,
                  round(quantity_sum / sum(quantity_sum) OVER () * 100 + 1e-8, 4) AS quantity_percentage
           FROM by_product""",
        "sales_lines",
        by_product=_BY_PRODUCT,
    ),
    "kpi_performance": sql(
        """SELECT product, round(share + 1e-8, 4) AS amount_share_pct, label AS amount_performance
           FROM labelled""",
        "sales_lines",
        by_product=_BY_PRODUCT,
        labelled=_LABELLED,
    ),
    "anomaly_flags": sql(
        """SELECT product, round(z + 1e-8, 4) AS amount_z_score, z >= 2.0 AS amount_anomaly
           FROM (SELECT product, abs((amount_avg - avg(amount_avg) OVER ())
                        / stddev_pop(amount_avg) OVER ()) AS z FROM by_product)""",
        "sales_lines",
        by_product=_BY_PRODUCT,
    ),
    "ranking": sql(
        """SELECT product, category, row_count, round(amount_sum + 1e-8, 4) AS amount_sum,
                  round(quantity_sum + 1e-8, 4) AS quantity_sum, amount_rank, quantity_rank,
                  amount_rank <= 10 AS amount_top_10, amount_rank > n - 10 AS amount_bottom_10,
                  quantity_rank <= 10 AS quantity_top_10,
                  quantity_rank > n - 10 AS quantity_bottom_10 FROM ranks""",
        "sales_lines",
        by_pair=_BY_PAIR,
        ranks=_RANKS,
    ),
    "performance_counts": sql(
        "SELECT label AS performance, count(*) AS groups FROM labelled GROUP BY label",
        "sales_lines",
        by_product=_BY_PRODUCT,
        labelled=_LABELLED,
    ),
    "top_segment": sql(
        """SELECT category, region, round(sum(amount) + 1e-8, 4) AS amount_sum FROM sales_lines
           GROUP BY category, region ORDER BY sum(amount) DESC, category, region LIMIT 1""",
        "sales_lines",
    ),
    "insights": sql(
        f"SELECT * FROM ({_INSIGHT.format('amount')}) "
        f"UNION ALL SELECT * FROM ({_INSIGHT.format('quantity')})",
        "sales_lines",
    ),
    "gold_kpis": sql(
        """SELECT count(DISTINCT (category, region)) AS groups, count(*) AS row_count,
                  round(sum(amount) + 1e-8, 4) AS total_amount, round(sum(quantity) + 1e-8, 4) AS total_quantity,
                  'PASS' AS quality, 'PASS' AS reconciliation FROM sales_lines""",
        "sales_lines",
    ),
    "gold_analytics": sql(
        """SELECT * EXCLUDE (s, a, n, z), round(s / total * 100 + 1e-8, 4) AS amount_percentage,
                  round(s / total * 100 + 1e-8, 4) AS amount_share_pct,
                  CASE WHEN s >= total / n THEN 'HIGH' ELSE 'LOW' END AS amount_performance,
                  amount_rank <= 10 AS amount_top_10, amount_rank > n - 10 AS amount_bottom_10,
                  round(z + 1e-8, 4) AS amount_z_score, z >= 2.0 AS amount_anomaly
           FROM (SELECT * EXCLUDE (total), total FROM (
                   SELECT *, sum(s) OVER () AS total, count(*) OVER () AS n,
                          row_number() OVER (ORDER BY s DESC, status, category) AS amount_rank,
                          abs((a - avg(a) OVER ()) / stddev_pop(a) OVER ()) AS z FROM groups_))""",
        "sales_orders",
        groups_=_ORDER_GROUPS,
    ).replace("EXCLUDE (s, a, n, z)", "EXCLUDE (s, a, n, z, total)"),
    "medallion_run": sql("SELECT * FROM months", "dirty_orders", months=_MONTHS),
}
