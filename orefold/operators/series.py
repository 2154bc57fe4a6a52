"""Monthly time series: totals, growth, year over year, trends.

A monthly series has one row per calendar month, so a window over all of its rows is
small however large the source is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.functions.columns import date_column, metric_column
from orefold.operators.clean import filter_rows

SERIES_LIMIT = 24


def _month(moment: Column) -> Column:
    """Months since year 0: a whole number, so neighbours differ by one."""
    return F.year(moment) * 12 + F.month(moment) - 1


def _period(month: Column) -> Column:
    year, in_year = F.floor(month / 12), F.pmod(month, F.lit(12)) + 1
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(in_year.cast("string"), 2, "0")
    )


def monthly_series(df: DataFrame, date: str, measures: Sequence[str]) -> DataFrame:
    """Row count, sums and averages per month; rows without a readable date drop out.

    Grouping is by a whole month number; its text form is made on the result only.
    """
    rows = df.select(
        _month(F.to_date(V.timestamp(df, date))).alias("_month"),
        *[V.number(df, m).alias(m) for m in measures],
    ).filter(F.col("_month").isNotNull())
    statistics = []
    for measure in measures:
        statistics += [
            F.sum(V.col(measure)).alias(f"{measure}_sum"),
            F.avg(V.col(measure)).alias(f"{measure}_avg"),
        ]
    months = rows.groupBy("_month").agg(F.count("*").alias("row_count"), *statistics)
    return months.select(
        _period(F.col("_month")).alias("period"),
        F.floor(F.col("_month") / 12).cast("int").alias("year"),
        (F.pmod("_month", F.lit(12)) + 1).cast("int").alias("month"),
        *V.cols(c for c in months.columns if c != "_month"),
    )


def add_growth(series: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Growth in percent against the previous present period, and its direction."""
    by_period = Window.orderBy("period")
    added = {}
    for measure in measures:
        current = V.col(f"{measure}_sum")
        previous = F.lag(current).over(by_period)
        known = current.isNotNull() & (previous != 0)
        growth = F.when(known, (current - previous) / F.abs(previous) * 100)
        added[f"{measure}_growth_pct"] = growth
        added[f"{measure}_trend"] = (
            F.when(current.isNull(), "NO_DATA")
            .when(growth.isNull(), "BASELINE")
            .when(growth > 0, "UP")
            .when(growth < 0, "DOWN")
            .otherwise("FLAT")
        )
    return series.withColumns(added)


def add_year_over_year(series: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Growth in percent against the same month one year earlier, if there is one."""
    same_month_last_year = Window.orderBy(
        F.col("year") * 12 + F.col("month")
    ).rangeBetween(-12, -12)
    added = {}
    for measure in measures:
        current = V.col(f"{measure}_sum")
        previous = F.first(current).over(same_month_last_year)
        added[f"{measure}_yoy_growth_pct"] = F.when(
            previous != 0, (current - previous) / F.abs(previous) * 100
        )
    return series.withColumns(added)


def trend_summary(series: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Per measure: rising and falling periods and the direction that prevails."""
    counted = series.agg(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("measure"),
                    F.count_if(V.col(f"{m}_growth_pct") > 0).alias("rising"),
                    F.count_if(V.col(f"{m}_growth_pct") < 0).alias("falling"),
                    F.count(V.col(f"{m}_growth_pct")).alias("known"),
                )
                for m in measures
            ]
        ).alias("all")
    ).select(F.inline("all"))
    trend = (
        F.when(F.col("known") == 0, "NO_DATA")
        .when(F.col("rising") > F.col("falling"), "UPWARD")
        .when(F.col("rising") < F.col("falling"), "DOWNWARD")
        .otherwise("MIXED")
    )
    return counted.withColumn("trend", trend)


def filtered_series(
    df: DataFrame,
    filters: Mapping[str, str] | None = None,
    metric: str = "amount",
    limit: int | None = SERIES_LIMIT,
) -> DataFrame:
    """Monthly totals of one metric over the filtered rows; the last periods, or all
    with no limit.

    Growth is against the previous period with its sign, rounded to 2 decimals.
    """
    date, column = date_column(df.columns), metric_column(df.columns, metric)
    if date is None or column is None:
        raise ValueError("the table has no date column or no such metric")
    rows = filter_rows(df, filters)
    rows = rows.select(
        _month(F.to_date(V.timestamp(df, date))).alias("_month"),
        V.number(df, column, lenient=False).alias("metric"),
    ).dropna()
    months = rows.groupBy("_month").agg(F.sum("metric").alias("metric"))
    previous = F.lag("metric").over(Window.orderBy("_month"))
    growth = F.when(previous != 0, (F.col("metric") - previous) / previous * 100)
    rows = months.select(
        _period(F.col("_month")).alias("period"),
        "metric",
        F.round(growth, 2).alias("growth_pct"),
    )
    if limit is not None:
        rows = rows.orderBy(F.desc("period")).limit(limit)
    return rows.orderBy("period")


def latest_period(series: DataFrame) -> DataFrame:
    """The last row of a series."""
    return series.orderBy(F.desc("period")).limit(1)
