"""Breakdowns of a metric by dimension values, with shares and ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators.clean import filter_rows
from orefold.operators.ordered import with_position

TOP_VALUES = 10
TOP_PAIRS = 20
TOP_CONTRIBUTORS = 5


def _amounts(df: DataFrame, keys: Mapping[str, str], metric: str) -> DataFrame:
    """Totals of the parseable metric per key; every missing key is a group too."""
    rows = df.select(
        *[V.present(V.text(df, column)).alias(name) for name, column in keys.items()],
        V.number(df, metric, lenient=False).alias("amount"),
    )
    return (
        rows.filter(F.col("amount").isNotNull())
        .groupBy(*keys)
        .agg(F.sum("amount").alias("amount"))
    )


def _share(value: Column, total: Column) -> Column:
    return F.when(total != 0, value / total * 100).otherwise(0.0)


def breakdown(
    df: DataFrame,
    dimension: str,
    metric: str,
    limit: int = TOP_VALUES,
    filters: Mapping[str, str] | None = None,
    bottom: bool = False,
) -> DataFrame:
    """The largest (or smallest) values of a dimension with their share of the total.

    Only the ``limit`` rows of the report are ranked.
    """
    amounts = _amounts(filter_rows(df, filters), {"value": dimension}, metric)
    total = amounts.agg(F.sum("amount")).scalar()
    order = [F.asc("amount") if bottom else F.desc("amount"), F.asc("value")]
    rows = amounts.withColumn("share_pct", _share(F.col("amount"), total))
    rows = rows.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return rows.select(rank.alias("rank"), "value", "amount", "share_pct")


def cross_breakdown(
    df: DataFrame,
    parent: str,
    child: str,
    metric: str,
    limit: int | None = TOP_PAIRS,
    filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """The largest parent and child pairs, or all with no limit, with the share within
    their parent.

    The pairs of the report are picked first; the parent totals are joined to those
    few rows only, so no parent's children are gathered in one task.
    """
    filtered = filter_rows(df, filters)
    amounts = _amounts(filtered, {"parent": parent, "child": child}, metric)
    order = [F.desc("amount"), F.asc("parent"), F.asc("child")]
    top = amounts if limit is None else amounts.orderBy(*order).limit(limit)
    totals = amounts.groupBy(F.col("parent").alias("total_of")).agg(
        F.sum("amount").alias("parent_total")
    )
    rows = totals.join(top, F.col("total_of").eqNullSafe(F.col("parent")))
    if limit is None:
        rows = with_position(rows, [], order, "rank")
    else:
        rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return rows.select(
        F.col("rank").cast("bigint").alias("rank"),
        "parent",
        "child",
        "amount",
        _share(F.col("amount"), F.col("parent_total")).alias("parent_share_pct"),
    )


def contribution(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Every value of a dimension with its sum, share and rank."""
    amounts = _amounts(df, {"value": dimension}, metric)
    order = [F.desc("amount"), F.asc("value")]
    ranked = with_position(amounts, [], order, "rank")
    total = ranked.agg(F.sum("amount")).scalar()
    return ranked.select(
        "value", "amount", _share(F.col("amount"), total).alias("share_pct"), "rank"
    )


def top_and_bottom(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """The first and the last value of the ranked breakdown with their shares."""
    amounts = _amounts(df, {"value": dimension}, metric)
    # Ranked by amount descending, then value ascending: the first is the smallest of
    # these structs, the last is the largest.
    entry = F.struct((-F.col("amount")).alias("order"), F.col("value"))
    ends = amounts.agg(
        F.sum("amount").alias("total"), F.min(entry).alias("top"), F.max(entry).alias("bottom")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label.upper()).alias("position"),
                F.col(label)["value"].alias("value"),
                (-F.col(label)["order"]).alias("amount"),
            )
            for label in ("top", "bottom")
        ]
    )
    return ends.filter(F.col("total").isNotNull()).select("total", F.inline(rows)).select(
        "position", "value", "amount", _share(F.col("amount"), F.col("total")).alias("share_pct")
    )


def filtered_summary(
    df: DataFrame, metric: str, filters: Mapping[str, str] | None = None
) -> DataFrame:
    """Row count of the filtered rows and total, average, range of the metric."""
    rows = filter_rows(df, filters).select(V.number(df, metric, lenient=False).alias("value"))
    return rows.agg(F.count("*").alias("row_count"), *_summary())


def _summary() -> list[Column]:
    return [
        F.sum("value").alias("total"),
        F.avg("value").alias("average"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    ]


def compare_values(
    df: DataFrame, dimension: str, values: Sequence[str], metric: str
) -> DataFrame:
    """Summaries of two or more values of one dimension, side by side, in one scan."""
    wanted = sorted({v.strip().lower() for v in values})
    if len(wanted) < 2:
        raise ValueError("a comparison needs at least two values")
    rows = df.select(
        F.lower(V.strip(V.text(df, dimension))).alias("name"),
        V.number(df, metric, lenient=False).alias("value"),
    ).filter(F.col("name").isin(*wanted))
    compared = rows.groupBy("name").agg(F.count("*").alias("row_count"), *_summary())
    return compared.filter(F.col("total").isNotNull()).select(
        F.lit(dimension).alias("dimension"),
        F.col("name").alias("value"),
        "row_count",
        "total",
        "average",
        "minimum",
        "maximum",
    )


def dimension_contributions(
    df: DataFrame, dimensions: Sequence[str], metric: str
) -> DataFrame:
    """Totals of every value of several dimensions from one scan."""
    rows = df.select(
        *[V.present(V.text(df, d)).alias(d) for d in dimensions],
        V.number(df, metric, lenient=False).alias("_amount"),
    ).filter(F.col("_amount").isNotNull())
    cells = rows.unpivot(["_amount"], V.cols(dimensions), "dimension", "value")
    return cells.groupBy("dimension", "value").agg(F.sum("_amount").alias("amount"))


def contributors(
    df: DataFrame, dimensions: Sequence[str], metric: str, limit: int = TOP_CONTRIBUTORS
) -> DataFrame:
    """The leading value of every dimension, the largest shares first."""
    values = dimension_contributions(df, dimensions, metric)
    leading = values.groupBy("dimension").agg(
        F.sum("amount").alias("total"),
        F.min(F.struct((-F.col("amount")).alias("order"), F.col("value"))).alias("best"),
    )
    amount = -F.col("best")["order"]
    return (
        leading.select(
            "dimension",
            F.col("best")["value"].alias("value"),
            amount.alias("amount"),
            _share(amount, F.col("total")).alias("share_pct"),
        )
        .orderBy(F.desc("share_pct"), "dimension")
        .limit(limit)
    )
