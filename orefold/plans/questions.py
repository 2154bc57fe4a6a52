"""Answer one structured request with the tables it asks for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.functions.columns import QUESTION_DIMENSIONS, date_column, metric_column
from orefold.operators import breakdown as B
from orefold.operators import questions as I
from orefold.operators.profile import dimension_values
from orefold.operators.series import SERIES_LIMIT, filtered_series

CROSS_ROWS = 50
DEFAULT_BREAKDOWNS = ("product", "category", "city")


@dataclass(frozen=True)
class GoldQuery:
    """A request against a detail table. ``cross_rows`` and ``series_rows`` limit two of
    the tables; None means all rows."""

    metric: str = "amount"
    mode: str = I.DEFAULT_MODE
    limit: int = I.DEFAULT_LIMIT
    bottom: bool = False
    series: bool = False
    dimensions: tuple[str, ...] = DEFAULT_BREAKDOWNS
    parent: str | None = None
    child: str | None = None
    filters: dict[str, str] = field(default_factory=dict)
    compare: tuple[str, tuple[str, ...]] | None = None
    also_compare: tuple[tuple[str, tuple[str, ...]], ...] = ()
    cross_rows: int | None = CROSS_ROWS
    series_rows: int | None = SERIES_LIMIT


def plan_question(df: DataFrame, question: str) -> GoldQuery:
    """Turn one question into a request, using the values the table really holds."""
    asked = df.sparkSession.createDataFrame([(0, question)], "id long, question string")
    intent = I.question_intent(asked, "question").first()
    dimensions = [d for d in QUESTION_DIMENSIONS if d in df.columns]
    filters, several = {}, []
    if dimensions:
        values = dimension_values(df, dimensions).select("dimension", "value")
        mentioned = I.mentioned_values(asked, "id", "question", values)
        order = [F.desc(F.length("value")), F.lower("value"), F.col("value")]
        found = {d: [] for d in dimensions}
        # A question names few values; only those come back.
        for row in mentioned.orderBy(*order).collect():
            found[row["dimension"]].append(row["value"])
        filters = {d: names[0] for d, names in found.items() if names}
        several = [(d, tuple(names)) for d, names in found.items() if len(names) > 1]
    requested = tuple(intent["mentioned"])
    if not requested:
        requested = ("city",) if intent["mentions_location"] else DEFAULT_BREAKDOWNS
    return GoldQuery(
        metric=intent["metric"],
        mode=intent["mode"],
        limit=intent["row_limit"],
        bottom=intent["bottom"],
        series=intent["mode"] == "TIME_SERIES" or intent["wants_series"],
        dimensions=requested,
        parent=intent["parent_dimension"],
        child=intent["child_dimension"],
        filters=filters,
        compare=several[0] if several else None,
        also_compare=tuple(several[1:]),
    )


def gold_query(df: DataFrame, query: GoldQuery) -> dict[str, DataFrame]:
    """The tables that answer a request; each is a lazy plan over ``df``.

    A breakdown by a dimension does not apply the filter on that dimension.
    """
    metric = metric_column(df.columns, query.metric)
    answer: dict[str, DataFrame] = {}
    if metric is None:
        return answer

    def without(*names: str | None) -> dict[str, str]:
        return {d: v for d, v in query.filters.items() if d not in names}

    if query.filters:
        answer["filtered_summary"] = B.filtered_summary(df, metric, query.filters)
    if query.compare:
        dimension, values = query.compare
        answer["comparison"] = B.compare_values(df, dimension, values, metric)
    for dimension, values in query.also_compare:
        answer[f"{dimension}_comparison"] = B.compare_values(df, dimension, values, metric)
    for dimension in query.dimensions:
        if dimension in df.columns:
            answer[f"{dimension}_breakdown"] = B.breakdown(
                df, dimension, metric, query.limit, without(dimension), query.bottom
            )
    pair = (query.parent, query.child)
    if all(name in df.columns for name in pair):
        answer[f"{query.parent}_by_{query.child}"] = B.cross_breakdown(
            df, query.parent, query.child, metric, query.cross_rows, without(*pair)
        )
    if query.series and date_column(df.columns):
        answer["detail_time_series"] = filtered_series(
            df, query.filters, query.metric, query.series_rows
        )
    answer["detail_size"] = df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )
    return answer
