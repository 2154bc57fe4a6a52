"""The gold products of one cleaned table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold import __version__
from orefold.functions.columns import date_column
from orefold.operators import gold as G
from orefold.operators import quality as Q
from orefold.operators import series as S
from orefold.operators.clean import calendar_attributes
from orefold.operators.roles import ColumnRole, names_with_role
from orefold.session import materialize


@dataclass(frozen=True)
class GoldLayout:
    """Which columns group, which are measured, which are only counted."""

    dimensions: tuple[str, ...]
    measures: tuple[str, ...]
    attributes: tuple[str, ...] = ()

    @classmethod
    def from_roles(cls, roles: Sequence[ColumnRole]) -> GoldLayout:
        """Columns without a role are measured when numeric and group otherwise."""
        numeric = [c.name for c in roles if c.role is None and c.type in ("integer", "float")]
        other = [c.name for c in roles if c.role is None and c.name not in numeric]
        dimensions = set(names_with_role(roles, "DIMENSION") + other)
        measures = set(names_with_role(roles, "MEASURE") + numeric)
        return cls(
            dimensions=tuple(c.name for c in roles if c.name in dimensions),
            measures=tuple(c.name for c in roles if c.name in measures),
            attributes=tuple(names_with_role(roles, "ATTRIBUTE")),
        )


def analytics(df: DataFrame, layout: GoldLayout) -> DataFrame:
    """Statistics, shares, ranks, anomaly flags and KPIs per group.

    The grouped statistics are written once; what follows reads that small table
    instead of the source.
    """
    stats = G.group_stats(df, layout.dimensions, layout.measures, layout.attributes)
    gold = materialize(stats, "gold")
    if layout.measures:
        totals = G.gold_totals(gold, layout.measures)
        gold = G.add_percentage_share(gold, layout.measures, totals)
        gold = G.add_rankings(gold, layout.dimensions, layout.measures, totals)
        gold = G.add_anomaly_flags(gold, layout.measures, totals)
        gold = G.add_kpis(gold, layout.measures, totals)
    date = date_column(df.columns)
    if date in layout.dimensions:
        gold = calendar_attributes(gold, date)
    return gold


def time_series(df: DataFrame, measures: Sequence[str]) -> DataFrame | None:
    """The monthly series with growth, if the table has a date column."""
    date = date_column(df.columns)
    if date is None:
        return None
    series = S.monthly_series(df, date, measures)
    series = S.add_growth(series, measures)
    return S.add_year_over_year(series, measures)


def stamp(gold: DataFrame, quality: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Add the engine version and both check results to every analytics row."""
    return gold.withColumns(
        {
            "_gold_engine_version": F.lit(__version__),
            "_gold_quality_status": quality.select("status").scalar(),
            "_reconciliation_status": reconciliation.select("status").scalar(),
        }
    )


def checked_analytics(
    source: DataFrame, detail: DataFrame, layout: GoldLayout
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analytics of the written detail table with its quality and reconciliation."""
    gold = materialize(analytics(detail, layout), "analytics")
    quality = Q.gold_quality(gold)
    reconciliation = Q.reconcile(source, detail, gold)
    return stamp(gold, quality, reconciliation), quality, reconciliation
