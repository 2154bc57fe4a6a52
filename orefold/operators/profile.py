"""Profiling: column types, missing counts, cardinality and numeric ranges.

The type of a column is found without a second pass: every cell is classed into one
bit, the bits of a column are OR-ed, and the three type rules read the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions import values as V

# One bit per kind of cell.
_ZERO_ONE, _PADDED_ZERO_ONE, _DIGITS, _INTEGER, _DOTTED, _NUMERIC, _BOOLEAN, _OTHER = (
    1 << i for i in range(8)
)
_ALL_INTEGER = _ZERO_ONE | _PADDED_ZERO_ONE | _DIGITS | _INTEGER
_ALL_NUMERIC = _ALL_INTEGER | _DOTTED | _NUMERIC

# For every mode: the type names and the kinds of cells each type allows.
_TYPE_RULES = {
    "numeric": (
        ("integer", _ALL_INTEGER),
        ("float", _ALL_NUMERIC),
        ("boolean", _ZERO_ONE | _PADDED_ZERO_ONE | _BOOLEAN),
    ),
    "strict": (
        ("integer", _ALL_INTEGER),
        ("float", _DOTTED),
        ("boolean", _BOOLEAN),
    ),
    "gold": (
        ("integer", _ZERO_ONE | _DIGITS),
        ("float", _ALL_NUMERIC),
    ),
}


SHORT_CELL = 32
"""Characters of a cell that are shuffled as they are; longer cells become digests."""

_TEXT_KIND = f"""
    CASE WHEN {{0}} IS NULL OR {{0}} = '' THEN 0
         WHEN {{0}} RLIKE r'{V.FLOAT}' THEN
             CASE WHEN {{0}} IN ('0', '1') THEN {_ZERO_ONE}
                  WHEN {{0}} RLIKE r'{V.DIGITS}' THEN {_DIGITS}
                  WHEN {{0}} RLIKE r'{V.ZERO_ONE}' THEN {_PADDED_ZERO_ONE}
                  WHEN {{0}} RLIKE r'{V.INTEGER}' THEN {_INTEGER}
                  WHEN contains({{0}}, '.') THEN {_DOTTED}
                  ELSE {_NUMERIC} END
         WHEN {{0}} RLIKE r'{V.BOOLEAN}' THEN {_BOOLEAN}
         WHEN {{0}} RLIKE r'{V.FLOAT_WORD}' THEN {_NUMERIC}
         ELSE {_OTHER} END"""


def _text_kind(name: str) -> Column:
    # One SQL text instead of dozens of calls per column: tables can be wide.
    return F.expr(_TEXT_KIND.replace("{0}", V.quoted(name)))


def _cell_kind(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return _text_kind(name)
    if isinstance(kind, T.IntegralType):
        bit = _DIGITS
    elif isinstance(kind, T.NumericType):
        bit = _DOTTED
    elif isinstance(kind, T.BooleanType):
        bit = _BOOLEAN
    else:
        bit = _OTHER
    return F.when(V.col(name).isNull(), 0).otherwise(bit)


def _type_name(kinds: Column, mode: str) -> Column:
    chosen = F.when(kinds == 0, "string")
    for name, allowed in _TYPE_RULES[mode]:
        chosen = chosen.when(kinds.bitwiseAND(~allowed) == 0, name)
    return chosen.otherwise("string")


def profile_counts(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, all columns in one aggregation."""
    counted = df.agg(
        *[F.count_if(V.col(c).isNull()).alias(c) for c in df.columns]
    )
    return counted.unpivot([], V.cols(df.columns), "name", "null_count")


def discover_schema(df: DataFrame, mode: str = "numeric") -> DataFrame:
    """One row per column: position, name, type, nullable, and its missing counts.

    One scan with a single-row result; nothing is shuffled but partial aggregates.
    """
    # Each cell is classed once, before its class is aggregated in three ways.
    kinds = df.select(*[_cell_kind(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)])
    per_column = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("name"),
            F.coalesce(F.bit_or(f"k{i}"), F.lit(0)).alias("kinds"),
            F.count_if(F.col(f"k{i}") != 0).alias("non_null_count"),
            F.count_if(F.col(f"k{i}") == 0).alias("null_count"),
        )
        for i, name in enumerate(df.columns)
    ]
    rows = kinds.agg(F.array(*per_column).alias("columns")).select(F.inline("columns"))
    return rows.select(
        "position",
        "name",
        _type_name(F.col("kinds"), mode).alias("type"),
        (F.col("null_count") > 0).alias("nullable"),
        "non_null_count",
        "null_count",
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of every distinct cell: (name, value, occurrences).

    The grouping key holds the value, so a frequent value is combined before the
    shuffle and no column is gathered in one task.
    """
    columns = list(columns or df.columns)
    as_text = df.select(*[V.text(df, c).alias(c) for c in columns])
    cells = as_text.unpivot([], V.cols(columns), "name", "value")
    return cells.groupBy("name", "value").agg(F.count("*").alias("occurrences"))


def column_stats(
    df: DataFrame, mode: str = "numeric", approximate: bool = False
) -> DataFrame:
    """Types plus cardinality, unique ratio and null rate, one row per column.

    Cells are counted per distinct value, so types of short texts are found on distinct
    values only and the exact cardinality is a plain count afterwards. A cell longer than
    ``SHORT_CELL`` characters is classed where it is read and goes on as a digest, so
    what is shuffled has a bounded width. ``approximate`` asks for a cardinality from
    sketches of two percent, with nothing but partial aggregates shuffled.
    """
    if approximate:
        return _stats_columns(_sketched_totals(df), mode)
    cells = []
    # The name of a column stays out of the grouping: it follows from the position.
    for position, name in enumerate(df.columns):
        value = V.present(V.text(df, name))
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        long = F.length(value) > SHORT_CELL
        kind = F.when(long, _cell_kind(df, name)) if is_text else _cell_kind(df, name)
        cells.append(
            F.struct(
                F.lit(position).alias("position"),
                F.when(long, None).otherwise(value).alias("value"),
                F.when(long, V.digest(value)).alias("digest"),
                kind.alias("typed_kind"),
            )
        )
    distinct = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("position", "value", "digest", "typed_kind")
        .agg(F.count("*").alias("occurrences"))
    )
    kind = F.coalesce("typed_kind", _text_kind("value"))
    found = F.col("value").isNotNull() | F.col("digest").isNotNull()
    totals = distinct.groupBy("position").agg(
        F.bit_or(kind).alias("kinds"),
        F.sum("occurrences").alias("row_count"),
        F.coalesce(F.sum(F.when(found, F.col("occurrences"))), F.lit(0)).alias(
            "non_null_count"
        ),
        F.count_if(found).alias("cardinality"),
    )
    names = F.array(*[F.lit(name) for name in df.columns])
    return _stats_columns(totals.withColumn("name", names[F.col("position")]), mode)


def _sketched_totals(df: DataFrame) -> DataFrame:
    per_column = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("name"),
            F.coalesce(F.bit_or(_cell_kind(df, name)), F.lit(0)).alias("kinds"),
            F.count("*").alias("row_count"),
            F.count(V.present(V.text(df, name))).alias("non_null_count"),
            F.approx_count_distinct(V.present(V.text(df, name)), 0.02).alias("cardinality"),
        )
        for position, name in enumerate(df.columns)
    ]
    totals = df.agg(F.array(*per_column).alias("columns")).select(F.inline("columns"))
    return totals.where("row_count > 0")


def _stats_columns(totals: DataFrame, mode: str) -> DataFrame:
    missing = F.col("row_count") - F.col("non_null_count")
    return totals.select(
        "position",
        "name",
        _type_name(F.col("kinds"), mode).alias("type"),
        (missing > 0).alias("nullable"),
        "row_count",
        "non_null_count",
        missing.alias("null_count"),
        "cardinality",
        F.round(F.col("cardinality") / F.col("row_count"), 4).alias("unique_ratio"),
        F.round(missing / F.col("row_count"), 4).alias("null_rate"),
        (F.col("cardinality") / F.col("row_count")).alias("exact_unique_ratio"),
    )


def numeric_summary(df: DataFrame) -> DataFrame:
    """Min, max, average (2 decimals) and count of the parseable cells per column."""
    parsed = df.select(
        *[V.number(df, c, lenient=False).alias(c) for c in df.columns]
    )
    per_column = [
        F.struct(
            F.lit(c).alias("name"),
            F.min(V.col(c)).alias("min"),
            F.max(V.col(c)).alias("max"),
            F.round(F.avg(V.col(c)), 2).alias("avg"),
            F.count(V.col(c)).alias("count"),
        )
        for c in df.columns
    ]
    rows = parsed.agg(F.array(*per_column).alias("columns")).select(F.inline("columns"))
    return rows.filter(F.col("count") > 0)


def dimension_values(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Distinct trimmed values of every dimension; sort by length for longest first."""
    cleaned = df.select(*[V.strip(V.text(df, d)).alias(d) for d in dimensions])
    cells = cleaned.unpivot([], V.cols(dimensions), "dimension", "value")
    return (
        cells.filter(F.col("value") != "")
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("occurrences"))
        .select("dimension", "value", F.length("value").alias("value_length"))
    )
