"""Cleaning: trimming, duplicate and empty rows, role-driven casts, calendar parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions import values as V
from orefold.operators.roles import ColumnRole

DECIMAL_TYPES = ("float", "double", "decimal")


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every text column in one projection."""
    return df.select(
        *[
            (
                F.trim(V.col(f.name)).alias(f.name)
                if isinstance(f.dataType, T.StringType)
                else V.col(f.name)
            )
            for f in df.schema.fields
        ]
    )


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one copy of every row."""
    return df.dropDuplicates()


def remove_empty_rows(df: DataFrame, empty_text: bool = False) -> DataFrame:
    """Drop rows that are all null; with ``empty_text`` empty texts count as null."""
    if not empty_text:
        return df.dropna(how="all")
    empty = reduce(lambda a, b: a & b, [V.is_missing(V.text(df, c)) for c in df.columns])
    return df.filter(~empty)


def standard_transform(df: DataFrame) -> DataFrame:
    """Empty rows out, texts trimmed, duplicates out."""
    return df.transform(remove_empty_rows).transform(clean_strings).transform(remove_duplicates)


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a cleaning step."""
    counted = before.agg(F.count("*").alias("rows_before")).select(
        "rows_before", after.agg(F.count("*")).scalar().alias("rows_after")
    )
    return counted.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def role_value(value: Column, column: ColumnRole) -> Column:
    """One text cell cleaned and cast the way its role and type ask for."""
    if column.role in ("KEY", "MEASURE"):
        if column.type == "integer":
            parse = V.to_integer if column.role == "KEY" else V.to_truncated_integer
            return parse(value)
        if column.type in DECIMAL_TYPES:
            return V.to_double(value)
    if column.role in ("DIMENSION", "ATTRIBUTE"):
        return V.normalize_text(value)
    return V.strip(value)


def role_transform(df: DataFrame, columns: Sequence[ColumnRole]) -> DataFrame:
    """Project to the schema columns, each cleaned by its role, in one pass.

    Empty dimension and attribute texts become null, so that "missing" is one group.
    """
    cleaned = []
    for column in columns:
        value = role_value(V.text(df, column.name), column)
        if column.role in ("DIMENSION", "ATTRIBUTE"):
            value = V.present(value)
        cleaned.append(value.alias(column.name))
    return df.select(*cleaned)


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse measure columns leniently and keep everything else."""
    return df.withColumns({c: V.number(df, c) for c in columns})


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Replace a text date column by its timestamp; unreadable dates become null."""
    return df.withColumn(column, V.timestamp(df, column))


def calendar_attributes(df: DataFrame, column: str, prefix: str = "date") -> DataFrame:
    """Add year, quarter, month, ISO week, day and their names for a date column."""
    moment = V.timestamp(df, column)
    staged = df.withColumn("_moment", moment)
    day = F.to_date("_moment")
    quarter = F.concat(F.lit("Q"), F.quarter(day).cast("string"))
    parts = {
        "year": F.year(day),
        "quarter": quarter,
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "week": F.weekofyear(day),
        "day": F.day(day),
        "day_of_week": F.date_format(day, "EEEE"),
        "year_month": F.date_format(day, "yyyy-MM"),
        "year_quarter": F.concat_ws("-", F.year(day).cast("string"), quarter),
    }
    return staged.select(
        *V.cols(df.columns),
        *[F.when(day.isNotNull(), part).alias(f"{prefix}_{name}") for name, part in parts.items()],
    )


def filter_rows(df: DataFrame, filters: Mapping[str, str] | None) -> DataFrame:
    """Keep rows that equal every wanted value, ignoring case and outer spaces.

    Filters on columns the table does not have are passed over.
    """
    for name, wanted in (filters or {}).items():
        if name in df.columns:
            df = df.filter(V.equals_ignoring_case(V.text(df, name), str(wanted)))
    return df
