"""Validation of rows against a declared schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators.quality import row_groups
from orefold.operators.roles import ColumnRole


def schema_conformance(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected and actual columns with their state and their filled cells."""
    actual = df.columns
    states = [(c, "PRESENT" if c in actual else "MISSING") for c in expected]
    states += [(c, "UNEXPECTED") for c in actual if c not in expected]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(state).alias("state"),
            (
                F.count_if(~V.is_missing(V.text(df, name)))
                if name in actual
                else F.lit(0).cast("bigint")
            ).alias("non_missing"),
        )
        for name, state in states
    ]
    return df.agg(F.array(*rows).alias("columns")).select(F.inline("columns"))


def blank_cells(df: DataFrame) -> DataFrame:
    """Cells that are null, empty or white space only."""
    per_row = reduce(
        lambda a, b: a + b, [V.is_blank(V.text(df, c)).cast("int") for c in df.columns]
    )
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("null_values"))


def key_column(
    columns: Sequence[ColumnRole], actual: Sequence[str], primary_only: bool = False
) -> str | None:
    """The first key column; with ``primary_only`` reference keys are passed over."""
    for column in columns:
        wanted = column.role == "KEY" and column.name in actual
        if wanted and not (primary_only and column.key_type == "REFERENCE"):
            return column.name
    return None


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key was seen before; missing keys count as one value."""
    return row_groups(df, [key]).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_keys")
    )


def _invalid(value: Column, expected: str) -> Column:
    if expected == "integer":
        valid = V.is_integer_text(value)
    elif expected == "float":
        valid = V.is_float_text(value)
    elif expected == "boolean":
        valid = F.lower(value).isin(*V.BOOLEAN_WORDS, "1", "0")
    else:
        valid = F.lit(True)
    return ~V.is_missing(value) & ~valid


def _checkable(df: DataFrame, columns: Sequence[ColumnRole]) -> list[ColumnRole]:
    return [c for c in columns if c.name in df.columns and c.type != "string"]


def type_error_samples(
    df: DataFrame, columns: Sequence[ColumnRole], row_key: str, limit: int = 10
) -> DataFrame:
    """The first offending cells in row order: row, column, value, expected type."""
    offenders = [
        F.when(
            _invalid(V.text(df, c.name), c.type),
            F.struct(
                F.lit(c.name).alias("column"),
                V.text(df, c.name).alias("value"),
                F.lit(c.type).alias("expected"),
            ),
        )
        for c in _checkable(df, columns)
    ]
    found = df.select(
        V.col(row_key).alias("row_key"),
        F.inline(F.array_compact(F.array(*offenders))),
    )
    return found.orderBy("row_key", "column", "value").limit(limit)


def validation_verdict(
    df: DataFrame,
    columns: Sequence[ColumnRole],
    ragged: str | None = None,
    primary_only: bool = False,
) -> DataFrame:
    """One row with all findings and whether the table may pass.

    ``ragged`` names a flag column of rows that did not fit the header.
    """
    actual = [c for c in df.columns if c != ragged]
    expected = [c.name for c in columns]
    missing = [c for c in expected if c not in actual]
    unexpected = [c for c in actual if c not in expected]
    invalid = [
        _invalid(V.text(df, c.name), c.type).cast("int") for c in _checkable(df, columns)
    ]
    errors = F.sum(reduce(lambda a, b: a + b, invalid)) if invalid else F.lit(0)
    blanks = reduce(
        lambda a, b: a + b, [V.is_blank(V.text(df, c)).cast("int") for c in actual]
    )
    key = key_column(columns, actual, primary_only)
    repeats = duplicate_keys(df, key).scalar() if key else F.lit(0).cast("bigint")
    inconsistent = F.count_if(F.col(ragged)) if ragged else F.lit(0).cast("bigint")
    findings = df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(missing)).alias("missing_columns"),
        F.lit(len(unexpected)).alias("unexpected_columns"),
        inconsistent.alias("inconsistent_rows"),
        F.coalesce(F.sum(blanks), F.lit(0)).cast("bigint").alias("null_values"),
        F.coalesce(errors, F.lit(0)).cast("bigint").alias("type_errors"),
    ).select("*", repeats.alias("duplicate_keys"))
    blocking = (
        "missing_columns",
        "unexpected_columns",
        "inconsistent_rows",
        "type_errors",
        "duplicate_keys",
    )
    clean = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in blocking])
    return findings.withColumn("valid", (F.col("row_count") > 0) & clean)
