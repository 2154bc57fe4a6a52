"""Writers for the layers. Files stay as parallel as the data unless asked otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from orefold.functions import values as V

# Doubled quotes, and outer spaces kept as they are.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    single_file: bool = False,
) -> None:
    """Write a table; ``single_file`` is for small reports only."""
    if single_file:
        df = df.coalesce(1)
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(format).save(path)


def silver_layout(df: DataFrame, schema_columns: Sequence[str]) -> DataFrame:
    """Schema columns first, then whatever else the table has."""
    known = [c for c in schema_columns if c in df.columns]
    extra = [c for c in df.columns if c not in known]
    return df.select(*V.cols(known + extra))


def write_silver(
    df: DataFrame, path: str, schema_columns: Sequence[str], format: str = "parquet"
) -> None:
    """Write the cleaned table with its columns in schema order."""
    write_table(silver_layout(df, schema_columns), path, format)


def write_gold(
    path: str,
    detail: DataFrame,
    analytics: DataFrame,
    series: DataFrame | None = None,
    format: str = "parquet",
) -> dict[str, str]:
    """Write the three gold products side by side and return where they are."""
    products = {"detail": detail, "analytics": analytics, "time_series": series}
    written = {}
    for name, table in products.items():
        if table is not None:
            written[name] = f"{path}/{name}"
            write_table(table, written[name], format)
    return written


def write_summary(summary: DataFrame, path: str) -> None:
    """Write a small summary as JSON lines."""
    write_table(summary, path, format="json", single_file=True)
