"""CSV scans: inferred, all text, whole folders, and rows that do not fit the header."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions import values as V


# Quotes inside a quoted field are doubled, as in the usual CSV dialect.
DIALECT = {"header": True, "mode": "PERMISSIVE", "encoding": "UTF-8", "escape": '"'}
SOURCE_FILE = "_source_file"
SOURCE_PATH = "_source_path"
RAGGED = "_ragged"
RECORD = "_record"
_BYTE_ORDER_MARK = chr(0xFEFF)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Scan with column types inferred from the data."""
    return spark.read.options(**DIALECT, inferSchema=True).csv(path)


def read_strings(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Scan with every column as text; a byte order mark in the header is dropped.

    ``multi_line`` allows line breaks inside quotes; such files cannot be split.
    """
    scanned = spark.read.options(**DIALECT, multiLine=multi_line).csv(path)
    if not scanned.columns:
        raise ValueError(f"no header found in {path}")
    clean = [c.removeprefix(_BYTE_ORDER_MARK) for c in scanned.columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in clean])
    return spark.read.options(**DIALECT, multiLine=multi_line).schema(schema).csv(path)


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """The first line of every file of a folder.

    A text scan of the files, of which only first lines leave the tasks.
    """
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .filter(F.col("file_block_start") == 0)
        .withColumn("line", F.monotonically_increasing_id())
    )
    return lines.groupBy("file_path").agg(F.min_by("value", "line").alias("header"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Scan all CSV files of a folder, keeping each row's file name.

    Files are grouped by header: one read per distinct header, columns matched by
    name, columns a file does not have are null. What reaches the driver is one
    header per file, as small as Spark's own file listing.
    """
    by_header = defaultdict(list)
    for row in file_headers(spark, folder, pattern).collect():
        by_header[row["header"]].append(row["file_path"])
    if not by_header:
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    parts = []
    for header in sorted(by_header):
        scanned = read_strings(spark, sorted(by_header[header]))
        name = F.col("_metadata.file_name").alias(SOURCE_FILE)
        parts.append(scanned.select(*V.cols(scanned.columns), name))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _separators(record: Column) -> Column:
    """Commas outside quotes."""
    unquoted = F.when(
        record.contains('"'), F.regexp_replace(record, '"([^"]|"")*"', "")
    ).otherwise(record)
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))


def plain_path(path: Column) -> Column:
    """A file's path from a scan's metadata as file listings write it."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:///", "file:/")


def read_with_ragged_flag(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    with_path: bool = False,
) -> DataFrame:
    """All-text scan plus a flag on rows with more fields than the header.

    Rows with fewer fields are padded with nulls and count as consistent, so a
    malformed record is too long if its last column is filled; only otherwise its
    separators are counted. Files without a header are read with the given
    ``columns``. The parser must see whole records even if few columns are wanted.
    ``with_path`` adds each row's file by its full path.
    """
    names = list(columns or read_strings(spark, path).columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    options = {
        **DIALECT,
        "header": not columns,
        "columnNameOfCorruptRecord": RECORD,
        "columnPruning": False,
    }
    scanned = spark.read.options(**options).schema(schema).csv(path)
    source = [plain_path(F.col("_metadata.file_path")).alias(SOURCE_PATH)] if with_path else []
    return scanned.select(*V.cols(names), is_ragged(names).alias(RAGGED), *source)


def is_ragged(names: Sequence[str]) -> Column:
    """Whether a scanned record has more fields than names."""
    record = F.col(RECORD)
    too_long = V.col(names[-1]).isNotNull() | (_separators(record) >= len(names))
    return F.coalesce(record.isNotNull() & too_long, F.lit(False))


def preview(df: DataFrame, order_by: list[str], rows: int = 10) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*V.cols(order_by)).limit(rows)


def dataset_reference(df: DataFrame, order_by: list[str], rows: int = 5) -> DataFrame:
    """A small stand-in for a table: its row count and a few sample rows as JSON."""
    keys, names = V.cols(order_by), V.cols(df.columns)
    sample = (
        df.orderBy(*keys)
        .limit(rows)
        .select(F.struct(*keys).alias("position"), F.to_json(F.struct(*names)).alias("row"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "row"))).alias("rows"))
        .select(F.transform("rows", lambda r: r["row"]).alias("rows"))
    )
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", sample.scalar().alias("sample_rows")
    )
