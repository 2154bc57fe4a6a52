"""File and table facts: ingestion records and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import values as V

def listed_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Paths of all files below the folder, empty ones included, in order.

    This is Spark's own file listing, which the driver holds anyway.
    """
    files = (
        spark.read.format("binaryFile")
        .options(pathGlobFilter=pattern, recursiveFileLookup=True)
        .load(folder)
        .inputFiles()
    )
    return sorted(unquote(path).replace("file:///", "file:/") for path in files)


def ingestion_audit(
    spark: SparkSession, folder: str, source: str, pattern: str = "*.csv"
) -> DataFrame:
    """One record per stored file: name, path, size, file time, ingest time, source.

    Comes from the file listing alone; no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return files.select(
        F.substring_index("path", "/", -1).alias("file_name"),
        F.col("path").alias("raw_path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.current_timestamp().alias("ingested_at"),
        F.lit(source).alias("source"),
        F.lit("STORED").alias("status"),
    )


def _row_hash(df: DataFrame, names: Sequence[str]) -> Column:
    """The first 60 bits of the SHA-256 of a row as a number."""
    first = F.substring(F.hex(V.row_digest(df, names)), 1, 15)
    return F.conv(first, 16, 10).cast("decimal(20,0)")


def _fingerprint(row_hash: Column) -> list[Column]:
    total = F.coalesce(F.sum(row_hash), F.lit(0).cast("decimal(20,0)"))
    return [F.count("*").alias("row_count"), total.cast("string").alias("fingerprint")]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a content hash that does not depend on row order or file layout.

    The row hashes are added up, so the work is one scan with partial sums. Column names
    and types are part of it.
    """
    rows, content = _fingerprint(_row_hash(df, df.columns))
    shape = F.sha2(F.lit(df.schema.simpleString()), 256)
    return df.agg(rows, content).withColumn(
        "fingerprint", F.concat("fingerprint", F.lit("-"), F.substring(shape, 1, 12))
    )


def file_fingerprints(
    spark: SparkSession, folder: str, pattern: str = "*.csv"
) -> DataFrame:
    """Row count and content hash per file below the folder, by its full path; large
    files are read by many tasks.

    A header line is part of the hash but not of the row count.
    """
    lines = (
        spark.read.options(pathGlobFilter=pattern, recursiveFileLookup=True)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("source"))
    )
    counted = lines.groupBy("source").agg(*_fingerprint(_row_hash(lines, ["value"])))
    return counted.select(
        "source", F.greatest(F.col("row_count") - 1, F.lit(0)).alias("row_count"), "fingerprint"
    )
