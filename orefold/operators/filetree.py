"""A tree of fingerprints, file by file, folder by folder and for the whole table.

A leaf holds what a listing says of a file (path, length, time) and what a scan found in
it: the number of rows and the sum of their digests. Sums of leaves are the folder's and
the table's, in any order. The tree is kept with the checkpoint, so an increment reads
only files that the listing shows as new or changed; what the others hold is known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators.incremental import (
    Order,
    _kinds,
    _named,
    beyond,
    digest_number,
    high_water_values,
    row_number_sum,
)
from orefold.operators.places import encode_place
from orefold.session import materialize
from orefold.sources.csv import SOURCE_PATH

LEAF_SCHEMA = (
    "path string, length bigint, modified timestamp, row_count bigint, content decimal(38,0)"
)
ReadFiles = Callable[[list[str]], DataFrame]


@dataclass(frozen=True)
class FileState:
    """What a source looks like now, and what was read to say so."""

    current: DataFrame
    leaves: DataFrame
    read_paths: list[str]
    rows: DataFrame | None


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Path, length and time of every file below the folder that is not empty; no file is
    opened."""
    files = (
        spark.read.format("binaryFile")
        .options(pathGlobFilter=pattern, recursiveFileLookup=True)
        .load(folder)
    )
    return files.select(
        F.regexp_replace("path", "^file:///", "file:/").alias("path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """The stored leaves; none if there is no tree yet."""
    try:
        return spark.read.schema(LEAF_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEAF_SCHEMA)


def scan_files(rows: DataFrame, order: Order, last: Sequence | None) -> DataFrame:
    """For each file its rows and their content, both whole and up to the last processed
    place, and its highest place. One scan with partial sums for each file. Names and
    types of the columns are part of every row's digest."""
    data = [name for name in rows.columns if name != SOURCE_PATH]
    shape = rows.select(*V.cols(data)).schema.simpleString()
    before = F.lit(True)
    if last is not None:
        before = ~F.coalesce(beyond(order, last), F.lit(False))
    shaped = rows.withColumn("_shape", F.lit(shape))
    found = shaped.select(
        F.col(SOURCE_PATH).alias("path"),
        digest_number(shaped, [*data, "_shape"]).alias("number"),
        before.alias("before"),
        F.struct(*_named(order)).alias("place"),
    )
    return found.groupBy("path").agg(
        F.count("*").alias("row_count"),
        row_number_sum(F.lit(True), F.col("number")).cast("decimal(38,0)").alias("content"),
        F.count_if("before").alias("rows_before"),
        row_number_sum(F.col("before"), F.col("number")).cast("decimal(38,0)").alias("before"),
        F.max("place").alias("place"),
    )


def file_state(
    listing: DataFrame,
    tree: DataFrame,
    read: ReadFiles,
    source: str,
    order: Order,
    stored_high_water: str | None = None,
) -> FileState:
    """One row on a source for :func:`incremental_status`, from its listing, its stored
    leaves, and a scan of the files that are not among them as they are now.

    All rows of a stored leaf were processed, so they count up to the stored place. A file
    that is new or has changed is read: what it holds up to that place must be what was
    processed, or the status tells of a change. A file that went missing takes its rows
    with it, unless another one brings the same rows. ``read`` gives the rows of files,
    with the file's path in the column ``SOURCE_PATH``.

    A file that changes without another length or time is not noticed; an empty ``tree``
    has everything read.
    """
    same = ["path", "length", "modified"]
    fresh = materialize(listing.join(tree.select(same), same, "left_anti"), "fresh-files")
    kept = tree.join(listing.select(same), same, "left_semi")
    # Names of new files only; the driver's own file listing holds all of them.
    paths = sorted(row["path"] for row in fresh.select("path").collect())
    if not paths:
        leaves = materialize(kept, "leaves")
        totals = leaves.agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("content"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("content"),
        )
        current = totals.select(
            F.lit(source).alias("source"),
            "row_count",
            F.col("content").alias("fingerprint"),
            F.lit(stored_high_water).alias("high_water"),
            F.col("row_count").alias("prefix_row_count"),
            F.col("content").alias("prefix_fingerprint"),
        )
        return FileState(current, leaves, [], None)
    rows = read(paths)
    last = high_water_values(rows, order, stored_high_water)
    kinds = _kinds(rows, order)
    scanned = materialize(scan_files(rows, order, last), "scanned-files")
    zero = F.lit(0).cast("decimal(38,0)")
    new = fresh.join(scanned, "path", "left").select(
        *same,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("content", zero).alias("content"),
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("before", zero).alias("before"),
    )
    known = kept.select(
        *same, "row_count", "content",
        F.col("row_count").alias("rows_before"), F.col("content").alias("before"),
    )
    leaves = materialize(known.union(new), "leaves")

    def text(total: Column) -> Column:
        return F.coalesce(total, zero).cast("decimal(38,0)").cast("string")

    highest = scanned.agg(F.max("place").alias("place"))
    if last is not None:
        stored = F.struct(
            *[
                (F.lit(None).cast(field.dataType) if value is None else value).alias(field.name)
                for value, field in zip(last, kinds)
            ]
        )
        highest = highest.select(F.greatest("place", stored).alias("place"))
    totals = leaves.agg(
        F.sum("row_count").alias("row_count"),
        text(F.sum("content")).alias("fingerprint"),
        F.sum("rows_before").alias("prefix_row_count"),
        text(F.sum("before")).alias("prefix_fingerprint"),
    )
    current = totals.select(
        F.lit(source).alias("source"),
        "row_count",
        "fingerprint",
        highest.select(encode_place(F.col("place"), kinds)).scalar().alias("high_water"),
        "prefix_row_count",
        "prefix_fingerprint",
    )
    leaves = leaves.select("path", "length", "modified", "row_count", "content")
    return FileState(current, leaves, paths, rows)


def tree_levels(leaves: DataFrame) -> DataFrame:
    """Rows ``level, path, files, row_count, fingerprint`` for every file, every folder that
    holds files, and the table, from one aggregation of the leaves."""
    parted = leaves.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    summed = parted.rollup("folder", "path").agg(
        F.grouping_id().alias("_depth"),
        F.count("*").alias("files"),
        F.sum("row_count").alias("row_count"),
        F.sum("content").cast("decimal(38,0)").cast("string").alias("fingerprint"),
    )
    level = F.when(F.col("_depth") == 0, "file").when(F.col("_depth") == 1, "folder")
    return summed.select(
        level.otherwise("table").alias("level"),
        F.coalesce("path", "folder", F.lit("")).alias("path"),
        "files",
        "row_count",
        "fingerprint",
    )


def tree_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rows ``level, path, state, rows_before, rows_now``: which files, which folders and
    whether the table were added, removed, changed in content, or are the same."""
    old = tree_levels(before).select(
        "level", "path",
        F.col("row_count").alias("rows_before"), F.col("fingerprint").alias("old"),
    )
    new = tree_levels(now).select(
        "level", "path",
        F.col("row_count").alias("rows_now"), F.col("fingerprint").alias("new"),
    )
    state = (
        F.when(F.col("old").isNull(), "ADDED")
        .when(F.col("new").isNull(), "REMOVED")
        .when((F.col("old") == F.col("new")) & (F.col("rows_before") == F.col("rows_now")), "SAME")
        .otherwise("CHANGED")
    )
    return old.join(new, ["level", "path"], "full").select(
        "level", "path", state.alias("state"), "rows_before", "rows_now"
    )
