"""New files as a stream, and results that are kept up to date as files arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orefold.functions import values as V
from orefold.operators.filetree import list_files
from orefold.operators.quality import type_error
from orefold.operators.roles import ColumnRole
from orefold.plans.medallion import FileRun, Gates, attempt_files, run_name
from orefold.session import remove_folder
from orefold.sources.csv import DIALECT, RAGGED, RECORD, SOURCE_FILE, is_ragged
from orefold.sources.files import listed_files
from orefold.sources.sinks import write_table

BatchHandler = Callable[[DataFrame, int], None]


def new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.csv",
    files_per_batch: int | None = None,
    flag_ragged: bool = False,
) -> DataFrame:
    """A stream over the CSV files of a folder, each row with its file name, and if
    asked for with a flag on rows that have more fields than the schema."""
    options = {**DIALECT, "pathGlobFilter": pattern}
    if files_per_batch:
        options["maxFilesPerTrigger"] = files_per_batch
    if flag_ragged:
        options |= {"columnNameOfCorruptRecord": RECORD, "columnPruning": False}
        schema = T.StructType([*schema, T.StructField(RECORD, T.StringType())])
    rows = spark.readStream.options(**options).schema(schema).csv(folder)
    names = [name for name in schema.names if name != RECORD]
    flag = [is_ragged(names).alias(RAGGED)] if flag_ragged else []
    return rows.select(
        *V.cols(names), *flag, F.col("_metadata.file_name").alias(SOURCE_FILE)
    )


def start_feed(
    stream: DataFrame, handle: BatchHandler, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Hand every batch of new rows to ``handle``.

    With an interval the feed keeps running; without one it takes what is there and
    ends. The checkpoint remembers the files that were seen.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def ignore_existing(stream: DataFrame, checkpoint: str) -> None:
    """Mark the files that are already there as seen, without processing them."""
    start_feed(stream, lambda batch, batch_id: None, checkpoint).awaitTermination()


def new_file_names(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.csv",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the files themselves: path, length and time of each that arrives below
    the folder, empty ones included. Their content is not read."""
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": True}
    if files_per_batch:
        options["maxFilesPerTrigger"] = files_per_batch
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").options(**options).schema(schema).load(folder)
    return files.select(
        F.regexp_replace("path", "^file:///", "file:/").alias("path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


OUTCOME_SCHEMA = (
    "path string, state string, message string, rows bigint, target string, "
    "started double, ended double"
)


def refine_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | None,
    target: str,
    checkpoint: str,
    gates: Gates = Gates(),
    interval: str | None = None,
    files_per_batch: int = 16,
    at_once: int = 4,
) -> StreamingQuery:
    """Take every new file below a folder through bronze, silver and gold.

    The stream is one of file names; each file is read by itself and becomes a run below
    ``target`` under the name of its full path, several at a time, so files of one name in
    several folders stay apart. How each file ended is written to the table that
    :func:`file_outcomes` reads. A file that fails (no header, columns other than those of
    ``schema`` where one is given, unreadable content) is set aside there with its error;
    the batch commits and the feed goes on. :func:`retry_quarantined` takes such files up
    again. A batch that is repeated after the driver was lost overwrites its own tables.
    """
    header = None if schema is None else schema.names

    def refine(batch: DataFrame, batch_id: int) -> None:
        # As many names as the batch has files, which its size limits.
        sizes = {row["path"]: row["length"] for row in batch.select("path", "length").collect()}
        sizes |= dict.fromkeys(_new_empty_files(spark, folder, target), 0)
        _refine(spark, sizes, folder, target, f"{batch_id:012d}", gates, at_once, header)

    stream = new_file_names(spark, folder, files_per_batch=files_per_batch)
    return start_feed(stream, refine, checkpoint, interval)


def _new_empty_files(spark: SparkSession, folder: str, target: str) -> list[str]:
    """Files without content that have no outcome yet. Scans give no rows for them, so
    they are what the listing has beside the others."""
    filled = {row["path"] for row in list_files(spark, folder).select("path").toLocalIterator()}
    empty = [path for path in listed_files(spark, folder) if path not in filled]
    if not empty:
        return []
    known = file_outcomes(spark, target).where(F.col("path").isin(empty)).select("path")
    return sorted({*empty} - {row["path"] for row in known.collect()})


def _refine(
    spark: SparkSession,
    sizes: dict[str, int],
    folder: str,
    target: str,
    run_id: str,
    gates: Gates,
    at_once: int,
    header: Sequence[str] | None,
) -> dict[str, FileRun]:
    """Run the files of a batch and write how each ended."""
    below = f"{target}/run_id={run_id}"
    found = attempt_files(spark, sizes, folder, below, gates, at_once, header, prefix="file=")
    rows = [
        (
            path,
            "QUARANTINED" if run.state == "FAILED" else run.state,
            run.message,
            run.run.quality.get("row_count", 0) if run.run else 0,
            f"{below}/file={run_name(path, folder)}" if run.run else None,
            run.started,
            run.ended,
        )
        for path, run in found.items()
    ]
    outcomes = spark.createDataFrame(rows, OUTCOME_SCHEMA).coalesce(1)
    write_table(outcomes, f"{target}/_outcomes/run_id={run_id}")
    return found


def file_outcomes(spark: SparkSession, target: str) -> DataFrame:
    """How the newest run of every file ended: SUCCESS, STOPPED, EMPTY or QUARANTINED, with
    the error, its rows and where its tables are. No rows before the first batch."""
    try:
        runs = spark.read.schema(f"{OUTCOME_SCHEMA}, run_id string").parquet(f"{target}/_outcomes")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        runs = spark.createDataFrame([], f"{OUTCOME_SCHEMA}, run_id string")
    newest = F.max_by(F.struct(*[c for c in runs.columns if c != "path"]), F.struct("ended", "run_id"))
    latest = runs.groupBy("path").agg(newest.alias("newest"), F.count("*").alias("attempts"))
    return latest.select("path", "newest.*", "attempts")


def retry_quarantined(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | None,
    target: str,
    gates: Gates = Gates(),
    at_once: int = 4,
) -> dict[str, FileRun]:
    """Run the files that are set aside once more, as they are now, and those that were
    empty and no longer are. A file that is no longer there fails again."""
    aside = file_outcomes(spark, target).where("state IN ('QUARANTINED', 'EMPTY')")
    present = list_files(spark, folder).select("path", "length")
    found = aside.select("path", "state").join(present, "path", "left")
    sizes = {
        row["path"]: -1 if row["length"] is None else row["length"]
        for row in found.collect()
        if row["state"] == "QUARANTINED" or row["length"]
    }
    if not sizes:
        return {}
    header = None if schema is None else schema.names
    run_id = f"retry-{uuid.uuid4().hex[:12]}"
    return _refine(spark, sizes, folder, target, run_id, gates, at_once, header)


def quality_counts(df: DataFrame, columns: Sequence[ColumnRole]) -> DataFrame:
    """The counters that add up row by row, for streams and tables alike: rows, empty
    rows, missing cells, type errors and rows that do not fit. On a stream they are one
    row of state. Duplicates need every row that was ever seen and are left to tables."""
    data = [c for c in df.columns if c not in (RAGGED, SOURCE_FILE)]
    missing = [V.is_missing(V.text(df, c)) for c in data]
    errors = [
        F.coalesce(e, F.lit(False))
        for c in columns
        if c.name in data and (e := type_error(df, c)) is not None
    ]
    ragged = F.col(RAGGED) if RAGGED in df.columns else F.lit(False)

    def total(conditions: Sequence[Column]) -> Column:
        found = reduce(lambda a, b: a + b, [c.cast("bigint") for c in conditions], F.lit(0))
        return F.coalesce(F.sum(found), F.lit(0))

    return df.agg(
        F.count("*").alias("row_count"),
        F.count_if(reduce(lambda a, b: a & b, missing)).alias("empty_rows"),
        total(missing).alias("null_values"),
        total(errors).alias("type_errors"),
        F.count_if(ragged).alias("inconsistent_rows"),
    )


def daily_series(
    df: DataFrame,
    moment: str,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    lateness: str = "1 day",
) -> DataFrame:
    """Row count, sums and averages per calendar day, for streams and tables alike.

    Days are those of the written, zone-free time. On a stream the watermark lets
    finished days leave the state.
    """
    # Time windows are cut at UTC midnight, so the clock is shifted there and back.
    zone = F.current_timezone()
    written = V.timestamp(df, moment).cast("timestamp")
    rows = df.withColumn(moment, F.from_utc_timestamp(written, zone))
    if df.isStreaming:
        rows = rows.withWatermark(moment, lateness)
    statistics = [F.count("*").alias("row_count")]
    for measure in measures:
        value = V.number(df, measure)
        statistics += [
            F.sum(value).alias(f"{measure}_sum"),
            F.avg(value).alias(f"{measure}_avg"),
        ]
    days = rows.groupBy(F.window(V.col(moment), "1 day"), *V.cols(keys)).agg(*statistics)
    return days.select(
        F.date_format(F.to_utc_timestamp("window.start", zone), "yyyy-MM-dd").alias("period"),
        *V.cols(c for c in days.columns if c != "window"),
    )


def keep_result(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the whole current result of a streaming aggregation after every batch.

    Meant for results whose size does not grow with the stream, such as a monthly
    series. Every batch gets a folder of its own, so a repeated batch overwrites only
    itself; ``latest_result`` reads the newest, and older ones are deleted.
    """
    spark = result.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id >= 2:
            remove_folder(spark, f"{path}/batch_id={batch_id - 2}")

    return _started(result, save, "complete", checkpoint)


def keep_updates(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of a streaming aggregation that a batch has changed.

    State that the watermark has passed is freed, and a batch writes no more than it
    changed. ``current_rows`` reads the newest row of each key.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _started(result, save, "update", checkpoint)


def _started(
    result: DataFrame, save: BatchHandler, mode: str, checkpoint: str
) -> StreamingQuery:
    return (
        result.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_result(spark: SparkSession, path: str) -> DataFrame:
    """The result after the newest batch."""
    batches = spark.read.parquet(path)
    newest = batches.agg(F.max("batch_id")).scalar()
    return batches.filter(F.col("batch_id") == newest).drop("batch_id")


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key among the written updates."""
    batches = spark.read.parquet(path)
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*V.cols(values)), "batch_id").alias("newest")
    return batches.groupBy(*V.cols(keys)).agg(newest).select(*V.cols(keys), "newest.*")
