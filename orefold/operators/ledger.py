"""Analytics over run reports, checkpoints and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_out", T.LongType()),
        T.StructField("artifact", T.StringType()),
    ]
)
ERROR_TYPE = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("execution_id", T.StringType()),
        T.StructField("pipeline", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("steps", T.ArrayType(STEP_TYPE)),
        T.StructField("artifacts", T.ArrayType(T.StringType())),
        T.StructField("errors", T.ArrayType(ERROR_TYPE)),
        T.StructField("retries", T.LongType()),
        T.StructField("total_rows", T.LongType()),
    ]
)
CHECKPOINT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("processed_row_count", T.LongType()),
        T.StructField("last_batch_row_count", T.LongType()),
        T.StructField("last_start_row", T.LongType()),
        T.StructField("execution_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("high_water", T.StringType()),
    ]
)

SUCCESS, FAILED = "SUCCESS", "FAILED"
SKIPPED = "SKIPPED_IDEMPOTENT"

_LOG_LINE = r"^\[([^\]]+)\] (\w+) \| Agent: (.*?) \| (?:Message: )?(.*)$"
_STEP_LINE = r"STEP (START|SUCCESS|FAILED) \| id=([^ |]+) \| step=(\w+)"
_STEP_TIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?)"


def append_reports(reports: DataFrame, path: str) -> None:
    """Append run reports to the ledger, one JSON document per line."""
    reports.write.mode("append").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The run ledger, read with its declared schema, so no inference pass is needed."""
    return spark.read.schema(REPORT_SCHEMA).json(path)


def _size(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def run_summary(reports: DataFrame) -> DataFrame:
    """One line per run: status, duration, steps, retries, artifacts, errors."""
    succeeded = F.filter("steps", lambda s: s["status"] == SUCCESS)
    return reports.select(
        "execution_id",
        "source",
        "status",
        "duration_seconds",
        _size("steps").alias("steps"),
        F.coalesce(F.size(succeeded), F.lit(0)).alias("successful_steps"),
        F.coalesce("retries", F.lit(0)).alias("retries"),
        _size("artifacts").alias("artifacts"),
        _size("errors").alias("errors"),
    )


def step_metrics(reports: DataFrame) -> DataFrame:
    """One line per run and step."""
    return reports.select("execution_id", F.inline("steps"))


def run_errors(reports: DataFrame) -> DataFrame:
    """How often each step failed with each kind of error."""
    errors = reports.select(F.inline("errors"))
    return errors.groupBy("step", "type").agg(F.count("*").alias("errors"))


def source_name(path: Column) -> Column:
    """The lower-cased file name at the end of a path."""
    return F.lower(F.substring_index(path, "/", -1))


def latest_run(reports: DataFrame) -> DataFrame:
    """The newest run of every source; combined before the shuffle, no sorting."""
    newest = F.max_by(
        F.struct("execution_id", "status", "started_at"),
        F.struct("started_at", "execution_id"),
    )
    latest = reports.groupBy(source_name(F.col("source")).alias("source")).agg(
        newest.alias("run")
    )
    return latest.select("source", "run.*")


def run_counts(reports: DataFrame) -> DataFrame:
    """Total, successful and failed runs."""
    return reports.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == SUCCESS).alias("success"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )


def folder_run_totals(reports: DataFrame) -> DataFrame:
    """Files and rows of a folder run, passed steps, and how it ended."""
    succeeded = F.size(F.filter("steps", lambda s: s["status"] == SUCCESS))
    totals = reports.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == SUCCESS).alias("successful_files"),
        F.count_if(F.col("status") != SUCCESS).alias("failed_files"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(succeeded), F.lit(0)).alias("passed_steps"),
        F.coalesce(F.sum(_size("steps")), F.lit(0)).alias("steps"),
    )
    return totals.withColumn(
        "final_status",
        F.when(F.col("failed_files") == 0, SUCCESS).otherwise("COMPLETED WITH ERRORS"),
    )


def checkpoint_summary(checkpoints: DataFrame) -> DataFrame:
    """Number of checkpoints, the newest one, and whether any source was skipped."""
    newest = F.max_by(
        F.struct("source", "status", "processed_row_count", "updated_at"),
        F.struct("updated_at", "source"),
    )
    counted = checkpoints.agg(
        F.count("*").alias("checkpoints"),
        newest.alias("latest"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped"),
    )
    return counted.select(
        "checkpoints",
        source_name(F.col("latest.source")).alias("latest_source"),
        F.coalesce("latest.status", F.lit("NO CHECKPOINT")).alias("latest_status"),
        F.coalesce("latest.processed_row_count", F.lit(0)).alias("processed_rows"),
        F.col("latest.updated_at").alias("updated_at"),
        (F.col("skipped") > 0).alias("any_skipped"),
    )


def checkpoint_table(checkpoints: DataFrame) -> DataFrame:
    """One line per source with its last batch."""
    return checkpoints.select(
        source_name(F.col("source")).alias("source"),
        "status",
        F.col("processed_row_count").alias("processed_rows"),
        F.col("last_batch_row_count").alias("last_batch"),
        F.col("execution_id").alias("execution"),
        F.col("updated_at").alias("updated"),
    )


def parse_log(lines: DataFrame) -> DataFrame:
    """Split log lines ``[time] LEVEL | Agent: a | message`` into columns."""
    line = F.col("value")
    parsed = lines.filter(line.rlike(_LOG_LINE))
    names = ("time", "level", "agent", "message")
    return parsed.select(
        *[F.regexp_extract(line, _LOG_LINE, i + 1).alias(n) for i, n in enumerate(names)]
    )


def log_counts(lines: DataFrame) -> DataFrame:
    """Log lines per level and agent with their first and last time."""
    return parse_log(lines).groupBy("level", "agent").agg(
        F.count("*").alias("lines"), F.min("time").alias("first"), F.max("time").alias("last")
    )


def step_status(lines: DataFrame) -> DataFrame:
    """The current state of every step of every run, from its newest step event.

    Events are ordered by the time at the start of the line; at the same time a start
    comes before its outcome.
    """
    line = F.col("value")
    event = F.regexp_extract(line, _STEP_LINE, 1)
    events = lines.filter(line.rlike(_STEP_LINE)).select(
        F.regexp_extract(line, _STEP_TIME, 1).alias("time"),
        event.alias("event"),
        F.regexp_extract(line, _STEP_LINE, 2).alias("execution_id"),
        F.regexp_extract(line, _STEP_LINE, 3).alias("step"),
    )
    newest = F.max_by("event", F.struct("time", F.col("event") != "START"))
    latest = events.groupBy("execution_id", "step").agg(newest.alias("event"))
    status = (
        F.when(F.col("event") == "START", "RUNNING")
        .when(F.col("event") == "SUCCESS", "COMPLETE")
        .otherwise("FAILED")
    )
    return latest.select("execution_id", "step", status.alias("status"))
