"""Section L: run reports and log lines. Both are derived from the events table: every
event stands for one run, or for one log line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import ledger as L
from orefold.session import scratch_path
from registry.views import sql, table

STEPS = ("SOURCE", "SCHEMA", "SEMANTIC", "QUALITY", "VALIDATION", "TRANSFORMATION", "SILVER", "GOLD")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger on disk: an error event is a run that failed in QUALITY."""
    failed = F.col("event_type") == "error"

    def step(name: str, status: Column | str) -> Column:
        state = F.lit(status) if isinstance(status, str) else status
        return F.struct(
            F.lit(name).alias("name"),
            state.alias("status"),
            F.lit(1).cast("bigint").alias("attempts"),
            F.col("value").alias("duration_seconds"),
            F.col("user_id").alias("rows_in"),
            F.col("user_id").alias("rows_out"),
            F.lit(None).cast("string").alias("artifact"),
        )

    steps = F.array(
        step("SOURCE", "SUCCESS"),
        step("QUALITY", F.when(failed, "FAILED").otherwise("SUCCESS")),
        F.when(~failed, step("GOLD", "SUCCESS")),
    )
    error = F.struct(
        F.lit("QUALITY").alias("step"),
        F.lit(1).cast("bigint").alias("attempt"),
        F.when(F.col("value") > 10, "ValueError").otherwise("KeyError").alias("type"),
        F.col("props").alias("message"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
    reports = table(spark, sf_dir, "events").select(
        F.concat(F.lit("EXEC_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias(
            "execution_id"
        ),
        F.lit("events").alias("pipeline"),
        F.concat(F.lit("data/raw/User_"), F.col("user_id"), F.lit(".csv")).alias("source"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at"),
        F.col("value").alias("duration_seconds"),
        F.array_compact(steps).alias("steps"),
        F.when(~failed, F.array(F.lit("gold"))).alias("artifacts"),
        F.array_compact(F.array(F.when(failed, error))).alias("errors"),
        (F.col("user_id") % 3).alias("retries"),
        F.col("user_id").alias("total_rows"),
    )
    path = scratch_path(spark, "ledger")
    L.append_reports(reports, path)
    return L.read_reports(spark, path)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_summary(_reports(spark, sf_dir))


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = L.step_metrics(_reports(spark, sf_dir))
    return metrics.select("execution_id", "name", "status", "attempts", "duration_seconds", "rows_in")


def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_errors(_reports(spark, sf_dir))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_run(_reports(spark, sf_dir))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_counts(_reports(spark, sf_dir))


def folder_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.folder_run_totals(_reports(spark, sf_dir))


def _lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    path = scratch_path(spark, "log")
    lines.write.text(path)
    return spark.read.text(path)


def log_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    agent = F.concat(F.lit("Agent: "), F.initcap("event_type"), F.lit(" agent | "))
    line = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit("["), time, F.lit("] ERROR | "), agent, F.lit("Message: "), F.col("props")),
    ).otherwise(F.concat(F.lit("["), time, F.lit("] PASS | "), agent, F.col("props")))
    events = table(spark, sf_dir, "events")
    return L.log_counts(_lines(spark, events.select(line.alias("line"))))


def step_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STEPS])
    state = (
        F.when(F.col("event_type") == "error", "FAILED")
        .when(F.col("event_type").isin("view", "click"), "START")
        .otherwise("SUCCESS")
    )
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSSSSS"),
        F.lit(" | INFO | STEP "),
        state,
        F.lit(" | id=EXEC_"),
        F.col("user_id").cast("string"),
        F.lit(" | step="),
        F.get(names, (F.col("event_id") % len(STEPS)).cast("int")),
        F.lit(" | attempt=1/3"),
    )
    events = table(spark, sf_dir, "events")
    return L.step_status(_lines(spark, events.select(line.alias("line"))))


QUERIES = {
    "run_summary": run_summary,
    "step_metrics": step_metrics,
    "run_errors": run_errors,
    "latest_run": latest_run,
    "run_counts": run_counts,
    "folder_run_totals": folder_run_totals,
    "log_analytics": log_analytics,
    "step_status_log": step_status_log,
}

_RUNS = """
    SELECT 'EXEC_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS execution_id, *,
           event_type = 'error' AS failed,
           CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at FROM events"""
_NAMES = ", ".join(f"'{s}'" for s in STEPS)

ORACLE = {
    "run_summary": sql(
        """SELECT execution_id, 'data/raw/User_' || user_id || '.csv' AS source, status,
                  value AS duration_seconds, CASE WHEN failed THEN 2 ELSE 3 END AS steps,
                  CASE WHEN failed THEN 1 ELSE 3 END AS successful_steps, user_id % 3 AS retries,
                  CASE WHEN failed THEN 0 ELSE 1 END AS artifacts,
                  CASE WHEN failed THEN 1 ELSE 0 END AS errors FROM runs""",
        runs=_RUNS,
    ),
    "step_metrics": sql(
        """SELECT execution_id, name,
                  CASE WHEN failed AND name = 'QUALITY' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
                  CAST(1 AS BIGINT) AS attempts, value AS duration_seconds, user_id AS rows_in
           FROM runs, (VALUES ('SOURCE'), ('QUALITY'), ('GOLD')) AS s(name)
           WHERE NOT (failed AND name = 'GOLD')""",
        runs=_RUNS,
    ),
    "run_errors": sql(
        """SELECT 'QUALITY' AS step,
                  CASE WHEN value > 10 THEN 'ValueError' ELSE 'KeyError' END AS type,
                  count(*) AS errors FROM runs WHERE failed GROUP BY ALL""",
        runs=_RUNS,
    ),
    "latest_run": sql(
        """SELECT 'user_' || user_id || '.csv' AS source, execution_id, status, started_at
           FROM runs QUALIFY row_number() OVER (PARTITION BY user_id
                                                ORDER BY started_at DESC, execution_id DESC) = 1""",
        runs=_RUNS,
    ),
    "run_counts": sql(
        """SELECT count(*) AS total, count(*) FILTER (WHERE NOT failed) AS success,
                  count(*) FILTER (WHERE failed) AS failed FROM runs""",
        runs=_RUNS,
    ),
    "folder_run_totals": sql(
        """SELECT count(*) AS files, count(*) FILTER (WHERE NOT failed) AS successful_files,
                  count(*) FILTER (WHERE failed) AS failed_files,
                  CAST(sum(user_id) AS BIGINT) AS total_rows,
                  CAST(sum(CASE WHEN failed THEN 1 ELSE 3 END) AS BIGINT) AS passed_steps,
                  CAST(sum(CASE WHEN failed THEN 2 ELSE 3 END) AS BIGINT) AS steps,
                  CASE WHEN bool_or(failed) THEN 'COMPLETED WITH ERRORS' ELSE 'SUCCESS' END
                      AS final_status FROM runs""",
        runs=_RUNS,
    ),
    "log_analytics": """
        SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'PASS' END AS level,
               upper(event_type[1]) || event_type[2:] || ' agent' AS agent, count(*) AS lines,
               strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first,
               strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last
        FROM events GROUP BY ALL""",
    "step_status_log": f"""
        SELECT 'EXEC_' || user_id AS execution_id, [{_NAMES}][event_id % 8 + 1] AS step,
               arg_max(CASE WHEN event_type = 'error' THEN 'FAILED'
                            WHEN event_type IN ('view', 'click') THEN 'RUNNING'
                            ELSE 'COMPLETE' END, ts) AS status
        FROM events GROUP BY ALL""",
}
