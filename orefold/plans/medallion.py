"""From raw rows to checked silver and gold tables."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import quality as Q
from orefold.operators import validation as C
from orefold.operators.clean import role_transform
from orefold.operators.gold import insights
from orefold.operators.filetree import ReadFiles, file_state, list_files, read_tree
from orefold.operators.incremental import (
    CHANGED,
    OVERTAKEN,
    READY,
    Order,
    beyond,
    checkpoint_number,
    commit_checkpoint,
    high_water_values,
    incremental_status,
    read_checkpoints,
    source_state,
)
from orefold.operators.ledger import FAILED, REPORT_SCHEMA, SUCCESS, append_reports
from orefold.operators.roles import ColumnRole, classify, collect_roles
from orefold.operators.profile import column_stats
from orefold.operators.series import trend_summary
from orefold.operators.signals import decisions
from orefold.plans.gold import GoldLayout, checked_analytics, time_series
from orefold.session import materialize, remove_folder
from orefold.sources.csv import RAGGED, SOURCE_PATH, read_strings, read_with_ragged_flag
from orefold.sources.files import ingestion_audit, listed_files
from orefold.sources.sinks import write_silver, write_table


@dataclass(frozen=True)
class Gates:
    """What may stop a run."""

    stop_on_quality_failure: bool = False
    stop_on_validation_failure: bool = False
    primary_only: bool = True


@dataclass(frozen=True)
class MedallionRun:
    """What a run found and wrote; the tables themselves stay in storage."""

    roles: list[ColumnRole]
    quality: dict
    validation: dict
    stopped_by: str | None = None
    silver: str | None = None
    gold: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class FileRun:
    """How the run of one file of a folder ended."""

    state: str
    run: MedallionRun | None
    message: str | None
    started: float
    ended: float


def run_table(raw: DataFrame, target: str, gates: Gates = Gates()) -> MedallionRun:
    """Profile, check, clean and aggregate one table of raw text rows.

    Only one-row check results and one record per column come to the driver.
    """
    spark = raw.sparkSession
    flagged = RAGGED in raw.columns
    ragged = RAGGED if flagged else None
    data = raw.drop(RAGGED)
    roles = collect_roles(classify(column_stats(data)))
    counters = materialize(Q.quality_counters(raw, roles, ragged), "counters")
    quality = Q.quality_score(Q.quality_report(counters)).first().asDict()
    quality["row_count"] = counters.first()["row_count"]
    verdict = C.validation_verdict(raw, roles, ragged, gates.primary_only).first().asDict()
    stopped_by = None
    if gates.stop_on_quality_failure and not Q.quality_gate(
        quality["status"], quality["score"]
    ):
        stopped_by = "QUALITY"
    elif gates.stop_on_validation_failure and not verdict["valid"]:
        stopped_by = "VALIDATION"
    if stopped_by:
        return MedallionRun(roles, quality, verdict, stopped_by)

    silver_path = f"{target}/silver"
    write_silver(role_transform(data, roles), silver_path, [c.name for c in roles])
    silver = spark.read.parquet(silver_path)

    layout = GoldLayout.from_roles(roles)
    written = _gold_products(data, silver, layout, f"{target}/gold")
    return MedallionRun(roles, quality, verdict, None, silver_path, written)


def _gold_products(
    source: DataFrame, silver: DataFrame, layout: GoldLayout, path: str
) -> dict[str, str]:
    """Write the gold products of a run and say where each one is.

    The detail is written first and read back: analytics, series and reconciliation see
    the rows that are in storage, so a detail that lost rows is noticed. Insights, trends
    and decisions are drawn from the written analytics and series.
    """
    spark = source.sparkSession
    written: dict[str, str] = {}

    def write(name: str, table: DataFrame) -> DataFrame:
        written[name] = f"{path}/{name}"
        write_table(table, written[name])
        return spark.read.parquet(written[name])

    detail = write("detail", silver)
    checked, _, _ = checked_analytics(source, detail, layout)
    gold = write("analytics", checked)
    series = time_series(detail, layout.measures)
    if series is not None:
        series = write("time_series", series)
    if layout.measures:
        write("insights", insights(gold, layout.dimensions, layout.measures))
        if series is not None:
            write("trends", trend_summary(series, layout.measures))
    write("decisions", decisions(gold, layout.dimensions, layout.measures))
    return written


def run_file(
    spark: SparkSession, path: str, target: str, gates: Gates = Gates()
) -> MedallionRun:
    """Run one CSV file or folder of equal files.

    The text is parsed once, into a columnar bronze table that every later pass reads.
    """
    bronze = f"{target}/bronze"
    write_table(read_with_ragged_flag(spark, path), bronze)
    return run_table(spark.read.parquet(bronze), target, gates)


def run_name(path: str, folder: str) -> str:
    """A file's path below the folder as the name of one folder. Every path has its own:
    what is not a letter, digit, dot or dash is written as its bytes."""
    below = path.split(folder.rstrip("/").split(":")[-1] + "/", 1)[-1].removesuffix(".csv")
    return re.sub(
        r"[^A-Za-z0-9.-]", lambda found: "".join(f"_{b:02x}" for b in found[0].encode()), below
    )


def attempt_file(
    spark: SparkSession,
    path: str,
    target: str,
    gates: Gates = Gates(),
    size: int | None = None,
    header: Sequence[str] | None = None,
) -> FileRun:
    """Run one file and say how it ended; no fault of the file is raised.

    The state is SUCCESS, STOPPED by a gate, EMPTY for a file without content, or FAILED
    with the error. With a ``header``, a file of other columns fails.
    """
    started = time.time()
    if size == 0:
        return FileRun("EMPTY", None, "no content", started, time.time())
    try:
        if header is not None:
            found = read_strings(spark, path).columns
            if found != list(header):
                raise ValueError(f"columns {found} are not {list(header)}")
        run = run_file(spark, path, target, gates)
    except Exception as error:  # noqa: BLE001 - any fault of one file is its own
        return FileRun("FAILED", None, str(error).split("\n")[0], started, time.time())
    state = "STOPPED" if run.stopped_by else "SUCCESS"
    return FileRun(state, run, run.stopped_by, started, time.time())


def attempt_files(
    spark: SparkSession,
    sizes: dict[str, int],
    folder: str,
    target: str,
    gates: Gates = Gates(),
    at_once: int = 4,
    header: Sequence[str] | None = None,
    prefix: str = "",
) -> dict[str, FileRun]:
    """Run files by themselves, several at a time, each to a folder of its own."""
    with ThreadPoolExecutor(at_once) as pool:
        pending = {
            path: pool.submit(
                attempt_file,
                spark, path, f"{target}/{prefix}{run_name(path, folder)}", gates, size, header,
            )
            for path, size in sorted(sizes.items())
        }
        return {path: future.result() for path, future in pending.items()}


def run_folder(
    spark: SparkSession,
    folder: str,
    target: str,
    gates: Gates = Gates(),
    ledger: str | None = None,
    at_once: int = 4,
) -> dict[str, FileRun]:
    """Run every CSV file below a folder by itself, several at a time.

    Every listed file is in the result under its full path, with a state: SUCCESS,
    STOPPED by a gate, EMPTY, or FAILED with the error, which does not stop the others.
    Each run is spread over the cluster; the driver only keeps one record per file. With
    a ``ledger`` the runs are appended to it as reports.
    """
    audit = ingestion_audit(spark, folder, "FOLDER")
    filled = {row["raw_path"] for row in audit.select("raw_path").toLocalIterator()}
    execution = uuid.uuid4().hex[:12]
    sizes = {path: int(path in filled) for path in listed_files(spark, folder)}
    found = attempt_files(spark, sizes, folder, target, gates, at_once)
    if ledger:
        append_reports(_reports(spark, found, execution), ledger)
    return found


def _reports(spark: SparkSession, runs: dict[str, FileRun], execution: str) -> DataFrame:
    """The runs as ledger reports; a file that did not run to its end counts as failed."""
    rows = []
    for i, (path, run) in enumerate(runs.items()):
        done = run.state == "SUCCESS"
        rows_out = run.run.quality.get("row_count", 0) if run.run else 0
        times = [datetime.fromtimestamp(t).isoformat(sep=" ") for t in (run.started, run.ended)]
        seconds = round(run.ended - run.started, 3)
        state = SUCCESS if done else FAILED
        step = ("MEDALLION", state, 1, seconds, None, rows_out, run.run.silver if run.run else None)
        errors = [] if done else [("MEDALLION", 1, run.state, run.message, times[1])]
        artifacts = sorted(run.run.gold.values()) if run.run else []
        rows.append(
            (f"{execution}_{i}", "medallion", path, state, *times, seconds, [step], artifacts,
             errors, 0, rows_out)
        )
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def run_incremental(
    raw: DataFrame,
    source: str,
    order: Order,
    target: str,
    checkpoints: str,
    execution_id: str,
    gates: Gates = Gates(),
    force: bool = False,
) -> tuple[str, MedallionRun | None]:
    """Run the rows that came to an append-only table since its last checkpoint.

    ``order`` names the columns, or gives the expressions, that put rows in their order
    of arrival; numbers that were read as text need a cast. The checkpoint holds the
    highest place that was processed and a fingerprint of all rows up to it. New rows are
    taken by a filter on that place, and only if the rows up to it are still the same: a
    row that comes late, or an edited one, is reported as ``CHANGED_NOT_APPENDED``. The
    checkpoint is written after the run; a run that a gate stopped leaves none, so its
    rows come again. Of two runs that started from one checkpoint only the first to end
    counts: the other deletes its tables and returns ``OVERTAKEN``. Every run needs an
    ``execution_id`` of its own; the runs whose tables count are those that
    :func:`~orefold.operators.incremental.committed_runs` names. Returns the incremental
    status and the run, if there was one.
    """
    spark = raw.sparkSession
    seen = checkpoint_number(spark, checkpoints, source)
    known = read_checkpoints(spark, checkpoints).where(F.col("source") == source)
    last = known.select("high_water", "updated_at").first()
    stored = last["high_water"] if last else None
    current = source_state(raw, source, order, stored)
    status = materialize(incremental_status(current, known, force), "status")
    found = status.first()
    run = None
    if found["status"] == READY:
        batch = raw
        if found["start_row"]:
            batch = raw.where(beyond(order, high_water_values(raw, order, stored)))
        run = _run_batch(batch, f"{target}/{execution_id}", gates)
    if run is None or run.stopped_by is None:
        previous = last["updated_at"] if last else None
        if not commit_checkpoint(status, execution_id, checkpoints, source, seen, previous):
            remove_folder(spark, f"{target}/{execution_id}")
            return OVERTAKEN, None
    return found["status"], run


def _run_batch(batch: DataFrame, target: str, gates: Gates) -> MedallionRun:
    """Run a batch that is written once: later passes read it, not the source again."""
    bronze = f"{target}/bronze"
    write_table(batch, bronze)
    return run_table(batch.sparkSession.read.parquet(bronze), target, gates)


def tree_path(checkpoints: str, source: str, execution_id: str) -> str:
    """Where the fingerprint tree of a checkpoint is kept."""
    name = hashlib.sha256(source.encode()).hexdigest()[:24]
    return f"{checkpoints.rstrip('/')}-trees/{name}/{execution_id}"


def run_incremental_files(
    spark: SparkSession,
    folder: str,
    source: str,
    order: Order,
    target: str,
    checkpoints: str,
    execution_id: str,
    gates: Gates = Gates(),
    force: bool = False,
    verify: bool = False,
    pattern: str = "*.csv",
    read: ReadFiles | None = None,
) -> tuple[str, MedallionRun | None, list[str]]:
    """Run the rows that came to a folder of equal files since its last checkpoint.

    As :func:`run_incremental`, but the state of files that were processed comes from the
    fingerprint tree kept with the checkpoint: only files that are new, or of another
    length or time, are read. Late rows, edited rows and missing files are found as there.
    ``verify`` reads all files again, and so notices a file that changed without another
    length or time. ``read`` gives the rows of files with their paths; the default reads
    CSV files of one header. Returns the status, the run, and the files that were read.

    The tree is written before the checkpoint that names it, so a run that fails in
    between leaves the old checkpoint with the old tree.
    """

    def read_csv(paths: list[str]) -> DataFrame:
        return read_with_ragged_flag(spark, paths, with_path=True)

    read = read or read_csv
    seen = checkpoint_number(spark, checkpoints, source)
    known = read_checkpoints(spark, checkpoints).where(F.col("source") == source)
    last = known.select("high_water", "execution_id", "updated_at").first()
    stored = last["high_water"] if last else None
    before = tree_path(checkpoints, source, last["execution_id"]) if last else None
    tree = read_tree(spark, before) if before else read_tree(spark, f"{checkpoints}-trees/none")
    listing = materialize(list_files(spark, folder, pattern), "listing")
    unread = tree.limit(0) if verify or force else tree
    state = file_state(listing, unread, read, source, order, stored)
    status = materialize(incremental_status(state.current, known, force), "status")
    found = status.first()
    run = None
    if found["status"] == READY and state.rows is not None:
        batch = state.rows
        if found["start_row"]:
            batch = batch.where(beyond(order, high_water_values(batch, order, stored)))
        run = _run_batch(batch.drop(SOURCE_PATH), f"{target}/{execution_id}", gates)
    if found["status"] != CHANGED and (run is None or run.stopped_by is None):
        leaves, previous = tree_path(checkpoints, source, execution_id), last and last["updated_at"]
        write_table(state.leaves, leaves)
        if not commit_checkpoint(status, execution_id, checkpoints, source, seen, previous):
            remove_folder(spark, f"{target}/{execution_id}")
            remove_folder(spark, leaves)
            return OVERTAKEN, None, state.read_paths
    return found["status"], run, state.read_paths
