"""Section K: incremental runs and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators import incremental as I
from orefold.operators.filetree import file_state, list_files, read_tree, tree_changes
from orefold.operators.ledger import (
    CHECKPOINT_SCHEMA,
    checkpoint_summary,
    checkpoint_table,
    folder_run_totals,
    read_reports,
)
from orefold.operators.roles import ColumnRole
from orefold.operators.series import monthly_series
from orefold.plans.medallion import run_folder
from orefold.session import materialize, remove_folder, scratch_path
from orefold.sources.csv import read_with_ragged_flag
from orefold.sources.files import table_fingerprint
from orefold.sources.sinks import write_table
from orefold.streaming import feed, keyed
from registry.views import dirty_orders, rounded, sales_lines, sales_orders, sql, table

SOURCES = ("orders", "customer", "part", "supplier")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = [
        table_fingerprint(table(spark, sf_dir, name)).withColumn("source", F.lit(f"raw/{name}.csv"))
        for name in SOURCES
    ]
    first, second, third, fourth = prints
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders unchanged, customers grown by a third, parts edited, suppliers new."""
    path = scratch_path(spark, "checkpoints")
    current = _current(spark, sf_dir)
    earlier = I.incremental_status(current, current.limit(0).select(
        "source",
        "fingerprint",
        F.col("row_count").alias("processed_row_count"),
    ))
    name = F.col("source")
    seen = earlier.filter(name != "raw/supplier.csv").withColumns(
        {
            "fingerprint": F.when(name == "raw/orders.csv", F.col("fingerprint")).otherwise("0"),
            "source_row_count": F.when(
                name == "raw/customer.csv", F.floor(F.col("source_row_count") * 2 / 3)
            ).otherwise(F.col("source_row_count")),
        }
    )
    I.commit_checkpoints(seen, "EXEC_1", path)
    return I.read_checkpoints(spark, path)


def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = I.incremental_status(_current(spark, sf_dir), _checkpoints(spark, sf_dir))
    return status.drop("fingerprint")


def incremental_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = I.incremental_status(
        _current(spark, sf_dir), _checkpoints(spark, sf_dir), force=True
    )
    return status.drop("fingerprint")


def checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_table(_checkpoints(spark, sf_dir)).drop("updated")


def checkpoint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_summary(_checkpoints(spark, sf_dir)).select(
        "checkpoints", "any_skipped", F.col("updated_at").isNotNull().alias("dated")
    )


def checkpoint_totals_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a second run: orders are skipped, parts stay reported, suppliers are new."""
    path = scratch_path(spark, "later")
    known = _checkpoints(spark, sf_dir)
    I.commit_checkpoints(I.incremental_status(_current(spark, sf_dir), known), "EXEC_2", path)
    return checkpoint_summary(I.read_checkpoints(spark, path)).withColumn(
        "updated_at", F.col("updated_at").isNotNull()
    )


def incremental_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders after as many rows as there are customers, in date and key order."""
    processed = table(spark, sf_dir, "customer").count()
    return I.tail_rows(sales_orders(spark, sf_dir), [F.asc("order_date"), F.asc("order_id")], processed).select(
        "order_id", "customer_id", "amount"
    )


def incremental_tail_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return I.tail_after(sales_orders(spark, sf_dir), "order_id", last).select(
        "order_id", "customer_id", "amount"
    )


def incremental_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw orders hold beyond one copy of every row."""
    dirty = dirty_orders(spark, sf_dir)
    return I.new_rows(dirty, dirty.distinct())


def stream_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lie in the folder already and are ignored; suppliers arrive."""
    folder, seen, result = (scratch_path(spark, n) for n in ("feed", "seen", "arrived"))
    customers = table(spark, sf_dir, "customer")
    suppliers = table(spark, sf_dir, "supplier")
    present = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    arriving = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    write_table(present, folder, format="csv", mode="append")
    stream = feed.new_files(spark, folder, present.schema)
    feed.ignore_existing(stream, seen)
    write_table(arriving, folder, format="csv", mode="append")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result}/batch_id={batch_id}")

    feed.start_feed(stream, store, seen).awaitTermination()
    return spark.read.parquet(result).select("id", "name")


def stream_medallion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw orders arrive in many files; the silver rows of all runs."""
    folder, target = scratch_path(spark, "arrivals"), scratch_path(spark, "runs")
    dirty = dirty_orders(spark, sf_dir)
    write_table(dirty.repartition(3), folder, format="csv")
    feed.refine_new_files(
        spark, folder, dirty.schema, target, scratch_path(spark, "state"), files_per_batch=2
    ).awaitTermination()
    return spark.read.parquet(f"{target}/run_id=*/file=*/silver")


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    folder = scratch_path(spark, "stream")
    write_table(df.repartition(6), folder, format="csv")
    return feed.new_files(spark, folder, df.schema, files_per_batch=2)


def stream_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly series of the lines, kept up to date over several batches."""
    lines = sales_lines(spark, sf_dir).select("amount", "quantity", "transaction_date")
    series = monthly_series(_stream(spark, lines), "transaction_date", ["amount", "quantity"])
    path = scratch_path(spark, "series")
    feed.keep_result(series, path, scratch_path(spark, "state")).awaitTermination()
    return rounded(feed.latest_result(spark, path))


def stream_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type from a stream with a watermark."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    daily = feed.daily_series(
        _stream(spark, events), "ts", ["value"], ["event_type"], lateness="100 days"
    )
    path = scratch_path(spark, "daily")
    feed.keep_updates(daily, path, scratch_path(spark, "state")).awaitTermination()
    return rounded(feed.current_rows(spark, path, ["period", "event_type"]))


def stream_current_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same days and types, kept in one table whose updates are merged as they come."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    daily = feed.daily_series(
        _stream(spark, events), "ts", ["value"], ["event_type"], lateness="100 days"
    )
    current = keyed.KeyedTable(scratch_path(spark, "current"), ["period", "event_type"], every=2)
    keyed.keep_table(daily, current, scratch_path(spark, "state")).awaitTermination()
    return rounded(current.read(spark))


def _arriving_copies(spark: SparkSession, sf_dir: str, key: str | None) -> keyed.KeyedTable:
    """The raw orders arrive two years at a time, each time in several batches."""
    folder, state = scratch_path(spark, "arriving"), scratch_path(spark, "state")
    seen = keyed.copies_table(scratch_path(spark, "copies"), "800 days", every=2)
    dirty = dirty_orders(spark, sf_dir)
    year = F.year(V.timestamp(dirty, "order_date"))
    span = dirty.agg(F.min(year).alias("first"), F.max(year).alias("last")).first()
    for first in range(span["first"], span["last"] + 1, 2):
        # Years go in pairs, and what has no date goes with the first.
        part = F.coalesce(year, F.lit(span["first"])).between(first, first + 1)
        write_table(dirty.where(part).repartition(4), folder, format="csv", mode="append")
        stream = feed.new_files(spark, folder, dirty.schema, files_per_batch=2)
        keyed.keep_copies(stream, seen, state, "order_date", key).awaitTermination()
    return seen


def stream_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rows of the raw orders, found as they arrive."""
    return keyed.duplicate_count(spark, _arriving_copies(spark, sf_dir, None))


def stream_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids that arrive more than once, and how often."""
    return keyed.repeated_keys(spark, _arriving_copies(spark, sf_dir, "order_id"))


def racing_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one source end after the same checkpoint, then a third follows."""
    path, orders = scratch_path(spark, "race"), sales_orders(spark, sf_dir)
    older = orders.where("order_id % 2 = 0")
    outcomes = []
    for name, rows, seen in (("first", older, 0), ("second", older, 0), ("third", orders, 1)):
        known = I.read_checkpoints(spark, path)
        status = I.incremental_status(I.source_state(rows, "orders", ["order_id"]), known, force=True)
        outcomes.append((name, I.commit_checkpoint(status, name, path, "orders", seen)))
    ran = spark.read.schema(CHECKPOINT_SCHEMA).json(path).select(
        F.col("execution_id").alias("run"), F.col("processed_row_count").alias("order_count")
    )
    return spark.createDataFrame(outcomes, "run string, committed boolean").join(ran, "run", "left")


COUNTED = [ColumnRole("order_id", "integer", "KEY"), ColumnRole("amount", "float", "MEASURE")]


def stream_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counters of the raw orders, kept up to date over several batches."""
    counts = feed.quality_counts(_stream(spark, dirty_orders(spark, sf_dir)), COUNTED)
    path = scratch_path(spark, "counts")
    feed.keep_result(counts, path, scratch_path(spark, "state")).awaitTermination()
    return feed.latest_result(spark, path)


def _processed(
    spark: SparkSession, first: DataFrame, later: DataFrame, order: I.Order | None = None
) -> DataFrame:
    """Commit the state of ``first``; the status and the new rows when ``later`` is found."""
    path, order = scratch_path(spark, "water"), order or [F.col("order_id").cast("bigint")]
    none = I.read_checkpoints(spark, path)
    I.commit_checkpoints(
        I.incremental_status(I.source_state(first, "orders", order), none), "EXEC_1", path
    )
    known = I.read_checkpoints(spark, path)
    stored = known.first()["high_water"]
    status = I.incremental_status(I.source_state(later, "orders", order, stored), known)
    last = I.high_water_values(later, order, stored)
    beyond = later.where(I.beyond(order, last))
    return status.select(
        "status", "start_row", "rows_to_process",
        beyond.agg(F.count("*")).scalar().alias("rows_beyond"),
        beyond.agg(F.sum(F.col("order_id").cast("bigint"))).scalar().alias("keys_beyond"),
    )


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose keys are numbers read as text."""
    return sales_orders(spark, sf_dir).select(
        F.col("order_id").cast("string").alias("order_id"), "status",
        F.col("amount").cast("decimal(18,2)").alias("amount"),
    )


def _half(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]


def incremental_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys up to a number were processed, then the others arrive."""
    orders, half = _keyed(spark, sf_dir), _half(spark, sf_dir)
    first = orders.where(F.col("order_id").cast("bigint") <= half)
    return _processed(spark, first, orders)


def incremental_late_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside new rows, rows arrive that belong before the last processed one."""
    orders, half = _keyed(spark, sf_dir), _half(spark, sf_dir)
    key = F.col("order_id").cast("bigint")
    first = orders.where((key <= half) & (key % 10 != 3))
    return _processed(spark, first, orders)


def incremental_edited_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside new rows, processed rows have changed."""
    orders, half = _keyed(spark, sf_dir), _half(spark, sf_dir)
    key = F.col("order_id").cast("bigint")
    first = orders.where(key <= half).withColumn(
        "status", F.when(key % 10 == 3, "?").otherwise(F.col("status"))
    )
    return _processed(spark, first, orders)


def incremental_typed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys up to a number were processed, then the others arrive, in orders of several
    types: microseconds, zone-free microseconds, decimals, days with a key, text, bytes."""
    orders, half = _keyed(spark, sf_dir), _half(spark, sf_dir)
    key = F.col("order_id").cast("bigint")
    orders = orders.withColumns(
        {
            "instant": F.timestamp_micros(F.lit(1_700_000_000_000_000) + key),
            "moment": F.timestamp_micros(F.lit(1_700_000_000_000_000) + key).cast("timestamp_ntz"),
            "exact": (key.cast("decimal(38,10)") + F.lit("0.0000000001").cast("decimal(38,10)")),
            "day": F.date_add(F.lit("2020-01-01").cast("date"), (key / 1000).cast("int")),
            "words": F.concat(F.lit('"é '), F.lpad("order_id", 12, "0")),
            "bytes": F.unhex(F.lpad(F.hex(key), 16, "0")),
        }
    )
    first = orders.where(key <= half)
    kinds = {name: [name] for name in ("instant", "moment", "exact", "words", "bytes")}
    kinds["day"] = ["day", key]
    found = [
        _processed(spark, first, orders, order).withColumn("kind", F.lit(kind))
        for kind, order in kinds.items()
    ]
    return reduce(DataFrame.unionByName, found)


STEPS = (
    ("appended", "key > half and key <= 2 * half", 0),
    ("nothing new", "false", 0),
    ("late rows", "key <= half and key % 10 = 3", 1),
    ("appended again", "key > 2 * half", 0),
    ("copied rows", "key <= half and key % 10 = 4", 1),
)
"""What arrives in a folder of processed files, and whether it is taken away again."""


def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of orders arrive in a folder step by step; what each step finds, from a scan
    of the files that came with it."""
    folder, trees = scratch_path(spark, "tree-folder"), scratch_path(spark, "trees")
    checkpoints = scratch_path(spark, "tree-checkpoints")
    key, half = F.col("order_id").cast("bigint"), _half(spark, sf_dir)
    orders = _keyed(spark, sf_dir).withColumns({"key": key, "half": F.lit(half)})
    data = orders.where((key <= half) & (key % 10 != 3)).drop("key", "half")
    write_table(data, f"{folder}/first", format="csv")
    found = []

    def look(step: str, commit: bool) -> None:
        known = I.read_checkpoints(spark, checkpoints)
        last = known.first()
        stored = last["high_water"] if last else None
        tree = read_tree(spark, f"{trees}/{last['execution_id']}" if last else f"{trees}/none")
        listing = list_files(spark, folder)
        state = file_state(listing, tree, _read_paths(spark), "orders", [key], stored)
        status = materialize(I.incremental_status(state.current, known), "status")
        if commit and status.first()["status"] != I.CHANGED:
            write_table(state.leaves, f"{trees}/{step}")
            I.commit_checkpoints(status, step, checkpoints)
        read = state.rows.count() if state.rows is not None else 0
        found.append(
            status.select(
                F.lit(step).alias("step"), "status", "start_row", "rows_to_process",
                F.lit(read).cast("bigint").alias("rows_read"),
            )
        )

    look("first", True)
    for step, condition, undone in STEPS:
        arriving = orders.where(condition).drop("key", "half")
        path = f"{folder}/{step.replace(' ', '-')}"
        if condition != "false":
            write_table(arriving, path, format="csv")
        look(step, not undone)
        if undone:
            remove_folder(spark, path)
    return reduce(DataFrame.union, found)


def _read_paths(spark: SparkSession):
    return lambda paths: read_with_ragged_flag(spark, paths, with_path=True)


def fingerprint_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a folder per status; one folder changes, one goes, one comes. The states
    of the folders and the table, with their rows."""
    folder = scratch_path(spark, "levels")
    orders = _keyed(spark, sf_dir)

    def leaves(tree: DataFrame) -> DataFrame:
        listing = list_files(spark, folder)
        return file_state(listing, tree, _read_paths(spark), "orders", ["order_id"]).leaves

    for status in ("F", "O", "P"):
        write_table(orders.where(F.col("status") == status), f"{folder}/{status}", format="csv")
    before = leaves(read_tree(spark, f"{folder}-none"))
    grown = orders.where("status = 'F' and int(order_id) % 2 = 0")
    write_table(grown, f"{folder}/F", format="csv", mode="append")
    remove_folder(spark, f"{folder}/P")
    write_table(orders.where("status = 'P'"), f"{folder}/P2", format="csv")
    levels = tree_changes(before, leaves(before)).where("level <> 'file'")
    return levels.select(
        "level", F.regexp_extract("path", "([^/]*)$", 1).alias("folder"), "state",
        "rows_before", "rows_now",
    )


def _put(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """One text file of a stated name, made from a one-column table."""
    made = scratch_path(spark, "one-file")
    lines.coalesce(1).write.text(made)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(hadoop)
    system.mkdirs(target.getParent())
    for found in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{made}/part-*")):
        system.rename(found.getPath(), target)


def _arrivals(spark: SparkSession, sf_dir: str) -> str:
    """Good files, two of one name and two whose paths look alike, a blank one without a
    header, one of other columns, and one that is empty."""
    folder = scratch_path(spark, "arriving")
    orders = _keyed(spark, sf_dir)
    rows = F.concat_ws(",", "order_id", "status", F.col("amount").cast("string"))

    def lines(header: str, condition: str) -> DataFrame:
        body = orders.where(condition).select(rows.alias("value"))
        return spark.createDataFrame([(header,)], "value string").union(body)

    header = "order_id,status,amount"
    _put(spark, lines(header, "status = 'F'"), f"{folder}/a/b.csv")
    _put(spark, lines(header, "status = 'O' and amount < 100000"), f"{folder}/a__b.csv")
    _put(spark, lines(header, "status = 'O' and amount >= 100000"), f"{folder}/c/b.csv")
    _put(spark, lines(header, "status = 'P'"), f"{folder}/c/d/p.csv")
    _put(spark, lines("order_id,other,amount", "status = 'P'"), f"{folder}/odd.csv")
    _put(spark, spark.createDataFrame([("",)] * 3, "value string"), f"{folder}/blank.csv")
    _put(spark, spark.createDataFrame([], "value string"), f"{folder}/empty.csv")
    return folder


def _below(path: str, folder: str) -> Column:
    """A file's path below the folder."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return F.substring_index(path, f"/{name}/", -1).alias("file")


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive, bad ones among them; the feed ends normally, and a second start has
    nothing to do. How each file ended, its rows, and the rows of its silver table."""
    folder, target, state = _arrivals(spark, sf_dir), scratch_path(spark, "fed"), scratch_path(spark, "fed-state")
    schema = _keyed(spark, sf_dir).schema
    for _ in range(2):
        feed.refine_new_files(spark, folder, schema, target, state, files_per_batch=3).awaitTermination()
    outcomes = feed.file_outcomes(spark, target)
    silver = spark.read.parquet(f"{target}/run_id=*/file=*/silver").select(
        F.regexp_replace(F.col("_metadata.file_path"), "/silver/[^/]*$", "").alias("at")
    )
    kept = silver.groupBy(F.substring_index("at", "/file=", -1).alias("name")).agg(
        F.count("*").alias("silver_rows")
    )
    return outcomes.join(
        kept, F.substring_index("target", "/file=", -1) == F.col("name"), "left"
    ).select(_below("path", folder), "state", "rows", "attempts", "silver_rows")


def stream_quarantine_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files set aside one is mended, then all of them are tried again."""
    folder, target = _arrivals(spark, sf_dir), scratch_path(spark, "retried")
    schema = _keyed(spark, sf_dir).schema
    feed.refine_new_files(
        spark, folder, schema, target, scratch_path(spark, "retried-state")
    ).awaitTermination()
    remove_folder(spark, f"{folder}/odd.csv")
    body = _keyed(spark, sf_dir).where("status = 'P'").select(
        F.concat_ws(",", "order_id", "status", F.col("amount").cast("string")).alias("value")
    )
    mended = spark.createDataFrame([("order_id,status,amount",)], "value string").union(body)
    _put(spark, mended, f"{folder}/odd.csv")
    feed.retry_quarantined(spark, folder, schema, target)
    return feed.file_outcomes(spark, target).select(
        _below("path", folder), "state", "rows", "attempts"
    )


def folder_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder run over the same files: the state of each, and the totals of its ledger."""
    folder, target, ledger = (
        _arrivals(spark, sf_dir), scratch_path(spark, "folder-run"), scratch_path(spark, "folder-ledger"),
    )
    runs = run_folder(spark, folder, target, ledger=ledger)
    rows = [
        (path, run.state, run.run.silver if run.run else None) for path, run in runs.items()
    ]
    counted = [
        spark.read.parquet(silver).agg(F.count("*").alias("silver_rows")).select(
            F.lit(path).alias("path"), F.lit(state).alias("state"), "silver_rows"
        )
        if silver
        else spark.createDataFrame([(path, state, None)], "path string, state string, silver_rows bigint")
        for path, state, silver in rows
    ]
    totals = folder_run_totals(read_reports(spark, ledger)).select(
        F.lit("failed files").alias("file"),
        F.concat(F.col("failed_files").cast("string"), F.lit(" of "), F.col("files").cast("string")).alias("state"),
        F.col("total_rows").cast("bigint").alias("silver_rows"),
    )
    each = reduce(DataFrame.union, counted)
    return each.select(_below("path", folder), "state", "silver_rows").union(totals)


QUERIES = {
    "stream_current_table": stream_current_table,
    "stream_duplicate_rows": stream_duplicate_rows,
    "stream_duplicate_keys": stream_duplicate_keys,
    "racing_checkpoints": racing_checkpoints,
    "stream_quarantine": stream_quarantine,
    "stream_quarantine_retried": stream_quarantine_retried,
    "folder_run": folder_run,
    "incremental_typed_places": incremental_typed_places,
    "incremental_files": incremental_files,
    "fingerprint_tree": fingerprint_tree,
    "incremental_status": incremental_status,
    "incremental_forced": incremental_forced,
    "checkpoint_report": checkpoint_report,
    "checkpoint_totals": checkpoint_totals,
    "checkpoint_totals_later": checkpoint_totals_later,
    "incremental_tail": incremental_tail,
    "incremental_tail_sequence": incremental_tail_sequence,
    "incremental_new_rows": incremental_new_rows,
    "stream_new_files": stream_new_files,
    "stream_medallion": stream_medallion,
    "stream_series": stream_series,
    "stream_daily_series": stream_daily_series,
    "stream_quality_counts": stream_quality_counts,
    "incremental_appended": incremental_appended,
    "incremental_late_row": incremental_late_row,
    "incremental_edited_prefix": incremental_edited_prefix,
}

_COUNTS = " UNION ALL ".join(
    f"SELECT 'raw/{name}.csv' AS source, count(*) AS n FROM {name}" for name in SOURCES
)
_SEEN = """
    SELECT source, n, CASE source WHEN 'raw/supplier.csv' THEN 0
                                  WHEN 'raw/customer.csv' THEN n * 2 // 3 ELSE n END AS seen
    FROM counts"""
_BEYOND = """
    SELECT {} AS status, CAST({} AS BIGINT) AS start_row, CAST({} AS BIGINT) AS rows_to_process,
           count(*) FILTER (WHERE k > half) AS rows_beyond,
           CAST(sum(k) FILTER (WHERE k > half) AS BIGINT) AS keys_beyond
    FROM (SELECT o_orderkey AS k FROM orders), (SELECT max(c_custkey) AS half FROM customer)"""

_TAKEN = "k <= half AND k % 10 <> 3"
_FILE_STEPS = {
    "first": ("'READY'", "0", _TAKEN, _TAKEN),
    "appended": ("'READY'", f"count(*) FILTER (WHERE {_TAKEN})", "k > half AND k <= 2 * half", "k > half AND k <= 2 * half"),
    "nothing new": ("'SKIPPED_IDEMPOTENT'", f"count(*) FILTER (WHERE {_TAKEN} OR k > half AND k <= 2 * half)", "false", "false"),
    "late rows": ("'CHANGED_NOT_APPENDED'", f"count(*) FILTER (WHERE {_TAKEN} OR k > half AND k <= 2 * half)", "false", "k <= half AND k % 10 = 3"),
    "appended again": ("'READY'", f"count(*) FILTER (WHERE {_TAKEN} OR k > half AND k <= 2 * half)", "k > 2 * half", "k > 2 * half"),
    "copied rows": ("'CHANGED_NOT_APPENDED'", f"count(*) FILTER (WHERE {_TAKEN} OR k > half)", "false", "k <= half AND k % 10 = 4"),
}

_ARRIVED = """
    WITH o AS (SELECT o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
    n AS (
      SELECT 'a/b.csv' AS file, 'SUCCESS' AS state, count(*) FILTER (WHERE s = 'F') AS n FROM o
      UNION ALL SELECT 'a__b.csv', 'SUCCESS', count(*) FILTER (WHERE s = 'O' AND a < 100000) FROM o
      UNION ALL SELECT 'c/b.csv', 'SUCCESS', count(*) FILTER (WHERE s = 'O' AND a >= 100000) FROM o
      UNION ALL SELECT 'c/d/p.csv', 'SUCCESS', count(*) FILTER (WHERE s = 'P') FROM o
      UNION ALL SELECT 'odd.csv', '{odd}', count(*) FILTER (WHERE s = 'P') FROM o
      UNION ALL SELECT 'blank.csv', '{bad}', NULL UNION ALL SELECT 'empty.csv', 'EMPTY', NULL)"""

ORACLE = {
    "stream_quarantine": _ARRIVED.format(odd="QUARANTINED", bad="QUARANTINED")
    + """SELECT file, state, CASE WHEN state = 'SUCCESS' THEN n ELSE 0 END AS rows,
                CAST(1 AS BIGINT) AS attempts, CASE WHEN state = 'SUCCESS' THEN n END AS silver_rows
         FROM n""",
    "stream_quarantine_retried": _ARRIVED.format(odd="SUCCESS", bad="QUARANTINED")
    + """SELECT file, state, CASE WHEN state = 'SUCCESS' THEN n ELSE 0 END AS rows,
                CAST(CASE WHEN file IN ('odd.csv', 'blank.csv') THEN 2 ELSE 1 END AS BIGINT) AS attempts
         FROM n""",
    "folder_run": _ARRIVED.format(odd="SUCCESS", bad="FAILED")
    + """SELECT file, state, n AS silver_rows FROM n
         UNION ALL SELECT 'failed files', '2 of 7', CAST(sum(n) AS BIGINT) FROM n""",
    "incremental_typed_places": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, * FROM ("
        + _BEYOND.format("'READY'", "count(*) FILTER (WHERE k <= half)", "count(*) FILTER (WHERE k > half)")
        + ")"
        for kind in ("instant", "moment", "exact", "day", "words", "bytes")
    ),
    "incremental_files": " UNION ALL ".join(
        f"""SELECT '{step}' AS step, {status} AS status, CAST({start} AS BIGINT) AS start_row,
                   count(*) FILTER (WHERE {taken}) AS rows_to_process,
                   count(*) FILTER (WHERE {read}) AS rows_read
            FROM (SELECT o_orderkey AS k FROM orders), (SELECT max(c_custkey) AS half FROM customer)"""
        for step, (status, start, taken, read) in _FILE_STEPS.items()
    ),
    "fingerprint_tree": """
        WITH n AS (
          SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
                 count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS even,
                 count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
                 count(*) FILTER (WHERE o_orderstatus = 'P') AS p,
                 count(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) AS every FROM orders)
        SELECT 'folder' AS level, 'F' AS folder, 'CHANGED' AS state, f AS rows_before, f + even AS rows_now FROM n
        UNION ALL SELECT 'folder', 'O', 'SAME', o, o FROM n
        UNION ALL SELECT 'folder', 'P', 'REMOVED', p, NULL FROM n
        UNION ALL SELECT 'folder', 'P2', 'ADDED', NULL, p FROM n
        UNION ALL SELECT 'table', '', 'CHANGED', every, every + even FROM n""",
    "incremental_status": sql(
        """SELECT source, n AS source_row_count, seen AS previous_row_count,
                  CASE source WHEN 'raw/orders.csv' THEN 'SKIPPED_IDEMPOTENT'
                              WHEN 'raw/part.csv' THEN 'CHANGED_NOT_APPENDED'
                              ELSE 'READY' END AS status,
                  seen AS start_row,
                  CASE WHEN source IN ('raw/orders.csv', 'raw/part.csv') THEN 0
                       ELSE n - seen END AS rows_to_process FROM seen_""",
        counts=_COUNTS,
        seen_=_SEEN,
    ),
    "incremental_forced": sql(
        """SELECT source, n AS source_row_count, seen AS previous_row_count, 'READY' AS status,
                  CAST(0 AS BIGINT) AS start_row, n AS rows_to_process FROM seen_""",
        counts=_COUNTS,
        seen_=_SEEN,
    ),
    "checkpoint_report": sql(
        """SELECT parse_filename(source) AS source, 'SUCCESS' AS status, seen AS processed_rows,
                  n AS last_batch, 'EXEC_1' AS execution
           FROM seen_ WHERE source <> 'raw/supplier.csv'""",
        counts=_COUNTS,
        seen_=_SEEN,
    ),
    "checkpoint_totals_later": """
        SELECT CAST(3 AS BIGINT) AS checkpoints, 'supplier.csv' AS latest_source,
               'SUCCESS' AS latest_status, count(*) AS processed_rows, true AS updated_at,
               true AS any_skipped FROM supplier""",
    "checkpoint_totals": sql(
        """SELECT count(*) AS checkpoints, false AS any_skipped, true AS dated
           FROM seen_ WHERE source <> 'raw/supplier.csv'""",
        counts=_COUNTS,
        seen_=_SEEN,
    ),
    "incremental_tail": sql(
        """SELECT order_id, customer_id, amount FROM (
             SELECT *, row_number() OVER (ORDER BY order_date, order_id) AS r FROM sales_orders)
           WHERE r > (SELECT count(*) FROM customer)""",
        "sales_orders",
    ),
    "incremental_tail_sequence": sql(
        """SELECT order_id, customer_id, amount FROM sales_orders
           WHERE order_id > (SELECT max(c_custkey) FROM customer)""",
        "sales_orders",
    ),
    "incremental_new_rows": sql(
        "SELECT * FROM dirty_orders EXCEPT ALL SELECT DISTINCT * FROM dirty_orders",
        "dirty_orders",
    ),
    "stream_new_files": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "stream_medallion": sql(
        """SELECT CAST(order_id AS BIGINT) AS order_id, CAST(customer_id AS BIGINT) AS customer_id,
                  nullif(trim(category), '') AS category, amount, order_date FROM dirty_orders""",
        "dirty_orders",
    ),
    "stream_series": sql(
        """SELECT strftime(transaction_date, '%Y-%m') AS period,
                  CAST(year(transaction_date) AS INTEGER) AS year,
                  CAST(month(transaction_date) AS INTEGER) AS month, count(*) AS row_count,
                  round(sum(amount) + 1e-8, 4) AS amount_sum, round(avg(amount) + 1e-8, 4) AS amount_avg,
                  round(sum(quantity) + 1e-8, 4) AS quantity_sum, round(avg(quantity) + 1e-8, 4) AS quantity_avg
           FROM sales_lines GROUP BY ALL""",
        "sales_lines",
    ),
    "stream_daily_series": """
        SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS row_count,
               round(sum(value) + 1e-8, 4) AS value_sum,
               round(avg(value) + 1e-8, 4) AS value_avg FROM events GROUP BY ALL""",
    "stream_current_table": """
        SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS row_count,
               round(sum(value) + 1e-8, 4) AS value_sum,
               round(avg(value) + 1e-8, 4) AS value_avg FROM events GROUP BY ALL""",
    "stream_duplicate_rows": sql(
        """SELECT (SELECT count(*) FROM dirty_orders) - count(*) AS duplicate_rows
           FROM (SELECT DISTINCT * FROM dirty_orders)""",
        "dirty_orders",
    ),
    "stream_duplicate_keys": sql(
        """SELECT trim(order_id) AS key, count(*) AS copies FROM dirty_orders
           WHERE order_id <> '' GROUP BY ALL HAVING count(*) > 1""",
        "dirty_orders",
    ),
    "racing_checkpoints": """
        SELECT 'first' AS run, true AS committed, count(*) AS order_count FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 'second', false, NULL
        UNION ALL SELECT 'third', true, count(*) FROM orders""",
    "stream_quality_counts": sql(
        """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS empty_rows,
                  CAST(sum((coalesce(category, '') = '')::INT) AS BIGINT) AS null_values,
                  CAST(sum((amount = 'n/a')::INT) AS BIGINT) AS type_errors,
                  CAST(0 AS BIGINT) AS inconsistent_rows FROM dirty_orders""",
        "dirty_orders",
    ),
    "incremental_appended": _BEYOND.format("'READY'", "count(*) FILTER (WHERE k <= half)", "count(*) FILTER (WHERE k > half)"),
    "incremental_late_row": _BEYOND.format(
        "'CHANGED_NOT_APPENDED'", "count(*) FILTER (WHERE k <= half AND k % 10 <> 3)", "0"
    ),
    "incremental_edited_prefix": _BEYOND.format(
        "'CHANGED_NOT_APPENDED'", "count(*) FILTER (WHERE k <= half)", "0"
    ),
}
