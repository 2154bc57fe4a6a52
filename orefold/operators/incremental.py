"""Incremental runs: what changed since the last checkpoint, and which rows are new."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions import values as V
from orefold.operators.commits import commit_numbers, try_commit
from orefold.operators.ledger import CHECKPOINT_SCHEMA, SKIPPED
from orefold.operators.ordered import with_position
from orefold.operators.places import after, decode_place, encode_place

READY = "READY"
CHANGED = "CHANGED_NOT_APPENDED"
OVERTAKEN = "OVERTAKEN"


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The newest checkpoint of every source from an append-only table.

    Before the first commit there is no table yet; then there are no checkpoints.
    """
    try:
        history = spark.read.schema(CHECKPOINT_SCHEMA).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHECKPOINT_SCHEMA)
    newest = F.max_by(
        F.struct(*[c for c in history.columns if c != "source"]),
        F.struct("updated_at", "execution_id"),
    )
    latest = history.groupBy("source").agg(newest.alias("checkpoint"))
    return latest.select("source", "checkpoint.*")


Order = Sequence[str | Column]


def _order_columns(order: Order) -> list[Column]:
    return [V.col(key) if isinstance(key, str) else key for key in order]


def _named(order: Order) -> list[Column]:
    return [key.alias(f"k{i}") for i, key in enumerate(_order_columns(order))]


def _kinds(df: DataFrame, order: Order) -> T.StructType:
    return df.select(F.struct(*_named(order)).alias("keys")).schema["keys"].dataType


def high_water_values(df: DataFrame, order: Order, stored: str | None) -> list | None:
    """The stored values of the last processed row, as literals in the types of the order."""
    return None if stored is None else decode_place(stored, _kinds(df, order))


def beyond(order: Order, last: Sequence) -> Column:
    """Whether a row comes after the last values; a comparison that a scan can use.

    The order is that of the columns' types, so numbers read as text need a cast. A row
    without a value comes before all that have one; it does not come after anything.
    """
    return after(_order_columns(order), last)


def row_number_sum(chosen: Column, number: Column) -> Column:
    """The sum of the row digests' numbers over the chosen rows."""
    return F.coalesce(F.sum(F.when(chosen, number)), F.lit(0).cast("decimal(38,0)"))


def digest_number(df: DataFrame, names: Sequence[str]) -> Column:
    """The first 60 bits of a row's digest as a number."""
    first = F.substring(F.hex(V.row_digest(df, names)), 1, 15)
    return F.conv(first, 16, 10).cast("decimal(20,0)")


def shape_suffix(schema: T.StructType) -> Column:
    """What names and types add to a fingerprint."""
    shape = F.substring(F.sha2(F.lit(schema.simpleString()), 256), 1, 12)
    return F.concat(F.lit("-"), shape)


def source_state(
    df: DataFrame, source: str, order: Order, stored_high_water: str | None = None
) -> DataFrame:
    """One row on a source, from one scan: its rows, content and highest place in the
    order, and the rows and content up to the place that was processed last."""
    last = high_water_values(df, order, stored_high_water)
    before = F.lit(True)
    if last is not None:
        before = ~F.coalesce(beyond(order, last), F.lit(False))
    rows = df.select(
        digest_number(df, df.columns).alias("number"),
        before.alias("before"),
        F.struct(*_named(order)).alias("place"),
    )
    shape = shape_suffix(df.schema)

    def content(chosen: Column) -> Column:
        return F.concat(row_number_sum(chosen, F.col("number")).cast("string"), shape)

    return rows.agg(
        F.lit(source).alias("source"),
        F.count("*").alias("row_count"),
        content(F.lit(True)).alias("fingerprint"),
        F.max("place").alias("place"),
        F.count_if("before").alias("prefix_row_count"),
        content(F.col("before")).alias("prefix_fingerprint"),
    ).select(
        "source",
        "row_count",
        "fingerprint",
        encode_place(F.col("place"), _kinds(df, order)).alias("high_water"),
        "prefix_row_count",
        "prefix_fingerprint",
    )


def incremental_status(
    current: DataFrame, checkpoints: DataFrame, force: bool = False
) -> DataFrame:
    """Per source, whether to run and from which row.

    ``current`` holds source, row_count and fingerprint. Same content means skip; more
    rows than before means run from the first new one. If ``current`` also says what the
    processed part looks like now (:func:`source_state`), rows are only taken as new if
    that part is unchanged; a late or edited row is reported as a change. Changed content
    without new rows is reported, so that the caller can force a full run.
    """
    previous = checkpoints.select(
        "source",
        F.col("fingerprint").alias("previous_fingerprint"),
        F.col("processed_row_count").alias("previous_rows"),
    )
    joined = current.join(previous, "source", "left")
    before = F.coalesce("previous_rows", F.lit(0))
    same = (F.col("fingerprint") == F.col("previous_fingerprint")) & (
        F.col("row_count") == before
    )
    grown = F.col("row_count") > before
    if "prefix_fingerprint" in current.columns:
        grown &= (F.col("prefix_row_count") == before) & (
            F.col("prefix_fingerprint") == F.col("previous_fingerprint")
        )
    if force:
        status, start = F.lit(READY), F.lit(0).cast("bigint")
    else:
        status = (
            F.when(same, SKIPPED)
            .when(F.col("previous_rows").isNull() | grown, READY)
            .otherwise(CHANGED)
        )
        start = F.least(before, F.col("row_count"))
    rows = F.when(status == READY, F.col("row_count") - start).otherwise(0)
    kept = ["high_water"] if "high_water" in current.columns else []
    return joined.select(
        "source",
        "fingerprint",
        F.col("row_count").alias("source_row_count"),
        before.alias("previous_row_count"),
        status.alias("status"),
        start.alias("start_row"),
        rows.alias("rows_to_process"),
        *kept,
    )


def tail_rows(df: DataFrame, order: Sequence[Column], start_row: int) -> DataFrame:
    """The rows after the first ``start_row`` in a stated total order."""
    numbered = with_position(df, [], order, "_position")
    return numbered.filter(F.col("_position") > start_row).drop("_position")


def tail_after(df: DataFrame, sequence: str, last: object) -> DataFrame:
    """The rows beyond the last processed sequence value; a filter the scan can use."""
    return df.filter(V.col(sequence) > F.lit(last))


def new_rows(df: DataFrame, processed: DataFrame) -> DataFrame:
    """The rows that were not there before, counting copies.

    Only digests and counts cross the network. A digest that is new brings its rows back;
    of one that is there more often than before, as many rows as it has more.
    """
    names = df.columns
    key = V.row_digest(df, names).alias("_digest")
    rows = df.select(F.struct(*V.cols(names)).alias("_row"), key)
    now = rows.groupBy("_digest").agg(F.count("*").alias("_now"))
    before = (
        processed.select(V.row_digest(processed, names).alias("_digest"))
        .groupBy("_digest")
        .agg(F.count("*").alias("_before"))
    )
    more = (
        now.join(before, "_digest", "left")
        .withColumn("_more", F.col("_now") - F.coalesce("_before", F.lit(0)))
        .where("_more > 0")
    )
    one = rows.join(more.select("_digest", "_more"), "_digest").groupBy("_digest")
    copies = one.agg(F.first("_row").alias("_row"), F.first("_more").alias("_more"))
    repeated = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_more"))))
    return repeated.select("_row.*")


def checkpoint_rows(
    status: DataFrame, execution_id: str, previous: str | None = None
) -> DataFrame:
    """A checkpoint for every source that was run or skipped.

    Changed content that was not run keeps its old checkpoint, so it is reported again.
    The highest place in the order is kept where the status has it. With the time of the
    ``previous`` checkpoint, the new one is later even if this machine's clock is behind.
    """
    known = "high_water" in status.columns
    high_water = F.col("high_water") if known else F.lit(None).cast("string")
    now = F.current_timestamp()
    if previous is not None:
        now = F.greatest(now, F.lit(previous).cast("timestamp") + F.expr("INTERVAL '0.001' SECOND"))
    return status.filter(F.col("status") != CHANGED).select(
        "source",
        "fingerprint",
        F.col("source_row_count").alias("processed_row_count"),
        F.col("rows_to_process").alias("last_batch_row_count"),
        F.col("start_row").alias("last_start_row"),
        F.lit(execution_id).alias("execution_id"),
        F.when(F.col("status") == READY, "SUCCESS").otherwise(F.col("status")).alias("status"),
        F.date_format(now, "yyyy-MM-dd HH:mm:ss.SSS").alias("updated_at"),
        high_water.alias("high_water"),
    )


def commit_checkpoints(status: DataFrame, execution_id: str, path: str) -> None:
    """Append the checkpoints of a table of sources, as :func:`checkpoint_rows` gives them.

    Nothing keeps another run from doing the same; :func:`commit_checkpoint` does.
    """
    checkpoint_rows(status, execution_id).write.mode("append").json(path)


def _commit_name(source: str) -> str:
    return f"checkpoint-{hashlib.sha256(source.encode()).hexdigest()[:24]}"


def checkpoint_number(spark: SparkSession, path: str, source: str) -> int:
    """The number of a source's newest checkpoint, 0 before the first; to be taken before
    the checkpoints are read."""
    return max(commit_numbers(spark, path, _commit_name(source)), default=0)


def commit_checkpoint(
    status: DataFrame,
    execution_id: str,
    path: str,
    source: str,
    seen: int,
    previous: str | None = None,
) -> bool:
    """Write the checkpoint of one source after number ``seen``.

    False, and nothing written, if another run has written one since. A status that leaves
    no checkpoint counts as written.
    """
    row = checkpoint_rows(status, execution_id, previous).select(F.to_json(F.struct("*"))).first()
    spark = status.sparkSession
    return row is None or try_commit(spark, path, _commit_name(source), seen + 1, row[0] + "\n")


def committed_runs(spark: SparkSession, path: str, source: str) -> list[str]:
    """The executions whose rows count, in their order: those that left a checkpoint.

    Tables of other executions are of runs that failed before their checkpoint.
    """
    try:
        history = spark.read.schema(CHECKPOINT_SCHEMA).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    ran = history.where((F.col("source") == source) & (F.col("status") == "SUCCESS"))
    ordered = ran.orderBy("updated_at", "execution_id").select("execution_id")
    return [row["execution_id"] for row in ordered.collect()]
