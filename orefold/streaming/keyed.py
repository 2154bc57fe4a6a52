"""Tables of one row per key that the batches of a stream keep up to date.

Every batch adds an update table, and after some batches the updates are merged with the
base into a new base. A commit (:mod:`orefold.operators.commits`) says which base and which
updates make up the table, so that readers see whole batches only, a batch that is repeated
after the driver was lost changes nothing, and the number of files does not grow.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orefold.functions import values as V
from orefold.operators.commits import child_names, commit_numbers, commit_path, read_commit, try_commit
from orefold.session import remove_folder
from orefold.sources.csv import RAGGED, SOURCE_FILE
from orefold.streaming.feed import start_feed

_BATCH = "_batch"
_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class KeyedTable:
    """Where a table lies and how rows of one key become one.

    Without ``merges`` the newest batch's row of a key replaces older ones; a batch may hold
    one row for each key. With ``merges`` (``sum``, ``min`` or ``max`` for every column
    beside the keys) rows are added up, however many there are. Null keys are a key.

    ``clock`` names a timestamp column: a key leaves the table once its time lies more than
    ``horizon`` before the newest time seen, unless the condition ``pinned`` holds for it.
    Rows without a time live as long as the newest time of their batch.
    """

    path: str
    keys: Sequence[str]
    merges: dict[str, str] = field(default_factory=dict)
    every: int = 8
    clock: str | None = None
    horizon: str | None = None
    pinned: str = "false"

    def add(self, batch: DataFrame, batch_id: int, owner: str) -> None:
        """Take a batch in. One that is in already changes nothing.

        ``owner`` stands for the stream that counts the batches. Another stream's numbers
        would pass for repeated batches, so they are refused.
        """
        spark = batch.sparkSession
        last = self._last(spark)
        if last and last["owner"] != owner:
            raise ValueError(f"{self.path} belongs to stream {last['owner']}, not {owner}")
        if last and batch_id <= last["number"]:
            return
        update = f"{self.path}/updates/{batch_id}"
        batch.write.mode("overwrite").parquet(update)
        newest = self._newest(spark.read.schema(batch.schema).parquet(update))
        times = [t for t in (newest, last and last["time"]) if t is not None]
        state = {
            "number": batch_id,
            "owner": owner,
            "schema": batch.schema.jsonValue(),
            "time": max(times, default=None),
            "base": last["base"] if last else None,
            "updates": [*(last["updates"] if last else []), [batch_id, newest]],
        }
        compacted = len(state["updates"]) >= self.every
        if compacted:
            merged = self._merged(spark, state)
            merged.write.mode("overwrite").parquet(f"{self.path}/bases/{batch_id}")
            state |= {"base": batch_id, "updates": []}
        if not try_commit(spark, f"{self.path}/commits", "batch", batch_id, json.dumps(state)):
            raise RuntimeError(f"batch {batch_id} of {self.path} was written by another run")
        if compacted and last and last["base"] is not None:
            self._clean(spark, last["base"])

    def read(self, spark: SparkSession) -> DataFrame:
        """The table after the newest batch. Its files stay until the updates were merged
        twice more."""
        state = self._last(spark)
        if state is None:
            raise FileNotFoundError(f"no batch has been committed to {self.path}")
        return self._merged(spark, state).drop(_BATCH)

    def _last(self, spark: SparkSession) -> dict | None:
        folder = f"{self.path}/commits"
        numbers = commit_numbers(spark, folder, "batch")
        return json.loads(read_commit(spark, folder, "batch", numbers[-1])) if numbers else None

    def _newest(self, update: DataFrame) -> int | None:
        """The newest time of an update, in microseconds."""
        if self.clock is None:
            return None
        return update.agg(F.unix_micros(F.max(V.col(self.clock)))).first()[0]

    def _merged(self, spark: SparkSession, state: dict) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        parts = []
        if state["base"] is not None:
            based = T.StructType([*schema, T.StructField(_BATCH, T.LongType())])
            parts.append(spark.read.schema(based).parquet(f"{self.path}/bases/{state['base']}"))
        for number, newest in state["updates"]:
            update = spark.read.schema(schema).parquet(f"{self.path}/updates/{number}")
            if self.clock is not None and newest is not None:
                known = F.coalesce(V.col(self.clock), F.timestamp_micros(F.lit(newest)))
                update = update.withColumn(self.clock, known)
            parts.append(update.withColumn(_BATCH, F.lit(number).cast("bigint")))
        rows = reduce(DataFrame.unionByName, parts)
        values = [f for f in schema if f.name not in self.keys]
        if self.merges:
            merged = [
                _MERGES[self.merges[f.name]](V.col(f.name)).cast(f.dataType).alias(f.name)
                for f in values
            ]
            grouped = rows.groupBy(*V.cols(self.keys)).agg(*merged, F.max(_BATCH).alias(_BATCH))
        else:
            row = F.struct(*V.cols(f.name for f in values), F.col(_BATCH))
            grouped = rows.groupBy(*V.cols(self.keys)).agg(F.max_by(row, _BATCH).alias("_row"))
            grouped = grouped.select(*V.cols(self.keys), "_row.*")
        return grouped.where(self._alive(state["time"])).select(*V.cols(schema.names), _BATCH)

    def _alive(self, newest: int | None) -> Column:
        if self.clock is None or self.horizon is None or newest is None:
            return F.lit(True)
        oldest = F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {self.horizon}")
        recent = F.coalesce(V.col(self.clock) >= oldest, F.lit(True))
        return recent | F.coalesce(F.expr(self.pinned), F.lit(False))

    def _clean(self, spark: SparkSession, base: int) -> None:
        """Delete what lies before a base that was merged into a newer one."""
        for kind, first in (("updates", base + 1), ("bases", base)):
            for name in child_names(spark, f"{self.path}/{kind}"):
                if name.isdigit() and int(name) < first:
                    remove_folder(spark, f"{self.path}/{kind}/{name}")
        for number in commit_numbers(spark, f"{self.path}/commits", "batch"):
            if number < base:
                remove_folder(spark, commit_path(f"{self.path}/commits", "batch", number))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark gives a stream and keeps with its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def keep_table(
    result: DataFrame, table: KeyedTable, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Keep the current rows of a streaming aggregation in a table: every batch adds the
    rows that it has changed, and state that the watermark has passed is freed."""

    def save(batch: DataFrame, batch_id: int) -> None:
        table.add(batch, batch_id, stream_id(batch.sparkSession, checkpoint))

    writer = result.writeStream.outputMode("update").foreachBatch(save)
    writer = writer.option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def copies_table(path: str, horizon: str, every: int = 8) -> KeyedTable:
    """A table of how often each key was seen. What was seen once leaves it after the
    horizon; what was seen more often is the result, and stays."""
    return KeyedTable(
        path, ["key"], {"copies": "sum", "seen": "max"}, every, "seen", horizon, "copies > 1"
    )


def _copies(batch: DataFrame, moment: str, key: str | None) -> DataFrame:
    """Rows of a batch per key, or per digest of the whole row, and their newest time."""
    if key is None:
        names = [c for c in batch.columns if c not in (RAGGED, SOURCE_FILE)]
        value = F.hex(V.row_digest(batch, names))
        rows = batch
    else:
        value = V.strip(V.text(batch, key))
        rows = batch.where(~V.is_missing(V.text(batch, key)))
    seen = V.timestamp(batch, moment).cast("timestamp")
    return rows.select(value.alias("key"), seen.alias("seen")).groupBy("key").agg(
        F.count("*").alias("copies"), F.max("seen").alias("seen")
    )


def keep_copies(
    stream: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    moment: str,
    key: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Find duplicates on a stream: rows that are equal as a whole, or have one ``key``.

    Copies are found however many batches lie between them, as long as their times are no
    further apart than the table's horizon. A batch is counted before it is written, so a
    key that holds a third of its rows is one row; missing keys do not count, as in tables.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        counted = _copies(batch, moment, key)
        table.add(counted, batch_id, stream_id(batch.sparkSession, checkpoint))

    return start_feed(stream, save, checkpoint, interval)


def repeated_keys(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """What was seen more than once, and how often."""
    return table.read(spark).where("copies > 1").select("key", "copies")


def duplicate_count(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """Rows beyond the first copy."""
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return repeated_keys(spark, table).agg(extra.alias("duplicate_rows"))
