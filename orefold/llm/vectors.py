"""Vector tables packed into tiles, and every block of queries against every tile."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RUNS = 4096
"""Runs of tiles at most; a longer table has more tiles in a run. Results do not depend on it."""
LAST = np.iinfo(np.int64).max
"""Sorts where an id is null; a flag beside it tells it from a real id."""


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(
        F.forall(
            vector.cast("array<double>"),
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
        ),
        F.lit(False),
    )


@dataclass(frozen=True)
class Shape:
    """What is known of a table before it is packed."""

    rows: int
    width: int

    def tiles(self, size: int) -> int:
        return max(1, -(-self.rows // size))


def shape(rows: DataFrame) -> Shape:
    """Count and longest vector of rows with a column ``vector``."""
    found = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    return Shape(found[0], found[1] or 0)


def dense(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(vectors), width)
    matrix = np.zeros((len(vectors), width), flat.dtype)
    matrix[np.arange(width) < lengths[:, None]] = flat
    return matrix


def ids_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which of them are null."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64), null


def id_array(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)


def listed(values: pa.Array) -> pa.ListArray:
    """One row with all the values as its list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def vector_array(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as vectors."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def gathered(
    batches: Iterable[pa.RecordBatch], size: int
) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A task's rows in pieces of ``size``, the last of less than twice as many, each with
    a number that no other piece of any task has."""
    at = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    count = 0

    def one() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        while count >= 2 * size:
            rows = one()
            yield at, rows.slice(0, size)
            at += 1
            held, count = [rows.slice(size)], count - size
    if count:
        yield at, one()


def cells(blocks: DataFrame, tiles: DataFrame, n_tiles: int) -> DataFrame:
    """Each row of ``blocks`` beside each row of ``tiles``: the stated queries against all
    rows. Tiles form runs, and blocks are sent once to each run. Where rows of one block
    follow each other, a task can go on with what it knows of the block.

    The number of partitions is given, as tiles are few and small beside the work on them.
    """
    runs = min(n_tiles, MOST_RUNS)
    parts = 2 * runs
    sent = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    run = F.pmod(F.shiftright("tile", 32), F.lit(runs)).cast("int")
    kept = tiles.withColumn("run", run).withColumnRenamed("tile", "of_tile")
    return sent.repartition(parts, "run").join(kept.repartition(parts, "run"), "run")
