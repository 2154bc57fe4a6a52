"""Helpers shared by the operators: bounded Arrow slices, and bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
"""Text bytes a task works on at once; a longer text is worked on alone."""


def packed(rows: DataFrame, **columns: Column) -> DataFrame:
    """All columns of the rows as one struct ``row`` beside the given ones, so that no
    name of theirs can clash; ``select("row.*")`` brings them back."""
    return rows.select(
        F.struct("*").alias("row"), *(value.alias(name) for name, value in columns.items())
    )


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column, or with a dot a field of a struct column; null becomes the empty text."""
    column, _, field = column.partition(".")
    found = batch.column(batch.schema.get_field_index(column))
    found = found.field(field) if field else found
    return found.fill_null("") if found.null_count else found


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts, ends = buffer_of(text_array(batch, column))
        total = np.cumsum(ends - starts)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the array, and where each text starts and ends in them."""
    wide = pa.types.is_large_string(texts.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    buffers = texts.buffers()
    if not len(texts) or buffers[1] is None:
        empty = np.zeros(len(texts), np.int64)
        return np.zeros(0, np.uint8), empty, empty
    offsets = np.frombuffer(buffers[1], kind, len(texts) + 1, texts.offset * width)
    offsets = offsets.astype(np.int64)
    data = (
        np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], np.uint8)
    )
    low, high = int(offsets[0]), int(offsets[-1])
    return data[low:high], offsets[:-1] - low, offsets[1:] - low


def remainder_of_id(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def bounded_sample(
    rows: DataFrame, doc_id: str, label: str, per_class: int
) -> DataFrame:
    """About ``per_class`` rows of each label, chosen by a hash of the id, so that the
    choice is the same on every run and does not depend on the partitions.

    The result never has more than twice ``per_class`` rows for each of the labels.
    Labels must be few; one count per label comes to the driver.
    """
    counts = {row[0]: row[1] for row in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(label) == F.lit(value), min(1.0, per_class / count)).otherwise(
            share
        )
    draw = F.xxhash64(F.lit("sample"), F.col(doc_id).cast("string"))
    chosen = rows.where((F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    return chosen.orderBy(draw, F.col(doc_id)).limit(2 * per_class * max(1, len(counts)))
