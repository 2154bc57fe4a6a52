"""Finding stretches of bytes in texts: windows cut in numpy, met by a bounded filter.

A text has as many windows of a size as it has bytes, and nearly all of them belong to no
value. Two bits of a hash tell so where the text is read, so that only windows some value
may have are handed on, as their bytes. A wrong hit costs one row, which the join drops.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import values as V

# Functions that run in tasks travel with their code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["orefold"])

# Values up to the first size are looked up as they are, longer ones by a window of the
# largest size that fits.
LONGEST_OWN = 16
LONG_WINDOW = 32
# The filter takes this many bits a window, within two to these powers (32 MB at most).
_BITS_EACH = 64
_FEWEST_BITS, _MOST_BITS = 16, 28
# The bits come from tasks in buckets of two to this power.
_BUCKET = 15

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_size(length: Column) -> Column:
    """The size of the windows by which a value of so many bytes is looked up."""
    longer = F.when(length < LONG_WINDOW, LONGEST_OWN).otherwise(LONG_WINDOW)
    return F.when(length <= LONGEST_OWN, length).otherwise(longer)


def _words(data: np.ndarray, at: np.ndarray | slice, size: int) -> list[np.ndarray]:
    """The windows at some places as numbers, which together hold all their bytes.

    ``data`` has eight bytes more than its last window.
    """
    every = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))

    def word(offset: int) -> np.ndarray:
        if isinstance(at, slice):
            return every[at.start + offset : at.stop + offset]
        return every[at + offset]

    if size < 8:
        return [word(0) & np.uint64((1 << 8 * size) - 1)]
    return [word(min(i, size - 8)) for i in range(0, size, 8)]


def _hashed(words: Sequence[np.ndarray], size: int) -> np.ndarray:
    found = np.full(len(words[0]), size, "u8")
    for word in words:
        found ^= word
        found *= _FIRST
        found ^= found >> np.uint64(32)
    return found * _SECOND


def _places(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a hash."""
    again = (hashed ^ (hashed >> np.uint64(29))) * _FIRST
    shift = np.uint64(64 - bits)
    return (hashed >> shift).astype("i8"), (again >> shift).astype("i8")


def _is_set(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (held[places >> 3] >> (places & 7).astype("u1")) & 1 == 1


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, with some more behind them, and its offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset :][: len(column) + 1]
    held = np.zeros(offsets[-1] - offsets[0] + LONG_WINDOW + 8, "u1")
    if offsets[-1] > offsets[0]:
        held[: offsets[-1] - offsets[0]] = np.frombuffer(column.buffers()[2], "u1")[
            offsets[0] : offsets[-1]
        ]
    return held, offsets - offsets[0]


def window_filter(stretches: DataFrame, column: str, count: int) -> tuple[np.ndarray, int]:
    """Bits of all stretches of a column, and the power of two that is their number.

    Spark combines them; what comes to the driver has a bounded size.
    """
    bits = min(max(int(count * _BITS_EACH).bit_length(), _FEWEST_BITS), _MOST_BITS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _binary(batch.column(0))
            lengths = np.diff(offsets)
            for size in np.unique(lengths).tolist():
                words = _words(data, offsets[:-1][lengths == size], size)
                both = np.unique(np.concatenate(_places(_hashed(words, size), bits)))
                yield pa.record_batch({"place": pa.array(both)})

    spots = stretches.select(column).mapInArrow(placed, "place bigint")
    bucket = F.shiftright("place", _BUCKET).alias("bucket")
    maps = spots.groupBy(bucket).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << _BUCKET) - 1)).alias("map")
    )
    held = np.zeros(1 << (bits - 3), "u1")
    width = 1 << (_BUCKET - 3)
    for row in maps.toLocalIterator():
        held[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["map"], "u1")
    return held, bits


def _hits(
    data: np.ndarray, offsets: np.ndarray, size: int, held: np.ndarray, bits: int, piece: int
) -> tuple[np.ndarray, np.ndarray]:
    """Windows that pass the filter, once for each text: text numbers and places, ordered
    by the windows' bytes."""
    texts, places = [], []
    end = int(offsets[-1]) - size + 1
    for start in range(0, max(end, 0), piece):
        part = slice(start, min(start + piece, end))
        hashed = _hashed(_words(data, part, size), size)
        first, second = _places(hashed, bits)
        at = np.flatnonzero(_is_set(held, first))
        at = at[_is_set(held, second[at])] + start
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + size <= offsets[text + 1]
        at, text = _once(data, at[inside], text[inside], size)
        texts.append(text)
        places.append(at)
    if not texts:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    at, text = _once(data, np.concatenate(places), np.concatenate(texts), size)
    return text, at


def _once(
    data: np.ndarray, at: np.ndarray, text: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """One place for each window of a text."""
    keys = [text, *_words(data, at, size)]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([np.diff(key[order]) != 0 for key in keys])
    return at[order[new]], text[order[new]]


def _cut(data: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The windows at some places as a binary column."""
    held = np.ascontiguousarray(data[at[:, None] + np.arange(size)])
    ends = np.arange(0, len(at) * size + 1, size, dtype="i4")
    return pa.Array.from_buffers(
        pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(held)]
    )


def _in_texts(
    sizes: Sequence[int], held: Broadcast, bits: int, pieces: tuple[int, int], counted: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _binary(batch.column(1))
            for size in sizes:
                text, at = _hits(data, offsets, size, held.value, bits, pieces[0])
                often = None
                if counted and len(at):
                    words = _words(data, at, size)
                    new = np.logical_or.reduce([np.diff(word) != 0 for word in words])
                    starts = np.flatnonzero(np.concatenate([[True], new]))
                    often, at = np.diff(np.append(starts, len(at))), at[starts]
                for i in range(0, len(at), pieces[1]):
                    part = slice(i, i + pieces[1])
                    if counted:
                        told = pa.array(often[part])
                    else:
                        told = batch.column(0).take(pa.array(text[part]))
                    yield pa.record_batch(
                        [told, _cut(data, at[part], size)],
                        ["_often" if counted else batch.schema.names[0], "_stretch"],
                    )

    return run


def stretches_in(
    texts: DataFrame,
    key: str,
    column: str,
    sizes: Sequence[int],
    held: Broadcast,
    bits: int,
    pieces: tuple[int, int],
) -> DataFrame:
    """``key`` and ``_stretch`` for every window of a text that passes the filter.

    ``pieces`` says how many bytes are worked on, and how many windows handed on, at once.
    """
    read = texts.select(F.col(key), F.col(column).cast("binary").alias("_bytes"))
    kind = read.schema[0].dataType.simpleString()
    schema = f"{V.quoted(key)} {kind}, _stretch binary"
    return read.mapInArrow(_in_texts(sizes, held, bits, pieces, False), schema)


def stretch_counts(
    texts: DataFrame,
    column: str,
    sizes: Sequence[int],
    held: Broadcast,
    bits: int,
    pieces: tuple[int, int],
) -> DataFrame:
    """How many texts have each window that passes the filter, as ``_often``."""
    read = texts.select(F.lit(0).alias("_key"), F.col(column).cast("binary").alias("_bytes"))
    cut = _in_texts(sizes, held, bits, pieces, True)
    counts = read.mapInArrow(cut, "_often bigint, _stretch binary")
    return counts.groupBy("_stretch").agg(F.sum("_often").alias("_often"))
