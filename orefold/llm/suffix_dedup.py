"""Exact repeated passages by a distributed, sparse suffix array.

Sorting the suffixes at every byte would move a hundred bytes for each byte of text. A
window of 100 bytes always holds the same *anchor*, the place of the lowest hash among
its stretches of 24 bytes, wherever it occurs; so suffixes at anchors, about one in 39,
are enough. Three steps, each smaller than the one before:

1. Each task finds its anchors. An anchor serves a run of windows, and its *context* is
   the text they cover. Contexts that occur again in a task are settled there.
2. Anchors meet by the hash of their stretch. One that stands alone is dropped; of equal
   contexts all but the first are repeats; only where contexts differ is their text
   needed.
3. Those contexts are sorted as suffixes: sampled splitters range-partition them by their
   leading bytes, buckets sort by multikey quicksort, and common prefixes of neighbours,
   with what lies left of the anchor, tell which windows are equal. Windows that may go
   on beyond a bucket's boundary are compared by content across buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import buffer_of, packed, text_array, text_slices
from orefold.session import materialize

LENGTH = 100
STRETCH = 24
_SLICE = 1 << 20
_TASK_ANCHORS = 250_000
_BUCKET_ROWS = 50_000
_MOST_BUCKETS = 50_000
_SAMPLED = 4
"""Rows sampled for each bucket; with the number of buckets it bounds what is collected."""
_NO_ID = (1 << 63) - 1
_MARK, _ANCHOR, _SUFFIX, _VARIED = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(28)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any stretch of a buffer, from running totals of weighted bytes. Weights
    are powers of an odd number, so a stretch's place cancels out."""

    def __init__(self, data: np.ndarray) -> None:
        steps = np.full(len(data) + 1, _BASE)
        steps[0] = 1
        self._up = np.cumprod(steps)
        steps[1:] = pow(int(_BASE), -1, 1 << 64)
        weighted = np.cumprod(steps)[:-1] * (data.astype(np.uint64) + np.uint64(1))
        self._total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self._total[stop] - self._total[start]) * self._up[start])

    def everywhere(self, length: int) -> np.ndarray:
        count = len(self._total) - length
        return _mix((self._total[length:] - self._total[:count]) * self._up[:count])


def find_anchors(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of all texts in the buffer: the text, the anchor's place,
    the first and last window it serves (places within the text), the hash of its
    stretch, and the hash of its context."""
    long = ends - starts >= LENGTH
    if not long.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    hashes = _Hashes(data)
    stretch = hashes.everywhere(STRETCH)
    place = np.arange(len(stretch), dtype=np.uint64)
    lowest = (stretch >> _PLACE_BITS << _PLACE_BITS) | place
    width, reach = LENGTH - STRETCH + 1, 1
    while 2 * reach <= width:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    if width > reach:
        lowest = np.minimum(lowest[: reach - width], lowest[width - reach :])
    counts = np.where(long, ends - starts - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(len(text)) + np.repeat(starts - np.cumsum(counts) + counts, counts)
    anchor = (lowest[window] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(anchor)) - 1
    low, high, anchor, text = window[first], window[last], anchor[first], text[first]
    context = hashes.of(low, high + LENGTH)
    begin = starts[text]
    return text, anchor - begin, low - begin, high - begin, stretch[anchor], context


def _pack(low: np.ndarray, anchor: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First window and distances to the anchor and the last window in one long; longs of
    one text are in the order of their first windows."""
    return (low << 14) | ((anchor - low) << 7) | (high - low)


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = span >> 14
    return low, low + (span >> 7 & 127), low + (span & 127)


def _elsewhere(
    doc: np.ndarray, version: np.ndarray, span: np.ndarray, origin: np.ndarray
) -> np.ndarray:
    """Which rows stand at another place than the row at ``origin``."""
    return (doc != doc[origin]) | (version != version[origin]) | (span != span[origin])


def settle(
    stretch: np.ndarray, context: np.ndarray, doc: np.ndarray, version: np.ndarray,
    span: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by stretch, context, document, version and span: which are the first of
    their context, which stand at another place than the first, and which have a stretch
    that occurs in several contexts."""
    new_stretch = np.append(True, stretch[1:] != stretch[:-1])
    first = new_stretch | np.append(True, context[1:] != context[:-1])
    origin = np.nonzero(first)[0][np.cumsum(first) - 1]
    repeat = _elsewhere(doc, version, span, origin)
    group = np.cumsum(new_stretch) - 1
    varied = np.bincount(group, first)[group] > 1
    return first, repeat, varied


_ROW = T.StructType(
    [
        T.StructField("stretch", T.LongType()),
        T.StructField("context", T.LongType()),
        T.StructField("doc", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("span", T.LongType()),
        T.StructField("kind", T.IntegerType()),
    ]
)


def _rows(stretch, context, doc, version, span, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "stretch": pa.array(stretch.view(np.int64)),
            "context": pa.array(context.view(np.int64)),
            "doc": pa.array(doc),
            "version": pa.array(version),
            "span": pa.array(span),
            "kind": pa.array(kind.astype(np.int32)),
        }
    )


def _combine(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Settle what a task can by itself. Each context goes on once; repeats of it are
    settled. A stretch that the task has seen in several contexts is known to need its
    text; then only one row of it goes on, to tell the other tasks."""
    columns = [np.concatenate(column) for column in zip(*parts)]
    if not len(columns[0]):
        return
    order = np.lexsort(columns[::-1])
    stretch, context, doc, version, span = (column[order] for column in columns)
    first, repeat, varied = settle(stretch, context, doc, version, span)
    told = np.append(True, stretch[1:] != stretch[:-1])
    kind = np.full(len(stretch), -1)
    kind[first & ~varied] = _ANCHOR
    kind[repeat] = _MARK
    kind[first & varied] = _SUFFIX
    settled = (kind == _MARK) | (kind == _SUFFIX)
    tell = np.nonzero(varied & told)[0]
    # Settled rows only travel along; their own hash spreads them evenly.
    own = _mix(doc.view(np.uint64) ^ version.view(np.uint64)) ^ span.view(np.uint64)
    spread = np.where(settled, _mix(own), stretch)
    used = np.nonzero(kind >= 0)[0]
    at = np.concatenate([used, tell])
    kinds = np.concatenate([kind[used], np.full(len(tell), _VARIED)])
    keys = np.concatenate([spread[used], stretch[tell]])
    for a in range(0, len(at), 100_000):
        part = at[a : a + 100_000]
        yield _rows(
            keys[a : a + 100_000],
            context[part],
            doc[part],
            version[part],
            span[part],
            kinds[a : a + 100_000],
        )


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []
    count = 0
    for batch in text_slices(batches, "__text", _SLICE):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        versions = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = find_anchors(*buffer_of(text_array(batch, "__text")))
        text, anchor, low, high, stretch, context = found
        parts.append((stretch, context, ids[text], versions[text], _pack(low, anchor, high)))
        count += len(text)
        if count >= _TASK_ANCHORS:
            yield from _combine(parts)
            parts, count = [], 0
    if parts:
        yield from _combine(parts)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle anchors that arrive sorted by stretch, context, document, version and span. A stretch
    has one row of each task at most, or one for each task and context it saw alone."""
    held: list[np.ndarray] | None = None

    def settled(columns: list[np.ndarray]) -> pa.RecordBatch:
        _, _, doc, version, span, kind = columns
        out = np.where((kind == _MARK) | (kind == _SUFFIX), kind, -1)
        open_ = np.nonzero(out < 0)[0]
        if len(open_):
            s, c, d, v, p, k = (column[open_] for column in columns)
            first, repeat, varied = settle(s, c, d, v, p)
            group = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1
            varied |= (np.bincount(group, k == _VARIED) > 0)[group]
            verdict = np.where(repeat, _MARK, np.where(varied, _SUFFIX, -1))
            # The task that told of a varied stretch has already passed its suffixes on.
            verdict[(k == _VARIED) & (verdict == _SUFFIX)] = -1
            # A later equal row at the first's own place is the same row read twice.
            verdict[~first & ~repeat] = -1
            out[open_] = verdict
        used = out >= 0
        return pa.RecordBatch.from_pydict(
            {
                "doc": pa.array(doc[used]),
                "version": pa.array(version[used]),
                "span": pa.array(span[used]),
                "kind": pa.array(out[used].astype(np.int32)),
            }
        )

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if cut:
            yield settled([column[:cut] for column in columns])
        held = [column[cut:] for column in columns]
    if held is not None and len(held[0]):
        yield settled(held)


_CONTEXT = "right binary, left binary, doc bigint, version bigint, span bigint"


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of suffixes: from the anchor on, and, backwards, from the anchor to the left."""
    for batch in text_slices(batches, "__text", _SLICE):
        right, left, docs, texts, spans = [], [], [], [], []
        ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        wanted = batch.column(2).to_pylist()
        for row, value in enumerate(text_array(batch, "__text")):
            text = value.as_buffer().to_pybytes()
            span = np.unique(np.array(wanted[row], np.int64))
            low, anchor, high = _unpack(span)
            for a, b, c in zip(low.tolist(), anchor.tolist(), high.tolist()):
                right.append(text[b : c + LENGTH])
                left.append(text[a:b][::-1])
            docs.append(np.full(len(span), ids[row]))
            texts.append(np.full(len(span), versions[row]))
            spans.append(span)
        yield pa.RecordBatch.from_pydict(
            {
                "right": pa.array(right, pa.binary()),
                "left": pa.array(left, pa.binary()),
                "doc": pa.array(np.concatenate(docs)),
                "version": pa.array(np.concatenate(texts)),
                "span": pa.array(np.concatenate(spans)),
            }
        )


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each value, padded with zeros, and the lengths."""
    sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in values], np.int64)
    joined = np.frombuffer(b"".join(v.as_py() for v in values), np.uint8)
    padded = np.zeros((len(sizes), width), np.uint8)
    column = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(np.arange(len(sizes)), sizes), column] = joined
    return padded, sizes


def multikey_quicksort(words: np.ndarray, small: int = 512) -> np.ndarray:
    """The order of rows of unsigned words: three-way partition at a pivot word, going on
    to the next word only where words are equal."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == words.shape[1] or len(rows) < 2:
            done.append(rows)
        elif len(rows) <= small:
            done.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
        else:
            keys = words[rows, depth]
            sample = np.sort(keys[:: max(1, len(keys) // 99)])
            pivot = sample[len(sample) // 2]
            # The last pushed is taken next: smaller rows come first.
            todo.append((rows[keys > pivot], depth))
            todo.append((rows[keys == pivot], depth + 1))
            todo.append((rows[keys < pivot], depth))
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _common_with(right: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
    """How many leading bytes each row shares with a bound; -1 without one."""
    if bound is None:
        return np.full(len(right), -1)
    differs = right != bound
    return np.where(differs.any(1), differs.argmax(1), right.shape[1])


def compare_suffixes(
    right: np.ndarray, right_sizes: np.ndarray, left: np.ndarray, doc: np.ndarray,
    version: np.ndarray, span: np.ndarray, bounds: tuple[np.ndarray | None, np.ndarray | None],
) -> tuple[np.ndarray, np.ndarray]:
    """For each row and distance from window to anchor: whether the window has an earlier
    equal in the bucket, and whether it is the bucket's first but may have equals beyond
    the boundaries. Rows are in the order of documents, versions and places.

    Other buckets lie before the lower bound or from the upper bound on, so they hold a
    window's bytes right of the anchor only if a bound begins with them.
    """
    n, reach = len(doc), LENGTH - STRETCH + 1
    low, anchor, high = _unpack(span)
    order = multikey_quicksort(right.view(">u8").astype(np.uint64))
    ordered = right[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(1), differs.argmax(1), right.shape[1])
    sizes = right_sizes[order]
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    near = np.maximum(*(_common_with(right, bound) for bound in bounds))
    repeated, open_ = np.zeros((n, reach), bool), np.zeros((n, reach), bool)
    side = np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)
    for distance in range(reach):
        if distance:
            _, side = np.unique(side * 256 + left[:, distance - 1], return_inverse=True)
        run[order] = np.concatenate([[0], np.cumsum(common < LENGTH - distance)])
        rows = np.nonzero((anchor - high <= distance) & (distance <= anchor - low))[0]
        if not len(rows):
            continue
        _, index, inverse = np.unique(
            run[rows] * (side.max() + 1) + side[rows], return_index=True, return_inverse=True
        )
        origin = rows[index][inverse]
        repeated[rows, distance] = _elsewhere(
            doc[rows], version[rows], span[rows], index[inverse]
        )
        open_[rows, distance] = (near[rows] >= LENGTH - distance) & (rows == origin)
    return repeated, open_


_FOUND = "doc bigint, version bigint, start bigint, stop bigint, content binary"


_RIGHT, _LEFT = LENGTH + 4, LENGTH


def _sort_keys(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bytes a row is sorted by: right of the anchor, then backwards to the left."""
    return np.concatenate([right, left], 1).view(f"S{_RIGHT + _LEFT}").ravel()


def sample_splitters(contexts: DataFrame, count: int, buckets: int) -> np.ndarray:
    """Bounds of the buckets, from a sample by hash of a few rows for each."""
    if buckets < 2:
        return np.zeros(0, f"S{_RIGHT + _LEFT}")
    every = max(1, count // (buckets * _SAMPLED))
    drawn = F.pmod(F.xxhash64("doc", "version", "span"), F.lit(every)) == 0
    sample = contexts.where(drawn).select("right", "left").limit(2 * buckets * _SAMPLED)
    table = sample.toArrow()
    keys = np.sort(
        _sort_keys(
            _matrix(table.column("right").combine_chunks(), _RIGHT)[0],
            _matrix(table.column("left").combine_chunks(), _LEFT)[0],
        )
    )
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets]) if len(keys) else keys


def _dealt(splitters: np.ndarray):
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _sort_keys(
                _matrix(batch.column(0), _RIGHT)[0], _matrix(batch.column(1), _LEFT)[0]
            )
            bucket = np.searchsorted(splitters, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), *batch.columns], ["bucket", *batch.schema.names]
            )

    return deal


def _bound(splitters: np.ndarray, at: int) -> np.ndarray | None:
    """The right part of a splitter; None beyond the first and the last."""
    if not 0 <= at < len(splitters):
        return None
    return np.frombuffer(splitters[at : at + 1].tobytes(), np.uint8)[:_RIGHT]


def _compared(splitters: np.ndarray):
    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        bounds = (_bound(splitters, bucket - 1), _bound(splitters, bucket))
        return pa.Table.from_batches(list(_bucket(table.combine_chunks(), bounds)))

    return compare


def _bucket(
    table: pa.Table, bounds: tuple[np.ndarray | None, np.ndarray | None]
) -> Iterator[pa.RecordBatch]:
    """Repeats within one bucket, with stop set, and first windows that may have equals in
    another, with their content's digest set."""
    doc = table.column("doc").to_numpy()
    span = table.column("span").to_numpy()
    version = table.column("version").to_numpy()
    order = np.lexsort((span, version, doc))
    doc, version, span = doc[order], version[order], span[order]
    right, sizes = _matrix(table.column("right").chunk(0), _RIGHT)
    left, _ = _matrix(table.column("left").chunk(0), _LEFT)
    right, sizes, left = right[order], sizes[order], left[order]
    repeated, open_ = compare_suffixes(right, sizes, left, doc, version, span, bounds)
    _, anchor, _ = _unpack(span)
    edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edges == 1)
    _, beyond = np.nonzero(edges == -1)
    yield pa.RecordBatch.from_pydict(
        {
            "doc": pa.array(doc[row]),
            "version": pa.array(version[row]),
            "start": pa.array(anchor[row] - beyond + 1),
            "stop": pa.array(anchor[row] - near + LENGTH),
            "content": pa.nulls(len(row), pa.binary()),
        }
    )
    row, distance = np.nonzero(open_)
    for a in range(0, len(row), 50_000):
        rows, back = row[a : a + 50_000], distance[a : a + 50_000]
        contents = [
            hashlib.blake2b(
                left[i, :d][::-1].tobytes() + right[i, : LENGTH - d].tobytes(), digest_size=16
            ).digest()
            for i, d in zip(rows.tolist(), back.tolist())
        ]
        yield pa.RecordBatch.from_pydict(
            {
                "doc": pa.array(doc[rows]),
                "version": pa.array(version[rows]),
                "start": pa.array(anchor[rows] - back),
                "stop": pa.nulls(len(rows), pa.int64()),
                "content": pa.array(contents, pa.binary()),
            }
        )


def _keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """The document's place in the order, and a hash that tells texts of one id apart."""
    doc = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID))
    return doc, F.xxhash64(F.col(f"`{text}`"))


def repeated_ranges(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc, version, start, stop``: byte ranges that are covered by windows which
    start earlier too. Ranges of one document may overlap."""
    doc, version = _keys(doc_id, text)
    rows = documents.select(
        doc.alias("doc"), version.alias("version"), F.col(f"`{text}`").alias("__text")
    )
    met = (
        rows.mapInArrow(_anchor_rows, _ROW)
        .repartition("stretch")
        .sortWithinPartitions("stretch", "context", "doc", "version", "span")
        .mapInArrow(_meet, "doc bigint, version bigint, span bigint, kind int")
    )
    met = materialize(met, "anchors")
    low = F.shiftright("span", 14)
    high = low + F.col("span").bitwiseAND(127)
    marks = met.where(F.col("kind") == _MARK).select(
        "doc",
        "version",
        low.alias("start"),
        (high + LENGTH).alias("stop"),
    )
    wanted = (
        met.where(F.col("kind") == _SUFFIX)
        .groupBy("doc", "version")
        .agg(F.collect_list("span").alias("spans"))
    )
    # Rows that are the same document read twice give the same suffixes: one is enough.
    texts = rows.join(wanted, ["doc", "version"]).select("doc", "version", "spans", "__text")
    contexts = materialize(texts.mapInArrow(_contexts, _CONTEXT), "contexts")
    count = contexts.count()
    if not count:
        return marks
    buckets = min(1 + count // _BUCKET_ROWS, _MOST_BUCKETS)
    splitters = sample_splitters(contexts, count, buckets)
    found = materialize(
        contexts.mapInArrow(_dealt(splitters), f"bucket int, {_CONTEXT}")
        .groupBy("bucket")
        .applyInArrow(_compared(splitters), _FOUND),
        "suffixes",
    )
    open_ = found.where(F.col("content").isNotNull()).select("content", "doc", "version", "start")
    firsts = (
        open_.groupBy("content")
        .agg(F.min(F.struct("doc", "version", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    across = (
        open_.join(firsts, "content")
        .where(F.struct("doc", "version", "start") != F.col("first"))
        .select("doc", "version", "start", (F.col("start") + LENGTH).alias("stop"))
    )
    inside = found.where(F.col("stop").isNotNull()).select("doc", "version", "start", "stop")
    return marks.union(inside).union(across)


def merge_ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.nonzero(new)[0][1:], len(reach)) - 1]


def _with_ranges(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents as a struct ``row`` and their ranges, packed start and length."""
    doc, version = _keys(doc_id, text)
    bounds = F.shiftleft("start", 31) + (F.col("stop") - F.col("start"))
    ranges = (
        repeated_ranges(documents, doc_id, text)
        .groupBy("doc", "version")
        .agg(F.collect_list(bounds).alias("ranges"))
    )
    rows = packed(documents, doc=doc, version=version)
    return rows.join(ranges, ["doc", "version"], "left").select("row", "ranges")


def _runs(ranges: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.array(ranges, np.int64)
    starts = values >> 31
    return merge_ranges(starts, starts + (values & ((1 << 31) - 1)))


def removals(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte is removed if a string of 100 bytes that covers it also starts earlier: in a
    document of smaller id, or earlier in the same one. Strings are those of the input,
    whatever is removed, may overlap, and never cross documents.

    Null texts count as empty. A null id comes after all others and stays null. Repeated
    rows of one document are the same document, not copies of each other, and each gives
    its row; different texts under one id are ordered by a hash. Texts shorter than 100
    bytes lose nothing. An empty table gives an empty result.
    """

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "row.text"):
            out: list[tuple] = []
            ranges = batch.column(1).to_pylist()
            for row, value in enumerate(text_array(batch, "row.text")):
                text = value.as_buffer().to_pybytes()
                starts, stops = _runs(ranges[row])
                digest, at = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), stops.tolist()):
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                removed = int((stops - starts).sum())
                out.append((len(text), removed, len(starts), digest.hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).field("doc_id"),
                    "n_bytes": pa.array(columns[0], pa.int64()),
                    "n_removed": pa.array(columns[1], pa.int64()),
                    "n_spans": pa.array(columns[2], pa.int64()),
                    "kept_sha256": pa.array(columns[3], pa.string()),
                }
            )

    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    return _with_ranges(rows, "doc_id", "text").mapInArrow(
        summed,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )


def cut_text(text: bytes, starts: np.ndarray, stops: np.ndarray) -> str:
    """The text without the ranges; a character that is only partly covered stays."""
    parts, at = [], 0
    for a, b in zip(starts.tolist(), stops.tolist()):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts).decode("utf-8")


def remove_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None
) -> DataFrame:
    """The documents, all columns and rows, with repeated passages cut from the text.

    Only whole characters are cut. ``length`` names a column that is to hold the new
    number of characters. A null text stays null; a text that is all repeats becomes
    empty. Otherwise as in :func:`removals`.
    """
    schema = T.StructType([T.StructField("row", documents.schema)])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, f"row.{text}"):
            rows, ranges = batch.column(0), batch.column(1).to_pylist()
            kept = []
            for row, value in enumerate(rows.field(text)):
                if ranges[row] and value.is_valid:
                    kept.append(cut_text(value.as_buffer().to_pybytes(), *_runs(ranges[row])))
                else:
                    kept.append(value.as_py())
            columns = {field.name: rows.field(field.name) for field in rows.type}
            columns[text] = pa.array(kept, columns[text].type)
            if length:
                sizes = [None if one is None else len(one) for one in kept]
                columns[length] = pa.array(sizes, columns[length].type)
            made = pa.StructArray.from_arrays(list(columns.values()), list(columns))
            yield pa.RecordBatch.from_arrays([made], ["row"])

    return _with_ranges(documents, doc_id, text).mapInArrow(cut, schema).select("row.*")
