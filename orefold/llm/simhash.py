"""Near duplicates by SimHash: tiled exact comparison of all distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import packed, text_array, text_slices
from orefold.llm.components import connected
from orefold.session import materialize

RADIUS = 3
TILE = 1 << 14
"""Fingerprints in a tile; a task holds two tiles and one block of comparisons."""
_BLOCK = 1024
_HASH = xxhash.xxh64_intdigest


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text, unsigned: A-Z lower-cased, words split at ASCII white space,
    shingles of ``width`` words with repeats, XXH64. A text of fewer words has one
    shingle, the whole sequence; one without words has fingerprint zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _HASH(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist()
    stops = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        hashes = np.array(
            [
                _HASH(joined[a:b], seed)
                for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])
            ],
            ">u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    set_bits = 2 * ones > len(starts)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def _prints(rows: DataFrame) -> DataFrame:
    """The rows with ``fingerprint``, a signed long with the 64 bits, for ``__text``."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            found = [
                fingerprint(value.as_buffer().to_pybytes())
                for value in text_array(batch, "__text")
            ]
            columns = dict(zip(batch.schema.names, batch.columns))
            del columns["__text"]
            columns["fingerprint"] = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)

    fields = [field for field in rows.schema if field.name != "__text"]
    return rows.mapInArrow(of, T.StructType([*fields, T.StructField("fingerprint", T.LongType())]))


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id``, ``fingerprint`` (a signed long with the 64 bits)."""
    return _prints(
        documents.select(
            F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text")
        )
    )


def _tiles(distinct: DataFrame, size: int) -> DataFrame:
    """Distinct fingerprints in order of their population count, packed into tiles."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def tile(values: np.ndarray) -> pa.RecordBatch:
            counts = np.bitwise_count(values)
            return pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([int(values[0].view(np.int64))]),
                    "low": pa.array([int(counts.min())], pa.int32()),
                    "high": pa.array([int(counts.max())], pa.int32()),
                    "prints": pa.array([values.tobytes()]),
                }
            )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            count += len(held[-1])
            while count >= size:
                values = np.concatenate(held)
                yield tile(values[:size])
                held, count = [values[size:]], count - size
        if count:
            yield tile(np.concatenate(held))

    population = F.bit_count("fingerprint")
    ordered = (
        distinct.select("fingerprint")
        .repartitionByRange(population, "fingerprint")
        .sortWithinPartitions(population, "fingerprint")
    )
    return ordered.mapInArrow(packed, "tile bigint, low int, high int, prints binary")


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles, each once, whose population counts come within the radius.

    Both sides are keyed by the counts they reach, so this is an equi-join of tile
    descriptions; the fingerprints are not in it.
    """
    shape = tiles.select("tile", "low", "high")
    left = shape.select(
        F.col("tile").alias("a"),
        F.col("low").alias("a_low"),
        F.explode(F.sequence(F.col("low"), F.col("high") + radius)).alias("reach"),
    )
    right = shape.select(
        F.col("tile").alias("b"),
        F.col("low").alias("b_low"),
        F.explode(F.sequence("low", "high")).alias("reach"),
    )
    later = (F.col("b_low") > F.col("a_low")) | (
        (F.col("b_low") == F.col("a_low")) & (F.col("b") >= F.col("a"))
    )
    return left.join(right, "reach").where(later).select("a", "b").distinct()


class Forest:
    """Links among a task's fingerprints, kept as one tree per connected group."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = self.root[self.root]
                if np.array_equal(jumped, self.root):
                    break
                self.root = jumped


def link_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (one tile if they are the same
    array): every pair is compared, in blocks; the forest connects what the pairs do."""
    same = a is b
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    forest = Forest(len(values))
    low_a, low_b = a.astype(np.uint32), b.astype(np.uint32)
    count_a, count_b = np.bitwise_count(a), np.bitwise_count(b)
    for i in range(0, len(a), _BLOCK):
        for j in range(i if same else 0, len(b), _BLOCK):
            one, two = count_a[i : i + _BLOCK], count_b[j : j + _BLOCK]
            if int(two.min()) - int(one.max()) > radius or int(one.min()) - int(two.max()) > radius:
                continue
            halves = low_a[i : i + _BLOCK, None] ^ low_b[None, j : j + _BLOCK]
            x, y = np.nonzero(np.bitwise_count(halves) <= radius)
            near = np.bitwise_count(a[i + x] ^ b[j + y]) <= radius
            forest.link(i + x[near], shift + j + y[near])
    child = np.nonzero(forest.root != np.arange(len(values)))[0]
    return values[child], values[forest.root[child]]


def _links(tiles: DataFrame, radius: int) -> DataFrame:
    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a = np.frombuffer(batch.column(0)[row].as_py(), np.uint64)
                b = a
                if not batch.column(2)[row].as_py():
                    b = np.frombuffer(batch.column(1)[row].as_py(), np.uint64)
                left, right = link_tiles(a, b, radius)
                yield pa.RecordBatch.from_pydict(
                    {
                        "src": pa.array(left.view(np.int64)),
                        "dst": pa.array(right.view(np.int64)),
                    }
                )

    pairs = _tile_pairs(tiles, radius)
    one = tiles.select(F.col("tile").alias("a"), F.col("prints").alias("left"))
    two = tiles.select(F.col("tile").alias("b"), F.col("prints").alias("right"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select("left", "right", (F.col("a") == F.col("b")).alias("same"))
        .mapInArrow(compared, "src bigint, dst bigint")
    )


def _components(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows ``fingerprint``, ``root`` (one of its component) and ``component_id``, for the
    rows ``doc_id, fingerprint``."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    distinct = materialize(distinct, "distinct-fingerprints")
    tiles = materialize(_tiles(distinct, tile), "tiles")
    links = materialize(_links(tiles, radius), "links")
    roots = connected(links)
    named = distinct.join(
        roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(
        named.join(smallest, "root").select("fingerprint", "root", "component_id"), "components"
    )


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """Rows ``doc_id``, ``fingerprint`` (16 lowercase hex digits), ``component_id``.

    Fingerprints that differ in at most ``radius`` bits are linked, and the component is
    the smallest id that links reach. Documents with equal fingerprints are one node of
    the comparison, so copies cost nothing. All distinct fingerprints are compared, tile
    by tile; tiles whose population counts are too far apart are skipped. Tasks give
    back a spanning forest, never all pairs of a dense group.

    Null and empty texts have fingerprint zero and are linked like any other. A null id
    is kept as a row but never names a component, which is null if it has no other id.
    Repeated rows each give a row. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(documents, doc_id, text), "fingerprints")
    named = _components(prints, radius, tile)
    return prints.join(named, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """The documents, with all their columns, of which one row of each group of near
    duplicates stays: that with the smallest id, null last, then the smallest hash of the
    text. Of rows that are equal in both, one stays, that with the smallest columns."""
    version = F.xxhash64(F.col(f"`{text}`"))
    key = F.col(f"`{doc_id}`").cast("long")
    narrow = documents.select(
        key.alias("doc_id"), version.alias("version"), F.col(f"`{text}`").alias("__text")
    )
    prints = materialize(_prints(narrow), "fingerprints")
    named = _components(prints, radius, TILE).drop("component_id")
    given = prints.groupBy("fingerprint", "doc_id", "version").agg(F.count("*").alias("copies"))
    given = materialize(given, "distinct-rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    first = given.groupBy("fingerprint").agg(F.min(place).alias("first"))
    first = named.join(first, "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
    placed = given.join(named.join(first, "root"), "fingerprint")
    later = ~place.eqNullSafe(F.col("first"))
    gone = materialize(
        placed.where(later | (F.col("copies") > 1)).select(
            F.col("doc_id").alias("gone"), F.col("version").alias("text"), later.alias("later")
        ),
        "later-rows",
    )
    rows = packed(documents, key=key, version=version)
    same = F.col("key").eqNullSafe(F.col("gone")) & (F.col("version") == F.col("text"))
    kept = rows.join(gone, same, "left_anti").select("row.*")
    repeated = gone.where(~F.col("later"))
    if repeated.isEmpty():
        return kept
    one = rows.join(repeated, same, "left_semi").groupBy("key", "version")
    one = one.agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.union(one.select("row.*"))
