"""Approximate nearest neighbours: a vantage-point tree for each shard of the vectors.

Rows are dealt into shards of bounded size. A shard is written as its tree: the vectors in
the order of the tree, so that a node is a stretch of them, its first vector the vantage
point, the nearer half of the others after it and the farther half behind. Beside each
vantage point stand the smallest and largest distance of either half. A block of queries
walks a tree at once; a half is left out for those queries whose triangle inequality says
that nothing in it is near enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefold.llm.vectors import (
    cells,
    dense,
    finite,
    gathered,
    id_array,
    ids_of,
    listed,
    shape,
    vector_array,
)
from orefold.session import materialize

NEIGHBOURS = 10
SHARD = 8192
"""Vectors of a tree."""
BLOCK = 512
"""Queries that walk a tree together."""
LEAF = 64
"""Nodes of at most so many vectors are compared as a whole."""
FACTOR = 0.5
"""Share of the search radius that prunes; 1 is the exact search."""
_TRIED = 6
_SPREAD = 64


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, in double precision."""
    return np.sqrt(np.square(left - right).sum(-1))


def plant(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points in their tree, and for each vantage point the smallest and
    largest distance of the nearer and of the farther half.

    Halves are equal in number, whatever the ties, so equal vectors do not make the tree
    deep. Of a few points that whose distances spread most becomes the vantage point.
    """
    order = np.arange(len(points))
    bounds = np.zeros((len(points), 4))
    random = np.random.default_rng(0)
    todo = [(0, len(points))]
    while todo:
        start, end = todo.pop()
        if end - start <= leaf:
            continue
        tried = random.integers(start, end, _TRIED)
        some = points[order[random.integers(start, end, _SPREAD)]]
        spread = [distances(some, points[order[i]]).std() for i in tried]
        best = tried[int(np.argmax(spread))]
        order[[start, best]] = order[[best, start]]
        away = distances(points[order[start + 1 : end]], points[order[start]])
        by = np.argsort(away, kind="stable")
        order[start + 1 : end] = order[start + 1 : end][by]
        away = away[by]
        half = middle(start, end) - start - 1
        bounds[start] = away[0], away[half - 1], away[half], away[-1]
        todo += [(start + 1, start + 1 + half), (start + 1 + half, end)]
    return order, bounds


def middle(start: int, end: int) -> int:
    """Where the farther half of a node begins."""
    return (start + 1 + end) // 2


class Nearest:
    """The nearest vectors found so far for each query of a block."""

    def __init__(self, queries: np.ndarray, most: int) -> None:
        self.queries = queries
        self.squares = np.square(queries).sum(1)
        self.most = most
        self.away = np.full((len(queries), most), np.inf)
        self.ids = np.zeros((len(queries), most), np.int64)
        self.null = np.zeros((len(queries), most), bool)

    def radius(self, of: np.ndarray) -> np.ndarray:
        return self.away[of, -1]

    def offer(self, of: np.ndarray, away: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Take the nearest of what each query has and is offered, by distance, then id."""
        shown = away.shape
        all_away = np.concatenate([self.away[of], away], 1)
        all_ids = np.concatenate([self.ids[of], np.broadcast_to(ids, shown)], 1)
        all_null = np.concatenate([self.null[of], np.broadcast_to(null, shown)], 1)
        first = np.lexsort((all_ids, all_null, all_away), axis=-1)[:, : self.most]
        self.away[of] = np.take_along_axis(all_away, first, 1)
        self.ids[of] = np.take_along_axis(all_ids, first, 1)
        self.null[of] = np.take_along_axis(all_null, first, 1)


class Tree:
    """A shard's vectors in the order of their tree."""

    def __init__(
        self, points: np.ndarray, bounds: np.ndarray, ids: np.ndarray, null: np.ndarray
    ) -> None:
        self.points, self.bounds, self.ids, self.null = points, bounds, ids, null
        self.squares = np.square(points).sum(1)

    def search(
        self, nearest: Nearest, own: np.ndarray, factor: float = FACTOR, leaf: int = LEAF
    ) -> None:
        """Offer the block's queries what the tree has near them. ``own`` is each query's
        own place in this tree, or -1. With ``factor`` 1 nothing near enough is missed."""
        self.nearest, self.own, self.factor, self.leaf = nearest, own, factor, leaf
        self._visit(0, len(self.points), np.arange(len(own)))

    def _visit(self, start: int, end: int, of: np.ndarray) -> None:
        if not len(of) or start == end:
            return
        if end - start <= self.leaf:
            self._compare(start, end, of)
            return
        away = distances(self.nearest.queries[of], self.points[start])
        shown = np.where(self.own[of] == start, np.inf, away)
        near = shown <= self.nearest.radius(of)
        if near.any():
            place = slice(start, start + 1)
            self.nearest.offer(of[near], shown[near, None], self.ids[place], self.null[place])
        low, high, far_low, far_high = self.bounds[start]
        half = middle(start, end)
        halves = [(start + 1, half, low, high), (half, end, far_low, far_high)]
        inner = away - high <= far_low - away
        for promising, ordered in ((inner, halves), (~inner, halves[::-1])):
            group, known = of[promising], away[promising]
            for first, last, least, most in ordered:
                gap = np.maximum(known - most, least - known)
                rounding = 1e-9 * (known + most)
                reach = gap <= self.factor * self.nearest.radius(group) + rounding
                self._visit(first, last, group[reach])

    def _compare(self, start: int, end: int, of: np.ndarray) -> None:
        """All vectors of a leaf: a matrix product leaves out what is surely too far, the
        others are measured exactly."""
        queries, points = self.nearest.queries[of], self.points[start:end]
        sizes = self.nearest.squares[of, None] + self.squares[start:end]
        rough = sizes - 2 * queries @ points.T
        near = rough <= np.square(self.nearest.radius(of))[:, None] + 1e-9 * sizes
        own = self.own[of] - start
        mine = np.flatnonzero((own >= 0) & (own < end - start))
        near[mine, own[mine]] = False
        some = np.flatnonzero(near.any(1))
        if len(some):
            away = np.full((len(some), end - start), np.inf)
            query, point = np.nonzero(near[some])
            away[query, point] = distances(queries[some[query]], points[point])
            self.nearest.offer(of[some], away, self.ids[start:end], self.null[start:end])


def index(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD
) -> tuple[DataFrame, int, int]:
    """The written trees, how many there are, and the length of their vectors.

    Rows ``tile, ids, matrix, bounds``: a tree for every ``shard`` vectors, dealt evenly
    whatever their ids and values. Every row with a finite vector other than zero is in
    one tree.
    """
    value = F.col(f"`{vector}`")
    rows = vectors.where(finite(value)).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), value.cast("array<double>").alias("vector")
    )
    rows = materialize(rows.where(F.exists("vector", lambda x: x != 0)), "vectors")
    known = shape(rows)

    def planted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, piece in gathered(batches, shard):
            points = dense(piece.column(1), known.width)
            order, bounds = plant(points)
            yield pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([tile]),
                    "ids": listed(piece.column(0).take(pa.array(order))),
                    "matrix": pa.array([points[order].tobytes()]),
                    "bounds": pa.array([bounds.tobytes()]),
                }
            )

    trees = rows.repartition(known.tiles(shard)).mapInArrow(
        planted, "tile bigint, ids array<bigint>, matrix binary, bounds binary"
    )
    return materialize(trees, "trees"), known.tiles(shard), known.width


def _blocks(trees: DataFrame, width: int, every: int, block: int) -> DataFrame:
    """The queries, with the tree and place where each of them stands, in blocks."""

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, ids, matrix in zip(*(batch.column(i) for i in range(3))):
                given, null = ids_of(ids.values)
                at = np.flatnonzero((given % every == 0) & ~null)
                points = np.frombuffer(matrix.as_buffer(), float).reshape(len(given), width)
                yield pa.RecordBatch.from_pydict(
                    {
                        "home": pa.array(np.full(len(at), tile.as_py())),
                        "at": pa.array(at, pa.int64()),
                        "id": pa.array(given[at]),
                        "vector": vector_array(points[at]),
                    }
                )

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in gathered(batches, block):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number]),
                    "homes": listed(piece.column(0)),
                    "places": listed(piece.column(1)),
                    "queries": listed(piece.column(2)),
                    "asked": pa.array([dense(piece.column(3), width).tobytes()]),
                }
            )

    queries = materialize(
        trees.select("tile", "ids", "matrix").mapInArrow(
            asked, "home bigint, at bigint, id bigint, vector array<double>"
        ),
        "queries",
    )
    count = max(1, -(-queries.count() // block))
    return materialize(
        queries.repartition(count).mapInArrow(
            packed,
            "block bigint, homes array<bigint>, places array<bigint>, queries array<bigint>, "
            "asked binary",
        ),
        "query-blocks",
    )


def nearest_neighbours(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    most: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every`` the ``most`` nearest other rows found, nearest first, ties by smaller id,
    null ids last; the score is the Euclidean distance in double precision.

    Every row is indexed, and every query walks the trees of all shards; what it has found
    in one shard narrows the search in the next ones of its task. A half of a node is left
    out if, by the triangle inequality, all of it is farther than ``factor`` times the
    distance of the worst neighbour found. With 1 the result is exact; smaller factors
    compare less and can miss neighbours.

    Vectors that are null, zero, or hold a null or non-finite component take no part.
    Shorter vectors end in zeros. Copies of a row are rows of their own: only the query's
    own row is no candidate. A query without candidates has no rows; an empty table gives
    an empty result. Other columns are ignored.
    """
    if factor <= 0:
        raise ValueError("the factor must be positive")
    trees, shards, width = index(vectors, vec_id, vector, shard)
    blocks = _blocks(trees, width, every, block)

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                if row["block"].as_py() != at:
                    if found is not None:
                        yield _result(found, queries, homes, places)
                    at = row["block"].as_py()
                    queries, homes, places = (
                        row[name].values.to_numpy(zero_copy_only=False)
                        for name in ("queries", "homes", "places")
                    )
                    asked = np.frombuffer(row["asked"].as_buffer(), float)
                    found = Nearest(asked.reshape(len(queries), width), most)
                ids, null = ids_of(row["ids"].values)
                points = np.frombuffer(row["matrix"].as_buffer(), float).reshape(len(ids), width)
                bounds = np.frombuffer(row["bounds"].as_buffer(), float).reshape(len(ids), 4)
                own = np.where(homes == row["of_tile"].as_py(), places, -1)
                Tree(points, bounds, ids, null).search(found, own, factor)
        if found is not None:
            yield _result(found, queries, homes, places)

    pairs = cells(blocks, trees, shards).select(
        "block", "homes", "places", "queries", "asked", "of_tile", "ids", "matrix", "bounds"
    )
    near = pairs.mapInArrow(
        searched, "home bigint, at bigint, query_id bigint, vec_id bigint, score double"
    )
    own = Window.partitionBy("home", "at").orderBy("score", F.col("vec_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _result(
    found: Nearest, queries: np.ndarray, homes: np.ndarray, places: np.ndarray
) -> pa.RecordBatch:
    query, place = np.nonzero(np.isfinite(found.away))
    return pa.RecordBatch.from_pydict(
        {
            "home": pa.array(homes[query]),
            "at": pa.array(places[query]),
            "query_id": pa.array(queries[query]),
            "vec_id": id_array(found.ids[query, place], found.null[query, place]),
            "score": pa.array(found.away[query, place]),
        }
    )
