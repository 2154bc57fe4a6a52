"""Hard negatives for anchors, with score bounds along a spanning tree of the anchors.

Anchors lie in blocks of similar ones, and each block has a minimum spanning tree. Against
a tile of candidates the root is scored in full. By Cauchy and Schwarz, the score of a
child differs from its parent's by at most the length of the edge times the candidate's
norm, so the parent's scores, or bounds, bound the child's. Only candidates whose bounds
overlap the windows asked for, and that may still be among the best of one, are scored.
Two passes do this: the first asks for each anchor's best rows of its own label, the
second for rows of other labels in the windows that those positives open.
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

POSITIVES = 5
NEGATIVES = 10
LOWEST, HIGHEST = 30, 90
"""A negative scores from 30 to 90 hundredths of the positive."""
TILE = 8192
BLOCK = 256
SCALE = 256
"""Components are floored after this factor, so scores are whole numbers."""
_PLANES = 16
_WINDOW = tuple[int, int]


def products(rows: np.ndarray, of: np.ndarray, vector: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products of chosen rows with a vector. ``norms`` is the product of the
    largest norms: no partial sum is beyond it, which says what type holds every sum."""
    if norms >= 2.0**53:
        return rows[of].astype(np.int64) @ vector.astype(np.int64)
    if 2 * len(of) > len(rows):
        return (rows @ vector)[of].astype(np.int64)
    return (rows[of] @ vector).astype(np.int64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree: the order in which points join it, and for each point its
    parent (-1 for the first) and the length of the edge between them."""
    count = len(points)
    up = np.full(count, -1)
    edge = np.full(count, np.inf)
    order, left = [0], np.ones(count, bool)
    left[0], edge[0], last = False, 0.0, 0
    while len(order) < count:
        away = np.sqrt(np.square(points - points[last]).sum(1))
        nearer = left & (away < edge)
        edge[nearer], up[nearer] = away[nearer], last
        last = int(np.argmin(np.where(left, edge, np.inf)))
        left[last] = False
        order.append(last)
    return np.array(order), up, edge


class Best:
    """The best rows found so far for one window of one anchor: score, then smaller id."""

    def __init__(self, window: _WINDOW, most: int) -> None:
        self.low, self.high = window
        self.most = most
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def least(self) -> float:
        """What a row must score to be among the best."""
        return self.scores[-1] if len(self.scores) == self.most else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fits = (scores >= max(self.low, self.least())) & (scores <= self.high)
        if not fits.any():
            return
        scores = np.append(self.scores, scores[fits])
        ids, null = np.append(self.ids, ids[fits]), np.append(self.null, null[fits])
        first = np.lexsort((ids, null, -scores))[: self.most]
        self.scores, self.ids, self.null = scores[first], ids[first], null[first]


class Candidates:
    """A tile of rows: ids, labels, whole-number vectors and their norms."""

    def __init__(self, ids: pa.Array, labels: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.null = ids_of(ids)
        self.labels = labels
        wide = matrix.astype(float)
        self.norms = np.sqrt(np.square(wide).sum(1))
        self.longest = float(self.norms.max(initial=0))
        self.wide, self.matrix = wide, matrix


def walk(
    tree: tuple[np.ndarray, np.ndarray, np.ndarray],
    anchors: np.ndarray,
    labels: np.ndarray,
    rows: Candidates,
    own: np.ndarray,
    wanted: list[list[Best]],
    same: bool,
) -> int:
    """Offer each anchor's windows the tile's rows of its own label (``same``) or of other
    labels; ``own`` is the anchor's own place in the tile, or -1. Returns the number of
    scores computed."""
    order, up, edge = tree
    waiting = np.bincount(up[up >= 0], minlength=len(order))
    norms = np.sqrt(np.square(anchors.astype(float)).sum(1))
    longest = float(norms.max(initial=0))
    limit = longest * rows.longest
    exact = rows.wide if limit < 2.0**53 else rows.matrix
    if limit < 2.0**24:
        exact = exact.astype(np.float32)
    vectors = anchors.astype(exact.dtype)
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    everything = np.arange(len(rows.labels))
    scored = 0
    for node in order:
        above = up[node]
        if above < 0:
            least = products(exact, everything, vectors[node], limit).astype(float)
            most = least.copy()
            scored += len(everything)
        else:
            apart = rows.norms * (edge[node] + 1e-9 * longest)
            least, most = low[above] - apart, high[above] + apart
            waiting[above] -= 1
            if not waiting[above]:
                del low[above], high[above]
        fits = (rows.labels == labels[node]) == same
        if own[node] >= 0:
            fits[own[node]] = False
        need = np.zeros(len(fits), bool)
        for best in wanted[node]:
            inside = fits & (most >= best.low) & (least <= best.high)
            sure = least[inside & (least >= best.low) & (most <= best.high)]
            enough = best.least()
            if len(sure) >= best.most:
                enough = max(enough, np.partition(sure, -best.most)[-best.most])
            need |= inside & (most >= enough)
        of = np.flatnonzero(need)
        scores = products(exact, of, vectors[node], limit)
        scored += len(of)
        for best in wanted[node]:
            best.offer(scores, rows.ids[of], rows.null[of])
        if waiting[node]:
            least[of] = most[of] = scores
            low[node], high[node] = least, most
    return scored


def _tiles(rows: DataFrame, count: int, size: int, width: int) -> DataFrame:
    """Rows ``tile, ids, labels, matrix``, dealt evenly whatever their ids and values."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, piece in gathered(batches, size):
            yield pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([tile]),
                    "ids": listed(piece.column(0)),
                    "labels": listed(piece.column(1)),
                    "matrix": pa.array([dense(piece.column(2), width).tobytes()]),
                }
            )

    tiles = rows.repartition(count).mapInArrow(
        packed, "tile bigint, ids array<bigint>, labels array<bigint>, matrix binary"
    )
    return materialize(tiles, "tiles")


def _blocks(tiles: DataFrame, width: int, every: int, size: int) -> DataFrame:
    """Anchors in blocks, each with its spanning tree. Anchors on the same side of fixed
    random planes come together, so that edges are short."""
    planes = np.random.default_rng(0).standard_normal((width, _PLANES))

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, ids, labels, matrix in zip(*batch.columns):
                given, null = ids_of(ids.values)
                at = np.flatnonzero((given % every == 0) & ~null)
                points = np.frombuffer(matrix.as_buffer(), np.int32).reshape(len(given), width)
                sides = (points[at] @ planes > 0) @ (1 << np.arange(_PLANES))
                yield pa.RecordBatch.from_pydict(
                    {
                        "home": pa.array(np.full(len(at), tile.as_py())),
                        "at": pa.array(at, pa.int64()),
                        "id": pa.array(given[at]),
                        "label": labels.values.take(pa.array(at)),
                        "side": pa.array(sides.astype(np.int64)),
                        "vector": vector_array(points[at]),
                    }
                )

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in gathered(batches, size):
            points = dense(piece.column(5), width)
            order, up, edge = spanning_tree(points.astype(float))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number]),
                    "homes": listed(piece.column(0)),
                    "places": listed(piece.column(1)),
                    "anchors": listed(piece.column(2)),
                    "anchor_labels": listed(piece.column(3)),
                    "vectors": pa.array([points.tobytes()]),
                    "joined": listed(pa.array(order, pa.int64())),
                    "up": listed(pa.array(up, pa.int64())),
                    "edge": listed(pa.array(edge)),
                }
            )

    anchors = materialize(
        tiles.mapInArrow(
            chosen,
            "home bigint, at bigint, id bigint, label bigint, side bigint, vector array<int>",
        ),
        "anchors",
    )
    count = max(1, -(-anchors.count() // size))
    blocks = anchors.repartitionByRange(count, "side", "home", "at").sortWithinPartitions(
        "side", "home", "at"
    )
    return materialize(
        blocks.mapInArrow(
            packed,
            "block bigint, homes array<bigint>, places array<bigint>, anchors array<bigint>, "
            "anchor_labels array<bigint>, vectors binary, joined array<bigint>, "
            "up array<bigint>, edge array<double>",
        ),
        "anchor-blocks",
    )


class _Block:
    """A block of anchors in a task, with what it has found so far."""

    def __init__(self, row: dict, width: int, most: int) -> None:
        of = {
            name: row[name].values.to_numpy(zero_copy_only=False)
            for name in ("homes", "places", "anchors", "anchor_labels", "joined", "up", "edge")
        }
        self.number = row["block"].as_py()
        self.homes, self.places, self.ids = of["homes"], of["places"], of["anchors"]
        self.labels = of["anchor_labels"]
        self.tree = of["joined"], of["up"], of["edge"]
        self.points = np.frombuffer(row["vectors"].as_buffer(), np.int32)
        self.points = self.points.reshape(len(self.ids), width)
        self.same = "chosen" not in row
        self.wanted: list[list[Best]] = [[] for _ in self.ids]
        self.positives: list[list[dict]] = [[] for _ in self.ids]
        if self.same:
            whole = (-(1 << 62), 1 << 62)
            self.wanted = [[Best(whole, most)] for _ in self.ids]
            return
        for one in row["chosen"].as_py() or ():
            window = -(-LOWEST * one["score"] // 100), HIGHEST * one["score"] // 100
            self.wanted[one["slot"]].append(Best(window, most))
            self.positives[one["slot"]].append(one)

    def meet(self, row: dict) -> None:
        labels = row["labels"].values.to_numpy(zero_copy_only=False)
        matrix = np.frombuffer(row["matrix"].as_buffer(), np.int32)
        rows = Candidates(row["ids"].values, labels, matrix.reshape(len(labels), -1))
        own = np.where(self.homes == row["of_tile"].as_py(), self.places, -1)
        walk(self.tree, self.points, self.labels, rows, own, self.wanted, self.same)

    def found(self) -> pa.RecordBatch:
        each = [
            (slot, place, best)
            for slot, bests in enumerate(self.wanted)
            for place, best in enumerate(bests)
        ]
        counts = [len(best.scores) for _, _, best in each]
        none = np.zeros(0, np.int64)

        def per(values: list) -> pa.Array:
            return pa.array(np.repeat(np.array(values, np.int64), counts))

        columns = {
            "block": per([self.number] * len(each)),
            "slot": per([slot for slot, _, _ in each]),
        }
        if not self.same:
            given = [self.positives[slot][place] for slot, place, _ in each]
            columns["anchor_id"] = per([self.ids[slot] for slot, _, _ in each])
            columns["place"] = per([one["place"] for one in given])
            null = np.repeat([one["id"] is None for one in given], counts).astype(bool)
            columns["positive_id"] = id_array(
                np.repeat(np.array([one["id"] or 0 for one in given], np.int64), counts), null
            )
            columns["positive_score"] = per([one["score"] for one in given])
        ids = np.concatenate([none, *(best.ids for _, _, best in each)])
        null = np.concatenate([none, *(best.null for _, _, best in each)]).astype(bool)
        columns["id"] = id_array(ids, null)
        columns["score"] = pa.array(np.concatenate([none, *(b.scores for _, _, b in each)]))
        return pa.RecordBatch.from_pydict(columns)


def _search(blocks: DataFrame, tiles: DataFrame, count: int, width: int, most: int) -> DataFrame:
    """The best rows of every window of the blocks' anchors within each run of tiles."""

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                if block is None or row["block"].as_py() != block.number:
                    if block is not None:
                        yield block.found()
                    block = _Block(row, width, most)
                block.meet(row)
        if block is not None:
            yield block.found()

    second = "chosen" in blocks.columns
    between = "anchor_id bigint, place bigint, positive_id bigint, positive_score bigint, "
    schema = f"block bigint, slot bigint, {between if second else ''}id bigint, score bigint"
    return cells(blocks, tiles, count).drop("run").mapInArrow(searched, schema)


def _best(found: DataFrame, most: int, *key: str) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Components become
    ``floor(256 * x)``, and a score is the whole-number inner product with the anchor. For
    each of an anchor's ``positives`` best other rows of its label, the ``negatives`` best
    rows of other labels that score from 30 to 90 hundredths of it. Ties go to the smaller
    id, null ids last.

    All rows are candidates, whatever the tree leaves unscored: it leaves out only what
    surely lies outside a window or behind its best. Rows with a null label, a null vector
    or a null or non-finite component take no part, nor do vectors so long (a norm of 2^31
    after scaling) that a score might not fit a long. Shorter vectors end in zeros. Rows
    are told apart by their place, not by id: a copy of the anchor can be its positive,
    and copies of an anchor each have their rows. Negative positives open empty windows.
    An empty table gives an empty result. Other columns are ignored.
    """
    value = F.col(f"`{vector}`")
    usable = vectors.where(finite(value) & F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.transform(
            value.cast("array<double>"),
            lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(1e12)), F.lit(-1e12))),
        ).alias("vector"),
    )
    norm = F.aggregate(
        "vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    usable = usable.where(norm < 2.0**62)
    rows = materialize(
        usable.withColumn("vector", F.col("vector").cast("array<int>")), "whole-vectors"
    )
    known = shape(rows)
    count = known.tiles(tile)
    tiles = _tiles(rows, count, tile, known.width)
    blocks = _blocks(tiles, known.width, every, block)
    first = _search(blocks, tiles, count, known.width, positives)
    chosen = _best(first, positives, "block", "slot").groupBy("block").agg(
        F.collect_list(
            F.struct("slot", F.col("rank").cast("long").alias("place"), "id", "score")
        ).alias("chosen")
    )
    opened = materialize(blocks.join(chosen, "block"), "anchor-windows")
    second = _search(opened, tiles, count, known.width, negatives)
    return _best(second, negatives, "block", "slot", "place").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
