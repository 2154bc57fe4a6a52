"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import (
    bounded_sample,
    buffer_of,
    remainder_of_id,
    text_array,
    text_slices,
)
from orefold.llm.toxicity import logistic

_SLICE = 2 << 20
_BINS = 6
FEATURES = (
    "length upper digit symbol pipe bang space non_ascii word_length same_as_last "
    "same_as_last_but_one ends_sentence starts_upper seen_before"
).split()


@dataclass(frozen=True)
class Training:
    """The field is fitted on about ``rows_per_class`` labelled documents of each class,
    chosen by a hash of the id, of each of which at most ``lines_per_document`` lines,
    from its start and its end, are used. A third of them only calibrates."""

    rows_per_class: int = 2000
    lines_per_document: int = 64
    epochs: int = 60
    rate: float = 0.05
    ridge: float = 1e-3


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(characters)] = 1
    return table


_WHITE = _class(b" \t\n\x0b\x0c\r")
_CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "digit": _class(b"0123456789"),
    "symbol": _class(b"#*$%&@^~=+<>_{}[]\\/`"),
    "pipe": _class(b"|"),
    "bang": _class(b"!"),
    "space": _class(b" \t\r\x0b\x0c"),
    "non_ascii": _class(bytes(range(128, 256))),
}
_SENTENCE_END = _class(b".!?:;")
_POWER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lines:
    """Lines of some texts: features, byte lengths, and the text each belongs to."""

    features: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and a hash of its bytes."""
    inside = _WHITE[data] == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    spans = np.diff(np.concatenate([[0], starts, [len(data)]]))
    place = np.arange(len(data), dtype=np.uint64)
    place -= np.repeat(np.concatenate([[0], starts]).astype(np.uint64), spans)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * (place * _POWER + np.uint64(0x51ED27))
    mixed ^= mixed >> np.uint64(29)
    mixed *= inside
    return starts, np.add.reduceat(mixed, starts)


def line_features(texts: pa.Array) -> Lines:
    """Lines that hold more than white space, with their features."""
    data, starts, ends = buffer_of(texts)
    if not len(data):
        return Lines(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Every line break and every start of a text starts a line; empty lines fall out.
    breaks = np.nonzero(data == 10)[0]
    line_starts = np.union1d(starts[ends > starts], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_stops = np.append(line_starts[1:], len(data))
    last = data[line_stops - 1] == 10
    line_stops = line_stops - last
    words, hashes = _word_hashes(data)
    first_word = np.searchsorted(words, line_starts)
    counts = np.searchsorted(words, line_stops) - first_word
    used = counts > 0
    line_starts, line_stops = line_starts[used], line_stops[used]
    first_word, counts = first_word[used], counts[used]
    if not len(line_starts):
        return Lines(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lengths = line_stops - line_starts
    owner = np.searchsorted(starts, line_starts, "right") - 1

    def totals(per_byte: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_byte, line_starts, dtype=np.int64)

    columns = {name: totals(table[data]) / lengths for name, table in _CLASSES.items()}
    columns["length"] = np.log1p(lengths)
    columns["word_length"] = np.log1p(lengths / counts)
    line_of_word = np.repeat(np.arange(len(line_starts)), counts)
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(first_word, counts)])
    for lag, name in ((1, "same_as_last"), (2, "same_as_last_but_one")):
        same = np.zeros(len(at), bool)
        same[lag:] = (hashes[at[lag:]] == hashes[at[:-lag]]) & (
            line_of_word[lag:] == line_of_word[:-lag]
        )
        columns[name] = np.bincount(line_of_word, same, len(line_starts)) / counts
    columns["ends_sentence"] = _SENTENCE_END[data[line_stops - 1]].astype(float)
    columns["starts_upper"] = _CLASSES["upper"][data[line_starts]].astype(float)
    turn = np.arange(1, len(at) + 1, dtype=np.uint64) - np.repeat(
        np.cumsum(counts) - counts, counts
    ).astype(np.uint64)
    whole = np.add.reduceat(
        hashes[at] * (turn * _POWER | np.uint64(1)), np.cumsum(counts) - counts
    )
    order = np.lexsort((np.arange(len(whole)), whole, owner))
    again = np.zeros(len(whole))
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (
        owner[order[1:]] == owner[order[:-1]]
    )
    columns["seen_before"] = again
    return Lines(np.stack([columns[name] for name in FEATURES], 1), lengths, owner)


@dataclass
class QualityModel:
    """Weights of binned features of a line and its neighbours, transitions between bad
    (0) and good (1) lines, and the calibration of the document's mean."""

    edges: list[np.ndarray]
    weights: np.ndarray
    moves: np.ndarray
    calibration: np.ndarray
    prior: float

    def bins(self, features: np.ndarray) -> np.ndarray:
        """The weight row of each feature of each line."""
        return np.stack(
            [
                np.searchsorted(edge, features[:, i], "right") + i * _BINS
                for i, edge in enumerate(self.edges)
            ],
            1,
        )

    def emissions(self, bins: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Log odds of good from the features of the line, the line before and after."""
        total = self.weights[0][bins].sum(1)
        before, after = neighbours(owner)
        total[before] += self.weights[1][bins[before - 1]].sum(1)
        total[after] += self.weights[2][bins[after + 1]].sum(1)
        return total

    def scores(self, lines: Lines, texts: int) -> np.ndarray:
        """Calibrated quality of each text; a text without lines gets the prior."""
        found = np.full(texts, self.prior)
        if len(lines.owner):
            emitted = self.emissions(self.bins(lines.features), lines.owner)
            good, _ = marginals(emitted, lines.owner, self.moves)
            x = document_features(good, emitted, lines)
            logits = x @ self.calibration[:-1] + self.calibration[-1]
            found[np.unique(lines.owner)] = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        return found


def neighbours(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that have a line before them, and lines that have one after them."""
    same = owner[1:] == owner[:-1]
    return np.nonzero(same)[0] + 1, np.nonzero(same)[0]


def marginals(
    emitted: np.ndarray, owner: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and for each line that has one before it the
    probabilities of the labels of both, by forward-backward over all texts at once.

    Texts are taken longest first, so the texts that still have a line at a given place
    are always the first ones.
    """
    starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
    sizes = np.diff(np.append(starts, len(owner)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    forward = np.zeros((len(emitted), 2))
    backward = np.zeros((len(emitted), 2))
    node = np.stack([np.zeros(len(emitted)), emitted], 1)
    forward[starts] = node[starts]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    for t in range(1, longest):
        at = starts[: active[t]] + t
        last = forward[at - 1]
        forward[at] = node[at] + np.logaddexp(
            last[:, :1] + moves[0], last[:, 1:] + moves[1]
        )
        forward[at] -= forward[at].max(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = backward[at + 1] + node[at + 1]
        backward[at] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        backward[at] -= backward[at].max(1, keepdims=True)
    total = forward + backward
    good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -30, 30)))
    at, _ = neighbours(owner)
    joint = forward[at - 1][:, :, None] + moves + (node + backward)[at][:, None, :]
    pairs = np.exp(joint - joint.max((1, 2), keepdims=True))
    return good, pairs / pairs.sum((1, 2), keepdims=True)


def document_features(good: np.ndarray, emitted: np.ndarray, lines: Lines) -> np.ndarray:
    """Per text with lines: log odds of the length-weighted mean marginal, and the
    length-weighted mean of the lines' own log odds, which orders saturated texts."""
    _, index = np.unique(lines.owner, return_inverse=True)
    weight = np.bincount(index, lines.lengths)
    mean = np.clip(np.bincount(index, lines.lengths * good) / weight, 1e-4, 1 - 1e-4)
    own = np.bincount(index, lines.lengths * np.clip(emitted, -8, 8)) / weight
    return np.stack([np.log(mean / (1 - mean)), own], 1)


def fit(lines: Lines, labels: np.ndarray, held: np.ndarray, training: Training) -> QualityModel:
    """Maximise the likelihood of lines that all carry their document's label.

    The gradient of the field's log likelihood is the labels' indicators less the
    marginals of lines and of pairs of lines.
    """
    edges = []
    for i in range(len(FEATURES)):
        values = lines.features[:, i]
        positive = values[values > 0]
        cuts = np.quantile(positive, [0.0, 0.25, 0.5, 0.75, 0.95]) if len(positive) else []
        edges.append(np.unique(np.asarray(cuts, float)))
    prior = float(labels.mean()) if len(labels) else 0.5
    model = QualityModel(
        edges,
        np.zeros((3, len(FEATURES) * _BINS)),
        np.zeros((2, 2)),
        np.array([1.0, 0.0, 0.0]),
        prior,
    )
    learned = ~held[lines.owner] if (~held).any() else np.ones(len(lines.owner), bool)
    bins, owner = model.bins(lines.features)[learned], lines.owner[learned]
    if len(owner):
        _ascend(model, bins, owner, labels, training)
    emitted = model.emissions(model.bins(lines.features), lines.owner)
    x = np.zeros((0, 2))
    if len(emitted):
        good, _ = marginals(emitted, lines.owner, model.moves)
        x = document_features(good, emitted, lines)
    texts = np.unique(lines.owner)
    chosen = held[texts] if len(np.unique(labels[texts[held[texts]]])) == 2 else slice(None)
    if len(texts) and len(np.unique(labels)) == 2:
        model.calibration = logistic(x[chosen], labels[texts][chosen].astype(float))
    return model


def _ascend(
    model: QualityModel, bins: np.ndarray, owner: np.ndarray, labels: np.ndarray,
    training: Training,
) -> None:
    """Adam steps on the full sample; each document weighs the same per line class."""
    truth = labels[owner].astype(float)
    _, index, sizes = np.unique(owner, return_inverse=True, return_counts=True)
    balance = np.where(truth > 0, 1 / max(truth.sum(), 1), 1 / max((1 - truth).sum(), 1))
    weight = balance * len(owner) / 2
    before, after = neighbours(owner)
    size = model.weights.size + 4
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, training.epochs + 1):
        good, pairs = marginals(model.emissions(bins, owner), owner, model.moves)
        error = (truth - good) * weight
        slope = np.zeros_like(model.weights)
        for i in range(bins.shape[1]):
            slope[0] += np.bincount(bins[:, i], error, slope.shape[1])
            slope[1] += np.bincount(bins[before - 1, i], error[before], slope.shape[1])
            slope[2] += np.bincount(bins[after + 1, i], error[after], slope.shape[1])
        seen = np.zeros((len(before), 2, 2))
        is_good = truth[before].astype(int)
        seen[np.arange(len(before)), is_good, is_good] = 1
        moves = ((seen - pairs) * weight[before][:, None, None]).sum(0)
        gradient = np.concatenate([slope.ravel(), moves.ravel()]) / len(owner)
        values = np.concatenate([model.weights.ravel(), model.moves.ravel()])
        gradient -= training.ridge * values
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        values += (
            training.rate
            * (first / (1 - 0.9**step))
            / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        )
        model.weights = values[:-4].reshape(model.weights.shape)
        model.moves = values[-4:].reshape(2, 2)


def _excerpt(text: str, most: int) -> str:
    lines = [line for line in text.split("\n") if line.strip()]
    return "\n".join(lines if len(lines) <= most else lines[: most // 2] + lines[-most // 2 :])


def train(
    documents: DataFrame, labels: DataFrame, training: Training, doc_id: str, text: str,
    label: str,
) -> QualityModel | None:
    """Fit on a bounded sample; features of bounded excerpts come to the driver."""
    known = labels.select(
        F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")
    ).where(
        F.col("__id").isNotNull()
        & F.col("__label").isin(0, 1)
        & (remainder_of_id(F.col("__id"), 3) != 1)
    )
    sample = bounded_sample(known.distinct(), "__id", "__label", training.rows_per_class)
    most = training.lines_per_document

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text", _SLICE):
            texts = [_excerpt(x, most) for x in text_array(batch, "__text").to_pylist()]
            lines = line_features(pa.array(texts, pa.string()))
            bounds = np.searchsorted(lines.owner, np.arange(len(texts) + 1))
            spans = list(zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([str(x) for x in batch.column(0).to_pylist()]),
                    "label": batch.column(1),
                    "features": pa.array([lines.features[a:b].tobytes() for a, b in spans]),
                    "lengths": pa.array([lines.lengths[a:b].tobytes() for a, b in spans]),
                }
            )

    rows = documents.select(
        F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text")
    )
    collected = (
        rows.join(F.broadcast(sample), "__id")
        .select("__id", "__label", "__text")
        .mapInArrow(measured, "id string, label int, features binary, lengths binary")
        .withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(3)) == 0)
        .collect()
    )
    if len({row["label"] for row in collected}) < 2:
        return None
    collected.sort(key=lambda row: (row["id"], row["label"], row["features"]))
    parts = [np.frombuffer(row["features"]).reshape(-1, len(FEATURES)) for row in collected]
    lines = Lines(
        np.concatenate(parts),
        np.concatenate([np.frombuffer(row["lengths"], np.int64) for row in collected]),
        np.repeat(np.arange(len(parts)), [len(part) for part in parts]),
    )
    return fit(
        lines,
        np.array([row["label"] for row in collected]),
        np.array([row["held"] for row in collected]),
        training,
    )


def classify(
    documents: DataFrame,
    labels: DataFrame,
    training: Training = Training(),
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted, n_lines``.

    Every line with a word is labelled good or bad by a linear-chain field whose features
    are those of the line, the one before and the one after. The marginals, weighted by
    length, make the document's score, calibrated to a probability. Learnt from labelled
    documents whose id leaves no remainder 1 (``held_out`` is the rest); only the text is
    scored. ``predicted`` is 1 at a score of 0.5 or more.

    Null, empty and blank texts get the share of good documents in the sample. Without
    both labels to learn from all scores are 0.5. Null ids stay null; repeated rows each
    give a row; an empty table gives an empty result.
    """
    model = train(documents, labels, training, doc_id, text, label)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model
        for batch in text_slices(batches, "__text", _SLICE):
            lines = line_features(text_array(batch, "__text"))
            scores = np.full(batch.num_rows, 0.5)
            if known is not None:
                scores = known.scores(lines, batch.num_rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "score": pa.array(scores),
                    "predicted": pa.array((scores >= 0.5).astype(np.int32)),
                    "n_lines": pa.array(np.bincount(lines.owner, minlength=batch.num_rows)),
                }
            )

    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (remainder_of_id(F.col(f"`{doc_id}`"), 3) == 1).alias("held_out"),
        F.col(f"`{text}`").alias("__text"),
    )
    return rows.mapInArrow(
        scored,
        "doc_id bigint, held_out boolean, score double, predicted int, n_lines bigint",
    )
