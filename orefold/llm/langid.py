"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import bounded_sample, remainder_of_id, text_array, text_slices

UNDETERMINED = "und"
_LENGTHS = (2, 3, 4)
_MULTIPLIER = np.uint32(2654435761)
_SLICE = 1 << 20
#: Bytes that stand for themselves: a-z and those of non-ASCII characters.
_KEPT = np.array([32 if i < 128 and not 97 <= i <= 122 else i for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Training:
    """The classifier is fitted on about ``rows_per_language`` labelled documents of each
    language, chosen by a hash of the id; a fifth of them is kept for calibration."""

    rows_per_language: int = 400
    bucket_bits: int = 15
    dimensions: int = 16
    epochs: int = 12
    rate: float = 0.4
    accepted_accuracy: float = 0.99
    seed: int = 7


def has_letter(text: str) -> bool:
    """Whether a character is a letter; digits, fractions and numerals are not."""
    return any(map(str.isalpha, text))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts with single breaks, and where each text starts."""
    raw = [f" {text.lower()} ".encode("utf-8", "replace") for text in texts]
    bounds = np.concatenate([[0], np.cumsum([len(one) for one in raw])])
    data = _KEPT[np.frombuffer(b"".join(raw), np.uint8)]
    single = np.ones(len(data), bool)
    single[1:] = (data[1:] != 32) | (data[:-1] != 32)
    single[bounds[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(single)])
    return data[single], kept[bounds]


def subwords(
    texts: list[str], bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each subword length the bucket at every place, and each text's range of them."""
    data, bounds = _letters(texts)
    wide = data.astype(np.uint32)
    for k, length in enumerate(_LENGTHS):
        code = np.zeros(max(0, len(wide) - length + 1), np.uint32)
        for i in range(length):
            code |= wide[i : i + len(code)] << np.uint32(8 * i)
        bucket = (code * _MULTIPLIER) >> np.uint32(32 - bits)
        starts = np.minimum(bounds[:-1], len(code))
        yield bucket.astype(np.int64) + (k << bits), starts, np.maximum(
            starts, np.minimum(bounds[1:] - length + 1, len(code))
        )


def sums_of(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of the rows in each range; ranges are in order and do not overlap."""
    zero = np.zeros((1,) + values.shape[1:], np.float64)
    if not len(values):
        return np.repeat(zero, len(starts), 0)
    padded = np.concatenate([values, zero.astype(values.dtype)])
    edges = np.stack([starts, stops], 1).ravel()
    total = np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
    total[starts >= stops] = 0
    return total


@dataclass
class LanguageModel:
    """Scores of every bucket for every language: embeddings times softmax weights."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        totals = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        for buckets, starts, stops in subwords(texts, self.bits):
            totals += sums_of(self.scores[buckets], starts, stops)
            counts += stops - starts
        logits = totals / np.maximum(counts, 1)[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(-1, keepdims=True))
    return powers / powers.sum(-1, keepdims=True)


def fit(
    rows: list[tuple[str, np.ndarray, np.ndarray, bool]], training: Training
) -> LanguageModel | None:
    """Fit from rows of label, buckets, their shares of the text, and whether the row is
    for calibration only."""
    languages = sorted({label for label, _, _, _ in rows})
    if not languages:
        return None
    order = {label: i for i, label in enumerate(languages)}
    random = np.random.default_rng(training.seed)
    size = len(_LENGTHS) << training.bucket_bits
    embeddings = random.normal(0, 0.1, (size, training.dimensions)).astype(np.float32)
    weights = np.zeros((training.dimensions, len(languages)), np.float32)
    weights += random.normal(0, 0.1, weights.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    learned = [i for i, row in enumerate(rows) if not row[3]] or list(range(len(rows)))
    for epoch in range(training.epochs):
        rate = training.rate * (1 - epoch / training.epochs)
        for i in random.permutation(learned):
            label, buckets, shares, _ = rows[i]
            if not len(buckets):
                continue
            hidden = shares @ embeddings[buckets]
            error = softmax(hidden @ weights + bias)
            error[order[label]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # Buckets of a text have small shares: the step is scaled to the mean share.
            embeddings[buckets] -= np.outer(
                shares * (rate * min(64.0, len(buckets) ** 0.5)), back
            )
    scores = embeddings @ weights
    held = [row for row in rows if row[3] and len(row[1])] or [r for r in rows if len(r[1])]
    logits = np.array([shares @ scores[buckets] + bias for _, buckets, shares, _ in held])
    truth = np.array([order[label] for label, _, _, _ in held], int)
    temperature, threshold = calibrate(logits, truth, training.accepted_accuracy)
    return LanguageModel(
        languages, scores.astype(np.float32), bias, training.bucket_bits, temperature, threshold
    )


def calibrate(logits: np.ndarray, truth: np.ndarray, accuracy: float) -> tuple[float, float]:
    """The temperature of highest likelihood, and the lowest top probability above which
    the held rows are right often enough."""
    if not len(truth):
        return 1.0, 0.0
    rows = np.arange(len(truth))
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(logits / t)[rows, truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    found = softmax(logits / temperature)
    top, right = found.max(1), found.argmax(1) == truth
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.nonzero(good >= accuracy)[0]
    return temperature, float(top[order][enough[-1]]) if len(enough) else 1.0


def _examples(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their shares."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for buckets, starts, stops in subwords(texts, bits):
        for i, (a, b) in enumerate(zip(starts, stops)):
            parts[i].append(buckets[a:b])
    found = []
    for part in parts:
        buckets, counts = np.unique(np.concatenate(part), return_counts=True)
        found.append((buckets, (counts / max(1, counts.sum())).astype(np.float32)))
    return found


def train(
    documents: DataFrame, training: Training, doc_id: str, text: str, lang: str
) -> LanguageModel | None:
    """Fit on a bounded sample; its bucket shares, not its texts, come to the driver.

    Each document is an example as a whole and by its shortest line with letters, so
    that short texts are learnt too.
    """
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"),
        F.col(f"`{lang}`").alias("__label"),
    ).where(
        F.col("__label").isNotNull()
        & F.col("__text").isNotNull()
        & (remainder_of_id(F.col("__id"), 4) != 2)
    )
    bits = training.bucket_bits

    def examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text", _SLICE):
            texts = text_array(batch, "__text").to_pylist()
            lines = [
                min((x for x in text.split("\n") if has_letter(x)), key=len, default="")
                for text in texts
            ]
            labels = batch.column(1).to_pylist()
            held = batch.column(2).to_pylist()
            found = _examples(texts + lines, bits)
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array(labels * 2),
                    "held": pa.array(held * 2),
                    "buckets": pa.array([x.astype(np.int32).tobytes() for x, _ in found]),
                    "shares": pa.array([x.tobytes() for _, x in found]),
                }
            )

    ids = bounded_sample(rows.select("__id", "__label"), "__id", "__label",
                         training.rows_per_language)
    picked = rows.join(F.broadcast(ids.distinct()), ["__id", "__label"], "left_semi")
    calibrating = F.pmod(F.xxhash64(F.lit("held"), F.col("__id").cast("string")), F.lit(5)) == 0
    sample = (
        picked.select("__text", "__label", calibrating.alias("held"))
        .mapInArrow(examples, "label string, held boolean, buckets binary, shares binary")
        .collect()
    )
    decoded = [
        (
            row["label"],
            np.frombuffer(row["buckets"], np.int32),
            np.frombuffer(row["shares"], np.float32),
            row["held"],
        )
        for row in sample
    ]
    decoded.sort(key=lambda row: (row[0], len(row[1]), row[1].tobytes(), row[2].tobytes()))
    return fit(decoded, training)


def identify(
    documents: DataFrame,
    training: Training = Training(),
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Rows ``doc_id, held_out, lang_pred, score, rejected``.

    Learnt from documents whose id leaves no remainder 2 (``held_out`` is the rest); the
    label, the source and the id are not inputs of a prediction. ``score`` is the
    calibrated probability of the predicted language, and ``rejected`` says that it is
    below the threshold at which accepted calibration rows reach the wanted accuracy.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so
    is everything if there is nothing to learn from. Null ids stay null; repeated rows
    each give a row; an empty table gives an empty result.
    """
    model = train(documents, training, doc_id, text, lang)

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model
        for batch in text_slices(batches, "__text", _SLICE):
            texts = text_array(batch, "__text").to_pylist()
            names = [UNDETERMINED] * len(texts)
            scores = np.zeros(len(texts))
            rejected = np.ones(len(texts), bool)
            if known is not None:
                found = known.probabilities(texts)
                top = found.argmax(1)
                for i, one in enumerate(texts):
                    if has_letter(one):
                        names[i] = known.languages[top[i]]
                        scores[i] = found[i, top[i]]
                        rejected[i] = scores[i] < known.threshold
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "lang_pred": pa.array(names),
                    "score": pa.array(np.clip(scores, 0, 1)),
                    "rejected": pa.array(rejected),
                }
            )

    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (remainder_of_id(F.col(f"`{doc_id}`"), 4) == 2).alias("held_out"),
        F.col(f"`{text}`").alias("__text"),
    )
    return rows.mapInArrow(
        predicted,
        "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    )
