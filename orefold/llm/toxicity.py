"""Toxicity by compression distance between two trained zstandard dictionaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.llm.common import bounded_sample, remainder_of_id, text_array, text_slices
from orefold.session import materialize

WINDOW = 16
"""Words in a window."""
_HEAD = 4
_GRAM = 6
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")
_BLOCK = 1 << 20
_CACHED = 300_000
_PARAMETERS = {
    "window_log": 17,
    "chain_log": 16,
    "hash_log": 16,
    "search_log": 4,
    "min_match": 4,
    "target_length": 32,
    "strategy": zstandard.STRATEGY_LAZY2,
}


@dataclass(frozen=True)
class Training:
    """The model is made from about ``rows_per_class`` labelled documents of each class,
    chosen by a hash of the id, whole texts each. A fifth of them only calibrates; of the
    rest at most about ``bytes_per_class`` of each class train the dictionaries, beyond
    which windows are drawn by a hash, evenly over all texts."""

    rows_per_class: int = 2000
    bytes_per_class: int = 32 << 20
    toxic_bytes: int = 8192
    ordinary_bytes: int = 32768
    rare_share: float = 0.002
    least_documents: int = 3
    least_log_odds: float = 1.5
    least_z: float = 3.5


class _Heads(dict):
    """Words as the dictionaries see them: the first letters upper case, so that the
    start of a word is never the same bytes as the middle of another."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHED:
            self.clear()
        coded = (word[:_HEAD].upper() + word[_HEAD:]).encode("utf-8", "replace")
        self[word] = coded
        return coded


def windows_of(text: str, heads: dict[str, bytes]) -> Iterator[bytes]:
    """The text's windows of ``WINDOW`` words, one blank one if it has none. Words are runs
    of letters, and of the few other numerals, such as ½, that are no decimal digits.

    The text is cut into words a block at a time, so a very long one needs little more
    memory than itself.
    """
    words: list[bytes] = []
    at, any_window = 0, False
    while at < len(text):
        end = at + _BLOCK
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        words += [heads[word] for word in _WORD.findall(text[at:end].lower())]
        at = end
        whole = len(words) - len(words) % WINDOW
        for start in range(0, whole, WINDOW):
            any_window = True
            yield b" " + b" ".join(words[start : start + WINDOW]) + b" "
        words = words[whole:]
    if words or not any_window:
        yield b" " + b" ".join(words) + b" "


@dataclass
class ToxicityModel:
    """An ordinary dictionary, and the toxic one that goes before it."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def __post_init__(self) -> None:
        self._heads = _Heads()
        self._coders = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_heads": _Heads(), "_coders": None}

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Of the bytes that the toxic dictionary saves on the text's windows: most, sum
        and mean, and the number of windows, as logarithms."""
        if self._coders is None:
            self._coders = _coder(self.toxic + self.ordinary), _coder(self.ordinary)
        toxic, ordinary = self._coders
        most = total = number = 0
        for window in windows_of(text, self._heads):
            saved = max(0, len(ordinary.compress(window)) - len(toxic.compress(window)))
            most, total, number = max(most, saved), total + saved, number + 1
        return tuple(np.log1p([most, total, total / number, number]))

    def scores(self, features: np.ndarray) -> np.ndarray:
        scaled = (features - self.mean) / self.spread
        logits = scaled @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
    made = zstandard.ZstdCompressionDict(
        content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    made.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=parameters)


def _trained(samples: set[bytes], size: int, segment: int) -> bytes:
    """A dictionary that the trainer of zstandard makes from distinct samples; where they
    are too few for it, the samples themselves."""
    ordered = sorted(samples)
    try:
        return zstandard.train_dictionary(size, ordered, k=segment, d=_GRAM).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ordered)[-size:]


def _found_in(documents: list[list[bytes]], grams: set[bytes]) -> Counter:
    """In how many documents each of the grams occurs."""
    counts: Counter = Counter()
    for document in documents:
        seen: set[bytes] = set()
        for window in document:
            seen |= grams.intersection(
                [window[i : i + _GRAM] for i in range(len(window) - _GRAM + 1)]
            )
        counts.update(seen)
    return counts


def _typical(
    content: bytes, toxic: list[list[bytes]], ordinary: list[list[bytes]], training: Training
) -> bytes:
    """The stretches of a dictionary that occur in toxic documents much more often than
    chance would have it, each once, in their order."""
    places = range(len(content) - _GRAM + 1)
    grams = {content[i : i + _GRAM] for i in places}
    theirs, others = _found_in(toxic, grams), _found_in(ordinary, grams)
    kept = np.zeros(len(content) + 2, np.int8)
    for i in places:
        count, other = theirs[content[i : i + _GRAM]], others[content[i : i + _GRAM]]
        if count < training.least_documents:
            continue
        cells = np.array([count, other, len(toxic) - count, len(ordinary) - other]) + 0.5
        odds = np.log(cells[0] / cells[2]) - np.log(cells[1] / cells[3])
        error = np.sqrt((1 / cells).sum())
        if odds > training.least_log_odds and odds / error > training.least_z:
            kept[i + 1 : i + 1 + _GRAM] = 1
    edges = np.flatnonzero(np.diff(kept))
    stretches = [content[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return b"".join(reversed(dict.fromkeys(reversed(stretches))))


def dictionaries(
    toxic: list[list[bytes]], ordinary: list[list[bytes]], training: Training
) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of documents given by their windows.

    The ordinary one is trained on ordinary windows. The toxic one is trained on the
    words of toxic windows that ordinary documents hardly hold, and loses the stretches
    that are no more frequent in toxic documents than in ordinary ones: what both kinds
    of text share would only add noise to the difference in length.
    """
    words: Counter = Counter()
    for document in ordinary:
        words.update({word for window in document for word in window.split()})
    few = training.rare_share * len(ordinary)
    own = set()
    for document in toxic:
        for window in document:
            rare = [word for word in window.split() if words[word] <= few]
            if rare:
                own.add(b" " + b" ".join(rare) + b" ")
    base = _trained({w for d in ordinary for w in d}, training.ordinary_bytes, 32)
    trained = _trained({w for w in own if len(w) > _GRAM}, training.toxic_bytes, 16)
    return _typical(trained, toxic, ordinary, training), base


def logistic(
    x: np.ndarray, y: np.ndarray, share: np.ndarray | float = 1.0, ridge: float = 1.0
) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps.
    ``share`` is how much each row counts."""
    rows = np.concatenate([x, np.ones((len(x), 1))], 1)
    weights = np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (share * (p - y)) + penalty * weights
        bend = (rows * (share * p * (1 - p))[:, None]).T @ rows + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def calibrate(model: ToxicityModel, x: np.ndarray, y: np.ndarray, counts: dict) -> None:
    """Fit the weights of the model to features and labels of sampled documents, where
    each class counts as much as its share of all labelled documents."""
    share = np.array([counts[int(one)] / (y == one).sum() for one in y])
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    scaled = (x - model.mean) / model.spread
    model.weights = logistic(scaled, y, share * len(y) / share.sum())


def train(
    documents: DataFrame, labels: DataFrame, training: Training, doc_id: str, text: str,
    label: str,
) -> ToxicityModel | None:
    """Fit on a bounded sample of documents, which is written once. Tasks cut the whole
    texts and compute the features; bounded windows and four numbers for each calibrating
    document are collected."""
    known = labels.select(
        F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")
    ).where(
        F.col("__id").isNotNull()
        & F.col("__label").isin(0, 1)
        & (remainder_of_id(F.col("__id"), 4) != 2)
    )
    known = known.distinct()
    counts = {row[0]: row[1] for row in known.groupBy("__label").count().collect()}
    sample = bounded_sample(known, "__id", "__label", training.rows_per_class)
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text")
    )
    calibrating = F.pmod(F.xxhash64(F.lit("held"), F.col("__id").cast("string")), F.lit(5)) == 0
    chosen = materialize(
        rows.join(F.broadcast(sample), "__id").select(
            F.col("__label"), calibrating.alias("__held"), F.col("__text")
        ),
        "toxic-sample",
    )
    sizes = {
        (row["__label"], row["__held"]): (row["n"], row["bytes"])
        for row in chosen.groupBy("__label", "__held")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)).alias("bytes"),
        )
        .collect()
    }
    if any((one, False) not in sizes for one in (0, 1)):
        return None
    shares = {
        one: min(1.0, training.bytes_per_class / max(1, sizes[one, False][1])) for one in (0, 1)
    }

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _Heads()
        for batch in text_slices(batches, "__text"):
            found = []
            for value, one in zip(text_array(batch, "__text"), batch.column(0).to_pylist()):
                most = int(shares[one] * (1 << 64))
                found.append(
                    [
                        window
                        for window in windows_of(value.as_py(), heads)
                        if xxhash.xxh64_intdigest(window) < most
                    ]
                )
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column(0), "windows": pa.array(found, pa.list_(pa.binary()))}
            )

    collected = (
        chosen.where("not __held")
        .select("__label", "__text")
        .mapInArrow(cut, "label int, windows array<binary>")
        .collect()
    )
    documents_of: dict[int, set] = {0: set(), 1: set()}
    for one, windows in collected:
        documents_of[one].add(tuple(bytes(window) for window in windows))
    toxic, ordinary = dictionaries(
        *([list(d) for d in sorted(documents_of[one])] for one in (1, 0)), training
    )
    model = ToxicityModel(toxic, ordinary, np.zeros(5), np.zeros(4), np.ones(4))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_model = model
        for batch in text_slices(batches, "__text"):
            found = [
                known_model.features(value.as_py()) for value in text_array(batch, "__text")
            ]
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column(0), "x": pa.array(found, pa.list_(pa.float64()))}
            )

    both = all((one, True) in sizes for one in (0, 1))
    held = chosen.where("__held") if both else chosen
    features = sorted(
        (row["label"], row["x"])
        for row in held.select("__label", "__text")
        .mapInArrow(measured, "label int, x array<double>")
        .collect()
    )
    x = np.array([row[1] for row in features])
    calibrate(model, x, np.array([row[0] for row in features], float), counts)
    return model


def detect(
    documents: DataFrame,
    labels: DataFrame,
    training: Training = Training(),
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted, max_saved``.

    A text's windows of words are compressed with an ordinary dictionary, and with a
    toxic one before it, both trained on text. The bytes that the toxic one saves (most,
    in all, and on average) are calibrated to a probability, where each class counts as
    much as among all labelled documents. Learnt from labelled documents whose id leaves
    no remainder 2 (``held_out`` is the rest); only the text is scored. ``predicted`` is
    1 at a score of ``threshold`` or more, ties included.

    Null and empty texts save nothing and get the score of that. Very long texts are
    scored whole, a block at a time. Without both labels to learn from all scores are 0.
    Null ids stay null; repeated rows each give a row and count once in the dictionaries;
    an empty table gives an empty result. Columns that are not named are not read.
    """
    model = train(documents, labels, training, doc_id, text, label)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model
        for batch in text_slices(batches, "__text"):
            scores, saved = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if known is not None:
                features = np.array(
                    [known.features(value.as_py()) for value in text_array(batch, "__text")]
                )
                scores, saved = known.scores(features), np.expm1(features[:, 0])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    "score": pa.array(scores),
                    "predicted": pa.array((scores >= threshold).astype(np.int32)),
                    "max_saved": pa.array(np.rint(saved).astype(np.int64)),
                }
            )

    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (remainder_of_id(F.col(f"`{doc_id}`"), 4) == 2).alias("held_out"),
        F.col(f"`{text}`").alias("__text"),
    )
    return rows.mapInArrow(
        scored,
        "doc_id bigint, held_out boolean, score double, predicted int, max_saved bigint",
    )
