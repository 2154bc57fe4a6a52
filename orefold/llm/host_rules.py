"""Quality rules judged per host.

Every document is measured against a few rules. Failures are added up per host, the
host's failure rate is shrunk towards the corpus by an empirical beta prior, and the
host's verdict goes back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.llm.common import packed, text_array, text_slices
from orefold.session import materialize

SYMBOLS = b"#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WHITE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules.

    A document fails if it has fewer than ``min_words`` words or more than
    ``max_repeat_percent`` of them in repeated three-word windows (the base rules), or,
    for the host's record only, more than ``max_symbol_percent`` symbols per word
    character or ``max_dup_line_percent`` repeated lines per ten words.

    A host is rejected if its shrunk failure rate is above ``least_host_rate`` and its
    odds of failure are more than ``host_odds`` times those of the average host. The
    prior is worth at most ``most_prior`` documents, so what a host needs of its own to
    be judged by it does not depend on the size of the corpus.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    host_odds: float = 4.0
    least_host_rate: float = 0.3
    least_prior: float = 2.0
    most_prior: float = 50.0


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The five base metrics of one text; words are runs of bytes that are not ASCII
    white space. The empty text has none of anything."""
    words = text.split()
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, _WHITE + _CONTINUATION))
    lines = [line for line in text.split(b"\n") if line.strip(_WHITE)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        reach = -1
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeated += at + 2 - max(reach, at - 1)
                reach = at + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def with_metrics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the five metrics of ``text`` as ``__n_words`` and so on. ``text`` is
    a column, which is left out of the result, or a field of a struct, which stays."""

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            found = [
                measure(value.as_buffer().to_pybytes()) for value in text_array(batch, text)
            ]
            columns = {
                name: batch.column(i) for i, name in enumerate(batch.schema.names) if name != text
            }
            for name, values in zip(METRICS, zip(*found)):
                columns[f"__{name}"] = pa.array(values, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType(
        [field for field in rows.schema if field.name != text]
        + [T.StructField(f"__{name}", T.LongType()) for name in METRICS]
    )
    return rows.mapInArrow(measured, schema)


def _failed(rules: HostRules) -> tuple[Column, Column]:
    n, chars = F.col("__n_words"), F.col("__word_chars")
    base = (n < rules.min_words) | (
        100 * F.col("__n_repeat_words") > rules.max_repeat_percent * n
    )
    noisy = (100 * F.col("__n_symbols") > rules.max_symbol_percent * chars) | (
        1000 * F.col("__n_dup_lines") > rules.max_dup_line_percent * n
    )
    return base, base | noisy


def host_verdicts(measured: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, and whether it is rejected.

    ``measured`` has ``__host`` and the metric columns. The prior is fitted over hosts,
    each counting once: its mean is their average rate, its strength comes from the
    variance of their rates beyond what sampling explains. Counts combine before the
    shuffle, so a host with most rows is no burden.
    """
    _, failed = _failed(rules)
    hosts = measured.groupBy("__host").agg(
        F.count("*").alias("__docs"), F.sum(failed.cast("long")).alias("__failures")
    )
    hosts = materialize(hosts, "hosts")
    rate = F.col("__failures") / F.col("__docs")
    over = hosts.agg(
        F.avg(rate).alias("rate"),
        F.avg(rate * rate).alias("square"),
        F.avg(1 / F.col("__docs")).alias("inverse"),
    ).first()
    mean = over["rate"] or 0.0
    within = mean * (1 - mean)
    between = (over["square"] or 0.0) - mean * mean - within * (over["inverse"] or 0.0)
    strength = within / between - 1 if between > 0 else rules.most_prior
    strength = min(max(strength, rules.least_prior), rules.most_prior)
    shrunk = (F.col("__failures") + mean * strength) / (F.col("__docs") + strength)
    relative = rules.host_odds * mean / (1 + (rules.host_odds - 1) * mean)
    return hosts.select(
        "__host",
        "__docs",
        "__failures",
        shrunk.alias("__host_rate"),
        (shrunk > max(rules.least_host_rate, relative)).alias("__host_rejected"),
    )


def judge(
    documents: DataFrame,
    rules: HostRules = HostRules(),
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """One row per document: its id, host, metrics, ``base_failed``, the host's shrunk
    rate (6 decimals) and ``kept``.

    Null text counts as empty and fails the base rules. Null hosts are one host; null
    ids stay null. Repeated rows are measured and counted each. An empty table gives an
    empty result. Columns that are not named here are not read, whatever their names.
    """
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("__id"),
        F.col(f"`{host}`").alias("__host"),
        F.col(f"`{text}`").alias("__text"),
    )
    measured = materialize(with_metrics(rows, "__text"), "rule-metrics")
    base, _ = _failed(rules)
    joined = measured.alias("d").join(
        host_verdicts(measured, rules).alias("h"),
        F.col("d.__host").eqNullSafe(F.col("h.__host")),
        "left",
    )
    return joined.select(
        F.col("__id").alias("doc_id"),
        F.col("d.__host").alias("host"),
        *(F.col(f"__{name}").alias(name) for name in METRICS),
        base.alias("base_failed"),
        F.round("__host_rate", 6).alias("host_rate"),
        (~base & ~F.col("__host_rejected")).alias("kept"),
    )


def keep_documents(
    documents: DataFrame,
    rules: HostRules = HostRules(),
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """The documents, with all their columns, that pass the base rules and whose host
    is not rejected.

    The texts are measured twice, once for the hosts and once beside the rows they
    belong to, so that no text is shuffled. Defined results as in :func:`judge`.
    """
    narrow = documents.select(
        F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__text")
    )
    verdicts = host_verdicts(
        materialize(with_metrics(narrow, "__text"), "rule-metrics"), rules
    )
    base, _ = _failed(rules)
    rejected = verdicts.where("__host_rejected").select(F.col("__host").alias("__bad"))
    rows = packed(documents, __host=F.col(f"`{host}`"))
    passed = with_metrics(rows, f"row.{text}").where(~base)
    kept = passed.join(rejected, F.col("__host").eqNullSafe(F.col("__bad")), "left_anti")
    return kept.select("row.*")
