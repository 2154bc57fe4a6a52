"""Mixing sources to target weights by temperature, realised as block permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefold.session import materialize

COLUMNS = ("mix_tokens", "mix_weight", "mix_epoch", "mix_place", "mix_order")
_SECTIONS = 32
_ROUNDS = 8


@dataclass(frozen=True)
class Mix:
    """What the mixture must meet.

    ``min_entropy`` is a share of the highest entropy possible, that of equal weights;
    ``max_repeats`` is how often a document of the scarcest source may be used for each
    use of one of the most plentiful source. The exponent is the largest that meets the
    entropy, or a larger one if the repeats demand it. ``tokens`` is the budget; without
    one it is the smallest that uses every document at least once. ``blocks`` is the
    number of blocks of a source: the budget is met to within one block of it.
    """

    min_entropy: float | None = 0.97
    max_repeats: float | None = 2.0
    tokens: int | None = None
    blocks: int = 256
    seed: int = 42


def count_words(text: Column) -> Column:
    """Words as runs of characters that are not ASCII white space; null has none."""
    counted = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(counted, F.lit(0)).cast("long")


def _bisect(met, low: float, high: float) -> float:
    """The place in [low, high] where a row of conditions turns from true to false.

    ``met`` answers for many places with one pass over the sources, so each round cuts
    the interval into many sections instead of two.
    """
    for _ in range(_ROUNDS):
        places = [low + (high - low) * k / _SECTIONS for k in range(_SECTIONS + 1)]
        answers = met(places)
        turn = next((k for k, answer in enumerate(answers) if not answer), None)
        if turn is None:
            return high
        if turn == 0:
            return low
        low, high = places[turn - 1], places[turn]
    return low


def exponent(shares: DataFrame, mix: Mix) -> float:
    """The exponent on the positive shares ``p``; 1 keeps them, 0 makes them equal."""
    p = F.col("p")
    bounds = shares.agg(F.min("p"), F.max("p"), F.count("*")).first()
    least, most, sources = bounds
    if not sources or least == most:
        return 1.0
    found = 0.0 if mix.min_entropy is not None or mix.max_repeats is not None else 1.0
    if mix.min_entropy is not None:
        target = F.log(F.lit(float(sources))) * mix.min_entropy

        def enough(places: list[float]) -> list[bool]:
            powers = [F.pow(p, F.lit(a)) for a in places]
            row = shares.agg(
                *(
                    (
                        F.log(F.sum(power)) - a * F.sum(power * F.log(p)) / F.sum(power)
                        >= target - 1e-12
                    )
                    for a, power in zip(places, powers)
                )
            ).first()
            return list(row)

        found = _bisect(enough, 0.0, 1.0)
    if mix.max_repeats is not None:
        ratio = most / least
        flat = _bisect(
            lambda places: [ratio ** (1 - a) > mix.max_repeats for a in places], 0.0, 1.0
        )
        found = max(found, flat)
    return found


def source_plan(sources: DataFrame, mix: Mix) -> DataFrame:
    """Rows ``source, tokens, share, weight, repeats`` from rows ``source, tokens``.

    Sources without tokens have weight zero and are used once.
    """
    total = sources.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    positive = shares.where("tokens > 0").withColumnRenamed("share", "p")
    alpha = exponent(positive, mix)
    norm, most = positive.agg(F.sum(F.pow("p", F.lit(alpha))), F.max("p")).first()
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(alpha)) / F.lit(norm or 1.0))
    if mix.tokens is None:
        repeats = F.pow(F.lit(most or 1.0) / F.col("share"), F.lit(1 - alpha))
    else:
        repeats = F.col("weight") * mix.tokens / F.col("tokens")
    return shares.withColumn("weight", F.coalesce(weight, F.lit(0.0))).withColumn(
        "repeats", F.when(F.col("tokens") > 0, repeats).otherwise(F.lit(1.0))
    )


def _schedule(blocks: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """Which blocks each epoch of a source uses, and in which order.

    A source has at most ``mix.blocks`` blocks, however large it is, so a permutation is
    a window over that many rows.
    """
    same = F.col("b.source").eqNullSafe(F.col("p.source"))
    rows = (
        blocks.alias("b")
        .join(plan.alias("p"), same)
        .select("b.source", "block", F.col("b.tokens").alias("tokens"), "weight", "repeats",
                F.col("p.tokens").alias("all_tokens"))
        .withColumn(
            "epoch",
            F.explode(
                F.sequence(
                    F.lit(0),
                    F.greatest(F.ceil(F.col("repeats") - 1e-9).cast("int") - 1, F.lit(0)),
                )
            ),
        )
    )
    shuffled = W.partitionBy("source", "epoch").orderBy(
        F.xxhash64(F.lit(mix.seed), "source", "epoch", "block"), "block"
    )
    before = F.sum("tokens").over(shuffled.rowsBetween(W.unboundedPreceding, -1))
    budget = F.least(F.col("repeats") - F.col("epoch"), F.lit(1.0)) * F.col("all_tokens")
    used = F.coalesce(before, F.lit(0)) < budget
    whole = F.col("repeats") - F.col("epoch") >= 1 - 1e-9
    return (
        rows.withColumn("place", F.row_number().over(shuffled) - 1)
        .withColumn("used", whole | used)
        .where("used")
        .select("source", "block", "epoch", "place", "weight")
    )


def mixed(
    documents: DataFrame,
    mix: Mix = Mix(),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """The mixture: a row for each use of a document.

    Columns: those of ``keep`` (the id and the source if not given), then ``mix_tokens``
    (its words), ``mix_weight`` (the source's weight), ``mix_epoch``, ``mix_place`` (the
    place of its block in that epoch's permutation of the source) and ``mix_order`` (a
    hash that orders documents within the block). Reading by epoch, place and order
    gives the shuffled corpus. A column of ``keep`` with one of these names is replaced.

    Null texts have no tokens; a null source is a source of its own; null ids and
    repeated rows are used like any other row. A source without any token is used once.
    An empty table gives an empty result. No row is dropped unless ``mix.tokens`` is too
    small for a whole epoch.
    """
    keep = [doc_id, source] if keep is None else keep
    keep = [name for name in keep if name not in COLUMNS]
    tokens = count_words(F.col(f"`{text}`"))
    block = F.pmod(
        F.xxhash64(F.lit(mix.seed), F.col(f"`{doc_id}`").cast("string")), F.lit(mix.blocks)
    ).cast("int")
    counted = documents.select(
        F.col(f"`{source}`").alias("source"), block.alias("block"), tokens.alias("n")
    )
    blocks = materialize(
        counted.groupBy("source", "block").agg(F.sum("n").alias("tokens")), "blocks"
    )
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plan = source_plan(materialize(sources, "sources"), mix)
    schedule = materialize(_schedule(blocks, plan, mix), "schedule")
    used = schedule.select(
        F.col("source").alias("__source"),
        F.col("block").alias("__block"),
        F.col("epoch").alias("mix_epoch"),
        F.col("place").alias("mix_place"),
        F.col("weight").alias("mix_weight"),
    )
    kept = F.struct(*(F.col(f"`{name}`") for name in keep))
    order = F.xxhash64(F.lit(mix.seed + 1), F.col(f"`{doc_id}`").cast("string"))
    rows = documents.select(
        kept.alias("row"),
        tokens.alias("mix_tokens"),
        order.alias("mix_order"),
        F.col(f"`{source}`").alias("__of"),
        block.alias("__in"),
    )
    same = F.col("__of").eqNullSafe(F.col("__source")) & (F.col("__in") == F.col("__block"))
    return rows.join(used, same).select(
        "row.*",
        "mix_tokens",
        F.round("mix_weight", 9).alias("mix_weight"),
        "mix_epoch",
        "mix_place",
        "mix_order",
    )
