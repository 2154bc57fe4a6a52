"""Exact positions and percentiles that never gather a group in one task.

Both work the same way. The rows are range-partitioned by group and order, so a large
group spreads over many partitions. The sorted table is written once; small
per-partition totals then turn positions inside a partition into positions inside the
whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators.joins import join_by
from orefold.session import materialize

# monotonically_increasing_id() keeps the partition number above this many bits.
_ROW_BITS = 33


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """Add the 1-based position of every row inside its group.

    ``order`` should be total, so that the positions are determined.
    """
    kept = df.columns
    spread = df.orderBy(*V.cols(group), *order).withColumn("_row", F.monotonically_increasing_id())
    written = materialize(spread, "positions")
    part = F.shiftrightunsigned(F.col("_row"), _ROW_BITS)
    written = written.withColumn("_part", part)
    # One record per partition and group met there: partitions + groups in number.
    pieces = written.groupBy(*V.cols(group), "_part").agg(
        F.count("*").alias("_rows"), F.min("_row").alias("_first")
    )
    earlier = (
        Window.partitionBy(*V.cols(group))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    # Written, its true size is known to the planner: it is broadcast when small, and
    # joined by partition and group, both spread evenly, when it is not.
    pieces = materialize(pieces.select(*V.cols(group), "_part", "_first", "_before"), "pieces")
    joined = join_by(written, pieces, [*group, "_part"])
    position = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return joined.select(*V.cols(kept), position.alias(name))


_ACCURACY = 10_000
"""Sketches place a value to within one such part of a group."""
_MARGIN = 2.0 / _ACCURACY
"""How far a bracket reaches to either side of its percentile."""


def exact_percentiles(
    df: DataFrame,
    dimensions: Sequence[str],
    measures: Sequence[str],
    percentages: dict[str, float],
) -> DataFrame:
    """Linearly interpolated percentiles per group as ``<measure>_<label>`` columns.

    Nulls are left out; a group without any value gets no row. The result is exact at
    every size. A first pass sketches each group and takes a narrow bracket around each
    percentile. A second one counts exactly what lies below and within each bracket, and
    finds the values next to it, which settles the positions at its borders and brackets
    of one value. Only the values of brackets that are still open are then sorted, spread
    by range. A bracket that the counts show to be wrong becomes its whole group.
    """
    names = [*dimensions, "_measure"]
    keys = V.cols(names)
    cells = (
        df.select(*V.cols([*dimensions, *measures]))
        .unpivot(V.cols(dimensions), V.cols(measures), "_measure", "_value")
        .filter(F.col("_value").isNotNull())
    )
    brackets = materialize(_brackets(cells, names, percentages), "brackets")
    low, high = _settled(F.col("_low")), _settled(F.col("_high"))
    rated = brackets.withColumns({"_low_value": low, "_high_value": high})
    undecided = rated.filter(F.col("_low_value").isNull() | F.col("_high_value").isNull())
    if not undecided.isEmpty():
        found = _selected(cells, undecided, names)
        rated = join_by(rated, found, [*names, "_label"], "left").withColumns(
            {
                "_low_value": F.coalesce("_low_value", "_found_low"),
                "_high_value": F.coalesce("_high_value", "_found_high"),
            }
        )
    low_value, high_value, weight = F.col("_low_value"), F.col("_high_value"), F.col("_weight")
    # Between equal values, or at one exactly, nothing is interpolated: the difference of
    # infinities would be no number.
    exact = (weight == 0) | (low_value == high_value)
    between = low_value + (high_value - low_value) * weight
    value = F.when(exact, low_value).otherwise(between)
    results = [
        F.max(F.when((F.col("_measure") == m) & (F.col("_label") == label), value)).alias(
            f"{m}_{label}"
        )
        for m in measures
        for label in percentages
    ]
    groups = V.cols(dimensions)
    return rated.groupBy(*groups).agg(*results)


def _brackets(cells: DataFrame, names: Sequence[str], percentages: dict[str, float]) -> DataFrame:
    """For each group and percentile: the bracket ``_from`` to ``_to`` with ``_below`` and
    ``_within`` values, the nearest values outside, the wanted positions ``_low`` and
    ``_high``, and the ``_weight`` between them. A wrong bracket is null: all values."""
    keys = V.cols(names)
    marks = [
        min(1.0, max(0.0, mark))
        for p in percentages.values()
        for mark in (p - _MARGIN, p + _MARGIN)
    ]
    sketched = cells.groupBy(*keys).agg(
        F.count("*").alias("_total"),
        F.approx_percentile("_value", marks, _ACCURACY).alias("_marks"),
    )
    sketches = materialize(sketched, "sketches")
    joined = join_by(cells, sketches.drop("_total"), names)
    value, counts = F.col("_value"), []
    for i in range(len(percentages)):
        start, end = F.col("_marks")[2 * i], F.col("_marks")[2 * i + 1]
        counts += [
            F.count_if(value < start).alias(f"_below{i}"),
            F.count_if((value >= start) & (value <= end)).alias(f"_within{i}"),
            F.max(F.when(value < start, value)).alias(f"_before{i}"),
            F.min(F.when(value > end, value)).alias(f"_after{i}"),
        ]
    # Numbers only: an array among the results would make the aggregation sort every row.
    counted = join_by(joined.groupBy(*keys).agg(*counts), sketches, names)
    each = F.array(
        *[
            F.struct(
                F.lit(label).alias("_label"),
                F.lit(p).alias("_percentage"),
                F.col("_marks")[2 * i].alias("_from"),
                F.col("_marks")[2 * i + 1].alias("_to"),
                *[F.col(f"{n}{i}").alias(n) for n in ("_below", "_within", "_before", "_after")],
            )
            for i, (label, p) in enumerate(percentages.items())
        ]
    )
    listed = counted.select(*keys, "_total", F.explode(each).alias("_one")).select(
        *keys, "_total", "_one.*"
    )
    exact = (F.col("_total") - 1) * F.col("_percentage")
    placed = listed.withColumn("_low", F.floor(exact)).withColumns(
        {
            "_high": F.least(F.col("_low") + 1, F.col("_total") - 1),
            "_weight": exact - F.col("_low"),
        }
    )
    wrong = (
        (F.col("_from") > F.col("_to"))
        | (F.col("_low") < F.col("_below") - 1)
        | (F.col("_high") > F.col("_below") + F.col("_within"))
    )
    whole = {
        "_from": F.when(~wrong, F.col("_from")),
        "_to": F.when(~wrong, F.col("_to")),
        "_below": F.when(wrong, F.lit(0)).otherwise(F.col("_below")),
    }
    return placed.withColumn("_whole", wrong).withColumns(whole).drop("_percentage")


def _settled(position: Column) -> Column:
    """The value at a position, where the counts of its bracket already say it."""
    inside = (position >= F.col("_below")) & (position < F.col("_below") + F.col("_within"))
    return (
        F.when(F.col("_whole"), F.lit(None))
        .when(inside & (F.col("_from") == F.col("_to")), F.col("_from"))
        .when(position == F.col("_below") - 1, F.col("_before"))
        .when(position == F.col("_below") + F.col("_within"), F.col("_after"))
    )


def _selected(cells: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """The values at the wanted positions of open brackets, as ``_found_low`` and
    ``_found_high``. Equal values are combined first; the values of the brackets are spread
    by range, so one bracket can fill many partitions."""
    by = [*names, "_label"]
    keys = V.cols(by)
    open_ones = wanted.select(*keys, "_whole", "_from", "_to", "_below", "_low", "_high")
    value = F.col("_value")
    within = join_by(cells, open_ones.drop("_below", "_low", "_high"), names).filter(
        F.col("_whole") | ((value >= F.col("_from")) & (value <= F.col("_to")))
    )
    counts = within.groupBy(*keys, "_value").agg(F.count("*").alias("_copies"))
    ranged = counts.repartitionByRange(*keys, "_value")
    written = materialize(ranged.withColumn("_part", F.spark_partition_id()), "percentiles")

    # Per bracket at most one record per partition.
    pieces = written.groupBy(*keys, "_part").agg(F.sum("_copies").alias("_rows"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = pieces.withColumn("_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    pieces = join_by(pieces, open_ones.drop("_whole", "_from", "_to"), by)
    pieces = pieces.withColumn("_earlier", F.col("_earlier") + F.col("_below"))
    holds_one = reduce(
        lambda a, b: a | b,
        [
            (F.col("_earlier") <= position)
            & (position < F.col("_earlier") + F.col("_rows"))
            for position in (F.col("_low"), F.col("_high"))
        ],
    )
    pieces = materialize(pieces.filter(holds_one).drop("_rows", "_below"), "pieces")

    # Only the pieces that hold a wanted position are counted through, each one no
    # larger than a range partition.
    rows = join_by(written, pieces, [*by, "_part"])
    running = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_until", F.col("_earlier") + F.sum("_copies").over(running))

    def value_at(position: Column) -> Column:
        hit = (position < F.col("_until")) & (position >= F.col("_until") - F.col("_copies"))
        return F.max(F.when(hit, value))

    return rows.groupBy(*keys).agg(
        value_at(F.col("_low")).alias("_found_low"), value_at(F.col("_high")).alias("_found_high")
    )
