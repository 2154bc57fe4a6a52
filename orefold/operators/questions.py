"""Tables of questions: what each one asks for, and which values it mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.functions.columns import QUESTION_DIMENSIONS
from orefold.operators.stretches import (
    LONGEST_OWN,
    stretch_counts,
    stretches_in,
    window_filter,
    window_size,
)
from orefold.session import materialize

# Words that set the number of rows, tried in this order.
LIMIT_WORDS = (
    (3, ("top 3", "top three")),
    (5, ("top 5", "top five")),
    (10, ("top 10", "top ten")),
    (3, ("bottom 3", "bottom three")),
    (5, ("bottom 5", "bottom five")),
)
DEFAULT_LIMIT = 10
# Words that ask for the quantity; everything else is about the amount.
QUANTITY_WORDS = ("quantity", "volume", "units", "unit sold", "units sold")
# Words that set the kind of answer, tried in this order.
MODE_WORDS = (
    ("COMPARE", ("compare", "versus", " vs ", "difference between")),
    (
        "TIME_SERIES",
        ("trend", "over time", "monthly", "month by month", "latest period", "growth"),
    ),
    ("REASONING", ("why", "reason", "cause", "explain")),
    ("RANKING", ("top ", "bottom ", "highest", "lowest", "most", "least")),
)
DEFAULT_MODE = "BREAKDOWN"
# Words that ask for the smallest values, or for a series in any mode.
BOTTOM_WORDS = ("bottom", "lowest", "least")
SERIES_WORDS = ("monthly", "over time", "trend")
GROUPING_PHRASES = ("by {}", "per {}", "for each {}")
# Values of up to so many characters are linked to texts without a key, too.
STRETCH = 6
# A value's window is chosen among those at its first places.
_MOST_PLACES = 64
# Bytes of texts that are worked on, and windows that are handed on, at once.
_LONG_PIECE, _SHORT_PIECE = 1 << 16, 1 << 15


def _first_hit(text: Column, choices: Sequence[tuple], default: object) -> Column:
    chosen = None
    for result, words in choices:
        hit = V.contains_any(text, list(words))
        chosen = F.when(hit, result) if chosen is None else chosen.when(hit, result)
    return chosen.otherwise(default)


def question_intent(questions: DataFrame, column: str) -> DataFrame:
    """Add mode, metric, limit, direction and dimensions of every question.

    One projection of text searches; nothing is shuffled.
    """
    question = F.lower(V.strip(F.col(column)))
    asked = questions.withColumn("_q", F.coalesce(question, F.lit("")))
    q = F.col("_q")
    mentioned = F.array_compact(
        F.array(*[F.when(q.contains(d), d) for d in QUESTION_DIMENSIONS])
    )
    child = F.coalesce(
        *[
            F.when(V.contains_any(q, [p.format(d) for p in GROUPING_PHRASES]), d)
            for d in QUESTION_DIMENSIONS
        ]
    )
    asked = asked.withColumns(
        {
            "mode": _first_hit(q, MODE_WORDS, DEFAULT_MODE),
            "metric": F.when(V.contains_any(q, list(QUANTITY_WORDS)), "quantity").otherwise(
                "amount"
            ),
            "row_limit": _first_hit(q, LIMIT_WORDS, DEFAULT_LIMIT),
            "bottom": V.contains_any(q, list(BOTTOM_WORDS)),
            "wants_series": V.contains_any(q, list(SERIES_WORDS)),
            "mentions_location": q.contains("location"),
            "mentioned": mentioned,
            "child_dimension": child,
        }
    )
    parent = F.get(
        F.filter("mentioned", lambda d: ~d.eqNullSafe(F.col("child_dimension"))), 0
    )
    return asked.withColumn("parent_dimension", parent).drop("_q")


def _lookups(lookup: DataFrame) -> DataFrame:
    """The windows, as ``_stretch``, by which each value of a lookup can be found."""
    whole = F.col("_whole").cast("binary")
    length = F.octet_length("_whole")
    places = F.least(length - window_size(length) + 1, F.lit(_MOST_PLACES))
    cut = F.transform(
        F.sequence(F.lit(1), places), lambda at: F.substring(whole, at, window_size(length))
    )
    return lookup.select("_id", F.explode(F.array_distinct(cut)).alias("_stretch"))


def _mentions(questions: DataFrame, key: str, column: str, values: DataFrame) -> DataFrame:
    """The links of :func:`mentioned_values`, some of them more than once."""
    lookup = values.select("dimension", "value", F.lower("value").alias("_whole")).distinct()
    lookup = lookup.filter(F.length("_whole") > 0).withColumn(
        "_id", F.monotonically_increasing_id()
    )
    # Written once, as the values may come from a scan of a whole detail table; the ids
    # are those of the written rows.
    lookup = materialize(lookup, "values")
    offered = materialize(_lookups(lookup), "value-stretches")
    # As many sizes as there are kinds of windows, however many values there are.
    known = offered.groupBy(F.octet_length("_stretch").alias("size")).count().collect()
    sizes = sorted(row["size"] for row in known)
    asked = questions.select(F.col(key), F.lower(F.col(column)).alias("_text")).filter(
        F.length("_text") > 0
    )
    # Cutting takes far longer than reading, so texts are dealt out evenly first, however
    # few files they come from.
    spark = questions.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = asked.repartition(max(parts, spark.sparkContext.defaultParallelism))

    own = F.octet_length("_whole") <= LONGEST_OWN
    held, bits = window_filter(offered, "_stretch", sum(row["count"] for row in known))
    held, pieces = spark.sparkContext.broadcast(held), (_LONG_PIECE, _SHORT_PIECE)
    chosen = lookup.filter(own).withColumn("_stretch", F.col("_whole").cast("binary"))
    if sizes and sizes[-1] >= LONGEST_OWN:
        long_sizes = [size for size in sizes if size >= LONGEST_OWN]
        often = stretch_counts(spread, "_text", long_sizes, held, bits, pieces)
        rated = offered.join(often, "_stretch")
        best = rated.groupBy("_id").agg(F.min_by("_stretch", F.struct("_often", "_stretch")))
        longer = lookup.filter(~own).join(best.toDF("_id", "_stretch"), "_id")
        chosen = chosen.unionByName(longer)
    chosen = materialize(chosen.drop("_id"), "chosen-stretches")
    found = stretches_in(spread, key, "_text", sizes, held, bits, pieces)
    found = found.join(chosen, "_stretch")
    # Of a text without a key only the shortest values are known.
    keyed = F.col(key).isNotNull() | (F.length("_whole") <= STRETCH)
    short = found.filter(own & keyed).select(key, "dimension", "value")
    long = found.filter(~own).join(asked, key).filter(F.contains("_text", "_whole"))
    return short.union(long.select(key, "dimension", "value"))


def mentioned_values(
    questions: DataFrame, key: str, column: str, values: DataFrame
) -> DataFrame:
    """Every dimension value that occurs anywhere inside a question's text.

    ``values`` has dimension and value. A value of few bytes is looked up by itself, a
    longer one by a window of its bytes, the one of its own that the fewest texts have.
    Texts are cut into windows where they are read, and a filter of bounded size, built
    from the windows of all values, lets pass what a value may have. Texts and values then
    meet by the bytes of windows, and what is longer than a window is compared in full.
    The work grows with the text and with true mentions, not with text times values. Joins
    are left to the planner, which knows the written lookup's size and splits windows that
    are very frequent.
    """
    return _mentions(questions, key, column, values).distinct()


def question_filters(
    questions: DataFrame, key: str, column: str, values: DataFrame
) -> DataFrame:
    """Per question and dimension, the longest value mentioned."""
    found = _mentions(questions, key, column, values)
    longest = F.min(
        F.struct(
            (-F.length("value")).alias("order"), F.lower("value").alias("folded"), F.col("value")
        )
    )
    return (
        found.groupBy(key, "dimension")
        .agg(longest.alias("best"))
        .select(key, "dimension", F.col("best")["value"].alias("value"))
    )
