"""Rule-based business signals and the actions that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators.series import latest_period

# Thresholds in percent, and the average that counts as high.
GROWTH_MEDIUM, GROWTH_HIGH = 10, 50
DECLINE_MEDIUM, DECLINE_HIGH = -10, -30
VOLUME_MOVE = 10
HIGH_AVERAGE = 60000
MAX_ACTIONS = 4

# The action for every kind of signal.
ACTIONS = {
    "GROWTH": "Break down the latest revenue increase by city, category and product.",
    "DECLINE": (
        "Investigate the latest revenue decline by business dimensions and data freshness."
    ),
    "TREND DOWN": (
        "Review the declining trend and identify the dimensions contributing most to the drop."
    ),
    "VOLUME DOWN": (
        "Check transaction-volume drivers and investigate periods with falling quantity."
    ),
    "VOLUME UP": "Compare volume growth with revenue growth to validate business performance.",
    "QUALITY": "Review the Gold quality issue before using the output for downstream decisions.",
}


def decisions(
    gold: DataFrame,
    dimensions: Sequence[str],
    measures: Sequence[str],
    threshold: float = HIGH_AVERAGE,
) -> DataFrame:
    """HIGH or NORMAL per measure average and the action text, for every group."""
    labels, actions = [], []
    for measure in measures:
        average = V.col(f"{measure}_avg")
        label = F.when(average >= threshold, f"HIGH {measure.upper()}").otherwise(
            f"NORMAL {measure.upper()}"
        )
        action = F.when(average >= threshold, f"Monitor {measure} trend").otherwise(
            f"No immediate action for {measure}"
        )
        labels.append(F.when(average.isNotNull(), label))
        actions.append(F.when(average.isNotNull(), action))
    if measures:
        decision, action = F.concat_ws(" | ", *labels), F.concat_ws(" | ", *actions)
    else:
        decision = F.lit("ANALYTICS GENERATED")
        action = F.lit("Review generated analytics")
    return gold.select(
        *V.cols(dimensions), "row_count", decision.alias("decision"), action.alias("action")
    )


def _signal(
    when: Column,
    kind: str,
    severity: Column | str,
    title: Column | str,
    message: Column,
    value: Column | None = None,
    state: Column | None = None,
) -> Column:
    def column(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("type"),
            column(severity).alias("severity"),
            column(title).alias("title"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if state is None else state).cast("string").alias("state"),
            message.alias("message"),
        ),
    )


def signals(
    series: DataFrame,
    quality: DataFrame | None = None,
    amount: str = "amount",
    quantity: str = "quantity",
) -> DataFrame:
    """Signals of the latest period of a series, and of the quality of its gold table.

    ``quality`` is a one-row table with a ``status`` column.
    """
    found = []
    if f"{amount}_growth_pct" in series.columns:
        growth = V.col(f"{amount}_growth_pct")
        message = F.format_string("Latest amount growth is %.2f%%.", growth)
        found.append(
            _signal(
                growth > GROWTH_MEDIUM,
                "GROWTH",
                F.when(growth >= GROWTH_HIGH, "HIGH").otherwise("MEDIUM"),
                "Revenue acceleration",
                message,
                value=growth,
            )
        )
        found.append(
            _signal(
                growth < DECLINE_MEDIUM,
                "DECLINE",
                F.when(growth <= DECLINE_HIGH, "HIGH").otherwise("MEDIUM"),
                "Revenue decline",
                message,
                value=growth,
            )
        )
    if f"{amount}_trend" in series.columns:
        trend = F.upper(V.col(f"{amount}_trend"))
        found.append(
            _signal(
                trend.isin("UP", "DOWN"),
                "TREND",
                F.when(trend == "DOWN", "MEDIUM").otherwise("INFO"),
                F.concat(F.lit("Amount trend "), trend),
                F.concat(F.lit("Latest amount trend is "), trend, F.lit(".")),
                state=trend,
            )
        )
    if f"{quantity}_growth_pct" in series.columns:
        growth = V.col(f"{quantity}_growth_pct")
        found.append(
            _signal(
                F.abs(growth) >= VOLUME_MOVE,
                "VOLUME",
                F.when(growth < 0, "MEDIUM").otherwise("INFO"),
                "Volume movement",
                F.format_string("Latest quantity growth is %.2f%%.", growth),
                value=growth,
            )
        )
    if quality is not None:
        status = F.upper(quality.select("status").scalar())
        found.append(
            _signal(
                status != "PASS",
                "QUALITY",
                "HIGH",
                "Gold quality issue",
                F.concat(F.lit("Gold quality status is "), status, F.lit(".")),
                state=status,
            )
        )
    all_signals = F.array_compact(F.array(*found))
    rows = latest_period(series).select(F.posexplode(all_signals).alias("position", "signal"))
    return rows.select("position", "signal.*")


def signal_actions(found: DataFrame, limit: int | None = MAX_ACTIONS) -> DataFrame:
    """The action of every signal in signal order, each text once; ``limit`` rows, or
    all with None.

    A series has at most one signal of each kind, so the list is short.
    """
    kind, down = F.col("type"), F.col("state") == "DOWN"
    action = (
        F.when(kind == "GROWTH", ACTIONS["GROWTH"])
        .when(kind == "DECLINE", ACTIONS["DECLINE"])
        .when((kind == "TREND") & down, ACTIONS["TREND DOWN"])
        .when((kind == "VOLUME") & (F.col("value") < 0), ACTIONS["VOLUME DOWN"])
        .when(kind == "VOLUME", ACTIONS["VOLUME UP"])
        .when(kind == "QUALITY", ACTIONS["QUALITY"])
    )
    first_seen = (
        found.select("position", action.alias("action"))
        .filter(F.col("action").isNotNull())
        .groupBy("action")
        .agg(F.min("position").alias("position"))
    )
    ordered = first_seen.orderBy("position").select("position", "action")
    return ordered if limit is None else ordered.limit(limit)


def signal_state(found: DataFrame) -> DataFrame:
    """How many signals there are and what they ask for overall."""
    high = F.count_if(F.col("severity") == "HIGH")
    medium = F.count_if(F.col("severity") == "MEDIUM")
    return found.agg(
        F.count("*").alias("signals"), high.alias("high"), medium.alias("medium")
    ).withColumn(
        "state",
        F.when(F.col("high") > 0, "ACTION REQUIRED")
        .when(F.col("medium") > 0, "REVIEW")
        .otherwise("MONITOR"),
    )


def reasoning_summary(
    found: DataFrame, contributors: DataFrame, metric: str = "amount_sum"
) -> DataFrame:
    """A headline from the signals and a sentence about the strongest contributor."""
    growth_signal = F.col("type").isin("GROWTH", "DECLINE")
    facts = found.agg(
        F.max(F.when(growth_signal, F.col("value"))).alias("growth"),
        F.max(F.when(F.col("type") == "TREND", F.col("state"))).alias("trend"),
    )
    growth, trend = F.col("growth"), F.col("trend")
    headline = (
        F.when(growth > 0, F.format_string("Latest business value increased by %.2f%%.", growth))
        .when(
            growth.isNotNull(),
            F.format_string("Latest business value changed by %.2f%%.", growth),
        )
        .when(
            trend.isNotNull(), F.concat(F.lit("Latest business trend is "), trend, F.lit("."))
        )
        .otherwise("No strong directional signal was detected.")
    )
    sentence = F.format_string(
        "The strongest visible contributor is %s=%s, representing %.2f%% of the available "
        f"{metric} total.",
        F.col("dimension"),
        F.col("value"),
        F.col("share_pct"),
    )
    strongest = (
        contributors.orderBy(F.desc("share_pct"), "dimension").limit(1).select(sentence).scalar()
    )
    fallback = (
        "No dimensional contributor could be calculated from the available analytics table."
    )
    return facts.select(
        headline.alias("headline"),
        F.coalesce(strongest, F.lit(fallback)).alias("contributor"),
    )
