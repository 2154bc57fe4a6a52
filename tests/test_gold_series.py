"""Goldens and properties for statistics, ranks, series, breakdowns and signals."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from orefold.operators import breakdown as B
from orefold.operators import gold as G
from orefold.operators import quality as Q
from orefold.operators import series as S
from orefold.operators import signals as J
from orefold.operators.clean import calendar_attributes
from orefold.operators.ordered import exact_percentiles, with_position
from orefold.plans.gold import GoldLayout, analytics, checked_analytics, time_series
from orefold.session import materialize
from tests.conftest import by

GROWTH = [None, 129.3051, -86.8248, 482.0, -48.6254, 391.6388]


def close(value):
    return pytest.approx(value, abs=5e-5)


def test_group_statistics(read):
    stats = G.group_stats(read("employees"), ["city"], ["salary"], ["name"])
    rows = by(stats.collect(), "city")
    top = rows["Lisbon"].asDict()
    expected = {
        "row_count": 3,
        "salary_sum": 9300,
        "salary_avg": 3100,
        "salary_min": 2800,
        "salary_max": 3600,
        "salary_median": 2900,
        "salary_stddev": close(355.9026),
        "salary_p25": 2850,
        "salary_p75": 3250,
        "salary_p95": 3530,
        "name_distinct_count": 3,
    }
    assert {k: top[k] for k in expected} == expected
    assert rows["Riga"].salary_stddev == 0 and rows["Riga"].salary_p95 == 3100


def test_analytics_of_employees(read):
    gold = analytics(read("employees"), GoldLayout(("city",), ("salary",)))
    rows = by(gold.collect(), "city")
    assert {c: (r.salary_rank, r.salary_performance) for c, r in rows.items()} == {
        "Lisbon": (1, "HIGH"),
        "Oslo": (2, "HIGH"),
        "Riga": (3, "LOW"),
    }
    assert rows["Riga"].salary_share_pct == close(14.3519)
    assert rows["Oslo"].salary_z_score == close(1.4142)
    assert not any(r.salary_anomaly for r in rows.values())
    assert all(r.salary_top_10 and r.salary_bottom_10 for r in rows.values())
    quality = Q.gold_quality(gold).first()
    assert (quality.score, quality.status) == (100.0, "PASS")
    decided = by(J.decisions(gold, ["city"], ["salary"], threshold=4000).collect(), "city")
    assert decided["Oslo"].decision == "HIGH SALARY"
    assert decided["Riga"].action == "No immediate action for salary"


def test_two_groups_have_no_anomaly_columns_filled(read):
    gold = analytics(read("products"), GoldLayout(("category",), ("price",)))
    rows = by(gold.collect(), "category")
    assert rows["Garden"].price_stddev == close(12.51)
    assert rows["Garden"].price_p95 == close(42.6)
    assert rows["Kitchen"].price_percentage == close(44.0678)
    assert rows["Kitchen"].price_anomaly is None and rows["Kitchen"].price_z_score is None


def test_global_statistics(read):
    row = G.group_stats(read("sales"), [], ["amount"], ["city"]).first().asDict()
    assert row["amount_sum"] == 1770.5 and row["city_distinct_total"] == 3


def test_percentiles_between_infinities(spark):
    inf = float("inf")
    rows = [("a", v) for v in (1.0, 2.0, inf)] + [("b", v) for v in (-inf, -inf, inf, inf, inf)]
    df = spark.createDataFrame(rows, "d string, m double").repartition(5)
    found = {r.d: (r.m_median, r.m_p25, r.m_p95) for r in G.group_stats(df, ["d"], ["m"]).collect()}
    assert found == {"a": (2.0, 1.5, inf), "b": (inf, -inf, inf)}


def test_sketches_only_when_asked_for(spark):
    df = spark.createDataFrame([("a", float(i), str(i)) for i in range(1000)], "d string, m double, t string")
    exact = G.group_stats(df, ["d"], ["m"], ["t"]).first()
    rough = G.group_stats(df, ["d"], ["m"], ["t"], approximate=True).first()
    assert exact.m_median == 499.5 and exact.t_distinct_count == 1000
    assert abs(rough.m_median - 499.5) < 20 and abs(rough.t_distinct_count - 1000) < 100


def test_missing_measures_and_dimensions(spark):
    df = spark.createDataFrame(
        [("a", "1"), ("a", "x"), (None, "4"), (None, "2"), ("b", None)], "d string, m string"
    )
    stats = G.group_stats(df, ["d"], ["m"])
    rows = {r.d: (r.row_count, r.m_sum, r.m_median) for r in stats.collect()}
    assert rows == {"a": (2, 1.0, 1.0), None: (2, 6.0, 3.0), "b": (1, None, None)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "d string, m double")
    gold = analytics(df, GoldLayout(("d",), ("m",)))
    assert gold.count() == 0
    assert Q.gold_quality(gold).first().status == "PASS"


def test_zero_total_gives_zero_share(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", -5.0)], "d string, m double")
    gold = analytics(df, GoldLayout(("d",), ("m",)))
    assert [r.m_percentage for r in gold.collect()] == [0.0, 0.0]
    assert Q.gold_quality(gold).first().status == "WARN"


def test_percentiles_of_a_group_that_holds_most_rows(spark):
    """Brute force over one huge and some small groups, with many equal values."""
    rng = random.Random(7)
    rows = [("hot", float(rng.randrange(500))) for _ in range(5000)]
    rows += [(f"g{i % 40}", rng.random()) for i in range(400)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = exact_percentiles(df, ["g"], ["v"], {"p10": 0.1, "median": 0.5, "p95": 0.95})
    groups = {}
    for group, value in rows:
        groups.setdefault(group, []).append(value)

    def percentile(values, share):
        values = sorted(values)
        at = (len(values) - 1) * share
        low = int(at)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (at - low)

    result = {r.g: r for r in found.collect()}
    assert set(result) == set(groups)
    for group, values in groups.items():
        assert result[group].v_p10 == pytest.approx(percentile(values, 0.1))
        assert result[group].v_median == pytest.approx(statistics.median(values))
        assert result[group].v_p95 == pytest.approx(percentile(values, 0.95))


def test_positions_inside_groups(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(8)
    found = with_position(df, ["g"], [F.desc("k"), F.asc("i")], "position").collect()
    expected = {}
    for group in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        expected.update({r[2]: n for n, r in enumerate(members, 1)})
    assert {r.i: r.position for r in found} == expected


def test_ties_rank_by_dimension(spark):
    df = spark.createDataFrame([(f"d{i:02d}", 1.0) for i in range(25)], "d string, m double")
    gold = analytics(df, GoldLayout(("d",), ("m",)))
    rows = gold.orderBy("m_rank").collect()
    assert [r.d for r in rows] == [f"d{i:02d}" for i in range(25)]
    assert [r.m_top_10 for r in rows] == [True] * 10 + [False] * 15
    assert [r.m_bottom_10 for r in rows] == [False] * 15 + [True] * 10
    assert sum(r.m_percentage for r in rows) == pytest.approx(100)


def test_gold_of_sales_with_products(read):
    layout = GoldLayout(("category", "city"), ("amount",), ("transaction_date",))
    gold = analytics(read("sales"), layout)
    found = {(r.category, r.city): r for r in gold.collect()}
    assert found["Kitchen", "Lisbon"].amount_sum == 321.5 and len(found) == 9
    assert found["Garden", "Oslo"].transaction_date_distinct_count == 3
    assert found["Home", "Lisbon"].transaction_date_distinct_count == 2
    assert G.insights(gold, layout.dimensions, ["amount"]).first().insight == (
        "category=Kitchen, city=Riga has the highest amount_sum (405.00)."
    )
    assert tuple(G.top_segment(gold, layout.dimensions, "amount").first()) == (
        "Kitchen",
        "Riga",
        405.0,
    )
    kpis = G.gold_kpis(gold).first()
    assert (kpis.groups, kpis.row_count, kpis.total_amount, kpis.total_quantity) == (
        9, 13, 1770.5, None
    )


def test_reconciliation_counts_the_written_table(read):
    sales = read("sales")
    detail = materialize(sales)
    layout = GoldLayout(("city",), ("amount",))
    gold, quality, reconciliation = checked_analytics(sales, detail, layout)
    assert {r._reconciliation_status for r in gold.collect()} == {"PASS"}
    short = Q.reconcile(sales, detail.filter("transaction_id <> '1'"), gold).first()
    assert (short.status, short.detail_row_difference) == ("FAIL", -1)


def test_calendar_attributes(spark):
    df = spark.createDataFrame([("2026-01-01",), ("junk",)], "d string")
    first, second = calendar_attributes(df, "d").orderBy("d").collect()
    assert tuple(first)[1:] == (
        2026, "Q1", 1, "January", 1, 1, "Thursday", "2026-01", "2026-Q1"
    )
    assert set(tuple(second)[1:]) == {None}


def test_calendar_parts_when_the_date_is_a_dimension(read):
    gold = analytics(read("sales"), GoldLayout(("transaction_date",), ("amount",)))
    assert gold.filter("date_year_month = '2025-04'").count() == 3


def test_monthly_growth(read):
    series = time_series(read("sales"), ["amount", "quantity"]).orderBy("period").collect()
    assert [r.period for r in series] == [f"2025-0{m}" for m in range(3, 9)]
    assert [r.amount_sum for r in series] == [165.5, 379.5, 50, 291, 149.5, 735]
    assert series[0].amount_trend == "BASELINE"
    assert [r.amount_growth_pct for r in series[1:]] == [close(g) for g in GROWTH[1:]]
    assert series[4].quantity_trend == "FLAT"
    assert {r.amount_yoy_growth_pct for r in series} == {None}


def test_gaps_zero_months_and_year_over_year(spark):
    months = [("2024-12", 0.0), ("2025-01", 50.0), ("2025-03", 100.0), ("2025-12", 10.0),
              ("2026-01", 75.0), ("2026-03", None)]
    df = spark.createDataFrame([(f"{m}-15", v) for m, v in months], "order_date string, m double")
    rows = by(time_series(df, ["m"]).collect(), "period")
    assert rows["2025-01"].m_trend == "BASELINE"
    assert rows["2025-03"].m_growth_pct == 100.0
    assert rows["2025-12"].m_yoy_growth_pct is None
    assert rows["2026-01"].m_yoy_growth_pct == 50.0
    assert rows["2026-03"].m_trend == "NO_DATA" and rows["2026-03"].m_yoy_growth_pct is None


def test_trends_and_signals(read):
    series = S.add_growth(
        S.monthly_series(read("sales"), "transaction_date", ["amount", "quantity"]),
        ["amount", "quantity"],
    )
    trends = by(S.trend_summary(series, ["amount", "quantity"]).collect(), "measure")
    assert (trends["amount"].trend, trends["amount"].rising) == ("UPWARD", 3)
    assert (trends["quantity"].trend, trends["quantity"].falling) == ("UPWARD", 1)
    found = J.signals(series)
    assert [(r.type, r.severity) for r in found.orderBy("position").collect()] == [
        ("GROWTH", "HIGH"),
        ("TREND", "INFO"),
        ("VOLUME", "INFO"),
    ]
    assert found.first().message == "Latest amount growth is 391.64%."
    assert J.signal_state(found).first().state == "ACTION REQUIRED"
    assert len(J.signal_actions(found).collect()) == 2
    strongest = B.contributors(read("sales"), ["city", "category"], "amount")
    summary = J.reasoning_summary(found, strongest).first()
    assert summary.headline == "Latest business value increased by 391.64%."
    assert "category=Kitchen, representing 45.58%" in summary.contributor
    nothing = J.reasoning_summary(found.limit(0), strongest.limit(0)).first()
    assert nothing.headline == "No strong directional signal was detected."
    assert nothing.contributor.startswith("No dimensional contributor")


def test_no_measures_still_gives_a_decision(spark):
    df = spark.createDataFrame([("a", 1)], "d string, row_count long")
    row = J.decisions(df, ["d"], []).first()
    assert (row.decision, row.action) == ("ANALYTICS GENERATED", "Review generated analytics")


def test_breakdowns(read):
    sales = read("sales")
    rows = B.breakdown(sales, "product", "amount").orderBy("rank").collect()
    assert [(r.value, r.amount, round(r.share_pct, 4)) for r in rows] == [
        ("Kettle", 807, 45.5803),
        ("Lamp", 500, 28.2406),
        ("Spade", 315, 17.7916),
        ("Rake", 148.5, 8.3875),
    ]
    lowest = B.breakdown(sales, "product", "amount", limit=1, bottom=True).first()
    assert (lowest.value, round(lowest.share_pct, 4)) == ("Rake", 8.3875)
    pairs = B.cross_breakdown(sales, "category", "product", "amount").orderBy("rank").collect()
    assert {(r.parent, r.child): round(r.parent_share_pct, 3) for r in pairs} == {
        ("Kitchen", "Kettle"): 100.0,
        ("Home", "Lamp"): 100.0,
        ("Garden", "Spade"): 67.961,
        ("Garden", "Rake"): 32.039,
    }
    every = B.contribution(sales, "product", "amount").orderBy("rank").collect()
    assert [tuple(r)[:2] for r in every] == [(r.value, r.amount) for r in rows]
    ends = by(B.top_and_bottom(sales, "product", "amount").collect(), "position")
    assert (ends["TOP"].value, ends["BOTTOM"].value) == ("Kettle", "Rake")
    best = B.contributors(sales, ["category", "city"], "amount").collect()
    assert [(r.dimension, r.value) for r in best] == [("category", "Kitchen"), ("city", "Lisbon")]
    assert best[1].share_pct == close(43.0104)


def test_filters_ignore_case_and_unknown_columns(read):
    row = B.filtered_summary(
        read("sales"), "amount", {"product": " kettle ", "planet": "mars"}
    ).first()
    assert (row.row_count, row.total, row.maximum) == (4, 807, 405)


def test_comparison_needs_two_values(read):
    rows = B.compare_values(read("sales"), "city", ["riga", "Oslo"], "amount")
    assert {r.value: r.total for r in rows.collect()} == {"riga": 554, "oslo": 455}
    with pytest.raises(ValueError):
        B.compare_values(read("sales"), "city", ["Riga", " riga"], "amount")


def test_missing_dimension_values_are_a_group(spark):
    df = spark.createDataFrame(
        [(None, "x", 1.0), ("", "x", 2.0), ("a", None, 4.0)], "p string, c string, m double"
    )
    assert {r.value: r.amount for r in B.breakdown(df, "p", "m").collect()} == {None: 3.0, "a": 4.0}
    pairs = B.cross_breakdown(df, "p", "c", "m").collect()
    assert {(r.parent, r.child): r.parent_share_pct for r in pairs} == {
        (None, "x"): 100.0,
        ("a", None): 100.0,
    }


@pytest.mark.parametrize("accuracy,margin", [(10_000, 2e-4), (20, 0.1), (10_000, -0.05)])
def test_percentiles_are_exact_whatever_the_brackets(spark, monkeypatch, accuracy, margin):
    """Narrow, wide, and wrong brackets, which the exact counts notice."""
    from orefold.operators import ordered

    monkeypatch.setattr(ordered, "_ACCURACY", accuracy)
    monkeypatch.setattr(ordered, "_MARGIN", margin)
    rng = random.Random(4)
    rows = [(rng.choice("aab"), float(rng.randrange(400)), rng.choice([None, rng.random()])) for _ in range(2500)]
    rows += [("c", 1.0, None), ("d", None, None), (None, 5.0, 2.0), (None, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(4)
    wanted = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r.g: r for r in exact_percentiles(df, ["g"], ["v", "w"], wanted).collect()}
    assert set(found) == {"a", "b", "c", None}
    for group, row in found.items():
        for i, measure in ((1, "v"), (2, "w")):
            values = sorted(r[i] for r in rows if r[0] == group and r[i] is not None)
            for label, p in wanted.items():
                got = row[f"{measure}_{label}"]
                if not values:
                    assert got is None
                    continue
                at = (len(values) - 1) * p
                low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
                assert got == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-12)
