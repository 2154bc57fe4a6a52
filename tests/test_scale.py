"""Plans and passes whose memory and time must not grow faster than their input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators import ordered, questions
from orefold.operators.profile import column_stats


@pytest.fixture
def grouped(spark):
    rows = [(f"g{i % 3}", float(i % 40)) for i in range(600)] + [(None, 1.5), ("g0", None)]
    return spark.createDataFrame(rows, "g string, _value double")


def test_brackets_are_counted_without_sorting_the_rows(spark, grouped):
    cells = grouped.selectExpr("g", "'m' AS _measure", "_value").where("_value IS NOT NULL")
    found = ordered._brackets(cells, ["g", "_measure"], {"median": 0.5})
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    counted = {r.g: (r._total, r._low) for r in found.collect()}
    assert counted == {"g0": (200, 99), "g1": (200, 99), "g2": (200, 99), None: (1, 0)}


def test_texts_are_not_cut_into_rows(spark, monkeypatch):
    texts = ["Wo der Fluß fließt, dort fließt die Zeit", "Zeit", "zeit, die Zeit " * 40, None, ""]
    asked = spark.createDataFrame([*enumerate(texts), (None, "die Zeit")], "id int, q string")
    names = ["ZEIT", "ß", "dort fließt die Zeit", "zeit, die zeit zeit, die zeit zeit,", "eit d"]
    values = spark.createDataFrame([("d", n) for n in names], "dimension string, value string")
    plans = []
    real = questions.stretches_in

    def seen(*args):
        plans.append(real(*args))
        return plans[-1]

    monkeypatch.setattr(questions, "stretches_in", seen)
    found = {tuple(r) for r in questions.mentioned_values(asked, "id", "q", values).collect()}
    wanted = {
        (i, "d", n) for i, t in enumerate(texts) for n in names if t and n.lower() in t.lower()
    }
    assert found == wanted | {(None, "d", "ZEIT")}
    # One row for each window that a value may have, not one for each window of a text.
    assert plans[0].count() < 20


def test_column_names_are_not_grouped_with_the_cells(spark):
    df = spark.createDataFrame([("a", "1"), ("a", None), ("", "2")], "`x y` string, z string")
    stats = column_stats(df)
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    groupings = [line.split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert len(groupings) == 2 and not any("name#" in line for line in groupings)
    found = {r.name: (r.type, r.row_count, r.null_count, r.cardinality) for r in stats.collect()}
    assert found == {"x y": ("string", 3, 1, 1), "z": ("integer", 3, 1, 2)}


def test_blank_cells_are_trimmed_at_one_end(spark):
    cells = [None, "", " ", "\t　", "a", " a", "a ", " b"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(V.is_blank(F.col("c")))
    assert "btrim" not in df._jdf.queryExecution().toString().lower()
    assert [r[0] for r in df.collect()] == [True] * 4 + [False] * 4
