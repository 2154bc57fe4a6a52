"""Cell-level parsing and cleaning."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orefold.functions import columns as C
from orefold.functions import values as V


def apply(spark, expression, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    out = rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in out]


TEXTS = [" 12 ", "1.5", "abc", "", None, "nan", "1e5", "-7", "1.5d", "3.0", ".5", "5."]


def test_lenient_number(spark):
    expected = [12.0, 1.5, None, None, None, None, None, -7.0, None, 3.0, 0.5, 5.0]
    assert apply(spark, V.to_number, TEXTS) == expected


def test_integer_and_truncated_integer(spark):
    assert apply(spark, V.to_integer, TEXTS) == [
        12, None, None, None, None, None, None, -7, None, None, None, None
    ]
    assert apply(spark, V.to_truncated_integer, ["2.9", "-2.9", "1e5", "x", "nan"]) == [
        2, -2, 100000, None, None
    ]


def test_coerced_number(spark):
    assert apply(spark, V.coerce_number, ["1e5", "nan", "x", " 2 "]) == [1e5, None, None, 2.0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_keep_the_written_time(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = apply(
            spark,
            lambda c: V.parse_date(c).cast("string"),
            [
                "2026-1-5",
                "05-01-2026",
                "5/1/2026",
                "2026/01/05",
                "2026-01-05 10:00:00",
                "2026-01-05T10:00:00.5",
                "2026-01-05T10:00:00Z",
                "2026-01-05T23:30:00-05:00",
                "2026-03-08 02:30:00",
                " 20260105 ",
            ],
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day = "2026-01-05 00:00:00"
    assert found == [
        day,
        day,
        day,
        day,
        "2026-01-05 10:00:00",
        "2026-01-05 10:00:00.5",
        "2026-01-05 10:00:00",
        "2026-01-05 23:30:00",
        "2026-03-08 02:30:00",
        day,
    ]


def test_unreadable_dates(spark):
    texts = ["junk", "2026", "2026-01", "2026-02-30", "5-1/2026", "", None, "2026-13-01"]
    assert apply(spark, V.parse_date, texts) == [None] * len(texts)


def test_text_normalisation_knows_unicode_spaces(spark):
    no_break = chr(0xA0)
    assert apply(spark, V.normalize_text, [f" a \t b{no_break}", f"{no_break}x"]) == ["a b", "x"]
    assert apply(spark, V.strip, [f"\n\ta b {no_break}"]) == ["a b"]


def test_missing_and_blank(spark):
    values = [None, "", "  ", "x"]
    assert apply(spark, V.is_missing, values) == [True, True, False, False]
    assert apply(spark, V.is_blank, values) == [True, True, True, False]


def test_typed_columns_pass_through(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), True, datetime(2026, 1, 5))],
        "a long, b double, c boolean, d timestamp_ntz",
    )
    row = df.select(
        V.number(df, "a").alias("a"),
        V.number(df, "b").alias("b"),
        V.number(df, "c").alias("c"),
        V.timestamp(df, "d").alias("d"),
    ).first()
    assert tuple(row) == (1.0, None, 1.0, datetime(2026, 1, 5))


def test_column_choice():
    assert C.date_column(["a", "Order_Date", "date"]) == "date"
    assert C.date_column(["a", "ship_date"]) == "ship_date"
    assert C.date_column(["a"]) is None
    assert C.metric_column(["sales", "revenue"], "amount") == "revenue"
    assert C.metric_column(["units"], "quantity") == "units"
    assert C.metric_column(["x"], "amount") is None
