"""Goldens for profiling, roles, quality and validation."""

from __future__ import annotations

import pytest

from orefold.operators import profile as P
from orefold.operators import quality as Q
from orefold.operators import roles as R
from orefold.operators import validation as V
from orefold.operators.clean import remove_empty_rows, role_transform
from tests.conftest import by


def roles_of(df):
    return R.collect_roles(R.semantic_roles(df))


def test_roles_of_samples(read):
    found = {c.name: (c.type, c.role, c.confidence) for c in roles_of(read("employees"))}
    assert found == {
        "id": ("integer", "KEY", 0.99),
        "name": ("string", "ATTRIBUTE", 0.95),
        "city": ("string", "DIMENSION", 0.98),
        "salary": ("integer", "MEASURE", 0.99),
    }
    customers = {c.name: (c.role, c.confidence, c.key_type) for c in roles_of(read("customers"))}
    assert customers["customer_id"] == ("KEY", 0.99, "REFERENCE")
    assert customers["customer_name"] == ("ATTRIBUTE", 0.85, None)
    assert customers["age"] == ("MEASURE", 0.85, None)
    assert customers["email"] == ("ATTRIBUTE", 0.95, None)
    sales = {c.name: (c.role, c.key_type) for c in roles_of(read("sales"))}
    assert sales["transaction_id"] == ("KEY", "PRIMARY")
    assert sales["product"] == ("ATTRIBUTE", None)
    assert sales["transaction_date"] == ("ATTRIBUTE", None)


def test_column_stats(read):
    stats = by(P.column_stats(read("customers")).collect(), "name")
    email, city = stats["email"], stats["city"]
    assert (email.cardinality, email.unique_ratio, email.null_rate) == (7, 0.7778, 0.1111)
    assert (city.cardinality, city.unique_ratio) == (5, 0.5556)
    assert email.nullable and not city.nullable


@pytest.mark.parametrize(
    ("values", "strict", "numeric", "gold"),
    [
        (["100", "2.5"], "string", "float", "float"),
        (["1.5", "2.5"], "float", "float", "float"),
        (["1", "-2"], "integer", "integer", "float"),
        (["01", "7"], "integer", "integer", "integer"),
        (["yes", "No"], "boolean", "boolean", "string"),
        (["yes", "0"], "string", "boolean", "string"),
        (["1e5", "nan"], "string", "float", "float"),
        (["a", "1"], "string", "string", "string"),
        (["", None], "string", "string", "string"),
        ([" 1", "0"], "integer", "integer", "float"),
    ],
)
def test_type_modes(spark, values, strict, numeric, gold):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    found = [P.discover_schema(df, m).first()["type"] for m in ("strict", "numeric", "gold")]
    assert found == [strict, numeric, gold]
    assert P.column_stats(df, "numeric").first()["type"] == numeric


def test_quality_of_samples(read):
    employees = read("employees")
    report = Q.quality_report(Q.quality_counters(employees, roles_of(employees)))
    assert Q.quality_score(report).first().asDict() == {
        "score": 100.0,
        "status": "PASS",
        "failed_checks": 0,
        "total_checks": 7,
    }
    customers = read("customers")
    counters = Q.quality_counters(customers, roles_of(customers))
    row = counters.first()
    assert (row.null_values, row.duplicate_rows, row.key_found) == (1, 1, False)
    checks = by(Q.quality_report(counters).collect(), "name")
    assert checks["Duplicate ID"].message == "No unique primary key detected"
    score = Q.quality_score(Q.quality_report(counters)).first()
    assert (score.score, score.status) == (71.43, "FAIL")
    weighted = Q.weighted_score(customers, customers.columns).first()
    assert (weighted.score, weighted.status) == (95.37, "PASS")


def test_keys_found_by_their_values(read):
    employees = read("employees").withColumnRenamed("id", "badge_id")
    columns = [R.ColumnRole("badge_id", "integer", "KEY")]
    row = Q.quality_counters(employees, columns).first()
    assert (row.duplicate_ids, row.key_found) == (0, True)


def test_validation_of_customers(read):
    customers = read("customers")
    row = V.validation_verdict(customers, roles_of(customers)).first()
    assert (row.duplicate_keys, row.valid) == (1, False)
    primary = V.validation_verdict(customers, roles_of(customers), primary_only=True).first()
    assert (primary.duplicate_keys, primary.valid) == (0, True)
    short = V.validation_verdict(customers, roles_of(customers)[:-1]).first()
    assert (short.unexpected_columns, short.valid) == (1, False)


def test_type_errors_per_kind(spark):
    texts = [" 12 ", "1.5", "abc", "", None, "nan", "1e5"]
    df = spark.createDataFrame(
        [(i, t, t, t) for i, t in enumerate(texts)], "i int, a string, b string, c string"
    )
    columns = [R.ColumnRole("a", "integer"), R.ColumnRole("b", "float")]
    found = {r.name: r.type_errors for r in Q.type_errors(df, columns).collect()}
    assert found == {"a": 4, "b": 1}
    columns.append(R.ColumnRole("c", "boolean"))
    samples = V.type_error_samples(df, columns, "i").collect()
    assert len(samples) == 10
    assert samples[0].asDict() == {
        "row_key": 0, "column": "c", "value": " 12 ", "expected": "boolean"
    }


def test_null_and_empty_are_different_copies(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("", "a")], "x string, y string")
    assert Q.duplicate_row_count(df).first()[0] == 1


def test_duplicates_are_group_sizes_less_one(read):
    customers = read("customers")
    groups = Q.row_groups(customers).collect()
    assert sum(g.copies - 1 for g in groups) == Q.duplicate_row_count(customers).first()[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, amount string")
    columns = [R.ColumnRole("id", "integer", "KEY", 0.99, "PRIMARY"), R.ColumnRole("amount", "float")]
    row = Q.quality_counters(df, columns).first()
    assert (row.row_count, row.null_values, row.duplicate_rows, row.duplicate_ids) == (0, 0, 0, 0)
    assert Q.quality_check(df).first().status == "FAIL"
    assert Q.weighted_score(df, df.columns).first().score == 100.0
    assert not V.validation_verdict(df, columns).first().valid
    assert {r.type for r in P.discover_schema(df).collect()} == {"string"}


def test_quality_gate():
    assert not Q.quality_gate("failed")
    assert not Q.quality_gate("WARN", 49.0)
    assert Q.quality_gate("WARN", 50.0)
    assert Q.quality_gate("PASS")


def test_empty_rows(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("a", None)], "x string, y string")
    assert remove_empty_rows(df).count() == 2
    assert remove_empty_rows(df, empty_text=True).count() == 1


def test_role_transform(spark):
    df = spark.createDataFrame(
        [(" 3 ", "2.9", "  a \t b ", ""), ("3.0", "x", "", "k")],
        "id string, quantity string, city string, note string",
    )
    columns = [
        R.ColumnRole("id", "integer", "KEY"),
        R.ColumnRole("quantity", "integer", "MEASURE"),
        R.ColumnRole("city", "string", "DIMENSION"),
        R.ColumnRole("note", "string", "ATTRIBUTE"),
    ]
    assert [tuple(r) for r in role_transform(df, columns).collect()] == [
        (3, 2, "a b", None),
        (None, None, None, "k"),
    ]


def test_rules_ask_for_review_when_unsure(spark):
    roles = spark.createDataFrame(
        [("a", "float", "KEY", 0.5), ("b", "string", "TIME", 0.9), ("c", "string", None, 0.9)],
        "name string, type string, role string, confidence double",
    )
    rules = {r.column: r.rules for r in R.transform_rules(roles).collect()}
    assert rules == {
        "a": ["TRIM", "CAST_NUMERIC", "KEY_VALIDATION", "LOW_CONFIDENCE_REVIEW"],
        "b": ["TRIM", "DATE_TIME_NORMALIZATION"],
        "c": ["TRIM"],
    }


def test_digests_tell_rows_apart_as_grouping_does(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a1:", "b"), ("a", "1:b"), (None, "-"), ("-", None), ("", None)]
    df = spark.createDataFrame(rows + rows[:2], "x string, y string")
    assert Q.duplicate_row_count(df).first()[0] == 2
    numbers = spark.createDataFrame(
        [(0.0, 1), (-0.0, 1), (float("nan"), 1), (float("nan"), 1), (None, 1)], "v double, n int"
    )
    assert Q.duplicate_row_count(numbers).first()[0] == 2


def test_no_exchange_carries_long_text(spark):
    df = spark.createDataFrame([(str(i), "long text " * 50) for i in range(20)], "id string, body string")
    for result in (
        Q.quality_counters(df, [R.ColumnRole("id", "integer", "KEY")]),
        P.column_stats(df),
        Q.quality_check(df),
        Q.weighted_score(df, df.columns),
    ):
        result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("Final Plan")[-1].split("Initial Plan")[0].splitlines():
            assert "Exchange" not in line or "body" not in line
    row = {r.name: r for r in P.column_stats(df).collect()}["body"]
    assert (row.cardinality, row.type) == (1, "string")
    rough = {r.name: r.cardinality for r in P.column_stats(df, approximate=True).collect()}
    assert rough == {"id": 20, "body": 1}


def test_names_may_hold_backticks(spark):
    df = spark.createDataFrame([("1", "x")], ["a`b", "c.d"])
    assert {r.name: r.type for r in P.discover_schema(df).collect()} == {"a`b": "integer", "c.d": "string"}
    assert P.column_stats(df).count() == 2 and Q.quality_check(df).first().status == "PASS"
