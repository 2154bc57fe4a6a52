"""Data quality: counters, the seven-check report, scores and gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators.roles import ColumnRole

# Names that make a key column the primary key of a table.
STRONG_KEY_NAMES = (
    "id",
    "uuid",
    "guid",
    "transaction_id",
    "transaction_key",
    "order_id",
    "invoice_id",
    "record_id",
    "event_id",
)
CHECK_NAMES = (
    "Row Count",
    "Empty Rows",
    "Null Values",
    "Duplicate Rows",
    "Duplicate ID",
    "Data Types",
    "Column Consistency",
)
FAILED_STATES = ("FAIL", "FAILED", "ERROR")


def _weighted(name: str) -> Column:
    """The sum of a row's number over all copies."""
    return F.coalesce(F.sum(F.col(name) * F.col("copies")), F.lit(0)).alias(name)


def _rows() -> Column:
    return F.coalesce(F.sum("copies"), F.lit(0))


def _repeats() -> Column:
    """Rows beyond the first of every group."""
    return F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))


def row_groups(
    df: DataFrame, columns: Sequence[str] | None = None, **known: Column
) -> DataFrame:
    """Distinct rows as ``row``, a digest, with ``copies`` and what is known of each.

    Nulls are equal to each other. A row is shuffled as its digest and a few numbers,
    however wide it is; copies are combined before, so a row repeated very often costs
    one record per input task. What ``known`` says must follow from the row.
    """
    rows = df.select(
        V.row_digest(df, columns or df.columns).alias("row"),
        *[value.alias(name) for name, value in known.items()],
    )
    return rows.groupBy("row", *known).agg(F.count("*").alias("copies"))


def _count(conditions: Sequence[Column]) -> Column:
    """How many conditions a row meets."""
    if not conditions:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy."""
    return row_groups(df).agg(_repeats().alias("duplicate_rows"))


def key_digest(df: DataFrame, name: str) -> Column:
    """A key's trimmed value as a digest; null where the key is missing."""
    return V.digest(V.strip(V.present(V.text(df, name))))


def _key_duplicates(groups: DataFrame, name: str) -> Column:
    """Repeats of a key digest, from row groups, as one number.

    Missing keys are passed over after the grouping: a filter before it would change
    the shuffle below, which then could not be shared.
    """
    keys = groups.groupBy(F.col(name).alias("key")).agg(F.sum("copies").alias("copies"))
    repeats = F.sum(F.when(F.col("key").isNotNull(), F.col("copies") - 1))
    return keys.agg(F.coalesce(repeats, F.lit(0))).scalar()


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key column: non-missing values, distinct trimmed values, duplicates."""
    as_text = df.select(*[V.text(df, k).alias(k) for k in keys])
    cells = as_text.unpivot([], V.cols(keys), "name", "raw")
    distinct = (
        cells.filter(~V.is_missing(F.col("raw")))
        .groupBy("name", V.strip(F.col("raw")).alias("key"))
        .agg(F.count("*").alias("copies"))
    )
    return distinct.groupBy("name").agg(
        F.sum("copies").alias("non_missing"),
        F.count("*").alias("distinct_values"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
    )


def infer_primary_key(df: DataFrame, columns: Sequence[ColumnRole]) -> DataFrame:
    """Key columns with the verdict whether each would serve as the primary key.

    A strong name decides when there is one; otherwise every key column whose values
    are all distinct qualifies.
    """
    keys = [c.name for c in columns if c.role == "KEY"]
    strong = [k for k in keys if k.lower() in STRONG_KEY_NAMES]
    as_text = df.select(*[V.text(df, k).alias(k) for k in keys])
    cells = as_text.unpivot([], V.cols(keys), "name", "value")
    distinct = (
        cells.filter(~V.is_missing(F.col("value")))
        .groupBy("name", "value")
        .agg(F.count("*").alias("copies"))
    )
    counted = distinct.groupBy("name").agg(
        F.sum("copies").alias("non_missing"), F.count("*").alias("distinct_values")
    )
    if strong:
        verdict = F.col("name").isin(*strong)
    else:
        verdict = F.col("non_missing") == F.col("distinct_values")
    return counted.withColumn("is_primary_key", verdict)


def type_error(df: DataFrame, column: ColumnRole) -> Column | None:
    """Whether a cell does not parse as its declared number; None if it need not."""
    value = V.text(df, column.name)
    if column.type == "integer":
        valid = V.is_integer_text(value)
    elif column.type in ("float", "double", "numeric"):
        valid = V.is_float_text(value)
    else:
        return None
    return ~V.is_missing(value) & ~valid


def type_errors(df: DataFrame, columns: Sequence[ColumnRole]) -> DataFrame:
    """Per declared integer or float column, the cells that do not parse."""
    errors = {c.name: type_error(df, c) for c in columns}
    checked = {name: e for name, e in errors.items() if e is not None}
    counted = df.agg(*[F.count_if(e).alias(name) for name, e in checked.items()])
    return counted.unpivot([], V.cols(checked), "name", "type_errors")


def quality_counters(
    df: DataFrame,
    columns: Sequence[ColumnRole],
    ragged: str | None = None,
) -> DataFrame:
    """All counters of the report in one row; ``ragged`` names a row flag column.

    The rows are read once. Each row's findings are counted where it is read; then rows
    meet by their digests, which the duplicate check needs, with those small numbers and
    the digests of keys. The key counters, as scalar subqueries, reuse the same shuffle.
    """
    names = [c.name for c in columns if c.name in df.columns]
    data = [c for c in df.columns if c != ragged]
    missing = {c: V.is_missing(V.text(df, c)) for c in data}
    errors = [e for c in columns if c.name in names if (e := type_error(df, c)) is not None]
    keys = [c.name for c in columns if c.role == "KEY" and c.name in names]
    flagged = [c.name for c in columns if c.key_type == "PRIMARY" and c.name in keys]
    strong = [k for k in keys if k.lower() in STRONG_KEY_NAMES]
    primary = flagged or strong or keys
    digests = {f"key_{i}": key_digest(df, k) for i, k in enumerate(primary)}
    if not (flagged or strong):
        # Whether a key column identifies rows is judged by its values as they are.
        digests |= {f"raw_{i}": V.digest(V.present(V.text(df, k))) for i, k in enumerate(keys)}
    groups = row_groups(
        df,
        empty_rows=_count([reduce(lambda a, b: a & b, missing.values())]),
        null_values=_count([missing[c] for c in names]),
        type_errors=_count([F.coalesce(e, F.lit(False)) for e in errors]),
        inconsistent_rows=_count([F.col(ragged)] if ragged else []),
        **digests,
    )
    counters = groups.agg(
        _rows().alias("row_count"),
        _weighted("empty_rows"),
        _weighted("null_values"),
        _weighted("type_errors"),
        _weighted("inconsistent_rows"),
        _repeats().alias("duplicate_rows"),
    )
    repeats = [_key_duplicates(groups, f"key_{i}") for i in range(len(primary))]
    if flagged or strong:
        key_duplicates = reduce(lambda a, b: a + b, repeats)
        key_found = F.lit(True)
    elif keys:
        # No primary key is known by flag or name: a key column counts as one only if
        # its raw values are all distinct.
        unique = [_key_duplicates(groups, f"raw_{i}") == 0 for i in range(len(keys))]
        filled = [
            groups.agg(F.count_if(F.col(f"raw_{i}").isNotNull())).scalar() > 0
            for i in range(len(keys))
        ]
        serves = [a & b for a, b in zip(unique, filled)]
        key_duplicates = reduce(
            lambda a, b: a + b, [F.when(s, r).otherwise(0) for s, r in zip(serves, repeats)]
        )
        key_found = reduce(lambda a, b: a | b, serves)
    else:
        key_duplicates = F.lit(0).cast("bigint")
        key_found = F.lit(False)
    return counters.select(
        "*", key_duplicates.alias("duplicate_ids"), key_found.alias("key_found")
    )


def quality_report(counters: DataFrame) -> DataFrame:
    """The seven checks as rows: position, name, status, value, message."""
    checks = (
        ("row_count", "rows detected", F.col("row_count") > 0),
        ("empty_rows", "empty rows", F.col("empty_rows") == 0),
        ("null_values", "null values", F.col("null_values") == 0),
        ("duplicate_rows", "duplicate rows", F.col("duplicate_rows") == 0),
        ("duplicate_ids", "duplicate IDs", F.col("duplicate_ids") == 0),
        ("type_errors", "type errors", F.col("type_errors") == 0),
        ("inconsistent_rows", "inconsistent rows", F.col("inconsistent_rows") == 0),
    )
    rows = []
    for position, (label, (counter, unit, passed)) in enumerate(zip(CHECK_NAMES, checks)):
        message = F.concat(F.col(counter).cast("string"), F.lit(f" {unit}"))
        if counter == "duplicate_ids":
            message = F.when(F.col("key_found"), message).otherwise(
                "No unique primary key detected"
            )
        rows.append(
            F.struct(
                F.lit(position + 1).alias("position"),
                F.lit(label).alias("name"),
                F.when(passed, "PASS").otherwise("FAIL").alias("status"),
                F.col(counter).alias("value"),
                message.alias("message"),
            )
        )
    return counters.select(F.inline(F.array(*rows)))


def quality_score(report: DataFrame) -> DataFrame:
    """Share of passed checks in percent and the overall status."""
    failed = F.count_if(F.col("status") == "FAIL")
    return report.agg(failed.alias("failed_checks"), F.count("*").alias("total_checks")).select(
        F.round(
            (F.col("total_checks") - F.col("failed_checks")) / F.col("total_checks") * 100, 2
        ).alias("score"),
        F.when(F.col("failed_checks") == 0, "PASS").otherwise("FAIL").alias("status"),
        "failed_checks",
        "total_checks",
    )


def quality_check(df: DataFrame) -> DataFrame:
    """Rows, nulls and duplicate rows with a FAIL, CHECK or PASS verdict."""
    groups = row_groups(df, null_values=_count([V.col(c).isNull() for c in df.columns]))
    counted = groups.agg(
        _rows().alias("row_count"),
        _weighted("null_values"),
        _repeats().alias("duplicate_rows"),
    )
    verdict = (
        F.when(F.col("row_count") == 0, "FAIL")
        .when((F.col("null_values") > 0) | (F.col("duplicate_rows") > 0), "CHECK")
        .otherwise("PASS")
    )
    return counted.withColumn("status", verdict)


def weighted_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """70 % completeness plus 30 % freedom from duplicates; PASS from 80 points."""
    missing = [V.is_missing(V.text(df, c)) for c in columns]
    counted = row_groups(df, columns, null_values=_count(missing)).agg(
        _rows().alias("row_count"),
        _weighted("null_values"),
        _repeats().alias("duplicate_rows"),
    )
    rows = F.col("row_count")
    cells = rows * len(columns)
    completeness = F.when(cells > 0, (cells - F.col("null_values")) / cells * 100).otherwise(
        100.0
    )
    unique = F.when(rows > 0, (rows - F.col("duplicate_rows")) / rows * 100).otherwise(100.0)
    score = F.round(completeness * 0.7 + unique * 0.3, 2)
    return counted.withColumn("score", score).withColumn(
        "status", F.when(score >= 80, "PASS").otherwise("WARN")
    )


def quality_gate(status: str, score: float | None = None, minimum: float = 50.0) -> bool:
    """Whether later steps may run after a quality result."""
    if status.upper() in FAILED_STATES:
        return False
    return score is None or score >= minimum


def gold_quality(gold: DataFrame) -> DataFrame:
    """Empty, duplicate and negative findings in an analytics table, with its score."""
    suffixes = ("_sum", "_avg")
    totals = [c for c in gold.columns if c.endswith(suffixes)]
    empty = reduce(lambda a, b: a & b, [V.is_missing(V.text(gold, c)) for c in gold.columns])
    negatives = [F.coalesce(V.number(gold, c) < 0, F.lit(False)) for c in totals]
    groups = row_groups(
        gold, empty_rows=_count([empty]), negative_metric_values=_count(negatives)
    )
    counted = groups.agg(
        _rows().alias("row_count"),
        _weighted("empty_rows"),
        _weighted("negative_metric_values"),
        _repeats().alias("duplicate_rows"),
    )
    findings = [
        (F.col(c) > 0).cast("int")
        for c in ("empty_rows", "duplicate_rows", "negative_metric_values")
    ]
    score = F.lit(100.0) - reduce(lambda a, b: a + b, findings) * 20.0
    return counted.withColumn("score", score).withColumn(
        "status", F.when(score == 100.0, "PASS").otherwise("WARN")
    )


def reconcile(source: DataFrame, detail: DataFrame, analytics: DataFrame) -> DataFrame:
    """Compare the row count of the source with that of the written detail table."""
    counted = source.agg(F.count("*").alias("source_rows")).select(
        "source_rows",
        detail.agg(F.count("*")).scalar().alias("detail_rows"),
        analytics.agg(F.count("*")).scalar().alias("analytics_rows"),
    )
    difference = F.col("detail_rows") - F.col("source_rows")
    return counted.withColumn("detail_row_difference", difference).withColumn(
        "status", F.when(difference == 0, "PASS").otherwise("FAIL")
    )
