"""Section C: quality and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import quality as Q
from orefold.operators import validation as V
from orefold.operators.roles import ColumnRole
from orefold.plans.gold import GoldLayout, analytics
from orefold.session import scratch_path
from orefold.sources.csv import RAGGED, read_with_ragged_flag
from orefold.sources.sinks import write_gold
from registry.profiling import CELLS, DIRTY_COLUMNS
from registry.views import dirty_orders, sales_lines, sql, table

# The schema the raw orders were declared with.
DECLARED = (
    ColumnRole("order_id", "integer", "KEY", 0.99, "PRIMARY"),
    ColumnRole("customer_id", "integer", "KEY", 0.99, "REFERENCE"),
    ColumnRole("category", "string", "DIMENSION", 0.98),
    ColumnRole("amount", "float", "MEASURE", 0.99),
    ColumnRole("order_date", "string", "ATTRIBUTE", 0.85),
)
UNFLAGGED = tuple(ColumnRole(c.name, c.type, c.role) for c in DECLARED)


def dq_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_row_count(dirty_orders(spark, sf_dir))


def dq_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_partkey", "l_quantity", "l_discount", "l_tax"]
    return Q.duplicate_row_count(table(spark, sf_dir, "lineitem").select(*columns))


def dq_key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_uniqueness(dirty_orders(spark, sf_dir), ["order_id", "customer_id"])


def infer_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.infer_primary_key(dirty_orders(spark, sf_dir), UNFLAGGED)


def infer_primary_key_by_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [ColumnRole(c, "integer", "KEY") for c in ("o_orderkey", "o_custkey")]
    return Q.infer_primary_key(table(spark, sf_dir, "orders"), columns)


def dq_type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.type_errors(dirty_orders(spark, sf_dir), DECLARED)


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_report(Q.quality_counters(dirty_orders(spark, sf_dir), DECLARED))


def dq_report_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on text lines of which some are empty and some have too many fields."""
    key = F.col("o_orderkey")
    whole = F.concat_ws(",", key.cast("string"), "o_orderpriority", F.col("o_custkey").cast("string"))
    line = F.when(key % 15 == 0, ",,").when(key % 10 == 1, F.concat(whole, F.lit(",x"))).otherwise(whole)
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "orders").select(line).write.text(path)
    raw = read_with_ragged_flag(spark, path, ["order_id", "priority", "customer_id"])
    columns = [ColumnRole("order_id", "integer", "KEY", 0.99, "PRIMARY"), ColumnRole("priority"),
               ColumnRole("customer_id", "integer", "KEY", 0.99, "REFERENCE")]
    return Q.quality_report(Q.quality_counters(raw, columns, RAGGED)).select("name", "status", "value")


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For tables of differing quality, whether later steps may run."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    half = customers.select(
        *[F.when(F.col("c_custkey") % 4 == 0, F.col(c)).alias(c) for c in customers.columns]
    )
    rows = []
    for name, df in (("whole", customers), ("mostly empty", half), ("none", customers.limit(0))):
        found = Q.weighted_score(df, df.columns).first()
        checked = Q.quality_check(df).first()["status"]
        rows.append((name, found["status"], checked, Q.quality_gate(found["status"], found["score"]),
                     Q.quality_gate(checked)))
    return spark.createDataFrame(
        rows, "name string, scored string, checked string, by_score boolean, by_check boolean"
    )


def dq_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_score(dq_report(spark, sf_dir))


def quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_check(dirty_orders(spark, sf_dir))


def dq_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.weighted_score(dirty_orders(spark, sf_dir), DIRTY_COLUMNS)


def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = ["order_id", "customer_id", "category", "amount", "currency"]
    return V.schema_conformance(dirty_orders(spark, sf_dir), expected)


def validation_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blank_cells(dirty_orders(spark, sf_dir))


def validation_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = dirty_orders(spark, sf_dir)
    return V.duplicate_keys(dirty, V.key_column(DECLARED, dirty.columns))


def type_error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.type_error_samples(dirty_orders(spark, sf_dir), DECLARED, "order_id")


def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validation_verdict(dirty_orders(spark, sf_dir), DECLARED)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = GoldLayout(("category", "region"), ("amount", "quantity"))
    return analytics(sales_lines(spark, sf_dir), layout)


def gold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gold_quality(_gold(spark, sf_dir))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    written = write_gold(scratch_path(spark, "reconcile"), lines, _gold(spark, sf_dir))
    detail, gold = [spark.read.parquet(written[p]) for p in ("detail", "analytics")]
    return Q.reconcile(lines, detail, gold)


QUERIES = {
    "dq_duplicate_rows": dq_duplicate_rows,
    "dq_duplicate_lines": dq_duplicate_lines,
    "dq_key_uniqueness": dq_key_uniqueness,
    "infer_primary_key": infer_primary_key,
    "infer_primary_key_by_values": infer_primary_key_by_values,
    "dq_type_errors": dq_type_errors,
    "dq_report": dq_report,
    "dq_score": dq_score,
    "dq_report_raw_lines": dq_report_raw_lines,
    "quality_gates": quality_gates,
    "quality_check": quality_check,
    "dq_weighted_score": dq_weighted_score,
    "schema_conformance": schema_conformance,
    "validation_nulls": validation_nulls,
    "validation_duplicate_key": validation_duplicate_key,
    "type_error_samples": type_error_samples,
    "validation_verdict": validation_verdict,
    "gold_quality": gold_quality,
    "reconcile": reconcile,
}

_COUNTERS = """
    SELECT (SELECT count(*) FROM dirty_orders) AS row_count,
           (SELECT count(*) FROM dirty_orders
            WHERE coalesce(order_id, '') = '' AND coalesce(customer_id, '') = ''
              AND coalesce(category, '') = '' AND coalesce(amount, '') = ''
              AND coalesce(order_date, '') = '') AS empty_rows,
           (SELECT count(*) FROM cells WHERE v IS NULL OR v = '') AS null_values,
           (SELECT count(*) FROM cells WHERE v IS NULL OR trim(v) = '') AS blanks,
           (SELECT count(*) FROM cells WHERE v IS NULL) AS nulls,
           (SELECT (SELECT count(*) FROM dirty_orders) - count(*)
            FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_rows,
           (SELECT count(*) - count(DISTINCT trim(order_id)) FROM dirty_orders
            WHERE order_id <> '') AS duplicate_ids,
           (SELECT count(*) FROM cells WHERE v <> '' AND
                (name = 'amount' AND try_cast(v AS DOUBLE) IS NULL
                 OR name IN ('order_id', 'customer_id') AND try_cast(v AS BIGINT) IS NULL))
               AS type_errors"""


def _counters(body: str) -> str:
    return sql(body, "dirty_orders", cells=CELLS, counters=_COUNTERS)


_CHECKS = (
    ("Row Count", "row_count", "rows detected", "row_count > 0"),
    ("Empty Rows", "empty_rows", "empty rows", "empty_rows = 0"),
    ("Null Values", "null_values", "null values", "null_values = 0"),
    ("Duplicate Rows", "duplicate_rows", "duplicate rows", "duplicate_rows = 0"),
    ("Duplicate ID", "duplicate_ids", "duplicate IDs", "duplicate_ids = 0"),
    ("Data Types", "type_errors", "type errors", "type_errors = 0"),
    ("Column Consistency", "0", "inconsistent rows", "true"),
)
_REPORT = " UNION ALL ".join(
    f"""SELECT {i + 1} AS position, '{name}' AS name,
               CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS status,
               CAST({value} AS BIGINT) AS value,
               CAST({value} AS VARCHAR) || ' {unit}' AS message FROM counters"""
    for i, (name, value, unit, passed) in enumerate(_CHECKS)
)
_GOLD_ROWS = "(SELECT count(DISTINCT (category, region)) FROM sales_lines)"

ORACLE = {
    "dq_report_raw_lines": """
        WITH c AS (
          SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 15 = 0) AS e,
                 count(*) FILTER (WHERE o_orderkey % 15 <> 0 AND o_orderkey % 10 = 1) AS r FROM orders)
        SELECT name, CASE WHEN (name = 'Row Count') = (value > 0) THEN 'PASS' ELSE 'FAIL' END AS status,
               CAST(value AS BIGINT) AS value
        FROM (SELECT unnest(['Row Count', 'Empty Rows', 'Null Values', 'Duplicate Rows', 'Duplicate ID',
                             'Data Types', 'Column Consistency']) AS name,
                     unnest([n, e, 3 * e, greatest(e - 1, 0), 0, 0, r]) AS value FROM c)""",
    "quality_gates": """
        SELECT * FROM (VALUES ('whole', 'PASS', 'PASS', true, true),
                              ('mostly empty', 'WARN', 'CHECK', false, true),
                              ('none', 'PASS', 'FAIL', true, false))
          AS t(name, scored, checked, by_score, by_check)""",
    "dq_duplicate_rows": _counters("SELECT duplicate_rows FROM counters"),
    "dq_duplicate_lines": """
        SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM
          (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity, l_discount, l_tax)""",
    "dq_key_uniqueness": sql(
        """SELECT name, count(*) AS non_missing, count(DISTINCT trim(v)) AS distinct_values,
                  count(*) - count(DISTINCT trim(v)) AS duplicates
           FROM cells WHERE name IN ('order_id', 'customer_id') AND v <> '' GROUP BY name""",
        "dirty_orders",
        cells=CELLS,
    ),
    "infer_primary_key": sql(
        """SELECT name, count(*) AS non_missing, count(DISTINCT v) AS distinct_values,
                  name = 'order_id' AS is_primary_key
           FROM cells WHERE name IN ('order_id', 'customer_id') AND v <> '' GROUP BY name""",
        "dirty_orders",
        cells=CELLS,
    ),
    "infer_primary_key_by_values": """
        SELECT 'o_orderkey' AS name, count(o_orderkey) AS non_missing,
               count(DISTINCT o_orderkey) AS distinct_values,
               count(o_orderkey) = count(DISTINCT o_orderkey) AS is_primary_key FROM orders
        UNION ALL
        SELECT 'o_custkey', count(o_custkey), count(DISTINCT o_custkey),
               count(o_custkey) = count(DISTINCT o_custkey) FROM orders""",
    "dq_type_errors": sql(
        """SELECT name,
                  count(*) FILTER (WHERE v <> '' AND
                      CASE name WHEN 'amount' THEN try_cast(v AS DOUBLE) IS NULL
                                ELSE try_cast(v AS BIGINT) IS NULL END) AS type_errors
           FROM cells WHERE name IN ('order_id', 'customer_id', 'amount') GROUP BY name""",
        "dirty_orders",
        cells=CELLS,
    ),
    "dq_report": _counters(_REPORT),
    "dq_score": _counters(
        f"""SELECT round((7 - failed) / 7 * 100, 2) AS score,
                   CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
                   failed AS failed_checks, CAST(7 AS BIGINT) AS total_checks
            FROM (SELECT count(*) FILTER (WHERE status = 'FAIL') AS failed FROM ({_REPORT}))"""
    ),
    "quality_check": _counters(
        """SELECT row_count, nulls AS null_values, duplicate_rows,
                  CASE WHEN row_count = 0 THEN 'FAIL' WHEN nulls + duplicate_rows > 0 THEN 'CHECK'
                       ELSE 'PASS' END AS status FROM counters"""
    ),
    "dq_weighted_score": _counters(
        """SELECT row_count, null_values, duplicate_rows, score,
                  CASE WHEN score >= 80 THEN 'PASS' ELSE 'WARN' END AS status
           FROM (SELECT *, round((row_count * 5 - null_values) / (row_count * 5) * 100 * 0.7
                        + (row_count - duplicate_rows) / row_count * 100 * 0.3, 2) AS score
                 FROM counters)"""
    ),
    "schema_conformance": sql(
        """SELECT name AS "column",
                  CASE name WHEN 'order_date' THEN 'UNEXPECTED' ELSE 'PRESENT' END AS state,
                  count(nullif(v, '')) AS non_missing FROM cells GROUP BY name
           UNION ALL SELECT 'currency', 'MISSING', 0""",
        "dirty_orders",
        cells=CELLS,
    ),
    "validation_nulls": _counters("SELECT blanks AS null_values FROM counters"),
    "validation_duplicate_key": sql(
        """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_keys
           FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY order_id)""",
        "dirty_orders",
    ),
    "type_error_samples": sql(
        """SELECT order_id AS row_key, name AS "column", value, expected FROM (
             SELECT order_id, 'amount' AS name, amount AS value, 'float' AS expected
             FROM dirty_orders WHERE amount <> '' AND try_cast(amount AS DOUBLE) IS NULL
             UNION ALL
             SELECT order_id, 'order_id', order_id, 'integer'
             FROM dirty_orders WHERE order_id <> '' AND try_cast(order_id AS BIGINT) IS NULL
             UNION ALL
             SELECT order_id, 'customer_id', customer_id, 'integer'
             FROM dirty_orders WHERE customer_id <> '' AND try_cast(customer_id AS BIGINT) IS NULL)
           ORDER BY row_key, "column", value LIMIT 10""",
        "dirty_orders",
    ),
    "validation_verdict": _counters(
        """SELECT row_count, 0 AS missing_columns, 0 AS unexpected_columns,
                  CAST(0 AS BIGINT) AS inconsistent_rows, blanks AS null_values, type_errors,
                  duplicate_ids AS duplicate_keys,
                  row_count > 0 AND type_errors = 0 AND duplicate_ids = 0 AS valid
           FROM counters"""
    ),
    "gold_quality": sql(
        f"""SELECT {_GOLD_ROWS} AS row_count, CAST(0 AS BIGINT) AS empty_rows,
                   count(*) FILTER (WHERE s < 0) AS negative_metric_values,
                   CAST(0 AS BIGINT) AS duplicate_rows,
                   CASE WHEN count(*) FILTER (WHERE s < 0) > 0 THEN 80.0 ELSE 100.0
                        END::DOUBLE AS score,
                   CASE WHEN count(*) FILTER (WHERE s < 0) > 0 THEN 'WARN' ELSE 'PASS'
                        END AS status
            FROM (SELECT unnest([sum(amount), avg(amount), sum(quantity), avg(quantity)]) AS s
                  FROM sales_lines GROUP BY category, region)""",
        "sales_lines",
    ),
    "reconcile": sql(
        f"""SELECT count(*) AS source_rows, count(*) AS detail_rows,
                   {_GOLD_ROWS} AS analytics_rows,
                   CAST(0 AS BIGINT) AS detail_row_difference, 'PASS' AS status
            FROM sales_lines""",
        "sales_lines",
    ),
}
