"""Section D: cleaning, casts, dates, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import values as V
from orefold.operators import clean as C
from orefold.operators.roles import ColumnRole
from orefold.operators import roles as R
from registry.quality import DECLARED
from registry.views import dirty_orders, priced_orders, rounded, sales_orders, sql, table


def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_strings(dirty_orders(spark, sf_dir))


def remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_duplicates(dirty_orders(spark, sf_dir))


def removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = dirty_orders(spark, sf_dir)
    return C.removal_report(dirty, C.remove_duplicates(dirty))


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns in which every cell of a row may be null or empty."""
    dirty = dirty_orders(spark, sf_dir)
    return dirty.select("category", F.when(F.col("amount") != "n/a", F.col("amount")).alias("amount"))


def remove_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_empty_rows(_gappy(spark, sf_dir))


def remove_empty_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remove_empty_rows(_gappy(spark, sf_dir), empty_text=True)


def standard_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.standard_transform(_gappy(spark, sf_dir))


def transform_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.transform_rules(R.semantic_roles(dirty_orders(spark, sf_dir)))
    return rules.withColumn("rules", F.array_join("rules", ","))


def role_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.role_transform(dirty_orders(spark, sf_dir), DECLARED), 2)


def role_transform_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded moments stripped as TIME, and counts truncated as an integer MEASURE."""
    roles = [
        ColumnRole("order_id", "integer", "KEY"),
        ColumnRole("order_date", "string", "TIME"),
        ColumnRole("quantity", "integer", "MEASURE"),
    ]
    orders = priced_orders(spark, sf_dir).withColumn(
        "quantity", F.concat("quantity", F.when(F.col("order_id") % 3 == 0, ".9").otherwise(""))
    )
    return C.role_transform(orders, roles)


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = V.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(normal).alias("length"), F.md5(normal).alias("digest")
    )


def to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = C.to_numbers(dirty_orders(spark, sf_dir), ["amount", "customer_id"])
    return numbers.select("order_id", "amount", "customer_id")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = C.parse_dates(dirty_orders(spark, sf_dir), "order_date")
    return parsed.select(
        "order_id", F.date_format(F.to_date("order_date"), "yyyy-MM-dd").alias("order_date")
    )


def calendar_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = dirty_orders(spark, sf_dir).select("order_id", "order_date")
    return C.calendar_attributes(dates, "order_date")


def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"category": " 5-low ", "status": "f"}
    kept = C.filter_rows(sales_orders(spark, sf_dir), filters)
    return kept.select("order_id", "category", "status", "amount")


QUERIES = {
    "clean_strings": clean_strings,
    "remove_duplicates": remove_duplicates,
    "removal_report": removal_report,
    "remove_empty_rows": remove_empty_rows,
    "remove_empty_text_rows": remove_empty_text_rows,
    "standard_transform": standard_transform,
    "transform_rules": transform_rules,
    "role_transform": role_transform,
    "role_transform_time": role_transform_time,
    "normalize_text": normalize_text,
    "to_number": to_number,
    "parse_dates": parse_dates,
    "calendar_attributes": calendar_attributes,
    "filtered_rows": filtered_rows,
}

_GAPPY = "SELECT category, nullif(amount, 'n/a') AS amount FROM dirty_orders"
_PARSED = """
    SELECT *, CASE WHEN regexp_matches(order_date, '^[0-9]{4}-') THEN strptime(order_date, '%Y-%m-%d')
                   WHEN regexp_matches(order_date, '^[0-9]{4}/') THEN strptime(order_date, '%Y/%m/%d')
                   WHEN contains(order_date, '-') THEN strptime(order_date, '%d-%m-%Y')
                   ELSE strptime(order_date, '%d/%m/%Y') END AS d FROM dirty_orders"""
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

ORACLE = {
    "clean_strings": sql(
        """SELECT trim(order_id) AS order_id, trim(customer_id) AS customer_id,
                  trim(category) AS category, trim(amount) AS amount,
                  trim(order_date) AS order_date FROM dirty_orders""",
        "dirty_orders",
    ),
    "remove_duplicates": sql("SELECT DISTINCT * FROM dirty_orders", "dirty_orders"),
    "removal_report": sql(
        """SELECT n AS rows_before, d AS rows_after, n - d AS rows_removed FROM (
             SELECT (SELECT count(*) FROM dirty_orders) AS n,
                    (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS d)""",
        "dirty_orders",
    ),
    "remove_empty_rows": sql(
        "SELECT * FROM gappy WHERE category IS NOT NULL OR amount IS NOT NULL",
        "dirty_orders",
        gappy=_GAPPY,
    ),
    "remove_empty_text_rows": sql(
        "SELECT * FROM gappy WHERE coalesce(category, '') <> '' OR coalesce(amount, '') <> ''",
        "dirty_orders",
        gappy=_GAPPY,
    ),
    "standard_transform": sql(
        """SELECT DISTINCT trim(category) AS category, trim(amount) AS amount FROM gappy
           WHERE category IS NOT NULL OR amount IS NOT NULL""",
        "dirty_orders",
        gappy=_GAPPY,
    ),
    "transform_rules": sql(
        """SELECT * FROM (VALUES
             ('order_id', 'KEY', 0.99::DOUBLE, 'TRIM,CAST_INTEGER,KEY_VALIDATION'),
             ('customer_id', 'KEY', 0.99, 'TRIM,CAST_INTEGER,KEY_VALIDATION'),
             ('category', 'DIMENSION', 0.98, 'TRIM,NORMALIZE_TEXT,EMPTY_VALUE_CHECK')
           ) AS t("column", role, confidence, rules)
           UNION ALL
           SELECT name, CASE WHEN many THEN 'ATTRIBUTE' ELSE 'DIMENSION' END,
                  CASE WHEN many THEN 0.85 ELSE 0.8 END,
                  CASE WHEN many THEN 'TRIM,NORMALIZE_TEXT'
                       ELSE 'TRIM,NORMALIZE_TEXT,EMPTY_VALUE_CHECK' END
           FROM (SELECT 'amount' AS name, count(DISTINCT amount) / count(*) > 0.8 AS many
                 FROM dirty_orders
                 UNION ALL
                 SELECT 'order_date', count(DISTINCT order_date) / count(*) > 0.8
                 FROM dirty_orders)""",
        "dirty_orders",
    ),
    "role_transform_time": sql(
        """SELECT order_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS order_date, quantity
           FROM priced_orders""",
        "priced_orders",
    ),
    "role_transform": sql(
        """SELECT try_cast(order_id AS BIGINT) AS order_id,
                  try_cast(customer_id AS BIGINT) AS customer_id,
                  nullif(trim(category), '') AS category,
                  round(try_cast(amount AS DOUBLE), 2) AS amount, order_date
           FROM dirty_orders""",
        "dirty_orders",
    ),
    "normalize_text": f"""
        SELECT doc_id, CAST(length(t) AS INTEGER) AS length, md5(t) AS digest
        FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS t
              FROM documents)""",
    "to_number": sql(
        """SELECT order_id, try_cast(amount AS DOUBLE) AS amount,
                  try_cast(customer_id AS DOUBLE) AS customer_id FROM dirty_orders""",
        "dirty_orders",
    ),
    "parse_dates": sql(
        "SELECT order_id, strftime(d, '%Y-%m-%d') AS order_date FROM parsed",
        "dirty_orders",
        parsed=_PARSED,
    ),
    "calendar_attributes": sql(
        """SELECT order_id, order_date, CAST(year(d) AS INTEGER) AS date_year,
                  'Q' || quarter(d) AS date_quarter, CAST(month(d) AS INTEGER) AS date_month,
                  monthname(d) AS date_month_name, CAST(weekofyear(d) AS INTEGER) AS date_week,
                  CAST(day(d) AS INTEGER) AS date_day, dayname(d) AS date_day_of_week,
                  strftime(d, '%Y-%m') AS date_year_month,
                  year(d) || '-Q' || quarter(d) AS date_year_quarter
           FROM parsed""",
        "dirty_orders",
        parsed=_PARSED,
    ),
    "filtered_rows": sql(
        """SELECT order_id, category, status, amount FROM sales_orders
           WHERE lower(trim(category)) = '5-low' AND lower(trim(status)) = 'f'""",
        "sales_orders",
    ),
}
