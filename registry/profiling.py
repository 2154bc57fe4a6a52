"""Section B: counts, types, statistics and roles of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import profile as P
from orefold.operators import roles as R
from registry.views import dirty_orders, rounded, sales_lines, sales_orders, sql, table, union_all

DIRTY_COLUMNS = ("order_id", "customer_id", "category", "amount", "order_date")


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_counts(table(spark, sf_dir, "lineitem"))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_profile(dirty_orders(spark, sf_dir))


def schema_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = dirty_orders(spark, sf_dir)
    first, second, third = [
        P.discover_schema(dirty, mode)
        .select("name", "type", "nullable")
        .withColumn("mode", F.lit(mode))
        for mode in ("numeric", "strict", "gold")
    ]
    return first.unionByName(second).unionByName(third)


def schema_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.column_stats(dirty_orders(spark, sf_dir))
    return stats.select(
        "name",
        "type",
        "nullable",
        "non_null_count",
        "null_count",
        F.col("cardinality").alias("unique_count"),
    )


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.column_stats(dirty_orders(spark, sf_dir))
    return stats.select("name", "cardinality", "unique_ratio", "null_rate")


def value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return P.value_counts(lines, ["l_returnflag", "l_linestatus", "l_linenumber"])


def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = R.semantic_roles(dirty_orders(spark, sf_dir))
    return roles.select("name", "type", "role", "confidence", "key_type", "unique_required")


def semantic_roles_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = P.discover_schema(dirty_orders(spark, sf_dir))
    return R.classify(schema, with_ratio=False).select("name", "role", "confidence")


def semantic_roles_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = P.discover_schema(table(spark, sf_dir, "customer"))
    return R.generic_roles(schema).select("name", "type", "role")


def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    schema = P.discover_schema(customers)
    generic = R.generic_roles(P.discover_schema(customers.drop("c_nationkey")))
    return R.merge_roles(schema, generic).select("name", "type", "nullable", "role")


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.numeric_summary(dirty_orders(spark, sf_dir)))


def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = sales_orders(spark, sf_dir)
    return P.dimension_values(orders, ["category", "status"])


def dimension_values_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dimension_values(sales_lines(spark, sf_dir), ["product", "category", "region"])


QUERIES = {
    "profile_counts": profile_counts,
    "null_profile": null_profile,
    "schema_discovery": schema_discovery,
    "schema_extended": schema_extended,
    "column_stats": column_stats,
    "value_frequencies": value_frequencies,
    "semantic_roles": semantic_roles,
    "semantic_roles_without_rows": semantic_roles_without_rows,
    "semantic_roles_generic": semantic_roles_generic,
    "schema_merge": schema_merge,
    "numeric_summary": numeric_summary,
    "dimension_values": dimension_values,
    "dimension_values_of_lines": dimension_values_of_lines,
}

# Cells in long form, one row per cell.
CELLS = union_all(
    [f"SELECT '{c}' AS name, {c} AS v FROM dirty_orders" for c in DIRTY_COLUMNS]
)
# What every filled cell of a column allows, from patterns.
FACTS = """
    SELECT name,
           bool_and(regexp_full_match(trim(v), '[+-]?[0-9]+')) AS all_int,
           bool_and(regexp_full_match(v, '[0-9]+')) AS all_digits,
           bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AS all_float,
           bool_and(try_cast(v AS DOUBLE) IS NOT NULL AND contains(v, '.')) AS all_dotted
    FROM cells WHERE v <> '' GROUP BY name"""
_STATS = """
    SELECT name, count(*) AS row_count, count(nullif(v, '')) AS non_null_count,
           count(*) - count(nullif(v, '')) AS null_count,
           count(DISTINCT nullif(v, '')) AS cardinality
    FROM cells GROUP BY name"""
_NUMERIC_TYPE = "CASE WHEN all_int THEN 'integer' WHEN all_float THEN 'float' ELSE 'string' END"
_STRICT_TYPE = "CASE WHEN all_int THEN 'integer' WHEN all_dotted THEN 'float' ELSE 'string' END"
_GOLD_TYPE = "CASE WHEN all_digits THEN 'integer' WHEN all_float THEN 'float' ELSE 'string' END"


def _dirty(body: str) -> str:
    return sql(body, "dirty_orders", cells=CELLS, facts=FACTS, stats=_STATS)


# The types of the customer columns follow from the file's own types.
_CUSTOMER_ROLES = """
    (VALUES ('c_custkey', 'integer', 'identifier'), ('c_name', 'string', 'dimension'),
            ('c_nationkey', 'integer', 'identifier'), ('c_acctbal', 'float', 'attribute'),
            ('c_mktsegment', 'string', 'attribute')) AS t(name, type, role)"""

ORACLE = {
    "profile_counts": """
        SELECT count(*) AS row_count,
               (SELECT CAST(count(*) AS INTEGER) FROM
                (SELECT unnest(map_keys(to_json(l)::MAP(VARCHAR, JSON)))
                 FROM (SELECT * FROM lineitem LIMIT 1) l)) AS column_count
        FROM lineitem""",
    "null_profile": _dirty(
        "SELECT name, count(*) - count(v) AS null_count FROM cells GROUP BY name"
    ),
    "schema_discovery": _dirty(
        union_all(
            [
                f"""SELECT name, {rule} AS type, null_count > 0 AS nullable, '{mode}' AS mode
                    FROM stats JOIN facts USING (name)"""
                for mode, rule in (
                    ("numeric", _NUMERIC_TYPE),
                    ("strict", _STRICT_TYPE),
                    ("gold", _GOLD_TYPE),
                )
            ]
        )
    ),
    "schema_extended": _dirty(
        f"""SELECT name, {_NUMERIC_TYPE} AS type, null_count > 0 AS nullable, non_null_count,
                   null_count, cardinality AS unique_count
            FROM stats JOIN facts USING (name)"""
    ),
    "column_stats": _dirty(
        """SELECT name, cardinality, round(cardinality / row_count, 4) AS unique_ratio,
                  round(null_count / row_count, 4) AS null_rate FROM stats"""
    ),
    "value_frequencies": union_all(
        [
            f"""SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS occurrences
                FROM lineitem GROUP BY {c}"""
            for c in ("l_returnflag", "l_linestatus", "l_linenumber")
        ]
    ),
    "semantic_roles": _dirty(
        f"""SELECT name, {_NUMERIC_TYPE} AS type,
                   CASE WHEN name LIKE '%\\_id' ESCAPE '\\' THEN 'KEY'
                        WHEN name = 'category' AND NOT all_float THEN 'DIMENSION'
                        WHEN all_float THEN 'MEASURE'
                        WHEN cardinality / row_count > 0.8 THEN 'ATTRIBUTE'
                        ELSE 'DIMENSION' END AS role,
                   CASE WHEN name LIKE '%\\_id' ESCAPE '\\' THEN 0.99
                        WHEN name = 'category' AND NOT all_float THEN 0.98
                        WHEN name = 'amount' AND all_float THEN 0.99
                        WHEN all_float OR cardinality / row_count > 0.8 THEN 0.85
                        ELSE 0.8 END::DOUBLE AS confidence,
                   CASE name WHEN 'order_id' THEN 'PRIMARY' WHEN 'customer_id' THEN 'REFERENCE'
                        END AS key_type,
                   CASE name WHEN 'order_id' THEN true WHEN 'customer_id' THEN false
                        END AS unique_required
            FROM stats JOIN facts USING (name)"""
    ),
    "semantic_roles_without_rows": _dirty(
        """SELECT name,
                  CASE WHEN name LIKE '%\\_id' ESCAPE '\\' THEN 'KEY'
                       WHEN all_float THEN 'MEASURE' ELSE 'DIMENSION' END AS role,
                  CASE WHEN name LIKE '%\\_id' ESCAPE '\\' THEN 0.99
                       WHEN name = 'category' THEN 0.98
                       WHEN name = 'amount' AND all_float THEN 0.99
                       WHEN all_float THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence
           FROM facts"""
    ),
    "semantic_roles_generic": f"SELECT * FROM {_CUSTOMER_ROLES}",
    "schema_merge": f"""
        SELECT name, type, (SELECT count(*) - count(c_custkey) FROM customer) > 0 AS nullable,
               CASE WHEN name = 'c_nationkey' THEN NULL WHEN role = 'identifier' THEN 'KEY'
                    ELSE upper(role) END AS role
        FROM {_CUSTOMER_ROLES}""",
    "numeric_summary": _dirty(
        """SELECT name, min(n) AS min, max(n) AS max, round(avg(n), 2) AS avg, count(n) AS count
           FROM (SELECT name, try_cast(v AS DOUBLE) AS n FROM cells WHERE v <> '')
           GROUP BY name HAVING count(n) > 0"""
    ),
    "dimension_values": sql(
        """SELECT DISTINCT 'category' AS dimension, trim(category) AS value,
                  CAST(length(trim(category)) AS INTEGER) AS value_length
           FROM sales_orders WHERE trim(category) <> ''
           UNION ALL
           SELECT DISTINCT 'status', trim(status), CAST(length(trim(status)) AS INTEGER)
           FROM sales_orders WHERE trim(status) <> ''""",
        "sales_orders",
    ),
    "dimension_values_of_lines": sql(
        union_all(
            [
                f"""SELECT DISTINCT '{c}' AS dimension, {c} AS value,
                           CAST(length({c}) AS INTEGER) AS value_length FROM sales_lines"""
                for c in ("product", "category", "region")
            ]
        ),
        "sales_lines",
    ),
}
