"""Business views over the given tables, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECIMALS = 4
NUDGE = 1e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("order_date"),
    )


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("product"),
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("region"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").alias("transaction_date"),
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as raw text with defects: padding, gaps, bad amounts, copies, four
    date formats. Every order is in it, some twice."""
    key = F.col("o_orderkey")
    category, date = F.col("o_orderpriority"), F.col("o_orderdate")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    copies = F.when(key % 20 == 0, 2).otherwise(1)
    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        key.cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 11 == 0, F.lit(""))
        .when(key % 7 == 0, F.concat(F.lit("  "), category, F.lit(" ")))
        .otherwise(category)
        .alias("category"),
        F.when(key % 17 == 0, "n/a").otherwise(money).alias("amount"),
        F.when(key % 4 == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format(date, "yyyy/MM/dd"))
        .when(key % 4 == 2, F.date_format(date, "dd-MM-yyyy"))
        .otherwise(F.date_format(date, "dd/MM/yyyy"))
        .alias("order_date"),
    )


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as raw text whose numbers are numbers: padded, some of them empty."""
    key, category = F.col("o_orderkey"), F.col("o_orderpriority")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    moment = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=key % 86400)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 11 == 0, F.lit(""))
        .when(key % 7 == 0, F.concat(F.lit("  "), category, F.lit(" ")))
        .otherwise(category)
        .alias("category"),
        F.when(key % 17 == 0, "").otherwise(F.lpad(money, 14, " ")).alias("amount"),
        (key % 9 + 1).cast("string").alias("quantity"),
        F.concat(F.lit(" "), F.date_format(moment, "yyyy-MM-dd HH:mm:ss")).alias("order_date"),
    )


SQL_VIEWS = {
    "priced_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
               CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 THEN o_orderpriority
               END AS category,
               CASE WHEN o_orderkey % 17 <> 0 THEN
                 CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount,
               o_orderkey % 9 + 1 AS quantity,
               CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS moment
        FROM orders""",
    "sales_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
               o_orderpriority AS category, o_totalprice AS amount, o_orderdate AS order_date
        FROM orders""",
    "sales_lines": """
        SELECT l_orderkey AS order_id, 'part ' || CAST(l_partkey AS VARCHAR) AS product,
               l_returnflag AS category, l_linestatus AS region, l_quantity AS quantity,
               l_extendedprice AS amount, l_discount AS discount,
               l_shipdate AS transaction_date
        FROM lineitem""",
    "dirty_orders": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ''
                    WHEN o_orderkey % 7 = 0 THEN '  ' || o_orderpriority || ' '
                    ELSE o_orderpriority END AS category,
               CASE WHEN o_orderkey % 17 = 0 THEN 'n/a'
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
               CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                    WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
                    WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y')
                    ELSE strftime(o_orderdate, '%d/%m/%Y') END AS order_date
        FROM orders, (VALUES (1), (2)) AS copies(copy)
        WHERE copy = 1 OR o_orderkey % 20 = 0""",
}


def sql(body: str, *views: str, **more: str) -> str:
    """SQL with the named views, and further ones given as text, in front."""
    named = {**{v: SQL_VIEWS[v] for v in views}, **more}
    parts = ",\n".join(f"{name} AS ({text})" for name, text in named.items())
    return f"WITH {parts}\n{body}" if parts else body


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Doubles to a fixed number of decimals, as the last bits of a sum depend on the
    order of its rows. An average of cents often lies exactly half-way between two
    rounded values; the nudge, far above those bits, makes it go the same way always.
    The SQL adds the same nudge."""
    doubles = {
        f.name: F.round(F.col(f.name) + NUDGE, decimals)
        for f in df.schema.fields
        if f.dataType.simpleString() == "double"
    }
    return df.withColumns(doubles) if doubles else df
