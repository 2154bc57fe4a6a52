"""Section A: scans, sinks, file facts, samples. Files are written by Spark from the
given tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators.profile import numeric_summary
from orefold.operators.series import monthly_series
from orefold.plans.gold import GoldLayout, analytics
from orefold.session import scratch_path
from orefold.sources import csv as C
from orefold.sources import files, sinks
from registry.views import dirty_orders, rounded, sales_lines, sales_orders, sql, table


FILES = 16


def scan_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "inferred")
    sinks.write_table(sales_orders(spark, sf_dir), path, format="csv")
    scanned = C.read_inferred(spark, path)
    return scanned.select(
        F.col("order_id").cast("bigint"),
        F.col("customer_id").cast("bigint"),
        "status",
        "category",
        F.round("amount", 2).alias("amount"),
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
    )


def scan_csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "strings")
    sinks.write_table(dirty_orders(spark, sf_dir), path, format="csv")
    return C.read_strings(spark, path)


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "folder")
    orders = sales_orders(spark, sf_dir).select("order_id", "customer_id", "status")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")
    )
    sinks.write_table(orders, path, format="csv", mode="append")
    sinks.write_table(customers, path, format="csv", mode="append")
    return C.read_folder(spark, path).drop(C.SOURCE_FILE)


def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    line = F.concat(
        key.cast("string"),
        F.lit(","),
        F.when(key % 7 == 0, F.lit('"a, ""quoted"" text"')).otherwise(F.col("o_orderpriority")),
        F.when(key % 8 == 0, "").otherwise(
            F.concat(F.lit(","), F.col("o_custkey").cast("string"))
        ),
        F.when((key % 8 != 0) & (key % 9 == 0), ",x").otherwise(""),
        F.when((key % 8 != 0) & (key % 10 == 1), ",").otherwise(""),
    )
    path = scratch_path(spark, "ragged")
    table(spark, sf_dir, "orders").select(line).write.text(path)
    scanned = C.read_with_ragged_flag(spark, path, ["order_id", "note", "customer_id"])
    return scanned.withColumnRenamed(C.RAGGED, "ragged")


def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "roundtrip")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sinks.write_table(customers, path, format="csv")
    return C.read_strings(spark, path)


def sink_csv_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of a few rows as one file."""
    path = scratch_path(spark, "report")
    segments = table(spark, sf_dir, "customer").groupBy("c_mktsegment").count()
    sinks.write_table(segments, path, format="csv", single_file=True)
    rows = C.read_strings(spark, path)
    one_file = F.count_distinct(F.col("_metadata.file_path")) == 1
    files_read = spark.read.text(path).agg(one_file.alias("one_file")).first()["one_file"]
    return rows.withColumn("one_file", F.lit(files_read))


def silver_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "silver")
    sinks.write_silver(dirty_orders(spark, sf_dir), path, ["order_date", "order_id"])
    return spark.read.parquet(path)


def gold_detail_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_lines(spark, sf_dir)
    layout = GoldLayout(("category", "region"), ("amount",))
    written = sinks.write_gold(
        scratch_path(spark, "gold"),
        lines,
        analytics(lines, layout),
        monthly_series(lines, "transaction_date", ["amount"]),
    )
    products = [
        spark.read.parquet(path).agg(
            F.lit(name).alias("product"),
            F.count("*").alias("row_count"),
            F.sum("amount" if name == "detail" else "amount_sum").alias("amount"),
        )
        for name, path in written.items()
    ]
    first, second, third = products
    return rounded(first.unionByName(second).unionByName(third))


def gold_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    summary = numeric_summary(sales_lines(spark, sf_dir))
    sinks.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ingest")
    customers = table(spark, sf_dir, "customer").repartition("c_mktsegment")
    sinks.write_table(customers, path, format="csv", partition_by=["c_mktsegment"])
    audit = files.ingestion_audit(spark, path, "RAW_UPLOAD")
    return audit.select(
        F.regexp_extract("raw_path", "c_mktsegment=([^/]+)/", 1).alias("segment"),
        F.col("file_name").endswith(".csv").alias("is_csv"),
        (F.col("size_bytes") > 0).alias("has_content"),
        (F.col("ingested_at") >= F.col("modified_at")).alias("ingested_after_write"),
        "source",
        "status",
    )


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_fingerprint(dirty_orders(spark, sf_dir))


def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one file for each remainder of their ids, each in a folder."""
    path = scratch_path(spark, "prints")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.concat_ws("|", "doc_id", F.regexp_replace("text", "[\\r\\n]", " "))
    part = F.pmod("doc_id", F.lit(FILES)).alias("part")
    lines = documents.select(part, line.alias("line")).repartition("part")
    lines.write.partitionBy("part").text(path)
    prints = files.file_fingerprints(spark, path, "*.txt")
    return prints.select(
        F.regexp_extract("source", r"/part=(\d+)/", 1).cast("bigint").alias("part"),
        "row_count",
        "fingerprint",
    )


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preview(table(spark, sf_dir, "customer"), ["c_custkey"])


def dataset_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = C.dataset_reference(table(spark, sf_dir, "customer"), ["c_custkey"])
    names = F.transform("sample_rows", lambda r: F.get_json_object(r, "$.c_name"))
    return reference.select("row_count", F.array_join(names, ";").alias("sample"))


QUERIES = {
    "scan_csv_inferred": scan_csv_inferred,
    "scan_csv_strings": scan_csv_strings,
    "scan_folder": scan_folder,
    "ragged_rows": ragged_rows,
    "sink_csv_roundtrip": sink_csv_roundtrip,
    "sink_csv_single_file": sink_csv_single_file,
    "silver_write": silver_write,
    "gold_detail_roundtrip": gold_detail_roundtrip,
    "gold_summary_json": gold_summary_json,
    "ingest_audit": ingest_audit,
    "table_fingerprint": table_fingerprint,
    "file_fingerprints": file_fingerprints,
    "preview": preview,
    "dataset_reference": dataset_reference,
}

_HASH = "CAST(CAST('0x' || substr(sha256({}), 1, 15) AS BIGINT) AS HUGEINT)"
_DIRTY_NAMES = ("order_id", "customer_id", "category", "amount", "order_date")
_DIRTY_ROW = " || ".join(
    f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in _DIRTY_NAMES
)
_DIRTY_SHAPE = "struct<" + ",".join(f"{c}:string" for c in _DIRTY_NAMES) + ">"
_SUMMARY = """
SELECT '{0}' AS name, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max,
       round(avg({0}), 2) AS avg, count({0}) AS count FROM sales_lines"""

ORACLE = {
    "scan_csv_inferred": sql(
        """SELECT order_id, customer_id, status, category, round(amount, 2) AS amount,
                  strftime(order_date, '%Y-%m-%d') AS order_date FROM sales_orders""",
        "sales_orders",
    ),
    # An empty field of a file reads back as null.
    "scan_csv_strings": sql(
        "SELECT * REPLACE (nullif(category, '') AS category) FROM dirty_orders", "dirty_orders"
    ),
    "scan_folder": sql(
        """SELECT CAST(order_id AS VARCHAR) AS order_id,
                  CAST(customer_id AS VARCHAR) AS customer_id, status, NULL AS segment
           FROM sales_orders
           UNION ALL
           SELECT NULL, CAST(c_custkey AS VARCHAR), NULL, c_mktsegment FROM customer""",
        "sales_orders",
    ),
    "ragged_rows": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
               CASE WHEN o_orderkey % 7 = 0 THEN 'a, "quoted" text' ELSE o_orderpriority END AS note,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END
                   AS customer_id,
               o_orderkey % 8 <> 0 AND (o_orderkey % 9 = 0 OR o_orderkey % 10 = 1) AS ragged
        FROM orders""",
    "sink_csv_roundtrip": """
        SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer""",
    "sink_csv_single_file": """
        SELECT c_mktsegment, CAST(count(*) AS VARCHAR) AS "count", true AS one_file
        FROM customer GROUP BY c_mktsegment""",
    "silver_write": sql("SELECT * FROM dirty_orders", "dirty_orders"),
    "gold_detail_roundtrip": sql(
        """SELECT 'detail' AS product, count(*) AS row_count, round(sum(amount) + 1e-8, 4) AS amount
           FROM sales_lines
           UNION ALL
           SELECT 'analytics', count(*), round(sum(s) + 1e-8, 4)
           FROM (SELECT sum(amount) AS s FROM sales_lines GROUP BY category, region)
           UNION ALL
           SELECT 'time_series', count(*), round(sum(s) + 1e-8, 4)
           FROM (SELECT sum(amount) AS s FROM sales_lines
                 GROUP BY strftime(transaction_date, '%Y-%m'))""",
        "sales_lines",
    ),
    "gold_summary_json": sql(
        " UNION ALL ".join(
            _SUMMARY.format(c) for c in ("order_id", "quantity", "amount", "discount")
        ),
        "sales_lines",
    ),
    "ingest_audit": """
        SELECT DISTINCT c_mktsegment AS segment, true AS is_csv, true AS has_content,
               true AS ingested_after_write, 'RAW_UPLOAD' AS source, 'STORED' AS status
        FROM customer""",
    "table_fingerprint": sql(
        f"""SELECT count(*) AS row_count,
                   CAST(sum({_HASH.format(_DIRTY_ROW)}) AS VARCHAR) || '-'
                     || substr(sha256('{_DIRTY_SHAPE}'), 1, 12) AS fingerprint
            FROM dirty_orders""",
        "dirty_orders",
    ),
    "file_fingerprints": f"""
        SELECT part, greatest(count(*) - 1, 0) AS row_count,
               CAST(sum({_HASH.format("strlen(line) || ':' || line")}) AS VARCHAR) AS fingerprint
        FROM (SELECT doc_id % {FILES} AS part, CAST(doc_id AS VARCHAR) || '|'
                     || regexp_replace(text, '[\\r\\n]', ' ', 'g') AS line FROM documents)
        GROUP BY part""",
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
    "dataset_reference": """
        SELECT (SELECT count(*) FROM customer) AS row_count,
               string_agg(c_name, ';' ORDER BY c_custkey) AS sample
        FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)""",
}
