"""Sections I9 to I11: questions as a table, and one structured request."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import questions as Q
from orefold.operators.profile import dimension_values
from orefold.plans.questions import gold_query, plan_question
from registry.views import rounded, sales_lines, sql, table


def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order, in six wordings, naming values of that order."""
    key = F.col("o_orderkey")
    part = F.concat(F.lit("part "), F.col("o_custkey").cast("string"))
    priority = F.col("o_orderpriority")
    wording = (
        F.when(key % 6 == 0, F.concat(F.lit("Show top 5 amount by category for "), part))
        .when(key % 6 == 1, F.concat(F.lit("Compare "), priority, F.lit(" versus "), part))
        .when(
            key % 6 == 2,
            F.concat(F.lit("Why did the quantity of "), part, F.lit(" fall per region?")),
        )
        .when(key % 6 == 3, F.concat(F.lit("Lowest sales for each category in "), priority))
        .when(key % 6 == 4, F.concat(F.lit("Monthly Revenue TREND of "), part, F.lit(" by product")))
        .otherwise(F.concat(F.lit("Units of city and product in "), priority))
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("question_id"), wording.alias("question")
    )


def _intent(asked: DataFrame, key: str) -> DataFrame:
    return asked.select(
        key,
        "mode",
        "metric",
        "row_limit",
        "bottom",
        "wants_series",
        F.array_join("mentioned", ",").alias("mentioned"),
        "parent_dimension",
        "child_dimension",
    )


def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = Q.question_intent(question_table(spark, sf_dir), "question")
    return _intent(asked, "question_id")


def question_intent_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over every turn of the conversations."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text"
    )
    return _intent(Q.question_intent(turns, "text"), "turn_id")


def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = dimension_values(sales_lines(spark, sf_dir), ["product", "category", "region"])
    return Q.question_filters(question_table(spark, sf_dir), "question_id", "question", values)


def question_filters_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links however questions and values lie in partitions."""
    values = dimension_values(sales_lines(spark, sf_dir), ["product", "category", "region"])
    questions = question_table(spark, sf_dir).repartition(16)
    return Q.question_filters(questions, "question_id", "question", values.repartition(5))


def question_filters_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts and values of many lengths: the longest benchmark item and the longest
    item's head that each document quotes."""
    items = table(spark, sf_dir, "benchmark")
    whole = items.select(F.lit("item").alias("dimension"), F.col("text").alias("value"))
    size = F.greatest(F.lit(12), (F.col("item_id") % 40).cast("int"))
    heads = items.select(
        F.lit("head").alias("dimension"), F.substring("text", F.lit(1), size).alias("value")
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.question_filters(documents, "doc_id", "text", whole.union(heads))


def question_filters_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages of the documents that a conversation turn mentions."""
    values = dimension_values(table(spark, sf_dir, "documents"), ["source", "lang"])
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text"
    )
    return Q.question_filters(turns, "turn_id", "text", values)


QUESTION = "Top 5 amount by region for Part 10 and part 11 over time"


def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of one question: every table it asks for, in long form."""
    lines = sales_lines(spark, sf_dir)
    answer = gold_query(lines, plan_question(lines, QUESTION))
    summary = answer["filtered_summary"].select(
        F.lit("filtered_summary").alias("part"),
        F.lit(None).cast("string").alias("label"),
        F.col("total").alias("amount"),
    )
    regions = answer["region_breakdown"].select(
        F.lit("region_breakdown").alias("part"), F.col("value").alias("label"), "amount"
    )
    compared = answer["comparison"].select(
        F.lit("comparison").alias("part"), F.col("value").alias("label"), F.col("total")
    )
    series = answer["detail_time_series"].select(
        F.lit("detail_time_series").alias("part"), F.col("period").alias("label"), F.col("metric")
    )
    size = answer["detail_size"].select(
        F.lit("detail_size").alias("part"),
        F.col("column_count").cast("string").alias("label"),
        F.col("row_count").cast("double").alias("amount"),
    )
    return rounded(summary.union(regions).union(compared).union(series).union(size))


def question_answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross breakdown of a question that names two dimensions, all pairs."""
    lines = sales_lines(spark, sf_dir)
    asked = plan_question(lines, "quantity of each category by product")
    answer = gold_query(lines, replace(asked, filters={}, cross_rows=None))
    return rounded(answer["category_by_product"])


QUERIES = {
    "question_intent": question_intent,
    "question_intent_of_turns": question_intent_of_turns,
    "question_filters": question_filters,
    "question_filters_spread": question_filters_spread,
    "question_filters_of_turns": question_filters_of_turns,
    "question_filters_of_documents": question_filters_of_documents,
    "question_answer": question_answer,
    "question_answer_pairs": question_answer_pairs,
}

_QUESTIONS = """
    SELECT o_orderkey AS question_id,
           CASE o_orderkey % 6
             WHEN 0 THEN 'Show top 5 amount by category for part ' || o_custkey
             WHEN 1 THEN 'Compare ' || o_orderpriority || ' versus part ' || o_custkey
             WHEN 2 THEN 'Why did the quantity of part ' || o_custkey || ' fall per region?'
             WHEN 3 THEN 'Lowest sales for each category in ' || o_orderpriority
             WHEN 4 THEN 'Monthly Revenue TREND of part ' || o_custkey || ' by product'
             ELSE 'Units of city and product in ' || o_orderpriority END AS question
    FROM orders"""


def _intent_sql(source: str, key: str, column: str) -> str:
    dimensions = ("product", "category", "city", "region", "department")
    child = " ".join(
        f"WHEN regexp_matches(q, '(by|per|for each) {d}') THEN '{d}'" for d in dimensions
    )
    mentioned = ", ".join(f"CASE WHEN contains(q, '{d}') THEN '{d}' END" for d in dimensions)
    return f"""
        SELECT {key}, mode, metric, row_limit, bottom, wants_series,
               array_to_string(list_filter(all_, lambda d: d IS NOT NULL), ',') AS mentioned,
               list_filter(all_, lambda d: d IS NOT NULL
                           AND d IS DISTINCT FROM child_dimension)[1] AS parent_dimension,
               child_dimension
        FROM (SELECT *, [{mentioned}] AS all_,
               CASE WHEN regexp_matches(q, 'compare|versus| vs |difference between') THEN 'COMPARE'
                    WHEN regexp_matches(q, 'trend|over time|monthly|month by month|latest period|growth')
                    THEN 'TIME_SERIES'
                    WHEN regexp_matches(q, 'why|reason|cause|explain') THEN 'REASONING'
                    WHEN regexp_matches(q, 'top |bottom |highest|lowest|most|least') THEN 'RANKING'
                    ELSE 'BREAKDOWN' END AS mode,
               CASE WHEN regexp_matches(q, 'quantity|volume|units|unit sold') THEN 'quantity'
                    ELSE 'amount' END AS metric,
               CASE WHEN regexp_matches(q, 'top (3|three)') THEN 3
                    WHEN regexp_matches(q, 'top (5|five)') THEN 5
                    WHEN regexp_matches(q, 'top (10|ten)') THEN 10
                    WHEN regexp_matches(q, 'bottom (3|three)') THEN 3
                    WHEN regexp_matches(q, 'bottom (5|five)') THEN 5 ELSE 10 END AS row_limit,
               regexp_matches(q, 'bottom|lowest|least') AS bottom,
               regexp_matches(q, 'monthly|over time|trend') AS wants_series,
               CASE {child} END AS child_dimension
              FROM (SELECT *, lower(trim({column})) AS q FROM {source}))"""


_TURNS = "SELECT conv_id || '-' || turn AS turn_id, text FROM conversations"
_LINE_VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM sales_lines"
    for d in ("product", "category", "region")
)
_DOCUMENT_VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM documents" for d in ("source", "lang")
)


def _links(source: str, key: str, column: str) -> str:
    return f"""
        SELECT {key}, dimension, value FROM (
          SELECT {key}, dimension, value,
                 row_number() OVER (PARTITION BY {key}, dimension
                                    ORDER BY length(value) DESC, lower(value), value) AS r
          FROM {source}, values_ WHERE contains(lower({column}), lower(value)))
        WHERE r = 1"""


_FILTERS = sql(
    _links("questions", "question_id", "question"),
    "sales_lines",
    questions=_QUESTIONS,
    values_=_LINE_VALUES,
)

ORACLE = {
    "question_intent": sql(
        _intent_sql("questions", "question_id", "question"), questions=_QUESTIONS
    ),
    "question_intent_of_turns": sql(_intent_sql("turns", "turn_id", "text"), turns=_TURNS),
    "question_filters": _FILTERS,
    "question_filters_spread": _FILTERS,
    "question_filters_of_turns": sql(
        _links("turns", "turn_id", "text"), turns=_TURNS, values_=_DOCUMENT_VALUES
    ),
    "question_filters_of_documents": sql(
        _links("documents", "doc_id", "text"),
        values_="""
            SELECT 'item' AS dimension, text AS value FROM benchmark UNION ALL
            SELECT 'head', substr(text, 1, greatest(12, item_id % 40)) FROM benchmark""",
    ),
    # The question names part 10 first by length and alphabet, and the letters a, r, f
    # and o of its words are values of the short dimensions.
    "question_answer_pairs": sql(
        """SELECT row_number() OVER (ORDER BY s DESC, category, product) AS "rank",
                  category AS parent, product AS child, round(s + 1e-8, 4) AS amount,
                  round(s / sum(s) OVER (PARTITION BY category) * 100 + 1e-8, 4) AS parent_share_pct
           FROM (SELECT category, product, sum(quantity) AS s FROM sales_lines GROUP BY ALL)""",
        "sales_lines",
    ),
    "question_answer": sql(
        """SELECT 'filtered_summary' AS part, NULL AS label, round(sum(amount) + 1e-8, 4) AS amount
           FROM sales_lines WHERE product = 'part 10' AND category = 'A' AND region = 'F'
           UNION ALL
           SELECT 'region_breakdown', region, round(sum(amount) + 1e-8, 4) FROM sales_lines
           WHERE product = 'part 10' AND category = 'A' GROUP BY region
           UNION ALL
           SELECT 'comparison', product, round(sum(amount) + 1e-8, 4) FROM sales_lines
           WHERE product IN ('part 10', 'part 11', 'part 1') GROUP BY product
           UNION ALL
           SELECT * FROM (
             SELECT 'detail_time_series', strftime(transaction_date, '%Y-%m'),
                    round(sum(amount) + 1e-8, 4) FROM sales_lines
             WHERE product = 'part 10' AND category = 'A' AND region = 'F'
             GROUP BY ALL ORDER BY 2 DESC LIMIT 24)
           UNION ALL
           SELECT 'detail_size', '8', count(*) FROM sales_lines""",
        "sales_lines",
    ),
}
