"""Small tables with every awkward case: nulls, blanks, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "The whole line says a thing about rivers and hills, then it ends. " * 3000
PASSAGE = (
    "a passage of some length that is long enough to count as a repeat because it has "
    "well over one hundred bytes in it"
)
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve. " * 6, "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", "a"),
    (4, " \n\t \n", "de", None),
    (5, LONG, "en", "a"),
    (6, f"Before it. {PASSAGE} After it.", "en", "b"),
    (7, f"{PASSAGE}", None, "b"),
    (8, "éé ß 日本語 😀 " * 40, "fr", "c"),
    (9, "word", "fr", "c"),
    (10, "word", "fr", "c"),
    (10, "word", "fr", "c"),
    (None, "no id here but some text " * 5, "en", None),
    (None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHING = (
    "n_words bigint, kept boolean, fingerprint string, component_id bigint, score double, "
    "start bigint, stop bigint, items string, mix_epoch int, mix_tokens bigint, block int, "
    "weight double, row string, doc bigint, version int, id bigint, w string, label int, "
    "`a.b` string, __id bigint, __text string, key string"
)


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def clashing(spark: SparkSession) -> DataFrame:
    """The same rows between extra columns with the operators' own names."""
    names = CLASHING.count(",") + 1
    rows = [(*row[:2], *[None] * names, *row[2:]) for row in ROWS]
    schema = SCHEMA.replace("text string,", f"text string, {CLASHING},")
    return spark.createDataFrame(rows, schema).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession) -> DataFrame:
    rows = [(i, i % 2, i % 3 % 2) for i in range(1, 11)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def benchmark(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "Two three four five six seven eight nine ten eleven!"),
        (2, "word"),
        (2, "word"),
        (3, None),
        (4, "..."),
        (None, "rivers and hills, then it ends the whole line says a thing"),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string")
