"""Business roles of columns: key, measure, dimension, attribute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.operators.profile import column_stats

# Names of primary keys.
PRIMARY_NAMES = (
    "id",
    "uuid",
    "guid",
    "key",
    "transaction_id",
    "transaction_key",
    "order_id",
    "order_key",
    "invoice_id",
    "invoice_key",
    "record_id",
    "record_key",
    "event_id",
    "event_key",
)
# Endings of reference keys.
REFERENCE_SUFFIXES = ("_id", "_key", "_uuid", "_guid")
# Names of measures.
MEASURE_NAMES = (
    "salary",
    "price",
    "amount",
    "revenue",
    "sales",
    "quantity",
    "profit",
    "cost",
    "value",
    "total",
    "sales_amount",
    "unit_price",
    "discount",
    "discount_pct",
)
# Names of dimensions.
DIMENSION_NAMES = (
    "city",
    "state",
    "country",
    "category",
    "department",
    "region",
    "status",
    "type",
    "payment_method",
    "order_status",
)
# Names of attributes.
ATTRIBUTE_NAMES = (
    "name",
    "first_name",
    "last_name",
    "product",
    "description",
    "email",
    "phone",
    "address",
)
NUMERIC_TYPES = ("integer", "float", "double", "numeric")
HIGH_CARDINALITY = 0.80

# Word parts for the role by name alone, tried in this order.
GENERIC_ROLE_PARTS = (
    ("identifier", ("id", "key", "code")),
    ("measure", ("amount", "price", "salary", "income", "revenue", "cost")),
    ("datetime", ("date", "time", "timestamp", "created", "updated")),
    ("dimension", ("name", "email", "city", "country", "status", "type")),
)


@dataclass(frozen=True)
class ColumnRole:
    """What later steps need to know about one column."""

    name: str
    type: str = "string"
    role: str | None = None
    confidence: float = 0.0
    key_type: str | None = None
    nullable: bool = False


def _first_match(rules: list[tuple], field: int) -> Column:
    *conditional, fallback = rules
    chosen = None
    for rule in conditional:
        result = F.lit(rule[field])
        chosen = F.when(rule[0], result) if chosen is None else chosen.when(rule[0], result)
    return chosen.otherwise(F.lit(fallback[field]))


def classify(stats: DataFrame, with_ratio: bool = True) -> DataFrame:
    """Add role, confidence, reason and key type to one-row-per-column statistics.

    ``with_ratio=False`` classifies from names and types only, as when no rows are at
    hand: texts that no name rule covers then become dimensions.
    """
    name = F.lower(F.trim("name"))
    numeric = F.col("type").isin(*NUMERIC_TYPES)
    reference = F.lit(False)
    for suffix in REFERENCE_SUFFIXES:
        reference = reference | name.endswith(suffix)
    if with_ratio:
        high_cardinality = F.col("exact_unique_ratio") > HIGH_CARDINALITY
    else:
        high_cardinality = F.lit(False)
    rules = [
        (name.isin(*PRIMARY_NAMES), "KEY", 0.99, "unique business key", "PRIMARY"),
        (reference, "KEY", 0.99, "reference key, may repeat", "REFERENCE"),
        (name.isin(*MEASURE_NAMES) & numeric, "MEASURE", 0.99, "known measure", None),
        (
            name.isin(*DIMENSION_NAMES) & (F.col("type") == "string"),
            "DIMENSION",
            0.98,
            "known dimension",
            None,
        ),
        (name.isin(*ATTRIBUTE_NAMES), "ATTRIBUTE", 0.95, "known attribute", None),
        (numeric, "MEASURE", 0.85, "numeric column", None),
        (high_cardinality, "ATTRIBUTE", 0.85, "mostly distinct values", None),
        (None, "DIMENSION", 0.80, "repeating values", None),
    ]
    key_type = _first_match(rules, 4).cast("string")
    return (
        stats.withColumn("role", _first_match(rules, 1))
        .withColumn("confidence", _first_match(rules, 2))
        .withColumn("reason", _first_match(rules, 3))
        .withColumn("key_type", key_type)
        .withColumn("unique_required", F.when(key_type.isNotNull(), key_type == "PRIMARY"))
    )


def semantic_roles(df: DataFrame, mode: str = "numeric") -> DataFrame:
    """Profile a table and classify its columns in one go."""
    return classify(column_stats(df, mode)).drop("exact_unique_ratio")


def generic_roles(schema: DataFrame) -> DataFrame:
    """The role by parts of the column name alone, first hit wins."""
    lowered = F.lower("name")
    role = None
    for label, parts in GENERIC_ROLE_PARTS:
        hit = lowered.rlike("|".join(parts))
        role = F.when(hit, label) if role is None else role.when(hit, label)
    return schema.withColumn("role", role.otherwise("attribute"))


def merge_roles(schema: DataFrame, roles: DataFrame) -> DataFrame:
    """Attach roles to a schema by column name; columns without a role keep null.

    Both sides hold one row per table column, so the lookup side is small by nature.
    """
    raw = F.upper("found_role")
    merged = (
        F.when(raw.isin("IDENTIFIER", "ID", "PRIMARY"), "KEY")
        .when(raw.isin("DATETIME", "ATTR"), "ATTRIBUTE")
        .otherwise(raw)
    )
    found = [F.col("name"), F.col("role").alias("found_role")]
    confidence = []
    if "confidence" in roles.columns:
        found.append(F.col("confidence"))
        confidence = ["confidence"]
    kept = [c for c in schema.columns if c not in ("role", "confidence")]
    return (
        schema.select(*kept)
        .join(F.broadcast(roles.select(*found)), "name", "left")
        .select(*kept, merged.alias("role"), *confidence)
    )


def transform_rules(roles: DataFrame) -> DataFrame:
    """The list of cleaning rules of every column."""
    decimal = F.col("type").isin("float", "double", "decimal")
    integer = F.col("type") == "integer"

    def rules(*names: str | Column) -> Column:
        return F.array(*[F.lit(n) if isinstance(n, str) else n for n in names])

    key_cast = F.when(integer, "CAST_INTEGER").when(decimal, "CAST_NUMERIC")
    measure_cast = F.when(integer, "CAST_INTEGER").when(decimal, "CAST_FLOAT")
    by_role = (
        F.when(F.col("role") == "KEY", rules("TRIM", key_cast, "KEY_VALIDATION"))
        .when(
            F.col("role") == "MEASURE",
            rules("TRIM", measure_cast, "NUMERIC_VALIDATION", "NEGATIVE_VALUE_CHECK"),
        )
        .when(
            F.col("role") == "DIMENSION",
            rules("TRIM", "NORMALIZE_TEXT", "EMPTY_VALUE_CHECK"),
        )
        .when(F.col("role") == "ATTRIBUTE", rules("TRIM", "NORMALIZE_TEXT"))
        .when(F.col("role") == "TIME", rules("TRIM", "DATE_TIME_NORMALIZATION"))
        .otherwise(rules("TRIM"))
    )
    review = F.when(F.col("confidence") < 0.70, "LOW_CONFIDENCE_REVIEW")
    return roles.select(
        F.col("name").alias("column"),
        "role",
        "confidence",
        F.array_compact(F.concat(by_role, F.array(review))).alias("rules"),
    )


def collect_roles(roles: DataFrame) -> list[ColumnRole]:
    """Bring the roles to the driver, one small record per column, in column order."""
    ordered = roles.orderBy("position") if "position" in roles.columns else roles
    fields = ("name", "type", "role", "confidence", "key_type", "nullable")
    known = [f for f in fields if f in roles.columns]
    return [ColumnRole(**row.asDict()) for row in ordered.select(*known).collect()]


def names_with_role(roles: list[ColumnRole], role: str) -> list[str]:
    return [c.name for c in roles if c.role == role]
