"""Which column plays which part, decided from column names alone."""

from __future__ import annotations

from collections.abc import Sequence

# Date column names, most trusted first.
DATE_NAMES = (
    "date",
    "datetime",
    "timestamp",
    "created_at",
    "updated_at",
    "transaction_date",
    "order_date",
    "event_date",
    "sale_date",
    "invoice_date",
)
DATE_SUFFIXES = ("_date", "_datetime", "_timestamp")

# The columns that can stand for a business metric, best first.
METRIC_COLUMNS = {
    "amount": ("amount", "amount_sum", "revenue", "sales", "value"),
    "quantity": ("quantity", "quantity_sum", "units", "volume"),
}

# The dimensions that questions may ask about.
QUESTION_DIMENSIONS = ("product", "category", "city", "region", "department")


def date_column(columns: Sequence[str]) -> str | None:
    """The column that most likely holds the date of a row."""
    by_lower = {name.lower(): name for name in columns}
    preferred = [by_lower[name] for name in DATE_NAMES if name in by_lower]
    by_suffix = [name for name in columns if name.lower().endswith(DATE_SUFFIXES)]
    return next(iter(preferred + by_suffix), None)


def metric_column(columns: Sequence[str], metric: str = "amount") -> str | None:
    """The column behind a metric name; unknown metrics fall back to the amount."""
    candidates = METRIC_COLUMNS.get(metric, METRIC_COLUMNS["amount"])
    return next((name for name in candidates if name in columns), None)
