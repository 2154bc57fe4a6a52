"""The registered queries and, for each, the SQL that must give the same rows."""

from registry import (
    breakdowns,
    cleaning,
    gold,
    incremental,
    ledger,
    medallion,
    profiling,
    quality,
    questions,
    series,
    signals,
    sources,
)

SECTIONS = (
    sources,
    profiling,
    quality,
    cleaning,
    gold,
    series,
    breakdowns,
    questions,
    signals,
    incremental,
    ledger,
    medallion,
)
QUERIES = {name: query for section in SECTIONS for name, query in section.QUERIES.items()}
ORACLE = {name: sql for section in SECTIONS for name, sql in section.ORACLE.items()}
