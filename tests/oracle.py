"""Compare registered queries with their SQL in DuckDB.

Usage: python -m tests.oracle [--sf DIR] [--zone ZONE] [--partitions N] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: str = "8", zone: str = "UTC", partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orefold-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", zone)
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="orefold-tests-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')"
        )
    return connection


def _cell(value: object) -> tuple:
    if isinstance(value, float):
        if math.isnan(value):
            return ("float", "nan")
        return ("float", repr(value + 0.0))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(_cell(v) for v in value))
    return (type(value).__name__, "" if value is None else str(value))


def _rows(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = sorted(tuple(_cell(row[i]) for i in order) for row in rows)
    return [names[i] for i in order], cells


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    return _rows([d[0] for d in result.description], result.fetchall())


def difference(left: tuple, right: tuple) -> str | None:
    """What differs between two results, or None."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    only_left = [r for r in left[1] if r not in set(right[1])][:3]
    only_right = [r for r in right[1] if r not in set(left[1])][:3]
    return (
        f"{len(left[1])} rows != {len(right[1])} rows;\n  spark only: {only_left}"
        f"\n  sql only:   {only_right}"
    )


def main() -> int:
    from registry import ORACLE, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--zone", default="UTC")
    parser.add_argument("--partitions", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = session(zone=args.zone, partitions=args.partitions)
    connection = oracle(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            result = spark_rows(QUERIES[name](spark, args.sf))
            taken = time.time() - start
            if name not in ORACLE:
                print(f"{name:28s} rows only {len(result[1])} ({taken:.1f}s)", flush=True)
                continue
            found = difference(result, oracle_rows(connection, ORACLE[name]))
        except Exception as error:  # report every query
            taken, found = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        state = "ok" if found is None else f"DIFFERS {found}"
        print(f"{name:28s} {taken:5.1f}s {state}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
