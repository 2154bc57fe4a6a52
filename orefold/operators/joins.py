"""Equi-joins in which a null key matches a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.functions import values as V


def join_by(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """All columns of ``left`` plus the columns of ``right`` that are no keys."""
    added = V.cols(c for c in right.columns if c not in keys)
    renamed = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.select(*[V.col(k).alias(v) for k, v in renamed.items()], *added)
    condition = reduce(
        lambda a, b: a & b,
        [V.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()],
    )
    return left.join(right, condition, how).drop(*renamed.values())
