"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.session import materialize


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each node the smallest node among its neighbours and itself."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
    return (
        both.join(_nearest(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nearest = _nearest(down)
    moved = down.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(nearest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))
    ).first()
    return tuple(row)


def connected(links: DataFrame) -> DataFrame:
    """Rows ``node``, ``root`` for every node of the links ``src``, ``dst``; the root is
    the smallest node that links reach.

    Large-star and small-star steps alternate until nothing changes, a number of rounds
    that grows with the logarithm of the longest chain. Each round is written to the
    shared folder, so lineage stays short. Smallest neighbours combine before the
    shuffle. An empty table gives an empty result.
    """
    edges = materialize(
        links.where("src != dst").select(F.col("src").alias("u"), F.col("dst").alias("v")),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())
