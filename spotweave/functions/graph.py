"""Connected components, of numbers at hand and by joins over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.session import materialize


def lowest_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the numbers below n the smallest that it reaches over the undirected edges a, b."""
    root = np.arange(n)
    while len(a):
        lower = root.copy()
        np.minimum.at(lower, a, b)
        np.minimum.at(lower, b, a)
        while not np.array_equal(lower, further := lower[lower]):
            lower = further
        root = lower[root]
        a, b = lower[a], lower[b]
        a, b = a[a != b], b[a != b]
    return root


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over the undirected edges (a, b), for every id in them.

    In each round an id takes the smallest root among its own and its neighbours', and then the root of its root, until
    nothing changes; the rounds grow with the logarithm of the longest chain for chains of random order, and every round
    is grouped sums, so a hub with many neighbours is one row after partial aggregation. All joins are between tables that grow
    with the ids: small files of compressed labels would otherwise be broadcast, through the driver, in every round.
    """
    both = edges.where("a is not null and b is not null").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a is not null and b is not null").distinct(), "edges")
    roots = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), "roots")
    while True:
        named = roots.select(F.col("id").alias("b"), F.col("root").alias("near"))
        lowest = both.join(named.hint("merge"), "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "id")
        lower = roots.join(lowest.hint("merge"), "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # an old root hears of the smallest root any of its members has met, and members follow it
        heads = lower.groupBy(F.col("old").alias("head")).agg(F.min("root").alias("lowest"))
        heads = materialize(heads, "heads")
        follow = lower.join(heads.withColumnsRenamed({"head": "old"}).hint("merge"), "old").select("id", "old", F.least("root", "lowest").alias("root"))
        jump = follow.join(heads.select(F.col("head").alias("root"), F.col("lowest").alias("next")).hint("merge"), "root", "left")
        new = materialize(jump.select("id", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        if new.where("old <> root").limit(1).count() == 0:
            return new.select("id", "root")
        roots = new.select("id", "root")
