"""Largest inner products through a low-dimensional projection, indexed by kd-trees.

Vectors get one more coordinate that makes their lengths equal, so that the largest inner product is the nearest
vector. A Gaussian projection to a few dimensions is stable: a projected squared distance is the true one times
a chi-square variable. The index is a written table: blocks of vectors, each with a kd-tree over its projected
points, a row per leaf with its box. A query takes the leaves of a block in the order of projected distance
and verifies their vectors in full, until the chi-square test says that a vector as near as its k-th best
would, at the confidence asked for, have been met by then. Queries meet blocks in groups, never row by row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.vectors import matrix, usable
from spotweave.session import fresh_path

DIMENSIONS = 8  # of the projection, even
LEAF = 64
BLOCK = 8192  # vectors of one kd-tree, about
QUERIES = 1024  # queries that visit a block together, about
CONFIDENCE = 0.95


def chi_square(x: float, freedom: int) -> float:
    """Distribution of chi-square for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_at(probability: float, freedom: int) -> float:
    """Where the distribution reaches a probability."""
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < probability:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < probability else (low, middle)
    return high


def _projection(d: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(77).normal(size=(d + 1, dimensions))


def _leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree: halved at the median of the widest coordinate until small enough."""
    open_, done = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        own = points[rows]
        along = int((own.max(0) - own.min(0)).argmax())
        order = np.argpartition(own[:, along], len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def build_index(rows: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, dict]:
    """The written index of usable rows (vec_id, embedding) and its parameters.

    Every row is in it; nothing is fitted but the largest length, over all rows.
    """
    squared = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.max(squared).alias("most")).first()
    facts = {"n": stats["n"], "d": stats["d"] or 0, "most": (stats["most"] or 0.0) * (1 + 1e-12), "dimensions": dimensions}
    facts["blocks"] = max(1, -(-facts["n"] // block))

    def plant(table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), matrix(table["embedding"])
        rest = np.sqrt(np.maximum(facts["most"] - np.einsum("nd,nd->n", x, x), 0))
        points = np.concatenate([x, rest[:, None]], 1) @ _projection(facts["d"], dimensions)
        parts = _leaves(points, leaf)
        return pa.table(
            {
                "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int64()),
                "ids": pa.array([ids[p] for p in parts], pa.list_(pa.int64())),
                "vectors": pa.array([x[p].tobytes() for p in parts], pa.binary()),
                "low": pa.array([points[p].min(0) for p in parts], pa.list_(pa.float64())),
                "high": pa.array([points[p].max(0) for p in parts], pa.list_(pa.float64())),
            }
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(facts["blocks"])))
    planted = dealt.groupBy("block").applyInArrow(
        plant, "block long, ids array<long>, vectors binary, low array<double>, high array<double>"
    )
    path = fresh_path(rows.sparkSession, "projected-index")
    planted.write.parquet(path)
    return rows.sparkSession.read.schema(planted.schema).parquet(path), facts


def visit(queries: np.ndarray, own_ids: np.ndarray, ids, vectors, low, high, facts: dict, k: int, confidence: float):
    """(scores, ids, leaves visited): the k best of one block for each query, by leaves until the test holds."""
    n, leaves = len(queries), len(ids)
    limit = chi_square_at(confidence, facts["dimensions"])
    projected = np.concatenate([queries, np.zeros((n, 1))], 1) @ _projection(facts["d"], facts["dimensions"])
    bound = np.empty((n, leaves))
    for j in range(leaves):
        outside = np.maximum(np.maximum(low[j] - projected, projected - high[j]), 0)
        bound[:, j] = np.einsum("nm,nm->n", outside, outside)
    order = bound.argsort(1)
    length = np.einsum("nd,nd->n", queries, queries)
    width = max(len(i) for i in ids)
    best, best_ids = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    active, visited = np.arange(n), np.zeros(n, np.int64)
    for turn in range(leaves):
        if turn:
            worst = best[active].min(1)
            reach = (facts["most"] + length[active] - 2 * worst) * limit
            active = active[~(bound[active, order[active, turn]] >= reach)]
            if not len(active):
                break
        visited[active] += 1
        leaf = order[active, turn]
        by_leaf = np.argsort(leaf, kind="stable")
        active, leaf = active[by_leaf], leaf[by_leaf]
        scores, found = np.full((len(active), width), -np.inf), np.full((len(active), width), -1, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            j = leaf[lo]
            near = queries[active[lo:hi]] @ vectors[j].T
            near[own_ids[active[lo:hi], None] == ids[j][None, :]] = -np.inf
            scores[lo:hi, : len(ids[j])] = near
            found[lo:hi, : len(ids[j])] = ids[j]
        scores, found = np.concatenate([best[active], scores], 1), np.concatenate([best_ids[active], found], 1)
        top = np.lexsort((found, -scores), axis=1)[:, :k] if scores.shape[1] > k else np.argsort(-scores, axis=1)
        best[active], best_ids[active] = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
    return best, best_ids, visited


def search(
    queries: DataFrame, index: DataFrame, facts: dict, k: int = 20, confidence: float = CONFIDENCE, group: int = QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every usable query (vec_id, embedding).

    A query's own id is not among its candidates; ties go to the smaller id; fewer candidates give fewer rows.
    """
    n = queries.count()
    groups = max(1, -(-n // group))
    asked = (
        queries.select(F.col("vec_id").alias("query_id"), "embedding")
        .withColumn("ask", F.pmod(F.xxhash64("query_id", F.lit("ask")), F.lit(groups)))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(facts["blocks"] - 1).cast("long"))))
    )
    offered = index.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = [np.array(i) for i in right["ids"].to_pylist()]
        vectors = [np.frombuffer(v, np.float64).reshape(len(i), -1) for i, v in zip(ids, right["vectors"].to_pylist())]
        low, high = matrix(right["low"]), matrix(right["high"])
        own = left["query_id"].to_numpy()
        best, best_ids, _ = visit(matrix(left["embedding"]), own, ids, vectors, low, high, facts, k, confidence)
        real = best_ids >= 0
        real &= np.isfinite(best)
        return pa.table({"query_id": np.repeat(own, k).reshape(-1, k)[real], "vec_id": best_ids[real], "score": best[real]})

    met = asked.groupBy("block", "ask").cogroup(offered.groupBy("block", "ask")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, is_query, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """Index all usable ``rows`` and search them for the rows where the column ``is_query`` holds."""
    good = usable(rows)
    index, facts = build_index(good)
    return search(good.where(is_query), index, facts, k, confidence)
