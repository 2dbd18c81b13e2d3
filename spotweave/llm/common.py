"""Helpers the operators share: tables, prefix sums and components, none of which gathers a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotweave.session import materialize

EDGES_AT_ONCE = 1_000_000  # of a task's edges, joined in memory
WORD = r"[^\x20\x09-\x0D]+"  # fixed by the contracts: a word is a run of anything but ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 length of a text, 0 where it is null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def nullable_key(column: Column) -> Column:
    """A string key that is never null and keeps null apart from every value; it sorts by code point, null last."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def hash_order(*columns: Column | str) -> Column:
    """A 32-digit hexadecimal rank of a row that depends on these values alone, the same in any engine."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws(":", *parts))


def hash_share(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends on these values alone."""
    return F.conv(F.substring(hash_order(*columns), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    levels: list[str],
    order: list[str],
    weight: str | None = None,
    out: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` (or the number) of a key's rows that come before each row, and of all (``total``).

    ``levels`` are nested bucket columns, non-decreasing along the order: rows are windowed inside the
    deepest bucket only, totals of buckets inside the next, and the offsets are joined back. A key that
    holds a third of all rows is thus spread over its buckets. Keys and levels must not be null.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda value, by, along: F.coalesce(
        F.sum(value).over(earlier(Window.partitionBy(*by).orderBy(*along))), F.lit(0)
    )
    deepest = [*keys, *levels]
    totals = df.groupBy(*deepest).agg(F.sum(amount).alias("_total"))
    offsets, upper = None, totals
    for depth in range(len(levels), 0, -1):
        by = [*keys, *levels[: depth - 1]]
        here = upper.select(
            *by, levels[depth - 1], sum_before(F.col("_total"), by, [levels[depth - 1]]).alias(f"_o{depth}")
        )
        if depth == 1 and total:
            here = here.join(upper.groupBy(*by).agg(F.sum("_total").alias(total)), by)
        offsets = here if offsets is None else offsets.join(here, [*by, levels[depth - 1]])
        upper = upper.groupBy(*by).agg(F.sum("_total").alias("_total"))
    total_offset = sum((F.col(f"_o{d}") for d in range(1, len(levels) + 1)), F.lit(0))
    offsets = offsets.select(*deepest, total_offset.alias("_offset"), *([total] if total else []))
    rows = df.withColumn("_inside", sum_before(amount, deepest, order))
    return (
        rows.join(offsets, deepest)
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_inside", "_offset")
    )


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id that hangs together with it) over the edges (a, b), for all ids but the smallest themselves."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        lower, new = np.minimum(rx, ry), root.copy()
        np.minimum.at(new, rx, lower)
        np.minimum.at(new, ry, lower)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            hanging = root != np.arange(len(ids))
            return ids[hanging], ids[root[hanging]]
        root = new


def _stars_of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, EDGES_AT_ONCE and a batch at most at a time, as stars that join the same ids."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        far, near = _stars(*[np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in (0, 1)])
        return pa.RecordBatch.from_arrays([pa.array(far, pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])

    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def _settled(edges: DataFrame) -> bool:
    """Whether every id points at one root, and no root points on."""
    points = edges.select(F.col("a").alias("id"), F.lit(1).alias("on"), F.lit(0).alias("at"))
    points = points.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("on"), F.lit(1).alias("at")))
    return points.groupBy("id").agg(F.sum("on").alias("on"), F.max("at").alias("at")).where("on > 1 or on = 1 and at = 1").isEmpty()


def components(edges: DataFrame, label: str = "components", inside_tasks: bool = False) -> DataFrame:
    """(id, component_id): the smallest id reachable over the undirected edges (a, b), for every id in them.

    Alternates hooking each id to its smallest neighbour's root and shortening the trees, as joins over
    written tables; the number of rounds grows with the logarithm of the longest chain. With ``inside_tasks``, for
    ids of type long, tasks first join what hangs together among their own edges, which leaves few edges and rounds.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges.mapInArrow(_stars_of_tasks, "a long, b long") if inside_tasks else edges, label)
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours hang below the smallest known id
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # then smaller neighbours and the id itself
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = materialize(small, label)
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component_id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
