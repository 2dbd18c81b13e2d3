"""Hard negatives of anchor vectors, by a vertical scan with bounds on what is still unread.

Vectors are numbered along label and a coarse code of their leading signs and cut into blocks. A block is stored by
columns: per dimension all its values, their least and their most. A group of anchors meets a few blocks in a task, and an
anchor reads the block's dimensions in the descending order of its own components' size. After every few
dimensions the least and the most that the unread ones can still add bound each candidate's score, and a candidate
whose bound falls outside what the anchor looks for leaves the bitmap; a block outside altogether is not read.

Two scans are made. The first reads blocks of the anchor's label for its nearest positives, with the best found
so far in a task as the lower bound. The second reads blocks of other labels: a positive's score opens a window of
scores, and all windows of an anchor are resolved in one pass, each wanting its best few.
The scores are exact integers throughout, so bounds need no margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.common import hash_order, prefix_sums
from spotweave.session import materialize

BLOCK = 8192  # rows of a block; no block holds two labels
PIECE = 4  # blocks that a task reads for a group of anchors
ANCHORS = 2048  # anchors of a group
MOST_TASKS = 20_000  # of one stage; beyond that a task takes several pieces, one after the other
DIMS_AT_ONCE = 8  # dimensions read between two looks at the bounds
CODE_DIMS = 12  # leading signs that neighbours in a block share
_NONE = np.iinfo(np.int64).min


def taking_part(rows: DataFrame, vec_id: Column, embedding: Column, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that take part, one per vec_id.

    Left out are rows with a null id, label or vector, null or non-finite components, no components, another number
    of components than most, or components so large that sums of products would leave 64 bits.
    """
    scaled = F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    good = rows.select(vec_id.cast("long").alias("vec_id"), embedding.cast("array<double>").alias("x"), scaled.alias("vector"), label.alias("label"))
    good = good.where("vec_id is not null and label is not null and x is not null")
    good = good.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    lengths = good.where("size(x) > 0").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    # 100 times a sum of d products stays below 2^62
    most = isqrt((1 << 62) // (100 * max(1, d)))
    good = good.where((F.size("x") == d) & F.forall("x", lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float(most - 1))))
    one = good.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("v"))
    return one.select("vec_id", F.col("v.label").alias("label"), F.col("v.vector").cast("array<long>").alias("vector")).where(F.lit(d > 0))


def columnar_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, block, vec_ids, width, columns, least, most): rows of one label, by columns.

    ``columns`` holds per dimension the block's values as little-endian numbers of ``width`` bytes, the fewest that do.
    """
    signs = [F.when(F.element_at("vector", i + 1) >= 0, F.lit("1")).otherwise(F.lit("0")) for i in range(CODE_DIMS)]
    code = F.concat(*[F.when(F.size("vector") > i, s).otherwise(F.lit("0")) for i, s in enumerate(signs)])
    keyed = vectors.withColumn("_label", F.col("label").cast("string")).withColumn("_code", code)
    keyed = keyed.withColumns({"_near": F.substring("_code", 1, 6), "_order": F.concat("_code", hash_order("vec_id"))})
    keyed = keyed.withColumn("_fine", F.substring("_order", 1, CODE_DIMS + 2))
    numbered = prefix_sums(keyed, ["_label"], ["_near", "_fine"], ["_order"], out="_number")
    numbered = numbered.select("label", "vec_id", "vector", F.floor(F.col("_number") / block).cast("long").alias("block"))
    rows = numbered.groupBy("label", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("rows"))
    schema = "label {}, block long, vec_ids binary, width int, columns array<binary>, least array<long>, most array<long>"
    return rows.mapInArrow(_by_columns, schema.format(vectors.schema["label"].dataType.simpleString()))


def _by_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            rows = batch.column(2).slice(at, 1).flatten()
            matrix = rows.field(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(rows), -1).T
            least, most = matrix.min(1), matrix.max(1)
            width = next(w for w in (2, 4, 8) if least.min() >= -(1 << (8 * w - 1)) and most.max() < 1 << (8 * w - 1))
            columns = [c.astype(f"<i{width}").tobytes() for c in matrix]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, 1),
                    batch.column(1).slice(at, 1),
                    pa.array([rows.field(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                    pa.array([width], pa.int32()),
                    pa.array([columns], pa.list_(pa.binary())),
                    pa.array([least.tolist()], pa.list_(pa.int64())),
                    pa.array([most.tolist()], pa.list_(pa.int64())),
                ],
                names=["label", "block", "vec_ids", "width", "columns", "least", "most"],
            )


class _Block:
    """A block inside a task, its columns decoded when first read."""

    def __init__(self, row: dict):
        self.ids, self.width, self.raw = np.frombuffer(row["vec_ids"], "<i8"), row["width"], row["columns"]
        self.least, self.most = np.array(row["least"], np.int64), np.array(row["most"], np.int64)
        self.columns: dict[int, np.ndarray] = {}

    def column(self, d: int) -> np.ndarray:
        if d not in self.columns:
            self.columns[d] = np.frombuffer(self.raw[d], f"<i{self.width}").astype(np.int64)
        return self.columns[d]

    def scan(self, anchor: np.ndarray, floor: int, ceiling: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the rows whose score is at least ``floor`` and at most ``ceiling``."""
        low, high = np.minimum(anchor * self.least, anchor * self.most), np.maximum(anchor * self.least, anchor * self.most)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        # what the dimensions from each step on can add
        rest_low = np.append(np.cumsum(low[order][::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(high[order][::-1])[::-1], 0)
        if rest_high[0] < floor or (ceiling is not None and rest_low[0] > ceiling):
            return none
        alive, sums = None, np.zeros(len(self.ids), np.int64)
        for first in range(0, len(order), DIMS_AT_ONCE):
            for d in order[first : first + DIMS_AT_ONCE]:
                if anchor[d]:
                    column = self.column(d)
                    sums += anchor[d] * (column if alive is None else column[alive])
            after = min(first + DIMS_AT_ONCE, len(order))
            stays = sums + rest_high[after] >= floor
            if ceiling is not None:
                stays &= sums + rest_low[after] <= ceiling
            kept = int(stays.sum())
            if kept == 0:
                return none
            if kept < len(sums):
                alive, sums = (np.flatnonzero(stays) if alive is None else alive[stays]), sums[stays]
        return (self.ids if alive is None else self.ids[alive]), sums


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best, higher scores first, ties by smaller id."""
    if len(scores) > n:
        edge = -np.partition(-scores, n - 1)[n - 1]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:n]


def _anchor_rows(groups: pa.Table) -> list[dict]:
    """The anchors of a group, their vectors as arrays."""
    anchors = [a for row in groups.column("anchors").to_pylist() for a in row]
    for a in anchors:
        a["vector"] = np.array(a["vector"], np.int64)
    return anchors


class _Held:
    """Best (score, id) of every anchor and window so far in this task; the last of a full list is a bound."""

    def __init__(self, wanted: int):
        self.wanted, self.lists = wanted, {}

    def floor(self, key, lowest: int) -> int:
        held = self.lists.get(key)
        return max(lowest, int(held[0][-1])) if held is not None and len(held[0]) == self.wanted else lowest

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.lists.get(key)
        if held is not None:
            scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
        if len(scores):
            places = _best(scores, ids, self.wanted)
            self.lists[key] = scores[places], ids[places]

    def table(self, key_names: list[str], id_name: str, score_name: str) -> pa.Table:
        """All that is held, a row each."""
        sizes = [len(ids) for _, ids in self.lists.values()]
        keys = [k if isinstance(k, tuple) else (k,) for k in self.lists]
        columns = [np.repeat(np.array([k[i] for k in keys], np.int64), sizes) for i in range(len(key_names))]
        joined = lambda at: np.concatenate([v[at] for v in self.lists.values()]) if sizes else np.zeros(0, np.int64)
        names = [*key_names, id_name, score_name]
        return pa.table([pa.array(c, pa.int64()) for c in (*columns, joined(1), joined(0))], names=names)


def _positives(wanted: int):
    def scan(groups: pa.Table, blocks: pa.Table) -> pa.Table:
        held, anchors = _Held(wanted), _anchor_rows(groups)
        for row in blocks.to_pylist():
            block = _Block(row)
            for a in anchors:
                ids, scores = block.scan(a["vector"], held.floor(a["anchor_id"], _NONE), None)
                other = ids != a["anchor_id"]
                held.add(a["anchor_id"], scores[other], ids[other])
        return held.table(["anchor_id"], "positive_id", "positive_score")

    return scan


def _negatives(wanted: int):
    def scan(groups: pa.Table, blocks: pa.Table) -> pa.Table:
        held, anchors = _Held(wanted), _anchor_rows(groups)
        for row in blocks.to_pylist():
            block = _Block(row)
            for a in anchors:
                if a["label"] == row["label"]:
                    continue
                keys = [(a["anchor_id"], w["lowest"], w["highest"]) for w in a["windows"]]
                looks = [(floor, key) for key in keys if (floor := held.floor(key, key[1])) <= key[2]]
                if not looks:
                    continue
                ids, scores = block.scan(a["vector"], min(f for f, _ in looks), max(key[2] for _, key in looks))
                for floor, key in looks:
                    fits = (scores >= floor) & (scores <= key[2])
                    held.add(key, scores[fits], ids[fits])
        return held.table(["anchor_id", "lowest", "highest"], "negative_id", "negative_score")

    return scan


def _met(groups: DataFrame, blocks: DataFrame, keys: list[str], tasks: int, scan, schema: str) -> DataFrame:
    """What ``scan`` finds where a group of anchors meets a piece of the blocks."""
    left, right = groups.repartition(tasks, *keys).groupBy(*keys), blocks.repartition(tasks, *keys).groupBy(*keys)
    return left.cogroup(right).applyInArrow(scan, schema)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    vec_id: Column,
    embedding: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    scale: int = 256,
    block: int = BLOCK,
    anchor_group: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1 for each anchor and positive.

    ``anchors`` chooses rows by a condition on the columns of ``rows``. Components are multiplied by ``scale`` and
    rounded down; a score is the inner product of these. An anchor's positives are its best ``positives`` other rows of its
    label, and a positive's negatives the best ``negatives`` rows of other labels whose score is between the two percentages
    of the positive's. Best are higher scores, ties go to the smaller id. A positive without any negative gives no row.

    Rows with a null id, label or vector or with null, non-finite or huge components take no part, nor do vectors of another length than
    most. An id that repeats takes part once, with its least vector and label, and is an anchor if any of its rows is.
    A zero vector takes part. An empty table, or one without anchors, gives an empty table.

    Every group of ``anchor_group`` anchors reads every block whose label it needs, so rows exchanged grow with
    blocks times groups; of each anchor a task returns its best few only.
    """
    chosen = rows.where(anchors & vec_id.isNotNull()).select(vec_id.cast("long").alias("vec_id")).distinct()
    vectors = materialize(taking_part(rows, vec_id, embedding, label, scale), "negatives-vectors")
    blocks = materialize(columnar_blocks(vectors, block), "negatives-blocks")
    mine = vectors.join(chosen, "vec_id", "left_semi").withColumn("_all", F.lit(0)).withColumn("_order", hash_order("vec_id"))
    mine = mine.withColumns({"_b1": F.substring("_order", 1, 2), "_b2": F.substring("_order", 1, 4)})

    # anchors of one label are numbered and grouped; they read the blocks of that label, a piece at a time
    by_label = prefix_sums(mine.withColumn("_label", F.col("label").cast("string")), ["_label"], ["_b1", "_b2"], ["_order"], out="_number")
    groups = by_label.groupBy("label", F.floor(F.col("_number") / anchor_group).alias("group")).agg(
        F.collect_list(F.struct(F.col("vec_id").alias("anchor_id"), "vector")).alias("anchors")
    )
    groups = materialize(groups, "negatives-label-groups")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    pieces = blocks.groupBy("label").agg(F.max(F.floor(F.col("block") / PIECE)).alias("last"))
    lasts = groups.groupBy("label").agg(F.max("group").alias("last"))
    left = groups.join(pieces, "label").withColumn("piece", upto(F.col("last"))).drop("last")
    right = blocks.withColumn("piece", F.floor(F.col("block") / PIECE)).join(lasts, "label").withColumn("group", upto(F.col("last"))).drop("last")
    tasks = min(MOST_TASKS, max(1, left.count()))
    schema = "anchor_id long, positive_id long, positive_score long"
    found = materialize(_met(left, right, ["label", "group", "piece"], tasks, _positives(positives), schema), "negatives-candidates")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("_place", rank).where(F.col("_place") <= positives).drop("_place")

    # in whole numbers, for products of large scores would round as doubles
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100)) div 100"), F.pmod(F.col("positive_score"), F.lit(100))
    lowest = hundreds * least_percent + F.ceil(rest * least_percent / 100)
    highest = hundreds * most_percent + F.floor(rest * most_percent / 100)
    windows = materialize(best.withColumns({"lowest": lowest, "highest": highest}).where("lowest <= highest"), "negatives-windows")

    # all anchors with a window, in groups that read all blocks
    wanted = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct("lowest", "highest")).alias("windows"))
    numbered = prefix_sums(mine.join(wanted, "vec_id"), ["_all"], ["_b1", "_b2"], ["_order"], out="_number")
    groups = numbered.groupBy(F.floor(F.col("_number") / anchor_group).alias("group")).agg(
        F.collect_list(F.struct(F.col("vec_id").alias("anchor_id"), "label", "vector", "windows")).alias("anchors")
    )
    groups = materialize(groups, "negatives-groups")
    n_groups, n_pieces = groups.count(), -(-blocks.count() // PIECE)
    left = groups.withColumn("piece", upto(F.lit(max(0, n_pieces - 1)).cast("long")))
    dealt = F.pmod(F.xxhash64("label", "block"), F.lit(max(1, n_pieces)))
    right = blocks.withColumn("piece", dealt).withColumn("group", upto(F.lit(max(0, n_groups - 1)).cast("long")))
    tasks = min(MOST_TASKS, max(1, n_groups * n_pieces))
    schema = "anchor_id long, lowest long, highest long, negative_id long, negative_score long"
    found = materialize(_met(left, right, ["group", "piece"], tasks, _negatives(negatives), schema), "negatives-found")
    order = Window.partitionBy("anchor_id", "lowest", "highest").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return windows.join(ranked, ["anchor_id", "lowest", "highest"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
