"""Permutation test of Moran's I with any number of permutations (A5).

Permutations run in blocks of some dozens. A permutation of the spots' numbers is a keyed bijection, computed where a value
lies, so no numbers are sorted and no permutation is stored. Tiles are neighbourhoods of some thousand spots, with numbers
in a row. Two shuffles follow, of packed binary rows:

1. values go to the tiles that hold their new places, where they form a matrix (places x permutations x genes) and a tile
   sums weight * value * value over its inner edges, for all permutations of the block at once;
2. the rows of the matrix that edges between two tiles need go to one of the two, which sums over these edges.

Values travel packed without loss: decimal numbers of a few places as whole numbers, others with all their bytes. They are
centred before they are multiplied, so the sums don't cancel. No task holds more than a tile or some thousand values' places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range
from spotweave.functions.running import hash_buckets, running
from spotweave.operators.spatial import autocorr_sums, moran
from spotweave.session import materialize

ROUNDS = 10  # of the bijection
DECIMALS = 4  # of numbers that are sent as whole ones, at most
TIE = 1e-10  # permuted statistics this close below the observed one count as equal, as sums round
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Sizes:
    """How much is computed together; results don't depend on it."""

    block: int = 64  # permutations
    genes: int = 8  # genes, at most
    chunk: int = 1 << 15  # values whose places are dealt out together, at least
    tile: int = 2048  # spots of a tile, about
    edges: int = 4096  # edges multiplied at once


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers under a key."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key
        z = (z ^ (z >> np.uint64(30))) * _MIX[0]
        z = (z ^ (z >> np.uint64(27))) * _MIX[1]
        return z ^ (z >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, seed: int, permutations: np.ndarray) -> np.ndarray:
    """The places (numbers x permutations) that each permutation of 0 ... n-1 sends the numbers to.

    A number is a row and a column of a table just large enough; rows and columns are shifted in turn by hashes of
    each other, and places beyond n are sent on until they fall below it.
    """
    across = max(1, int(np.ceil(np.sqrt(n))))
    down = -(-n // across)
    base = _mixed(permutations, _mixed(np.array([seed & 0x7FFFFFFFFFFFFFFF]), np.uint64(1)))
    keys = [_mixed(base, np.uint64(2 * r + 3)) for r in range(ROUNDS)]

    def once(x: np.ndarray, which: list[np.ndarray]) -> np.ndarray:
        row, column = x // across, x % across
        for r in range(0, ROUNDS, 2):
            row = (row + (_mixed(column, which[r]) % np.uint64(down)).astype(np.int64)) % down
            column = (column + (_mixed(row, which[r + 1]) % np.uint64(across)).astype(np.int64)) % across
        return row * across + column

    out = once(np.repeat(np.asarray(numbers, np.int64)[:, None], len(permutations), 1), keys)
    while True:
        i, p = np.nonzero(out >= n)
        if len(i) == 0:
            return out
        out[i, p] = once(out[i, p], [k[p] for k in keys])


def _blocks(n_permutations: int, block: int) -> list[np.ndarray]:
    return [np.arange(b, min(b + block, n_permutations)) for b in range(0, n_permutations, block)]


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed without loss."""
    raw = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    raw += [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    raw = b"".join(raw)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosened(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).reshape(-1))
        at += n * width
    return out


@dataclass(frozen=True)
class _Coded:
    """Rows of values as bytes, column by column: of a column of decimal numbers the whole numbers that they are multiples of
    a power of ten by, where that gives back every bit, and else all bytes of the values. 0 stands for a value kept aside."""

    head: np.ndarray  # decimals (-1: all bytes), least whole number and bytes of each column
    planes: np.ndarray  # rows x bytes
    aside: np.ndarray  # rows x columns
    values: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> _Coded:
        head, planes, aside = [], [], np.zeros(values.shape, bool)
        for j in range(values.shape[1]):
            x = np.ascontiguousarray(values[:, j], "<f8")
            best, known = -1, x[:0]
            with np.errstate(all="ignore"):
                for d in range(DECIMALS + 1):
                    whole = np.rint(x * 10.0**d)
                    same = (np.abs(whole) < 2.0**53) & (whole / 10.0**d == x) & ((x != 0) | ~np.signbit(x))
                    if best < 0 or same.sum() > known.sum():
                        best, known, wholes = d, same, whole
                    if same.all():
                        break
            if 2 * known.sum() <= len(x):
                head += [-1, 0, 8]
                planes.append(x.view(np.uint8).reshape(-1, 8))
                continue
            least = int(wholes[known].min())
            codes = np.zeros(len(x), "<u8")
            codes[known] = (wholes[known].astype(np.int64) - least + 1).astype(np.uint64)
            size = (int(codes.max()).bit_length() + 7) // 8
            head += [best, least, size]
            planes.append(codes.view(np.uint8).reshape(-1, 8)[:, :size])
            aside[:, j] = ~known
        return _Coded(np.array(head, "<i8"), np.concatenate(planes, 1), aside, values)

    def arrays(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, ...]:
        """Some of the rows, for ``_squeezed``."""
        aside = self.aside[rows]
        kept = self.values[rows].T[aside.T] if aside.any() else np.zeros(0)
        return self.head, self.planes[rows].T.ravel(), kept.astype("<f8")


CODED = ("<i8", "u1", "<f8")  # what _squeezed gets of coded rows


def _decoded(head: np.ndarray, planes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    head = head.reshape(-1, 3).tolist()
    total = sum(size for *_, size in head)
    n, at, used = len(planes) // total, 0, 0
    out = np.empty((n, len(head)))
    for j, (decimals, least, size) in enumerate(head):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = planes[at * n : (at + size) * n].reshape(size, n).T
        at += size
        if decimals < 0:
            out[:, j] = wide.view("<f8").reshape(-1)
            continue
        codes = wide.view("<i8").reshape(-1)
        out[:, j] = (codes - 1 + least) / 10.0**decimals
        aside = np.flatnonzero(codes == 0)
        out[aside, j] = kept[used : used + len(aside)]
        used += len(aside)
    return out


def _send(n: int, seed: int, n_permutations: int, width: int, starts: np.ndarray, sizes: Sizes):
    """Values to the tiles of their new places; ``starts`` are the tiles' first numbers, in order."""

    def dealt(ranks: np.ndarray, groups: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        owns = [(int(g), np.flatnonzero(groups == g)) for g in np.unique(groups)]
        coded = [_Coded.of(values[mine]) for _, mine in owns]
        for number, which in enumerate(_blocks(n_permutations, sizes.block)):
            places = permuted(ranks, n, seed, which)
            for (group, mine), code in zip(owns, coded):
                cell = (places[mine] * sizes.block + np.arange(len(which))).ravel()
                order = np.argsort(cell)
                cell, owner = cell[order], order // len(which)
                tile = np.searchsorted(starts, cell // sizes.block, "right") - 1
                first = np.flatnonzero(np.diff(tile, prepend=-1))
                packed = []
                for a, b in zip(first, np.append(first[1:], len(tile))):
                    gaps = np.diff(cell[a:b], prepend=starts[tile[a]] * sizes.block).astype("<u4")
                    packed.append(_squeezed(gaps, *code.arrays(owner[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(starts[tile[first]], pa.int64()),
                        pa.array(np.full(len(first), group), pa.int64()),
                        pa.array(np.full(len(first), number), pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["tile", "genes", "block", "packed"],
                )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ranks = batch.column(0).to_numpy(zero_copy_only=False)
            groups = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ranks), width)
            held.append((ranks, groups, values))
            count += len(ranks)
            if count >= sizes.chunk:
                yield from dealt(*map(np.concatenate, zip(*held)))
                held, count = [], 0
        if count:
            yield from dealt(*map(np.concatenate, zip(*held)))

    return send


def _pack_edges(table: pa.Table) -> pa.Table:
    """A tile's edges: ``inner`` ones by places in the tile (its size: no spot), ``outer`` ones by numbers."""
    tile, size = table.column("tile")[0].as_py(), table.column("size")[0].as_py()
    a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
    order = np.lexsort((w, b, a))  # the same order of summing in every run
    a, b, w = a[order], b[order], w[order].astype("<f8")
    here = lambda r: (r < 0) | ((r >= tile) & (r < tile + size))
    inner = here(a) & here(b)
    place = lambda r: np.where(r < 0, size, r - tile).astype("<u4")
    packed = _squeezed(place(a[inner]), place(b[inner]), w[inner]), _squeezed(a[~inner].astype("<i8"), b[~inner].astype("<i8"), w[~inner])
    return pa.table({"tile": pa.array([tile], pa.int64()), "inner": pa.array(packed[:1], pa.binary()), "outer": pa.array(packed[1:], pa.binary())})


def _pack_routes(table: pa.Table) -> pa.Table:
    """The numbers of a tile that others' sums need, or its own with others' numbers, and whose they are."""
    rank, to = (table.column(c).to_numpy() for c in ("rank", "to"))
    order = np.lexsort((rank, to))
    packed = _squeezed(rank[order].astype("<i8"), to[order].astype("<i8"))
    return pa.table({"tile": table.column("tile")[:1], "routes": pa.array([packed], pa.binary())})


def _summed(matrix: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, edges: int) -> np.ndarray:
    total = np.zeros(matrix.shape[1])
    for i in range(0, len(w), edges):
        total += np.einsum("e,ex,ex->x", w[i : i + edges], matrix[a[i : i + edges]], matrix[b[i : i + edges]])
    return total


MOVED = "tile long, genes long, block long, ranks binary, rows binary, cross array<double>"
_MOVED = pa.schema(
    [("tile", pa.int64()), ("genes", pa.int64()), ("block", pa.int64()), ("ranks", pa.binary()), ("rows", pa.binary()), ("cross", pa.list_(pa.float64()))]
)


def _settle(sizes: Sizes):
    def settle(arrived: pa.Table, tiles: pa.Table) -> pa.Table:
        """A tile's sums over its inner edges, for all permutations of a block, and the rows that outer edges need."""
        out: list[tuple] = []
        for row in tiles.to_pylist():  # one
            fill, tile = np.array(row["fill"]), row["tile"]
            values = np.zeros((row["size"] * sizes.block, len(fill)))
            for message in arrived.column("packed"):
                gaps, *coded = _loosened(message.as_py(), "<u4", *CODED)
                values[np.cumsum(gaps, dtype=np.int64)] = _decoded(*coded)
            if row["routes"] is not None:
                rank, to = _loosened(row["routes"], "<i8", "<i8")
                by_place = values.reshape(row["size"], -1)
                first = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(first, np.append(first[1:], len(to))):
                    rows = _Coded.of(by_place[rank[a:b] - tile].reshape(-1, len(fill))).arrays()
                    out.append((int(to[a]), row["genes"], row["block"], _squeezed(rank[a:b]), _squeezed(*rows), None))
            if row["inner"] is not None:
                a, b, w = _loosened(row["inner"], "<u4", "<u4", "<f8")
                matrix = np.concatenate([values, np.zeros((sizes.block, len(fill)))]) + fill  # the last row: no spot
                total = _summed(matrix.reshape(row["size"] + 1, -1), a, b, w, sizes.edges)
                out.append((tile, row["genes"], row["block"], None, None, total.tolist()))
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, _MOVED)], schema=_MOVED)

    return settle


def _cross(sizes: Sizes):
    def cross(arrived: pa.Table, tiles: pa.Table) -> pa.Table:
        """Sums of weight * value * value over a tile's edges, for all permutations of a block."""
        groups, blocks, sums = [], [], []
        for row in tiles.to_pylist() if arrived.num_rows else []:
            fill = np.array(row["fill"])
            total, ranks, matrix = np.zeros(sizes.block * len(fill)), [], []
            for moved in arrived.to_pylist():
                if moved["cross"] is not None:
                    total += np.array(moved["cross"])
                else:
                    ranks += _loosened(moved["ranks"], "<i8")
                    matrix.append((_decoded(*_loosened(moved["rows"], *CODED)) + fill).reshape(len(ranks[-1]), -1))
            if ranks:
                ranks, matrix = np.concatenate(ranks), np.concatenate(matrix)
                order = np.argsort(ranks)
                a, b, w = _loosened(row["outer"], "<i8", "<i8", "<f8")
                place = lambda r: order[np.searchsorted(ranks[order], r)]
                total = total + _summed(matrix, place(a), place(b), w, sizes.edges)
            groups.append(row["genes"])
            blocks.append(row["block"])
            sums.append(total.tolist())
        return pa.table(
            [pa.array(groups, pa.int64()), pa.array(blocks, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["genes", "block", "cross"]
        )

    return cross


def _numbered_spots(spots: DataFrame, tile: int) -> DataFrame:
    """(spot_id, tile, rank): spots of a neighbourhood share a tile, ranks run from 0 to n-1 along the tiles.

    Neighbourhoods are cells of a grid over ``x, y`` where the spots have them; a crowded cell is several tiles.
    """
    everyone = spots.select("spot_id", *[c for c in ("x", "y") if c in spots.columns]).where("spot_id is not null").dropDuplicates(["spot_id"])
    n = everyone.count()
    cell = F.lit("all")
    if {"x", "y"} <= set(everyone.columns):
        sides = everyone.agg(*[f(c).cast("double").alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]).first()
        cells = max(1, int(np.ceil(np.sqrt(n / tile))))

        def along(c: str):
            low, high = sides[f"{c}0"], sides[f"{c}1"]
            if low is None or not np.isfinite([low, high]).all() or high <= low:
                return F.lit("0")
            return F.least(F.floor((F.col(c) - low) / (high - low) * cells), F.lit(cells - 1)).cast("string")

        cell = F.coalesce(F.concat(along("x"), F.lit(","), along("y")), F.lit("nowhere"))
    everyone = everyone.select("spot_id", cell.alias("cell"))
    parts = everyone.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    h = F.xxhash64(F.lit("tile"), "spot_id")
    everyone = everyone.join(parts, "cell").withColumn("tile_key", F.concat("cell", F.lit("#"), F.pmod(h, F.col("parts")).cast("string")))
    everyone = materialize(everyone.select("spot_id", "tile_key"), "spot-tiles")
    tiles = everyone.groupBy("tile_key").agg(F.count("*").alias("c")).withColumn("_h", F.xxhash64("tile_key"))
    tiles = running(tiles, [], "_h", {"upto": ("sum", F.col("c"))}, buckets=hash_buckets, tiebreak=["tile_key"])
    inside = F.row_number().over(Window.partitionBy("tile_key").orderBy(F.xxhash64("spot_id"), "spot_id"))
    return everyone.join(tiles.select("tile_key", (F.col("upto") - F.col("c")).alias("tile")), "tile_key").select(
        "spot_id", F.col("tile").cast("long").alias("tile"), (F.col("tile") + inside - 1).cast("long").alias("rank")
    )


def autocorr_permutation(
    expr: DataFrame,
    weights: DataFrame,
    spots: DataFrame,
    genes: list[str] | None = None,
    n: int = fv.PERMUTATIONS,
    seed: int = 0,
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """A5. (gene, morans_i, at_least, permutations, p_value) with the one-sided p = (1 + #{I* >= I}) / (1 + n).

    A missing (spot, gene) value is a zero. A gene without variance has null I, count and p. An end of a weight that
    is no spot of ``spots`` has the value 0, as in the other statistics. All weights of one spot meet in one task.
    """
    in_range("n", n, 1)
    values = expr.select("spot_id", "gene", F.col("value").cast("double").alias("value"))
    if genes is not None:
        values = values.where(F.col("gene").isin(list(genes)))
    sums = materialize(moran(autocorr_sums(values, weights, spots)), "autocorrelation-sums")  # a row per gene
    ranks = materialize(_numbered_spots(spots, sizes.tile), "spot-ranks")
    n_spots = ranks.count()

    width = max(1, min(sizes.genes, sums.count()))
    order = running(sums.select("gene", F.xxhash64("gene").alias("_h")), [], "_h", {"_i": ("sum", F.lit(1))}, buckets=hash_buckets, tiebreak=["gene"])
    numbered = order.select("gene", F.floor((F.col("_i") - 1) / width).cast("long").alias("genes"), ((F.col("_i") - 1) % width).alias("slot"))
    numbered = materialize(numbered.join(sums.select("gene", "mean"), "gene"), "gene-groups")
    pick = lambda v: F.array(*[F.coalesce(F.sum(F.when(F.col("slot") == j, v)), F.lit(0.0)) for j in range(width)])
    fills = numbered.groupBy("genes").agg(pick(-F.col("mean")).alias("fill"))
    # values are centred where they are summed, so that a gene without a value at a spot is centred too
    rows = values.where("value is not null").join(numbered, "gene").join(ranks.select("spot_id", "rank"), "spot_id")
    rows = rows.groupBy("rank", "genes").agg(pick(F.col("value")).alias("v"))

    end = lambda c: ranks.select(F.col("spot_id").alias(c), F.col("rank").alias(f"{c}_rank"), F.col("tile").alias(f"{c}_tile"))
    edges = weights.where("weight is not null").select("spot_id", "neighbour_id", F.col("weight").cast("double").alias("w"))
    edges = edges.join(end("spot_id"), "spot_id", "left").join(end("neighbour_id"), "neighbour_id", "left")
    rank_or_none = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    tile = F.coalesce("spot_id_tile", "neighbour_id_tile")
    edges = edges.select(tile.alias("tile"), rank_or_none("spot_id_rank").alias("a"), rank_or_none("neighbour_id_rank").alias("b"), "w")
    edges = materialize(edges, "tile-edges")
    outside = edges.where("tile is null").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).scalar()
    edges = edges.where("tile is not null")
    tile_sizes = materialize(ranks.groupBy("tile").agg(F.count("*").alias("size")), "tile-sizes")
    starts = np.sort(tile_sizes.select("tile").toArrow().column("tile").to_numpy())  # one number per some thousand spots
    by_tile = edges.join(tile_sizes, "tile").groupBy("tile").applyInArrow(_pack_edges, "tile long, inner binary, outer binary")
    home = ranks.select("rank", F.col("tile").alias("home"))
    outer = edges.join(home.select(F.col("rank").alias("b"), "home"), "b").where("a >= 0 and home <> tile")
    needed = outer.select(F.explode(F.array("a", "b")).alias("rank"), F.col("tile").alias("to")).distinct().join(home, "rank")
    routes = needed.withColumnRenamed("home", "tile").groupBy("tile").applyInArrow(_pack_routes, "tile long, routes binary")
    tiles = tile_sizes.join(by_tile, "tile", "left").join(routes, "tile", "left").where("inner is not null or routes is not null")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(_blocks(n, sizes.block)) - 1).cast("long")))
    # every group of genes and block of permutations reads the tiles
    every = materialize(fills.withColumn("block", blocks), "permutation-blocks").withColumn("_all", F.lit(0))
    tiles = materialize(tiles, "tiles").withColumn("_all", F.lit(0)).join(every, "_all").drop("_all")

    sent = rows.mapInArrow(_send(n_spots, seed, n, width, starts, sizes), "tile long, genes long, block long, packed binary")
    key = ["tile", "genes", "block"]
    at_home = tiles.select(*key, "fill", "size", "inner", "routes")
    moved = sent.groupBy(*key).cogroup(at_home.groupBy(*key)).applyInArrow(_settle(sizes), MOVED)
    ends = tiles.where("inner is not null").select(*key, "fill", "outer")
    crossed = moved.groupBy(*key).cogroup(ends.groupBy(*key)).applyInArrow(_cross(sizes), "genes long, block long, cross array<double>")
    crossed = crossed.select("genes", "block", F.posexplode("cross").alias("at", "cross")).groupBy("genes", "block", "at").agg(F.sum("cross").alias("cross"))
    crossed = crossed.select(
        "genes", (F.col("at") % width).alias("slot"), (F.col("block") * sizes.block + F.floor(F.col("at") / width)).alias("perm"), "cross"
    ).where(F.col("perm") < n)
    stars = crossed.join(numbered.select("genes", "slot", "gene"), ["genes", "slot"]).join(sums, "gene")
    cross = F.col("cross") + F.col("mean") * F.col("mean") * outside
    i_star = F.try_divide(F.col("n") * cross, F.col("s0") * F.col("m2"))
    counted = stars.groupBy("gene").agg(F.count_if(i_star >= F.col("morans_i") - TIE).alias("at_least"))
    known = F.col("morans_i").isNotNull()
    # without any edge both I and I* are undefined
    return sums.join(counted, "gene", "left").select(
        "gene",
        "morans_i",
        F.when(known, F.coalesce("at_least", F.lit(0))).alias("at_least"),
        F.lit(n).cast("long").alias("permutations"),
        F.when(known, (F.coalesce("at_least", F.lit(0)) + 1) / F.lit(float(n + 1))).alias("p_value"),
    )
