"""Image catalog, registration and per-ROI features on pixel tables (K1-K5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns, one_of
from spotweave.functions.geometry import points_in_boxes
from spotweave.functions.graph import connected, lowest_joined
from spotweave.functions.running import exact_quantiles
from spotweave.session import materialize


def find_images(
    catalog: DataFrame,
    image_id: str | None = None,
    stain_type: str | None = None,
    resolution: str = "high",
    max_size_mb: float | None = None,
) -> DataFrame:
    """K1. Images by id and stain code; high resolution means 20x, anything else 10x."""
    one_of("resolution", resolution, ("high", "medium", "low"))
    rows = catalog
    if image_id is not None:
        rows = rows.where(F.col("image_id") == image_id)
    if stain_type is not None:
        one_of("stain_type", stain_type, fv.STAIN_CODES.values())
        rows = rows.where(F.col("stain_type").isin([s for s, code in fv.STAIN_CODES.items() if code == stain_type]))
    if max_size_mb is not None:
        rows = rows.where(F.col("file_size_mb") <= max_size_mb)
    return rows.withColumn("served_magnification", F.lit("20x" if resolution == "high" else "10x"))


def _centred_sums(landmarks: DataFrame) -> DataFrame:
    """Second moments around the means per sample: means first, so large offsets do not cancel."""
    means = landmarks.groupBy("sample_id").agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("x", "y", "u", "v")], F.count("*").alias("matched_points")
    )
    centred = landmarks.join(means, "sample_id").select(
        "sample_id", "matched_points", "m_x", "m_y", "m_u", "m_v",
        *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("x", "y", "u", "v")],
    )
    product = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}")
    return centred.groupBy("sample_id", "matched_points", "m_x", "m_y", "m_u", "m_v").agg(
        product("x", "x"), product("y", "y"), product("x", "y"),
        product("x", "u"), product("y", "u"), product("x", "v"), product("y", "v"),
    )


def fit_registration(landmarks: DataFrame, method: str = "affine") -> DataFrame:
    """K2. Least-squares map from spot (x, y) to image (u, v) per sample: u = a x + b y + tx, v = c x + d y + ty.

    ``affine`` solves the 2x2 normal equations in closed form, ``rigid`` allows rotation and shift only.
    """
    one_of("method", method, ("affine", "rigid"))
    need_columns(landmarks, "sample_id", "x", "y", "u", "v")
    s = _centred_sums(landmarks)
    if method == "affine":
        det = F.nullif(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"), F.lit(0.0))
        solve = lambda p, q: (
            (F.col(p) * F.col("syy") - F.col(q) * F.col("sxy")) / det,
            (F.col(q) * F.col("sxx") - F.col(p) * F.col("sxy")) / det,
        )
        a, b = solve("sxu", "syu")
        c, d = solve("sxv", "syv")
    else:
        angle = F.atan2(F.col("sxv") - F.col("syu"), F.col("sxu") + F.col("syv"))
        a, b, c, d = F.cos(angle), -F.sin(angle), F.sin(angle), F.cos(angle)
    fitted = s.withColumns({"a": a, "b": b, "c": c, "d": d}).where("a is not null")
    return fitted.select(
        "sample_id", "matched_points", "a", "b", "c", "d",
        (F.col("m_u") - F.col("a") * F.col("m_x") - F.col("b") * F.col("m_y")).alias("translation_x"),
        (F.col("m_v") - F.col("c") * F.col("m_x") - F.col("d") * F.col("m_y")).alias("translation_y"),
        F.sqrt(F.col("a") * F.col("a") + F.col("c") * F.col("c")).alias("scale_x"),
        F.sqrt(F.col("b") * F.col("b") + F.col("d") * F.col("d")).alias("scale_y"),
        F.degrees(F.atan2("c", "a")).alias("rotation_degrees"),
    )


def apply_registration(spots: DataFrame, transforms: DataFrame) -> DataFrame:
    """K3. Adds ``image_x, image_y``; a sample without a transform drops out."""
    params = transforms.select("sample_id", "a", "b", "c", "d", "translation_x", "translation_y")
    x, y = F.col("x"), F.col("y")
    return spots.join(params, "sample_id").withColumns(
        {
            "image_x": F.col("a") * x + F.col("b") * y + F.col("translation_x"),
            "image_y": F.col("c") * x + F.col("d") * y + F.col("translation_y"),
        }
    ).drop("a", "b", "c", "d", "translation_x", "translation_y")


def registration_quality(landmarks: DataFrame, transforms: DataFrame, max_rmse: float = 5.0) -> DataFrame:
    """K4. RMSE in pixels, correlation of predicted and true coordinates (mean of both axes), pass below 5."""
    in_range("max_rmse", max_rmse, 0)
    placed = apply_registration(landmarks, transforms)
    dx, dy = F.col("image_x") - F.col("u"), F.col("image_y") - F.col("v")
    out = placed.groupBy("sample_id").agg(
        F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"),
        ((F.corr("image_x", "u") + F.corr("image_y", "v")) / 2).alias("correlation"),
        F.count("*").alias("matched_points"),
    )
    return out.withColumn("passed", F.col("rmse") < max_rmse)


def pixels_in_rois(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels ``image_id, x, y, intensity`` with every ROI (closed box) that covers them."""
    return points_in_boxes(pixels, rois, keys=["image_id"] if "image_id" in rois.columns else None).drop(
        "x1", "y1", "x2", "y2"
    )


def image_intensity(roi_pixels: DataFrame) -> DataFrame:
    """K5 intensity. Moments and exact quartiles per ROI."""
    v = F.col("intensity").cast("double")
    moments = roi_pixels.groupBy("roi_id").agg(
        F.count("*").alias("pixels"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    quartiles = exact_quantiles(roi_pixels, ["roi_id"], "intensity", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quartiles, "roi_id")


def grey_level(value: Column, low: float, high: float, levels: int) -> Column:
    scaled = F.floor((value - low) / (high - low) * levels)
    return F.least(F.greatest(scaled, F.lit(0)), F.lit(levels - 1)).cast("int")


def image_texture(roi_pixels: DataFrame, low: float, high: float, levels: int = 8) -> DataFrame:
    """K5 texture. Grey-level co-occurrence with the right-hand neighbour: contrast, energy,
    homogeneity and correlation. A window holds one pixel row of an ROI, which the image width bounds.
    """
    in_range("levels", levels, 2, 256)
    if high <= low:
        raise ValueError("high must be above low")
    grey = roi_pixels.select(
        "roi_id", *[c for c in ("image_id",) if c in roi_pixels.columns], "x", "y",
        grey_level(F.col("intensity").cast("double"), low, high, levels).alias("g"),
    )
    line = [c for c in ("roi_id", "image_id", "y") if c in grey.columns]
    w = Window.partitionBy(*line).orderBy("x")
    pairs = grey.withColumns({"_g2": F.lead("g").over(w), "_x2": F.lead("x").over(w)}).where(
        F.col("_x2") == F.col("x") + 1
    )
    cells = pairs.groupBy("roi_id", F.col("g").alias("i"), F.col("_g2").alias("j")).agg(F.count("*").cast("double").alias("c"))
    i, j, c = F.col("i").cast("double"), F.col("j").cast("double"), F.col("c")
    n = F.sum("c")
    mi, mj = F.sum(c * i) / n, F.sum(c * j) / n
    vi, vj = F.sum(c * i * i) / n - mi * mi, F.sum(c * j * j) / n - mj * mj
    cov = F.sum(c * i * j) / n - mi * mj
    return cells.groupBy("roi_id").agg(
        n.cast("long").alias("pairs"),
        (F.sum(c * (i - j) * (i - j)) / n).alias("contrast"),
        (F.sum(c * c) / (n * n)).alias("energy"),
        (F.sum(c / (1.0 + F.abs(i - j))) / n).alias("homogeneity"),
        F.when((vi > 1e-12) & (vj > 1e-12), cov / F.sqrt(vi * vj)).alias("correlation"),
    )


def image_morphology(roi_pixels: DataFrame, threshold: float) -> DataFrame:
    """K5 morphology. Area, centroid and axis lengths of the pixels at or above a threshold."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    base = roi_pixels.where(F.col("intensity") >= threshold).groupBy("roi_id").agg(
        F.count("*").alias("area"), F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"),
        F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"), F.covar_pop(x, y).alias("_xy"),
    )
    half = (F.col("_xx") + F.col("_yy")) / 2
    root = F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) / 4 + F.col("_xy") * F.col("_xy"))
    axis = lambda e: 4.0 * F.sqrt(F.greatest(e, F.lit(0.0)))
    return base.select(
        "roi_id", "area", "centroid_x", "centroid_y",
        axis(half + root).alias("major_axis"), axis(half - root).alias("minor_axis"),
    )


def image_features(pixels: DataFrame, rois: DataFrame, feature_type: str = "intensity", **options) -> DataFrame:
    """K5. Dispatch on the feature family after one ROI join."""
    one_of("feature_type", feature_type, fv.FEATURE_TYPES)
    inside = pixels_in_rois(pixels, rois)
    return {"texture": image_texture, "intensity": image_intensity, "morphology": image_morphology}[feature_type](
        inside, **options
    )


#: Steps to the neighbours that a texture compares: right, below, and both diagonals downwards.
DIRECTIONS = {"0": (1, 0), "90": (0, 1), "45": (1, -1), "135": (1, 1)}


def image_summary(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """K5. Per whole image (or ROI): pixels, extent, mean, deviation, least and greatest intensity."""
    v = F.col("intensity").cast("double")
    return pixels.where(v.isNotNull()).groupBy(key).agg(
        F.count("*").alias("pixels"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def texture_2d(
    pixels: DataFrame, low: float, high: float, levels: int = 8, key: str = "image_id", directions: tuple[str, ...] = tuple(DIRECTIONS)
) -> DataFrame:
    """K5. Grey-level co-occurrence in two dimensions, one row per image and direction.

    Pixels are ``image_id, x, y, intensity``, one row per place. A neighbour is found by one join on image and place, so neither an
    image nor a pixel row is gathered anywhere. Pairs count both ways round, as the matrix is symmetric.
    """
    in_range("levels", levels, 2, 256)
    if high <= low:
        raise ValueError("high must be above low")
    for d in directions:
        one_of("direction", d, list(DIRECTIONS))
    grey = pixels.where("intensity is not null").select(key, "x", "y", grey_level(F.col("intensity").cast("double"), low, high, levels).alias("g"))
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(DIRECTIONS[d][0]).alias("dx"), F.lit(DIRECTIONS[d][1]).alias("dy")) for d in directions]))
    asked = grey.withColumn("s", steps).select(
        key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("s.d").alias("direction"), F.col("g").alias("i")
    )
    there = grey.select(*[F.col(c).alias(c) for c in (key, "x", "y")], F.col("g").alias("j"))
    seen = asked.join(there, [key, "x", "y"]).groupBy(key, "direction", "i", "j").agg(F.count("*").cast("double").alias("c"))
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    cells = seen.withColumn("p", both).groupBy(key, "direction", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("c").alias("c"))
    i, j, c = F.col("i").cast("double"), F.col("j").cast("double"), F.col("c")
    n = F.sum("c")
    mean = F.sum(c * i) / n
    spread, shared = F.sum(c * i * i) / n - mean * mean, F.sum(c * i * j) / n - mean * mean
    return cells.groupBy(key, "direction").agg(
        (n / 2).cast("long").alias("pairs"),
        (F.sum(c * (i - j) * (i - j)) / n).alias("contrast"),
        (F.sum(c * c) / (n * n)).alias("energy"),
        (F.sum(c / (1.0 + F.abs(i - j))) / n).alias("homogeneity"),
        F.when(spread > 1e-12, shared / spread).alias("correlation"),
    )


PIXELS_AT_ONCE = 100_000  # of whole tiles that are labelled together, about; a tile with more is labelled by itself
SIDES_OF_A_BLOCK = 1_000_000  # that tiles of a block can share with each other, at most


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value is another one than that before it."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values[1:], values[:-1])], bool)
    codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _group_starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row begins a group of equal columns, the first row too; rows come in order of groups."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for c in columns:
        new |= _differs(table.column(c).combine_chunks())
    return np.append(np.ones(min(1, table.num_rows), bool), new)


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int) -> Iterator[pa.Table]:
    """Ordered rows again, in tables of at least about so many rows that end with a group."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows and any(held[0].column(c)[0] != batch.column(c)[-1] for c in columns):
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_group_starts(table, columns))[-1])
            if last:
                yield table.slice(0, last)
                held, n = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def _tile_labels(table: pa.Table, key: str, tile: int) -> pa.Table:
    """A row per connected group of pixels within a tile, named by its first pixel in order of x and y; ``rim`` is its pixels at the tile's border.

    Rows of one place are one pixel that counts as often as it is there.
    """
    x, y = (table.column(c).to_numpy() for c in ("x", "y"))
    number = np.cumsum(_group_starts(table, [key, "tile_x", "tile_y"])) - 1
    places, row, pixels = np.unique((number * tile + x % tile) * tile + y % tile, return_index=True, return_counts=True)
    x, y = x[row], y[row]
    column, line = x % tile, y % tile
    right, below = np.searchsorted(places, places + tile), np.searchsorted(places, places + 1)
    there = np.append(places, -1)
    right_of = np.flatnonzero((column < tile - 1) & (there[right] == places + tile))
    above = np.flatnonzero((line < tile - 1) & (there[below] == places + 1))
    one, other = np.append(right_of, above), np.append(right[right_of], below[above])
    root = lowest_joined(len(places), one, other)
    heads = np.flatnonzero(root == np.arange(len(root)))
    label = np.searchsorted(heads, root)
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], np.arange(len(heads)))
    fold = lambda how, values: how.reduceat(values[order], first) if len(heads) else np.zeros(0, np.int64)
    sides = np.zeros(len(heads), np.int64)
    np.add.at(sides, label[one], pixels[one] * pixels[other])
    rim = order[((column == 0) | (column == tile - 1) | (line == 0) | (line == tile - 1))[order]]
    ends = np.searchsorted(label[rim], np.arange(len(heads) + 1))
    rims = pa.StructArray.from_arrays([pa.array(v[rim], pa.int64()) for v in (x, y, pixels)], names=["x", "y", "n"])
    columns = {
        key: table.column(key).take(pa.array(row[heads])), "first_x": x[heads], "first_y": y[heads], "area": fold(np.add, pixels),
        "sum_x": fold(np.add, x * pixels), "sum_y": fold(np.add, y * pixels), "x1": fold(np.minimum, x), "y1": fold(np.minimum, y),
        "x2": fold(np.maximum, x), "y2": fold(np.maximum, y), "sides": sides, "rim": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rims),
    }
    return pa.table({c: v if c in (key, "rim") else pa.array(v, pa.int64()) for c, v in columns.items()})


def _labels(key: str, tile: int):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, [key, "tile_x", "tile_y"], PIXELS_AT_ONCE):
            yield from _tile_labels(table, key, tile).combine_chunks().to_batches()

    return label


def _joined_in_blocks(columns: list[str]):
    """(id, root) of the edges a, b of whole blocks: the smallest id that their own edges reach."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, columns, PIXELS_AT_ONCE):
            ends = [table.column(c).to_numpy() for c in ("a", "b")]
            ids, place = np.unique(np.concatenate(ends), return_inverse=True)
            root = lowest_joined(len(ids), *np.split(place, 2))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], names=["id", "root"])

    return join


def image_objects(pixels: DataFrame, threshold: float, key: str = "image_id", tile: int = 512) -> DataFrame:
    """K5 morphology of whole images. Connected groups of pixels at or above a threshold (sides touch):
    ``key, object_x, object_y, area, centroid_x, centroid_y, x1, y1, x2, y2, perimeter``.

    Tiles are labelled by themselves, many small ones at once; only pixels at their borders are joined with those beyond. Labels that
    touch are joined within blocks of tiles first, and by rounds of joins across blocks; their components are the objects.
    An object is named by its component's smallest (x, y) among its tiles' first pixels. ``perimeter`` counts sides without a
    neighbour in the object. Pixels of one place must be one row; the tile bounds what a task holds. Joins are merges, as pixels and
    labels are as many as the images hold, however small their files.
    """
    in_range("tile", tile, 1)
    shown = pixels.where(F.col("intensity") >= threshold).select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    kind = shown.schema[key].dataType.simpleString()
    tiled = shown.withColumns({"tile_x": F.floor(F.col("x") / tile), "tile_y": F.floor(F.col("y") / tile)})
    at = [key, "tile_x", "tile_y"]
    numbers = ("first_x", "first_y", "area", "sum_x", "sum_y", "x1", "y1", "x2", "y2", "sides")
    schema = f"{key} {kind}, {', '.join(f'{c} long' for c in numbers)}, rim array<struct<x:bigint,y:bigint,n:bigint>>"
    parts = tiled.repartition(*at).sortWithinPartitions(*at).mapInArrow(_labels(key, tile), schema)
    parts = materialize(parts.withColumn("label", F.monotonically_increasing_id()), "tile-labels")
    # sides that two pixels share across tiles join labels and, like those inside, shorten the outline
    rim = parts.select(key, "label", F.explode("rim").alias("p")).select(key, "label", "p.*")
    block = tile * max(1, math.isqrt(SIDES_OF_A_BLOCK // (2 * tile)))
    x, y = F.col("x"), F.col("y")
    step = lambda at, dx, dy: F.when(F.pmod(at, F.lit(tile)) == tile - 1, F.struct((x + dx).alias("x"), (y + dy).alias("y")))
    asked = rim.withColumn("to", F.explode(F.array_compact(F.array(step(x, 1, 0), step(y, 0, 1)))))
    own = [F.floor(c / block) for c in (x, y)]
    local = (F.floor(F.col("to.x") / block) == own[0]) & (F.floor(F.col("to.y") / block) == own[1])
    asked = asked.select(
        key, F.col("to.x").alias("x"), F.col("to.y").alias("y"), F.col("label").alias("a"), F.col("n").alias("n_a"),
        own[0].alias("block_x"), own[1].alias("block_y"), local.alias("local"),
    )
    there = rim.where((F.pmod(x, F.lit(tile)) == 0) | (F.pmod(y, F.lit(tile)) == 0))
    there = there.select(*[F.col(c).alias(c) for c in (key, "x", "y")], F.col("label").alias("b"), F.col("n").alias("n_b"))
    touching = asked.join(there.hint("merge"), [key, "x", "y"]).groupBy(key, "block_x", "block_y", "local", "a", "b")
    touching = materialize(touching.agg(F.sum(F.col("n_a") * F.col("n_b")).alias("sides")), "touching-labels")
    blocks = [key, "block_x", "block_y"]
    inside = touching.where("local").select(*blocks, "a", "b").repartition(*blocks).sortWithinPartitions(*blocks)
    inside = materialize(inside.mapInArrow(_joined_in_blocks(blocks), "id long, root long"), "block-labels")
    across = touching.where("not local").select("a", "b")
    for end in ("a", "b"):
        known = inside.select(F.col("id").alias(end), F.col("root").alias("to"))
        across = across.join(known.hint("merge"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    joined = connected(across.where("a <> b").select("a", "b"))
    shared = touching.groupBy(F.col("a").alias("label")).agg(F.sum("sides").alias("across"))
    whole = parts.drop("rim").join(shared.hint("merge"), "label", "left")
    whole = whole.join(inside.withColumnsRenamed({"id": "label", "root": "block_root"}).hint("merge"), "label", "left")
    whole = whole.withColumn("id", F.coalesce("block_root", "label")).join(joined.hint("merge"), "id", "left")
    # pixels without an image touch none
    sides = F.coalesce("across", F.lit(0)) + F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.col("sides"))
    whole = whole.groupBy(F.coalesce("root", "id").alias("object")).agg(
        F.first(key).alias(key), F.min(F.struct("first_x", "first_y")).alias("first"),
        F.sum("area").alias("area"), F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum(sides).alias("sides"),
    )
    return whole.select(
        key, F.col("first.first_x").alias("object_x"), F.col("first.first_y").alias("object_y"), "area",
        (F.col("sum_x") / F.col("area")).alias("centroid_x"), (F.col("sum_y") / F.col("area")).alias("centroid_y"),
        "x1", "y1", "x2", "y2", (4 * F.col("area") - 2 * F.col("sides")).alias("perimeter"),
    )
