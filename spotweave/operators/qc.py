"""Spot quality control, regions and tiles (Q1-Q11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns, one_of
from spotweave.functions.geometry import points_in_boxes
from spotweave.functions.numeric import clean_double


def qc_pass(min_reads: int, min_genes: int, max_mt_percent: float) -> Column:
    """All three bounds inclusive; NULL and NaN fail."""
    return F.coalesce(
        (F.col("n_reads") >= min_reads)
        & (F.col("n_genes") >= min_genes)
        & (clean_double("mt_percent") <= max_mt_percent),
        F.lit(False),
    )


def _check_thresholds(min_reads, min_genes, max_mt_percent) -> None:
    in_range("min_reads", min_reads, 0)
    in_range("min_genes", min_genes, 0)
    in_range("max_mt_percent", max_mt_percent, 0, 100)


def filter_quality(
    spots: DataFrame,
    min_reads: int = fv.MIN_READS_PER_SPOT,
    min_genes: int = fv.MIN_GENES_PER_SPOT,
    max_mt_percent: float = fv.MAX_MT_PERCENT,
) -> DataFrame:
    """Q1."""
    _check_thresholds(min_reads, min_genes, max_mt_percent)
    need_columns(spots, "n_reads", "n_genes", "mt_percent")
    return spots.where(qc_pass(min_reads, min_genes, max_mt_percent))


def qc_summary(
    spots: DataFrame,
    min_reads: int = fv.MIN_READS_PER_SPOT,
    min_genes: int = fv.MIN_GENES_PER_SPOT,
    max_mt_percent: float = fv.MAX_MT_PERCENT,
    by: list[str] | None = None,
) -> DataFrame:
    """Q2. Before/after figures of Q1 in one pass. ``filtering_rate`` is the retained share.

    The median is over whole gene counts, so its buffer is bounded by the genome, not by the data.
    """
    _check_thresholds(min_reads, min_genes, max_mt_percent)
    need_columns(spots, "n_reads", "n_genes", "mt_percent")
    kept = spots.withColumn("_kept", qc_pass(min_reads, min_genes, max_mt_percent))
    when_kept = lambda c: F.when(F.col("_kept"), c)
    out = kept.groupBy(*(by or [])).agg(
        F.count("*").alias("spots_before"),
        F.count_if("_kept").alias("spots_after"),
        F.coalesce(F.max(when_kept(F.col("n_genes"))).cast("int"), F.lit(0)).alias("genes_detected"),
        F.coalesce(F.avg(when_kept(F.col("n_reads"))), F.lit(0.0)).alias("mean_reads_per_spot"),
        F.coalesce(F.median(when_kept(F.col("n_genes"))), F.lit(0.0)).alias("median_genes_per_spot"),
        F.coalesce(F.avg(when_kept(clean_double("mt_percent"))), F.lit(0.0)).alias("mean_mt_percent"),
    )
    return out.withColumn(
        "filtering_rate",
        F.coalesce(F.col("spots_after") / F.nullif("spots_before", F.lit(0)), F.lit(0.0)),
    )


def spot_metrics(expr: DataFrame, mt_prefix: str = fv.MT_PREFIX) -> DataFrame:
    """Q3. Long expression -> n_reads, n_genes (count > 0) and mt_percent per spot.

    Repeated (spot, gene) rows add up first, so a gene is counted once per spot.
    """
    per_gene = expr.groupBy("spot_id", "gene").agg(F.sum("count").alias("count"))
    mt = F.when(F.col("gene").startswith(mt_prefix), F.col("count")).otherwise(0)
    return per_gene.groupBy("spot_id").agg(
        F.sum("count").alias("n_reads"),
        F.count_if(F.col("count") > 0).alias("n_genes"),
        F.coalesce(F.lit(100.0) * F.sum(mt) / F.nullif(F.sum("count"), F.lit(0)), F.lit(0.0)).alias("mt_percent"),
    )


def grid_regions(spots: DataFrame, num_regions: int = 4, x: str = "x_coord") -> DataFrame:
    """Q5. Equal-width, right-closed bins of one coordinate, ``region_0`` upward; NULL stays NULL.

    A constant coordinate lies in the middle of its (widened) range, as a right-closed cut puts it.
    """
    in_range("num_regions", num_regions, 1)
    value = clean_double(x)
    span = spots.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("s")).scalar()
    framed = spots.withColumn("_span", span)
    low, high = F.col("_span.low"), F.col("_span.high")
    position = F.ceil((value - low) * num_regions / (high - low)) - 1
    number = F.when(high == low, F.lit((num_regions + 1) // 2 - 1)).otherwise(
        F.least(F.greatest(position, F.lit(0)), F.lit(num_regions - 1))
    )
    region = F.when(value.isNotNull(), F.concat(F.lit("region_"), number.cast("string")))
    return framed.withColumn("region", region).drop("_span")


def split_by_region(
    spots: DataFrame, regions: list[str] | None = None, num_regions: int = 4, x: str = "x_coord"
) -> DataFrame:
    """Q4. Rows with their region, restricted to ``regions`` when given; a sink partitions by it in one pass.

    Without a region column the coordinate grid supplies it; asking for names that cannot exist is an error.
    """
    if "region" not in spots.columns:
        if regions:
            raise ValueError("region names were given but the spots have no region column")
        return grid_regions(spots, num_regions, x)
    return spots.where(F.col("region").isin(list(regions))) if regions else spots


def roi_regions(spots: DataFrame, rois: DataFrame) -> DataFrame:
    """Q6. Assign spots to named rectangles (closed on all sides); one row per (spot, roi) hit."""
    return points_in_boxes(spots, rois).drop("x1", "y1", "x2", "y2")


def region_counts(spots: DataFrame) -> DataFrame:
    return spots.groupBy("region").agg(F.count("*").alias("barcode_count"))


def region_stats(spots: DataFrame) -> DataFrame:
    """Q7. Number of regions, and mean (cut to int), min and max spots per region."""
    return region_counts(spots).agg(
        F.count("*").alias("total_regions"),
        F.coalesce(F.avg("barcode_count"), F.lit(0.0)).cast("long").alias("mean_per_region"),
        F.coalesce(F.min("barcode_count"), F.lit(0)).alias("min_per_region"),
        F.coalesce(F.max("barcode_count"), F.lit(0)).alias("max_per_region"),
    )


def region_distribution(spots: DataFrame) -> DataFrame:
    """Q10. Spots and percent per region; the total comes from the region counts, not from a second scan."""
    counts = region_counts(spots)
    return counts.withColumn("_total", counts.agg(F.sum("barcode_count").alias("t")).scalar()).select(
        "region",
        F.col("barcode_count").alias("spots"),
        (F.lit(100.0) * F.col("barcode_count") / F.col("_total")).alias("percent"),
    )


def merge_tiles(tiles: DataFrame, how: str = "average", order: list[str] | None = None) -> DataFrame:
    """Q8. ``tiles`` is the union of all tiles (``union_tiles``); one row per barcode remains.

    ``first`` and the non-numeric columns of ``average`` take the row that is lowest in ``order``
    (tile, then row number), because Spark rows have no order of their own. NULL barcodes are dropped.
    Without a barcode column the union itself is the result.
    """
    one_of("how", how, fv.MERGE_MODES)
    if "barcode" not in tiles.columns:
        return tiles
    order = order or []
    need_columns(tiles, *order)
    fields = [f for f in tiles.schema.fields if f.name != "barcode" and f.name not in order]
    numeric = {f.name for f in fields if isinstance(f.dataType, NumericType)}
    rows = tiles.where(F.col("barcode").isNotNull())
    if how == "max":
        return rows.groupBy("barcode").agg(*[F.max(f.name).alias(f.name) for f in fields])
    taken = [f.name for f in fields if how == "first" or f.name not in numeric]
    if taken and not order:
        raise ValueError("an explicit order column is needed to keep the first row")
    aggregates = [F.avg(n).alias(n) for n in numeric] if how == "average" else []
    if taken:
        aggregates.append(F.min_by(F.struct(*taken), F.struct(*order)).alias("_first"))
    merged = rows.groupBy("barcode").agg(*aggregates)
    pick = [F.col(f"_first.{f.name}").alias(f.name) if f.name in taken else F.col(f.name) for f in fields]
    return merged.select("barcode", *pick)


def union_tiles(tiles: list[DataFrame]) -> DataFrame:
    """All tiles with a ``tile`` number; a column missing from one tile is NULL there."""
    if not tiles:
        raise ValueError("no tiles")
    parts = [t.withColumn("tile", F.lit(i)) for i, t in enumerate(tiles)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def overlap_stats(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """Q9. Rows beyond one per barcode over all tiles, also as percent of the merged rows."""
    per_barcode = (
        tiles.where(F.col("barcode").isNotNull())
        .groupBy("barcode")
        .agg(F.count("*").alias("n"))
    )
    totals = per_barcode.agg(
        F.count("*").alias("total_barcodes"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("overlapping_barcodes"),
    )
    return totals.select(
        tiles.agg(F.countDistinct(tile).alias("t")).scalar().alias("tiles_merged"),
        "total_barcodes",
        "overlapping_barcodes",
        F.coalesce(
            F.lit(100.0) * F.col("overlapping_barcodes") / F.nullif("total_barcodes", F.lit(0)), F.lit(0.0)
        ).alias("overlap_percent"),
    )


def gene_filter(expr: DataFrame, genes: DataFrame | list[str]) -> DataFrame:
    """Q11. Rows of the wanted genes; a Python list becomes a pushed-down IN, a table a semi join."""
    if isinstance(genes, DataFrame):
        return expr.join(genes.select("gene"), "gene", "left_semi")
    return expr.where(F.col("gene").isin(list(genes)))
