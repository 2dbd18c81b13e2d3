"""Spot QC, regions, tiles, expression and spatial statistics."""

import random

import pytest
from pyspark.sql import functions as F

from spotweave.operators import expression as E
from spotweave.operators import qc as Q
from spotweave.operators import spatial as A

SPOTS = "barcode string, n_reads long, n_genes long, mt_percent double"
EDGE = [
    ("on", 1000, 200, 20.0), ("reads", 999, 200, 20.0), ("genes", 1000, 199, 20.0), ("mt", 1000, 200, 20.01),
    ("null", 1000, 200, None), ("nan", 1000, 200, float("nan")), ("good", 3000, 401, 1.0),
]


def test_quality_bounds_are_inclusive(spark):
    kept = Q.filter_quality(spark.createDataFrame(EDGE, SPOTS))
    assert {r.barcode for r in kept.collect()} == {"on", "good"}


def test_quality_summary(spark):
    got = Q.qc_summary(spark.createDataFrame(EDGE, SPOTS)).first()
    assert (got.spots_before, got.spots_after, got.genes_detected) == (7, 2, 401)
    assert (got.mean_reads_per_spot, got.median_genes_per_spot, got.mean_mt_percent) == (2000.0, 300.5, 10.5)
    assert got.filtering_rate == pytest.approx(2 / 7)
    empty = Q.qc_summary(spark.createDataFrame([], SPOTS)).first()
    assert (empty.spots_before, empty.filtering_rate, empty.mean_reads_per_spot) == (0, 0.0, 0.0)


def test_quality_arguments(spark):
    df = spark.createDataFrame(EDGE, SPOTS)
    for bad in ({"min_reads": -1}, {"min_genes": -1}, {"max_mt_percent": 101}):
        with pytest.raises(ValueError):
            Q.filter_quality(df, **bad)
    with pytest.raises(ValueError, match="n_genes"):
        Q.filter_quality(df.drop("n_genes"))


def test_spot_metrics(spark):
    expr = spark.createDataFrame(
        [("s", "MT-A", 1), ("s", "B", 2), ("s", "B", 1), ("s", "C", 0), ("z", "B", 0)], "spot_id string, gene string, count long"
    )
    got = {r.spot_id: (r.n_reads, r.n_genes, r.mt_percent) for r in Q.spot_metrics(expr).collect()}
    assert got == {"s": (4, 2, 25.0), "z": (0, 0, 0.0)}


def test_grid_regions_cut_to_the_right(spark):
    xs = [0.0, 1.0, 2.0, 2.5, 4.0, 5.0, 7.5, 10.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x_coord double")
    got = [r.region for r in Q.split_by_region(df).orderBy("i").collect()]
    assert got == [f"region_{n}" for n in (0, 0, 0, 0, 1, 1, 2, 3)] + [None]
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, x_coord double")
    assert {r.region for r in Q.grid_regions(flat).collect()} == {"region_1"}


def test_regions(spark):
    df = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "s"), ("d", None)], "barcode string, region string")
    assert Q.split_by_region(df, ["s"]).count() == 1 and Q.split_by_region(df).count() == 4
    with pytest.raises(ValueError):
        Q.split_by_region(df.drop("region").withColumn("x_coord", F.lit(1.0)), ["s"])
    stats = Q.region_stats(df).first()
    assert tuple(stats) == (3, 1, 1, 2)
    assert {r.region: r.percent for r in Q.region_distribution(df).collect()} == {"t": 50.0, "s": 25.0, None: 25.0}


def tiles(spark):
    a = spark.createDataFrame([("x", 1.0, "p"), ("y", 2.0, "p"), (None, 9.0, "p")], "barcode string, v double, region string")
    b = spark.createDataFrame([("x", 3.0, 5), ("z", 4.0, 6)], "barcode string, v double, extra int")
    c = spark.createDataFrame([("x", 2.0, "q"), ("y", 8.0, "q")], "barcode string, v double, region string")
    return Q.union_tiles([a, b, c]).withColumn("row", F.monotonically_increasing_id())


def test_merge_tiles(spark):
    t = tiles(spark)
    rows = lambda how: {r.barcode: r for r in Q.merge_tiles(t, how, ["tile", "row"]).collect()}
    first, average, top = rows("first"), rows("average"), rows("max")
    assert set(first) == set(average) == set(top) == {"x", "y", "z"}
    assert (first["x"].v, first["x"].region, first["x"].extra) == (1.0, "p", None)
    assert (average["x"].v, average["x"].region, average["x"].extra) == (2.0, "p", 5.0)
    assert (top["x"].v, top["x"].region, top["y"].v) == (3.0, "q", 8.0)
    assert Q.merge_tiles(t.drop("barcode"), "max").count() == 7
    with pytest.raises(ValueError):
        Q.merge_tiles(t, "sum")
    with pytest.raises(ValueError, match="order"):
        Q.merge_tiles(t, "first")
    o = Q.overlap_stats(t).first()
    assert (o.tiles_merged, o.total_barcodes, o.overlapping_barcodes) == (3, 3, 3)
    assert o.overlap_percent == 100.0


def test_wide_long_and_gene_filter(spark):
    long = spark.createDataFrame([("s1", "A", 2), ("s1", "A", 1), ("s2", "B", 5)], "spot_id string, gene string, count long")
    wide = E.to_wide(long, ["A", "B"])
    assert {tuple(r) for r in wide.collect()} == {("s1", 3, 0), ("s2", 0, 5)}
    assert {tuple(r) for r in E.to_long(wide, ["spot_id"]).collect()} == {("s1", "A", 3), ("s1", "B", 0), ("s2", "A", 0), ("s2", "B", 5)}
    assert Q.gene_filter(long, ["B"]).count() == 1
    assert Q.gene_filter(long, spark.createDataFrame([("A",)], "gene string")).count() == 2


def test_normalisation(spark):
    rng = random.Random(1)
    expr = spark.createDataFrame(
        [(f"s{i % 7}", f"g{rng.randrange(9)}", rng.randrange(50)) for i in range(200)], "spot_id string, gene string, count long"
    )
    lengths = spark.createDataFrame([(f"g{i}", 100 * (i + 1)) for i in range(9)], "gene string, length long")
    totals = E.normalize(expr, "TPM", lengths).groupBy("spot_id").agg(F.sum("value").alias("t")).collect()
    assert len(totals) == 7 and all(r.t == pytest.approx(1e6) for r in totals)
    two = spark.createDataFrame([("s", "g0", 10), ("s", "g1", 30)], "spot_id string, gene string, count long")
    fpkm = {r.gene: r.value for r in E.normalize(two, "FPKM", lengths).collect()}
    assert fpkm == {"g0": pytest.approx(10 * 1e9 / (100 * 40)), "g1": pytest.approx(30 * 1e9 / (200 * 40))}
    assert {r.value for r in E.normalize(two, "counts").collect()} == {10.0, 30.0}
    with pytest.raises(ValueError):
        E.normalize(two, "TPM")


def test_region_expression_and_markers(spark):
    spots = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "q")], "spot_id string, region string")
    expr = spark.createDataFrame([("a", "EPCAM", 4), ("b", "EPCAM", 0), ("c", "VIM", 1)], "spot_id string, gene string, count long")
    got = {(r.region, r.gene): (r.total, r.mean_count, r.detection_rate) for r in E.region_expression(expr, spots).collect()}
    assert got == {("r", "EPCAM"): (4, 2.0, 0.5), ("q", "VIM"): (1, 1.0, 1.0)}
    scores = {(r.spot_id, r.category): r for r in E.marker_category_scores(expr, E.marker_table(spark)).collect()}
    assert scores[("c", "stromal")].markers_seen == 1
    assert scores[("a", "epithelial")].score == pytest.approx(1.6094379 / 8)


def brute(points, k):
    out = set()
    for i, x, y in points:
        near = sorted(((px - x) ** 2 + (py - y) ** 2, j) for j, px, py in points if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("shape", ["uniform", "clusters", "speck", "outlier", "one_place", "line", "few"])
def test_neighbours_match_brute_force(spark, shape):
    rng = random.Random(11)
    k = 4
    if shape == "uniform":
        points = [(rng.random() * 100, rng.random() * 100) for _ in range(250)]
    elif shape == "clusters":  # a third of all points in a speck, the rest far and wide
        points = [(50 + rng.random() * 1e-3, 50 + rng.random() * 1e-3) for _ in range(90)]
        points += [(rng.random() * 1e4, rng.random() * 1e4) for _ in range(160)]
    elif shape == "speck":  # far denser than the grid of the first round, with sparse points right beside it
        points = [(50 + rng.random() * 1e-8, 50 + rng.random() * 1e-8) for _ in range(120)]
        points += [(50 + rng.random() * 10 ** -rng.randrange(8), 50.0) for _ in range(80)] + [(0.0, 0.0), (100.0, 100.0)]
    elif shape == "outlier":  # everything in one cell but one point
        points = [(rng.random(), rng.random()) for _ in range(200)] + [(1e9, 1e9)]
    elif shape == "one_place":  # a third of all points at one location
        points = [(3.0, 3.0)] * 90 + [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(160)]
    elif shape == "line":
        points = [(float(i), 0.0) for i in range(40)] + [(1e6, 0.0)]
    else:
        points = [(0.0, 0.0), (1.0, 1.0), (5.0, 0.0)]
    points = [(i, x, y) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(points, "spot_id long, x double, y double")
    got = A.knn_weights(df, k)
    assert {(r.spot_id, r.neighbour_id, r["rank"]) for r in got.collect()} == brute(points, k)


def test_neighbours_stay_within_a_sample(spark):
    rng = random.Random(12)
    points = [(i, f"s{i % 3}", rng.random() * 10 ** (i % 3), rng.random()) for i in range(120)]
    df = spark.createDataFrame(points, "spot_id long, sample string, x double, y double")
    want = set()
    for s in ("s0", "s1", "s2"):
        want |= brute([(i, x, y) for i, g, x, y in points if g == s], 3)
    got = A.knn_weights(df, 3, keys=["sample"]).collect()
    assert {(r.spot_id, r.neighbour_id, r["rank"]) for r in got} == want


def test_neighbours_of_other_points(spark):
    rng = random.Random(13)
    a = [(i, rng.random(), rng.random()) for i in range(40)]
    b = [(i, rng.random() * 3, rng.random() * 3) for i in range(60)]
    schema = "id long, x double, y double"
    got = A.nearest_neighbours(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 5).collect()
    want = set()
    for i, x, y in a:
        near = sorted(((px - x) ** 2 + (py - y) ** 2, j) for j, px, py in b)[:5]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    assert {(r.id, r.neighbour_id, r["rank"]) for r in got} == want


def test_neighbours_far_from_all_points(spark):
    """Every query works at a coarse level, as no point is near; crowds are opened cell by cell."""
    rng = random.Random(16)
    a = [(i, rng.random(), rng.random()) for i in range(60)]
    b = [(i, 900 + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    schema = "id long, x double, y double"
    got = A.nearest_neighbours(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3).collect()
    want = set()
    for i, x, y in a:
        near = sorted(((px - x) ** 2 + (py - y) ** 2, j) for j, px, py in b)[:3]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    assert {(r.id, r.neighbour_id, r["rank"]) for r in got} == want


def lattice(spark, value):
    """Rook weights on a 4x4 grid."""
    ids = [(i, j) for i in range(4) for j in range(4)]
    name = lambda i, j: i * 4 + j
    weights = [
        (name(i, j), name(i + a, j + b), 1.0)
        for i, j in ids for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < 4 and 0 <= j + b < 4
    ]
    values = [(name(i, j), "g", float(value(i, j))) for i, j in ids]
    return (
        spark.createDataFrame([v for v in values if v[2] != 0] or values, "spot_id long, gene string, value double"),
        spark.createDataFrame(weights, "spot_id long, neighbour_id long, weight double"),
        spark.createDataFrame([(name(i, j),) for i, j in ids], "spot_id long"),
    )


def test_autocorrelation_on_a_lattice(spark):
    board = A.morans_i(*lattice(spark, lambda i, j: (i + j) % 2)).first().morans_i
    assert board == pytest.approx(-1.0)
    expr, weights, spots = lattice(spark, lambda i, j: 1 if i < 2 else 0)
    halves = A.morans_i(expr, weights, spots)
    assert halves.first().morans_i == pytest.approx(2 / 3)
    assert A.morans_i(expr.withColumn("value", F.col("value") * 50), weights, spots).first().morans_i == pytest.approx(2 / 3)
    assert A.gearys_c(expr, weights, spots).first().gearys_c == pytest.approx(15 * 8 / (2 * 48 * 4))
    assert A.interpret_autocorr(halves).first().interpretation == "clustered"
    assert A.autocorr_summary(A.interpret_autocorr(halves)).first().significantly_clustered == 1
    sums = A.autocorr_sums(expr, weights, spots)
    sig = A.autocorr_significance(sums, weights).first()
    assert sig.z_score > 2 and sig.p_value < 0.01 and sig.geary_z < -2
    flat = lattice(spark, lambda i, j: 7)
    row = A.autocorr_significance(A.autocorr_sums(*flat), flat[1]).first()
    assert row.morans_i is None and row.gearys_c is None and row.p_value is None


def test_weight_moments(spark):
    w = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)], "spot_id long, neighbour_id long, weight double")
    m = A.weight_moments(w).first()
    # pairs: {1,2} both ways -> 4, {2,3} one way -> 1; degrees out+in: 2, 3, 1
    assert (m.s0, m.s1, m.s2) == (3.0, 5.0, 14.0)
