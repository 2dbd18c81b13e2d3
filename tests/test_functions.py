"""Numeric helpers, running totals and geometric joins."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import geometry
from spotweave.functions.checks import in_range, need_columns, one_of, safe_identifier, valid_genome
from spotweave.functions import geometry
from spotweave.functions.geometry import inside_polygon, overlapping_intervals, points_in_boxes
from spotweave.functions.numeric import (
    chi2_upper, clean_double, erfc, hypergeometric_upper, log_gamma, normal_two_sided, t_two_sided,
)
from spotweave.functions.running import exact_quantiles, hash_buckets, running


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_erfc_matches_libm(spark):
    points = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 5.0]
    got = one(spark, *[erfc(F.lit(x)) for x in points])
    for x, y in zip(points, got):
        assert y == pytest.approx(math.erfc(x), rel=1e-12)


def test_two_sided_normal(spark):
    assert one(spark, normal_two_sided(F.lit(-1.959964)))[0] == pytest.approx(0.05, abs=1e-6)


def test_chi_square_even_odd_and_null_df(spark):
    h = 3.65
    got = one(
        spark, chi2_upper(F.lit(7.3), F.lit(4)), chi2_upper(F.lit(3.841459), F.lit(1)),
        chi2_upper(F.lit(7.814728), F.lit(3)), chi2_upper(F.lit(7.3), F.lit(0)),
    )
    assert got[0] == pytest.approx(math.exp(-h) * (1 + h))
    assert got[1] == pytest.approx(0.05, abs=1e-6)
    assert got[2] == pytest.approx(0.05, abs=1e-6)
    assert got[3] is None


def test_log_gamma_and_hypergeometric(spark):
    got = one(
        spark, log_gamma(F.lit(1.0)), log_gamma(F.lit(20001.0)),
        hypergeometric_upper(F.lit(3), F.lit(5), F.lit(5), F.lit(20)),
        hypergeometric_upper(F.lit(0), F.lit(5), F.lit(5), F.lit(20)),
        hypergeometric_upper(F.lit(5), F.lit(5), F.lit(5), F.lit(20)),
    )
    assert got[0] == pytest.approx(0.0, abs=1e-12)
    assert got[1] == pytest.approx(math.lgamma(20001.0))
    assert got[2] == pytest.approx(1126 / 15504)
    assert got[3] == 1.0
    assert got[4] == pytest.approx(1 / 15504)


def test_tails_of_large_counts(spark):
    """Where the first term underflows: depleted large sets, many degrees of freedom, z = 0."""

    def upper(k, m, d, t):
        log_c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
        terms = [math.exp(log_c(m, i) + log_c(t - m, d - i) - log_c(t, d)) for i in range(max(k, d + m - t), min(m, d) + 1)]
        return min(1.0, math.fsum(terms))

    cases = [(1, 5000, 5000, 20000), (100, 8000, 3000, 20000), (1200, 8000, 3000, 20000), (1300, 8000, 3000, 20000), (6, 5, 5, 20), (3, 18, 5, 20)]
    got = one(spark, *[hypergeometric_upper(*map(F.lit, c)) for c in cases])
    for value, case in zip(got, cases):
        assert value == pytest.approx(upper(*case), rel=1e-6, abs=1e-9)
    chi = one(spark, chi2_upper(F.lit(2000.0), F.lit(2000)), chi2_upper(F.lit(1999.0), F.lit(1999)), chi2_upper(F.lit(0.0), F.lit(4)))
    assert chi[0] == pytest.approx(0.4958, abs=5e-4) and chi[1] == pytest.approx(0.4958, abs=5e-4) and chi[2] == 1.0
    assert one(spark, normal_two_sided(F.lit(0.0)))[0] == 1.0


def test_t_tail_known_values(spark):
    got = one(
        spark, t_two_sided(F.lit(2.228139), F.lit(10.0)), t_two_sided(F.lit(12.7062), F.lit(1.0)),
        t_two_sided(F.lit(0.0), F.lit(7.0)), t_two_sided(F.lit(None).cast("double"), F.lit(7.0)),
    )
    assert got[0] == pytest.approx(0.05, abs=1e-6)
    assert got[1] == pytest.approx(0.05, abs=1e-5)
    assert got[2] == pytest.approx(1.0)
    assert got[3] is None


def test_clean_double_maps_nan_to_null(spark):
    got = one(spark, clean_double(F.lit(float("nan"))), clean_double(F.lit(1.5)))
    assert list(got) == [None, 1.5]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_plain_window(spark, descending):
    rng = random.Random(3)
    values = {(rng.choice("ab"), rng.choice([round(rng.gauss(0, 5), 2), 0.0, 1e-9, -1e7, 2.0**k]))
              for k in range(-5, 200)}
    rows = [(k, v, i % 9 + 1) for i, (k, v) in enumerate(sorted(values))]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    out = running(
        df, ["k"], "v", {"s": ("sum", F.col("w")), "lo": ("min", F.col("w")), "hi": ("max", F.col("w"))},
        descending=descending,
    ).collect()
    assert len(out) == len(rows)
    for key in "ab":
        group = sorted([r for r in out if r.k == key], key=lambda r: r.v, reverse=descending)
        total, lo, hi = 0, 99, 0
        for r in group:
            total, lo, hi = total + r.w, min(lo, r.w), max(hi, r.w)
            assert (r.s, r.lo, r.hi) == (total, lo, hi)


def test_running_without_keys_and_over_hashes(spark):
    df = spark.range(500).withColumn("h", F.xxhash64("id"))
    out = running(
        df, [], "h", {"rank": ("sum", F.lit(1))}, buckets=hash_buckets, tiebreak=["id"]
    ).orderBy("h").collect()
    assert [r["rank"] for r in out] == list(range(1, 501))


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), rng.choice([rng.random(), 3.0, -rng.random() * 1e6])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect():
        want = np.quantile([v for k, v in rows if k == r.k], [0.1, 0.5, 0.99])
        assert [r.p10, r.p50, r.p99] == pytest.approx(list(want))
    median = exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert median == pytest.approx(statistics.median(v for _, v in rows))


def test_boxes_match_brute_force(spark):
    rng = random.Random(7)
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)] + [(300, 0.0, 0.0), (301, 4.0, 8.0)]
    boxes = []
    for j in range(60):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-3, 2), 10 ** rng.uniform(-3, 2)
        boxes.append((j, x, y, x + w, y + h))
    boxes += [(60, 0.0, 0.0, 4.0, 8.0), (61, 0.0, 0.0, 0.0, 0.0), (62, 5.0, 5.0, 1.0, 9.0)]
    got = points_in_boxes(
        spark.createDataFrame(points, "p long, x double, y double"),
        spark.createDataFrame(boxes, "b long, x1 double, y1 double, x2 double, y2 double"),
    )
    want = {(p, b) for p, x, y in points for b, x1, y1, x2, y2 in boxes if x1 <= x <= x2 and y1 <= y <= y2}
    rows = [(r.p, r.b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_intervals_match_brute_force(spark):
    rng = random.Random(9)
    make = lambda n: [
        (i, f"c{rng.randrange(3)}", s := rng.randrange(0, 5000), s + int(10 ** rng.uniform(0, 3.5))) for i in range(n)
    ]
    left, right = make(150), make(120) + [(500, "c0", 0, 9000), (501, "c1", 7, 7)]
    got = overlapping_intervals(
        spark.createDataFrame(left, "l long, chromosome string, start long, end long"),
        spark.createDataFrame(right, "r long, chromosome string, r_start long, r_end long"),
    )
    want = {(l, r) for l, c, s, e in left for r, d, a, b in right if c == d and s <= b and a <= e}
    rows = [(x.l, x.r) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_intervals_turned_around_and_crowds_at_one_place(spark, monkeypatch):
    """Ends before starts meet what the plain conditions say; more points in a bin than an array holds are cut."""
    monkeypatch.setattr(geometry, "CHUNK", 3)
    rng = random.Random(5)
    left = [(i, "c", s, s + rng.choice([-40, -1, 0, 3, 50])) for i, s in enumerate([7] * 20 + [rng.randint(-60, 90) for _ in range(40)])]
    right = [(i, "c", s, s + rng.choice([-9, -1, 0, 2, 30, 4000])) for i, s in enumerate([9] * 20 + [rng.randint(-60, 90) for _ in range(40)])]
    left, right = left + [(90, None, 1, 2), (91, "c", None, 5), (92, "c", 5, None)], right + [(90, None, 1, 2), (91, "c", None, 5), (92, "c", 5, None)]
    got = overlapping_intervals(
        spark.createDataFrame(left, "l long, chromosome string, start long, end long"),
        spark.createDataFrame(right, "r long, chromosome string, r_start long, r_end long"),
    )
    whole = lambda rows: [r for r in rows if None not in r]
    want = {(l, r) for l, _, s, e in whole(left) for r, _, a, b in whole(right) if s <= b and a <= e}
    rows = [(x.l, x.r) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_few_intervals_are_compared_that_do_not_meet(spark):
    """Lengths of every order: what meets in bins is at most a few times what overlaps, not all that is short in the bins of the longest."""
    rng = random.Random(6)
    spans = lambda n: [("c", s, s + int(2 ** (rng.random() * 12))) for s in (rng.randint(0, 100_000) for _ in range(n))]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(spans(3000))], "l long, chromosome string, start long, end long")
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(spans(1000))], "r long, chromosome string, r_start long, r_end long")
    kept = overlapping_intervals(left, right).count()
    compared = geometry._ranges_with_points(left, "start", "end", right, "r_start", "chromosome").count()
    compared += geometry._ranges_with_points(right, "r_start", "r_end", left, "start", "chromosome").count()
    assert 10_000 < kept <= compared < 3 * kept


def test_polygons(spark):
    def inside(x, y, shape):
        corners = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in shape])
        return inside_polygon(F.lit(float(x)), F.lit(float(y)), corners)

    square, notched = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    got = one(
        spark, inside(1, 1, square), inside(5, 1, square), inside(0, 2, square), inside(4, 2, square),
        inside(2, 3, notched), inside(0.5, 2, notched), inside(1, 1, [(0, 0), (2, 2)]),
    )
    # an edge belongs to the shape on its low side only, so neighbouring shapes never share a point
    assert list(got) == [True, False, True, False, False, True, False]


def test_predicates_and_parameter_checks(spark):
    got = one(
        spark, valid_genome(F.lit("hg38")), valid_genome(F.lit("hg99")), safe_identifier(F.lit("a_1-b.c/d")),
        safe_identifier(F.lit("a b")), safe_identifier(F.lit("")), safe_identifier(F.lit("x" * 1001)),
    )
    assert list(got) == [True, False, True, False, False, False]
    with pytest.raises(ValueError):
        one_of("how", "x", ("a", "b"))
    with pytest.raises(ValueError):
        in_range("n", -1, 0)
    with pytest.raises(ValueError, match="missing column"):
        need_columns(spark.range(1), "id", "barcode")
