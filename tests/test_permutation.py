import math

import numpy as np
import pytest

from spotweave.operators import permutation as P
from spotweave.operators import spatial as A
from spotweave.operators.permutation import Sizes, autocorr_permutation, permuted

EXPR, WEIGHTS, SPOTS = "spot_id long, gene string, value double", "spot_id long, neighbour_id long, weight double", "spot_id long, x double, y double"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutations_are_bijections(n):
    places = permuted(np.arange(n), n, 5, np.arange(130))
    assert all(sorted(places[:, p]) == list(range(n)) for p in range(130))
    assert (permuted(np.arange(n)[::-1], n, 5, np.array([7]))[::-1] == places[:, 7:8]).all()
    if n >= 16:
        assert len({tuple(c) for c in places.T}) == 130 and (permuted(np.arange(n), n, 6, np.arange(130)) != places).any()


def test_permutations_are_spread_evenly():
    places = permuted(np.arange(20), 20, 1, np.arange(20_000))
    counts = np.stack([np.bincount(row, minlength=20) for row in places])
    chi = ((counts - 1000) ** 2 / 1000).sum()
    assert abs(chi - 19 * 19) < 5 * math.sqrt(2 * 19 * 19)  # 361 degrees of freedom
    # pairs of places too: the distance between the places of two numbers
    apart = np.bincount((places[0] - places[1]) % 20, minlength=20)[1:]
    assert ((apart - 20_000 / 19) ** 2 / (20_000 / 19)).sum() < 18 + 5 * math.sqrt(36)


def plain(expr, weights, ranks, n, seed):
    """Every permutation applied to a dense vector."""
    size, out = len(ranks), {}
    places = permuted(np.arange(size), size, seed, np.arange(n))
    for gene in sorted({g for _, g, _ in expr}):
        x = np.zeros(size)
        for s, g, v in expr:
            if g == gene and s in ranks and v is not None:
                x[ranks[s]] += v
        z = np.append(x - x.mean(), -x.mean())  # what is no spot has the value 0
        edges = [(ranks.get(a, size), ranks.get(b, size), w) for a, b, w in weights]
        s0 = sum(w for *_, w in weights)
        stat = lambda v: size * sum(w * v[a] * v[b] for a, b, w in edges) / (s0 * (z[:size] ** 2).sum())
        if (z[:size] ** 2).sum() <= 1e-12 * max(1, size * x.mean() ** 2):
            out[gene] = (None, None, None)
            continue
        observed, above = stat(z), 0
        for p in range(n):
            moved = z.copy()
            moved[places[:, p]] = z[:size]
            above += stat(moved) >= observed - P.TIE
        out[gene] = (observed, above, (above + 1) / (n + 1))
    return out


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(block=7, genes=2, chunk=16, tile=9, edges=5)])
def test_against_plain_permutations(spark, sizes):
    rng = np.random.default_rng(3)
    n = 60
    spots = [(i, float(i % 8), float(i // 8)) for i in range(n)] + [(n, 2.0, 2.0), (n + 1, None, 1.0), (n + 2, float("nan"), 1.0)]
    expr = [(i, "random", float(rng.normal())) for i in range(n)] + [(i, "sparse", 3.0) for i in range(0, n, 7)]
    expr += [(i, "trend", 1000.0 + i // 8) for i in range(n + 3)] + [(i, "flat", 5.0) for i in range(n + 3)]
    expr += [(i, "few", float(i % 3)) for i in range(20)] + [(999, "random", 7.0), (3, "sparse", None)]
    weights = [(i, j, 1.0 + i % 2) for i in range(n) for j in (i + 1, i + 8, i - 8) if 0 <= j < n + 2] + [(5, 999, 2.0), (7, 7, 0.5), (998, 3, 1.5), (998, 999, 0.7)]
    frames = spark.createDataFrame(expr, EXPR), spark.createDataFrame(weights, WEIGHTS), spark.createDataFrame(spots, SPOTS)
    ranks = {r.spot_id: r["rank"] for r in P._numbered_spots(frames[2], sizes.tile).collect()}
    assert sorted(ranks.values()) == list(range(n + 3))
    got = {r.gene: r for r in autocorr_permutation(*frames, n=40, seed=11, sizes=sizes).collect()}
    want = plain(expr, weights, ranks, 40, 11)
    assert sorted(got) == sorted(want)
    for gene, (i, above, p) in want.items():
        assert got[gene].permutations == 40 and (got[gene].at_least, got[gene].p_value) == (above, p)
        assert got[gene].morans_i == (None if i is None else pytest.approx(i))
    assert want["trend"][2] < 0.05 < want["random"][2]


def test_default_number_and_reruns(spark):
    spots = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(16)], SPOTS)
    expr = spark.createDataFrame([(i, "halves", 1.0) for i in range(8)] + [(i, "board", float((i + i // 4) % 2)) for i in range(16)], EXPR)
    weights = A.knn_weights(spots, 3)
    rows = {r.gene: r for r in autocorr_permutation(expr, weights, spots, seed=1).collect()}
    assert rows["halves"].permutations == 1000 and rows["halves"].p_value < 0.01 and rows["board"].p_value > 0.9
    again = {r.gene: r for r in autocorr_permutation(expr.repartition(5), weights, spots.drop("x"), seed=1).collect()}
    assert again["board"].p_value > 0.9  # without coordinates the numbers differ, the test does not
    assert {r.gene: r for r in autocorr_permutation(expr.repartition(5), weights, spots, seed=1).collect()} == rows


def test_without_values_or_weights(spark):
    spots = spark.createDataFrame([(i, 0.0, 0.0) for i in range(5)], SPOTS)
    none = spark.createDataFrame([], EXPR)
    edges = spark.createDataFrame([(0, 1, 1.0)], WEIGHTS)
    assert autocorr_permutation(none, edges, spots, n=3).count() == 0
    expr = spark.createDataFrame([(0, "g", 1.0)], EXPR)
    lonely = autocorr_permutation(expr, edges.limit(0), spots, n=3).collect()
    assert [(r.gene, r.morans_i, r.p_value) for r in lonely] == [("g", None, None)]
    with pytest.raises(ValueError):
        autocorr_permutation(expr, edges, spots, n=0)


def test_values_travel_packed_without_loss():
    rng = np.random.default_rng(8)
    odd = [0.0, -0.0, np.nan, np.inf, -np.inf, 5e-324, 1e300, 2.0**53, 2.0**60, 0.1 + 0.2, -999.99, 1 / 3]
    money = np.round(rng.uniform(-999, 9999, 3000), 2)
    columns = [money, np.concatenate([odd, money[12:]]), rng.normal(size=3000), np.zeros(3000), np.floor(money)]
    values = np.stack(columns, 1)
    rows = rng.integers(0, 3000, 5000)
    got = P._decoded(*P._loosened(P._squeezed(*P._Coded.of(values).arrays(rows)), *P.CODED))
    assert (got.view(np.uint64) == values[rows].view(np.uint64)).all()


def test_a_value_of_a_few_decimals_takes_few_bytes_per_permutation():
    rng = np.random.default_rng(9)
    n, tile, values = 8192, 2048, np.round(rng.uniform(-999, 9999, (8192, 2)), 2)
    batch = P.pa.RecordBatch.from_arrays(
        [P.pa.array(np.arange(n)), P.pa.array(np.zeros(n, np.int64)), P.pa.array(values.tolist())], names=["rank", "genes", "v"]
    )
    sent = [r for b in P._send(n, 3, 64, 2, np.arange(0, n, tile), Sizes())([batch]) for r in b.to_pylist()]
    assert sum(len(r["packed"]) for r in sent) < 9 * n * 64  # 20 of two genes' plain values and place
    for r in sent:
        gaps, *coded = P._loosened(r["packed"], "<u4", *P.CODED)
        place, p = np.divmod(np.cumsum(gaps, dtype=np.int64), 64)
        assert len(gaps) == tile * 64 and (permuted(np.arange(n), n, 3, np.arange(64)).T.argsort()[p, place + r["tile"]] < n).all()
        assert (P._decoded(*coded) == values[permuted(np.arange(n), n, 3, np.arange(64)).T.argsort()[p, place + r["tile"]]]).all()
