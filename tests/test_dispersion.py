import math

import numpy as np
import pytest

from spotweave.operators import differential as D

COUNTS, GROUPS = "sample_id string, gene string, count long", "sample_id string, grp int"


def fixture(n_genes=200, n=12, seed=1):
    rng = np.random.default_rng(seed)
    mean = rng.uniform(5, 500, n_genes)
    dispersion = (0.05 + 4 / mean) * rng.lognormal(0, 0.5, n_genes)
    depth = rng.uniform(0.6, 1.6, n)
    fold = np.ones((n_genes, n))
    fold[:10, : n // 2] = 4
    dispersion[20:21] = 40.0  # far above the trend
    lam = mean[:, None] * depth[None] * fold
    counts = rng.negative_binomial(1 / dispersion[:, None], 1 / (1 + lam * dispersion[:, None]))
    return counts, np.repeat([1, 2], n // 2)


def plain(counts, grp):
    seen = (counts > 0).all(1)
    g = np.exp(np.log(np.where(counts > 0, counts, 1)).mean(1))
    factor = np.array([np.median(counts[seen, j] / g[seen]) for j in range(counts.shape[1])])
    v = counts / factor
    keep = v.sum(1) > 0
    v = v[keep]
    n1, n2 = (grp == 1).sum(), (grp == 2).sum()
    mu, mu1, mu2 = v.mean(1), v[:, grp == 1].mean(1), v[:, grp == 2].mean(1)
    var = (((v[:, grp == 1] - mu1[:, None]) ** 2).sum(1) + ((v[:, grp == 2] - mu2[:, None]) ** 2).sum(1)) / (n1 + n2 - 2)
    alpha = np.maximum((var - mu * (1 / factor).mean()) / mu**2, 1e-8)
    usable, a0, a1 = alpha > 1e-7, 0.1, 1.0
    while True:
        fit = a0 + a1 / mu
        inside = usable & (alpha / fit > 1e-4) & (alpha / fit < 15)
        x = np.stack([np.ones(inside.sum()), 1 / mu[inside]], 1) / fit[inside, None]
        b0, b1 = np.linalg.lstsq(x, alpha[inside] / fit[inside], rcond=None)[0]
        change = math.log(b0 / a0) ** 2 + math.log(b1 / a1) ** 2
        a0, a1 = b0, b1
        if change < 1e-6:
            break
    trend = a0 + a1 / mu
    away = np.log(alpha / trend)
    spread = np.median(np.abs(away[usable] - np.median(away[usable]))) / 0.6744897501960817
    own = D.trigamma((n1 + n2 - 2) / 2)
    prior = max(0.25, spread**2 - own)
    shrunk = np.exp((np.log(alpha) / own + np.log(trend) / prior) / (1 / own + 1 / prior))
    shrunk = np.where(away > 2 * math.sqrt(prior + own), alpha, shrunk)
    m1, m2 = np.maximum(mu1, 0.5), np.maximum(mu2, 0.5)
    z = np.log(m1 / m2) / np.sqrt((1 / m1 + shrunk) / n1 + (1 / m2 + shrunk) / n2)
    return {f"g{i}": r for i, r in zip(np.flatnonzero(keep), zip(mu, alpha, trend, shrunk, z))}


def frames(spark, counts, grp):
    rows = [(f"s{j}", f"g{i}", int(counts[i, j])) for i in range(counts.shape[0]) for j in range(counts.shape[1])]
    return spark.createDataFrame(rows, COUNTS), spark.createDataFrame([(f"s{j}", int(x)) for j, x in enumerate(grp)], GROUPS)


def test_trigamma():
    assert D.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-10) and D.trigamma(0.5) == pytest.approx(math.pi**2 / 2, rel=1e-10)
    assert D.trigamma(7.0) == pytest.approx(math.pi**2 / 6 - sum(1 / k**2 for k in range(1, 7)), rel=1e-9)


def test_shrunk_dispersions_against_plain(spark):
    counts, grp = fixture()
    got = {r.gene: r for r in D.de_negbin_shrunk(*frames(spark, counts, grp)).collect()}
    want = plain(counts, grp)
    assert set(got) == set(want)
    for gene, values in want.items():
        r = got[gene]
        assert (r.base_mean, r.dispersion, r.trend, r.shrunk, r.z_score) == pytest.approx(values, rel=1e-5, abs=1e-7)
    assert got["g20"].shrunk == got["g20"].dispersion
    hits = {g for g, r in got.items() if r.p_value < 1e-4}
    assert len(hits & {f"g{i}" for i in range(10)}) >= 8 and len(hits - {f"g{i}" for i in range(10)}) <= 2


def test_few_genes_and_none(spark):
    counts, grp = fixture(2, 6)
    assert D.de_negbin_shrunk(*frames(spark, counts, grp)).count() == 2
    none = spark.createDataFrame([], COUNTS), spark.createDataFrame([("s0", 1)], GROUPS)
    assert D.de_negbin_shrunk(*none).count() == 0
