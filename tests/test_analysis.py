"""Differential expression, multiple testing, batch effects and enrichment."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spotweave.operators import batch_effects as B
from spotweave.operators import differential as D
from spotweave.operators import enrichment as P

OBS = "gene string, grp int, value double"


def rank_sum(a, b):
    pooled = sorted(a + b)
    rank = lambda v: (2 * pooled.index(v) + pooled.count(v) + 1) / 2
    n1, n2, n = len(a), len(b), len(a) + len(b)
    u = sum(map(rank, a)) - n1 * (n1 + 1) / 2
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    return u, (u - n1 * n2 / 2) / math.sqrt(var) if var > 0 else None


def test_wilcoxon_with_ties(spark):
    rng = random.Random(2)
    data = {g: ([float(rng.randrange(6)) for _ in range(25)], [float(rng.randrange(2, 9)) for _ in range(31)]) for g in "ab"}
    data["flat"] = ([1.0] * 4, [1.0] * 5)
    rows = [(g, i + 1, v) for g, pair in data.items() for i, values in enumerate(pair) for v in values]
    rows.append(("a", 1, float("nan")))
    got = {r.gene: r for r in D.de_wilcoxon(spark.createDataFrame(rows, OBS)).collect()}
    for g, (a, b) in data.items():
        u, z = rank_sum(a, b)
        assert got[g].u_statistic == pytest.approx(u)
        assert (got[g].z_score is None) if z is None else got[g].z_score == pytest.approx(z)
    assert got["flat"].p_value == 1.0


def test_wilcoxon_with_implied_zeros(spark):
    dense = [("g", 1, v) for v in (0.0, 0.0, 3.0, 5.0)] + [("g", 2, v) for v in (0.0, 1.0, 0.0)]
    sparse = [r for r in dense if r[2] != 0]
    full = D.de_wilcoxon(spark.createDataFrame(dense, OBS)).first()
    short = D.de_wilcoxon(spark.createDataFrame(sparse, OBS), group_sizes=(4, 3)).first()
    assert short == full


def test_welch_t(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    rows = [("g", 1, v) for v in a] + [("g", 2, v) for v in b] + [("flat", 1, 1.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("flat", 2, 1.0)]
    got = {r.gene: r for r in D.de_ttest(spark.createDataFrame(rows, OBS)).collect()}
    va, vb = 5 / 3 / 4, 10 / 5
    assert got["g"].t_statistic == pytest.approx((2.5 - 6) / math.sqrt(va + vb))
    assert got["g"].df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 4))
    assert 0.05 < got["g"].p_value < 0.12
    assert got["flat"].t_statistic is None and got["flat"].p_value == 1.0


def test_negative_binomial(spark):
    rng = random.Random(4)
    rows, groups = [], [(f"s{i}", 1 if i < 6 else 2) for i in range(12)]
    for s, g in groups:
        depth = rng.uniform(0.5, 2)
        rows += [(s, f"g{j}", int(depth * (200 + 10 * j) * (4 if j == 0 and g == 1 else 1) * rng.uniform(0.95, 1.05))) for j in range(20)]
    counts = spark.createDataFrame(rows, "sample_id string, gene string, count long")
    table = {r.gene: r for r in D.de_negbin(counts, spark.createDataFrame(groups, "sample_id string, grp int")).collect()}
    assert table["g0"].log2_fold_change == pytest.approx(2.0, abs=0.2) and table["g0"].p_value < 1e-6
    assert all(abs(table[f"g{j}"].log2_fold_change) < 0.2 for j in range(1, 20))


def bh(ps):
    order = sorted(range(len(ps)), key=lambda i: -ps[i])
    out, low = [0.0] * len(ps), 1.0
    for k, i in enumerate(order):
        low = min(low, ps[i] * len(ps) / (len(ps) - k))
        out[i] = low
    return out


def test_benjamini_hochberg(spark):
    known = spark.createDataFrame([(f"g{i}", i / 100) for i in range(1, 6)], "gene string, p_value double")
    assert [r.p_adj for r in D.adjust_pvalues(known).collect()] == pytest.approx([0.05] * 5)
    rng = random.Random(6)
    families = {f: [rng.choice([rng.random() ** 4, 0.5, 0.0, 1.0]) for _ in range(80)] for f in "xy"}
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)] + [("x", 999, None)]
    got = D.adjust_pvalues(spark.createDataFrame(rows, "f string, i int, p_value double"), "bh", ["f"]).collect()
    table = {(r.f, r.i): r.p_adj for r in got}
    assert len(got) == 161 and table[("x", 999)] is None
    for f, ps in families.items():
        assert [table[(f, i)] for i in range(80)] == pytest.approx(bh(ps))


def test_bonferroni_and_calls(spark):
    df = spark.createDataFrame(
        [("a", 0.01, 0.5), ("b", 0.02, -0.5), ("c", 0.001, 0.49), ("d", 0.5, 3.0), ("e", None, 9.0)],
        "gene string, p_value double, log2_fold_change double",
    )
    adj = {r.gene: r.p_adj for r in D.adjust_pvalues(df, "bonferroni").collect()}
    assert adj == {"a": 0.04, "b": 0.08, "c": 0.004, "d": 1.0, "e": None}
    called = D.call_significant(D.adjust_pvalues(df, "bonferroni"))
    assert {r.gene for r in called.where("significant").collect()} == {"a"}
    edge = D.call_significant(df.withColumn("p_adj", F.lit(0.05)))
    assert edge.where("significant").count() == 0
    loose = D.call_significant(D.adjust_pvalues(df), 0.4, 0.2)
    assert [r.gene for r in D.top_genes(loose, 5, "up").collect()] == ["a", "c"]
    assert [r.gene for r in D.top_genes(loose, 5, "down").collect()] == ["b"]
    s = D.de_summary(loose, 3, 4).first()
    assert (s.total_genes_tested, s.significant_genes, s.upregulated, s.downregulated, s.group1_size) == (5, 3, 2, 1, 3)


@pytest.mark.parametrize("method", ["wilcoxon", "t_test", "deseq2"])
def test_full_differential_run(spark, method):
    rng = random.Random(8)
    rows = [
        (f"s{s}", f"g{j}", 1 if s < 10 else 2, float(rng.randrange(20, 30) * (3 if j == 0 and s < 10 else 1)))
        for s in range(20) for j in range(6)
    ]
    obs = spark.createDataFrame(rows, "spot_id string, gene string, grp int, value double")
    got = {r.gene: r.significant for r in D.differential_expression(obs, method).collect()}
    assert got["g0"] and not any(v for g, v in got.items() if g != "g0")
    with pytest.raises(ValueError):
        D.differential_expression(obs, "edger")


def batches(spark):
    rng = random.Random(10)
    rows = [
        (i, f"g{g}", f"b{i % 3}", 10 * g + (i % 3) * (2 + g % 2) + rng.gauss(0, 1 + i % 3))
        for i in range(90) for g in range(15)
    ]
    return spark.createDataFrame(rows + [(i, "flat", f"b{i % 3}", 1.0) for i in range(6)], "spot_id long, gene string, batch string, value double")


def test_combat_removes_the_batch_share(spark):
    fixed = B.combat(batches(spark))
    assert fixed.count() == 90 * 15 + 6 and fixed.where("corrected is null").count() == 0
    assert {r.corrected for r in fixed.where("gene = 'flat'").collect()} == {1.0}
    v = B.batch_variance(fixed).first()
    assert v.variance_before > 0.4 and v.variance_after < 0.05 and v.variance_reduction > 0.9
    s = B.batch_summary(fixed).first()
    assert (s.num_batches, s.num_samples, s.genes_corrected) == (3, 90, 16)


def test_enrichment(spark):
    sets = spark.createDataFrame(
        [("hit", f"G{i}") for i in range(5)] + [("miss", f"H{i}") for i in range(5)] + [("hit", "G0")], "pathway string, gene string"
    )
    genes = spark.createDataFrame([(g,) for g in ("G0", "G1", "G2", "X1", "X2", "X2")], "gene string")
    rows = {r.pathway: r for r in P.enrich(genes, sets, background_size=20).collect()}
    assert rows["hit"].p_value == pytest.approx(1126 / 15504) and rows["hit"].genes == ["G0", "G1", "G2"]
    assert rows["hit"].fold_enrichment == pytest.approx((3 / 5) / (5 / 20)) and rows["hit"].p_adj == pytest.approx(2 * 1126 / 15504)
    assert rows["miss"].p_value == 1.0 and rows["miss"].genes == []
    s = P.enrich_summary(P.enrich(genes, sets, background_size=20), 0.2).first()
    assert (s.pathways_tested, s.pathways_enriched, s.top_pathway) == (2, 1, "hit")
    background = spark.createDataFrame([(g,) for g in ("G0", "G1", "H0", "X1")], "gene string")
    row = {r.pathway: r for r in P.enrich(genes, sets, background).collect()}["hit"]
    assert (row.genes_in_pathway, row.genes_overlapping, row.genes_analyzed, row.background_size) == (2, 2, 3, 4)
    assert row.p_value == pytest.approx(3 / 6)
