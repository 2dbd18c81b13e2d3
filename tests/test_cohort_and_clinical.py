"""Cohorts, survival, mutations, clinical records and catalogs."""

import math
import random
from datetime import date

import numpy as np
import pytest

from spotweave import session
from spotweave.operators import catalogs as G
from spotweave.operators import clinical as C
from spotweave.operators import cohort as T
from spotweave.operators import survival as S

SURV = "grp string, months int, event boolean"


def test_cohort_search(spark):
    catalog = T.builtin_cohorts(spark)
    codes = lambda **k: {r.code for r in T.query_cohorts(catalog, **k).collect()}
    assert codes() == {"BRCA", "LUAD", "COAD"}
    assert codes(tissue_type="normal", min_samples=59) == {"BRCA", "LUAD"}
    assert codes(tissue_type="metastatic") == set()
    assert codes(tissue_type="unheard of", min_samples=1000) == {"BRCA"}
    assert codes(cancer_type="NONE") == set()


def test_compare_to_cohort(spark):
    rows = [("BRCA", "primary_tumor", f"s{i}", g, v) for g, vs in {"A": [1, 2, 3, 4], "B": [5, 5, 5, 5], "C": [1, 2, 3, 100]}.items() for i, v in enumerate(map(float, vs))]
    cohort = spark.createDataFrame(rows, "cohort string, tissue_type string, sample_id string, gene string, value double")
    sample = T.sample_from_map(spark, {"A": 10.0, "B": 7.0})
    got = {r.gene: r for r in T.compare_to_cohort(sample, cohort).collect()}
    sd = math.sqrt(5 / 3)
    assert got["A"].z_score == pytest.approx(7.5 / sd) and got["A"].interpretation == "higher" and got["A"].percentile == 100.0
    assert got["B"].z_score == 0.0 and got["B"].p_value == pytest.approx(1.0, abs=1e-6)
    assert got["C"].sample_expression == 0.0 and got["C"].percentile == 0.0
    assert {r.gene for r in T.outlier_genes(T.compare_to_cohort(sample, cohort)).collect()} == {"A"}
    t = {r.gene: r.p_value for r in T.compare_to_cohort(sample, cohort, ["A"], "t_test").collect()}
    assert set(t) == {"A"} and 0.005 < t["A"] < 0.02
    w = {r.gene: r.p_value for r in T.compare_to_cohort(sample, cohort, test="wilcoxon").collect()}
    assert w["A"] == pytest.approx(math.erfc(2 / math.sqrt(2) / math.sqrt(2)), rel=1e-6)
    arrays = T.expression_arrays(T.fetch_expression(cohort, "BRCA", ["A"])).first()
    assert arrays["values"] == [1.0, 2.0, 3.0, 4.0] and arrays.sample_ids == ["s0", "s1", "s2", "s3"]
    with pytest.raises(ValueError):
        T.compare_to_cohort(sample, cohort, test="anova")


def test_arrays_in_chunks(spark):
    rows = [(f"s{i:03d}", g, float(i)) for i in range(250) for g in "AB"]
    arrays = T.expression_arrays(spark.createDataFrame(rows, "sample_id string, gene string, value double"), width=100).collect()
    assert sorted((r.gene, r.chunk, len(r["values"])) for r in arrays) == [(g, c, n) for g in "AB" for c, n in ((0, 100), (1, 100), (2, 50))]
    held = {(r.gene, r.chunk): r for r in arrays}
    for c in range(3):
        a, b = held["A", c], held["B", c]
        assert a.sample_ids == b.sample_ids == sorted(a.sample_ids) and a["values"] == [float(s[1:]) for s in a.sample_ids]


def plain_log_rank(rows):
    labels = sorted({g for g, m, _ in rows if m is not None})
    u, v = np.zeros(len(labels)), np.zeros((len(labels), len(labels)))
    for t in sorted({m for _, m, e in rows if e and m is not None}):
        n = np.array([sum(g == x and m is not None and m >= t for g, m, _ in rows) for x in labels], float)
        d = np.array([sum(g == x and m == t and bool(e) for g, m, e in rows) for x in labels], float)
        u += d - d.sum() * n / n.sum()
        if n.sum() > 1:
            w, s = d.sum() * (n.sum() - d.sum()) / (n.sum() - 1), n / n.sum()
            v += w * (np.diag(s) - np.outer(s, s))
    return float(u @ np.linalg.pinv(v, rcond=1e-10) @ u)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_log_rank_of_many_groups(spark, k):
    rng = random.Random(k)
    rows = [(f"g{i % k}", round(rng.expovariate(0.1 * (1 + i % k)), 1), rng.random() < 0.7) for i in range(120)] + [("g0", None, True), (None, 3.0, True)]
    got = S.log_rank_groups(spark.createDataFrame(rows, SURV)).first()
    want = plain_log_rank([r for r in rows if r[0] is not None])
    assert (got.groups, got.degrees) == (k, k - 1) and got.chi_square == pytest.approx(want, rel=1e-9)
    if k == 3:
        assert got.p_value == pytest.approx(math.exp(-want / 2))
    if k == 2:
        assert got.chi_square == pytest.approx(S.log_rank(spark.createDataFrame(rows, SURV)).first().chi_square)
        with pytest.raises(ValueError):
            S.log_rank_groups(spark.createDataFrame([("a", 1.0, True)], SURV))


def test_log_rank_with_a_group_never_at_risk_with_others(spark):
    rows = [("a", 1.0, True), ("a", 2.0, True), ("b", 1.0, True), ("b", 5.0, True), ("early", 0.1, False)]
    got = S.log_rank_groups(spark.createDataFrame(rows, SURV)).first()
    assert got.degrees == 1 and got.chi_square == pytest.approx(plain_log_rank(rows))


def test_survival_curve(spark):
    rows = [("a", 1, True), ("a", 2, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("a", None, True), ("b", 7, False)]
    curve = S.kaplan_meier(spark.createDataFrame(rows, SURV)).collect()
    got = {(r.grp, r.months): (r.at_risk, r.events, r.censored, round(r.survival, 6)) for r in curve}
    assert got == {
        ("a", 1): (5, 1, 0, 0.8), ("a", 2): (4, 1, 1, 0.6), ("a", 3): (2, 1, 0, 0.3), ("a", 4): (1, 1, 0, 0.0),
        ("b", 7): (1, 0, 1, 1.0),
    }
    frame = S.kaplan_meier(spark.createDataFrame(rows, SURV))
    medians = {r.grp: r for r in S.median_survival(frame).collect()}
    assert medians["a"].median_survival_months == 3 and medians["b"].median_survival_months is None
    assert (medians["a"].num_samples, medians["a"].num_events) == (5, 4)
    assert {r.grp: round(r.survival_rate, 6) for r in S.survival_at(frame, 2).collect()} == {"a": 0.6, "b": 1.0}


def test_log_rank_and_hazard(spark):
    rows = [("high", m, True) for m in (1, 2, 3)] + [("low", m, True) for m in (4, 5)] + [("low", 6, False)]
    frame = spark.createDataFrame(rows, SURV)
    got = S.log_rank(frame).first()
    e1 = 3 / 6 + 2 / 5 + 1 / 4
    v = 3 * 3 / 36 + 2 * 3 / 25 + 1 * 3 / 16
    assert got.expected1 == pytest.approx(e1) and got.variance == pytest.approx(v)
    assert got.chi_square == pytest.approx((3 - e1) ** 2 / v)
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(got.chi_square / 2)), rel=1e-6)
    h = S.hazard_ratio(frame).first()
    assert h.hazard_ratio == pytest.approx((3 / e1) / (2 / (5 - e1))) and h.ci_low < h.hazard_ratio < h.ci_high
    report = {r.grp: r for r in S.survival_report(frame, 3).collect()}
    assert report["high"].survival_rate == 0.0 and report["low"].median_survival_months == 5
    assert report["low"].log_rank_p_value == pytest.approx(got.p_value) and report["low"].hazard_ratio == pytest.approx(h.hazard_ratio)
    alone = S.survival_report(frame.where("grp = 'high'")).first()
    assert alone.num_events == 3 and alone.log_rank_p_value is None
    with pytest.raises(ValueError):  # one group: nothing to compare
        S.log_rank(frame.where("grp = 'high'"))


def test_log_rank_takes_labels_from_the_data(spark):
    rows = [("A", m, True) for m in (0.2, 0.9, 1.5)] + [("B", m, True) for m in (40.5, 50.25)] + [("B", 60.0, False)]
    frame = spark.createDataFrame(rows, "grp string, months double, event boolean")
    named, found = S.log_rank(frame, first="A", second="B").first(), S.log_rank(frame).first()
    assert found == named and found.chi_square > 4
    assert [r.months for r in S.kaplan_meier(frame).where("grp = 'A'").orderBy("months").collect()] == [0.2, 0.9, 1.5]
    third = frame.unionByName(spark.createDataFrame([("C", 1.0, True)], frame.schema))
    with pytest.raises(ValueError):
        S.log_rank(third)
    assert S.log_rank(third, first="A", second="B").first() == named


def test_split_by_expression(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 2.0), (4, 5.0), (5, None)], "id int, value double")
    groups = lambda t: {r.id: r.grp for r in S.split_by_expression(df, t).collect()}
    assert groups(0.0) == {1: "low", 2: "high", 3: "high", 4: "high", 5: None}
    assert groups(None) == {1: "high", 2: "high", 3: "high", 4: "high", 5: None}
    assert groups("median") == {1: "low", 2: "low", 3: "high", 4: "high", 5: None}


def test_mutations(spark):
    mutations = spark.createDataFrame(
        [("s1", "TP53", "missense"), ("s1", "TP53", "nonsense"), ("s2", "TP53", "missense"), ("s3", "KRAS", "missense")],
        "sample_id string, gene string, variant_class string",
    )
    samples = spark.createDataFrame([(f"s{i}",) for i in range(1, 5)], "sample_id string")
    got = {r.gene: r for r in T.mutation_frequency(mutations, samples).collect()}
    assert (got["TP53"].mutated_samples, got["TP53"].frequency) == (2, 0.5)
    assert got["TP53"].missense_share == pytest.approx(2 / 3) and got["TP53"].splice_site_share == 0.0
    assert T.mutation_frequency(mutations, samples, ["KRAS"]).count() == 1
    expr = spark.createDataFrame([(f"s{i}", "TP53", v) for i, v in ((1, 9.0), (2, 7.0), (3, 1.0), (4, 3.0))], "sample_id string, gene string, value double")
    row = T.mutation_expression(mutations, expr).first()
    assert (row.mean_mutated, row.mean_wild_type) == (8.0, 2.0)
    assert row.point_biserial_r == pytest.approx(3 / math.sqrt(10))


def test_catalogs_of_samples(spark):
    rows = [("BRCA", "normal", "LumA"), ("BRCA", "normal", "LumB"), ("BRCA", "metastatic", "LumA"), ("LUAD", "normal", None)]
    samples = spark.createDataFrame(rows, "cohort string, tissue_type string, subtype string")
    got = {r.code: (r.primary_tumor_samples, r.normal_samples, r.metastatic_samples) for r in T.cohort_catalog(samples).collect()}
    assert got == {"BRCA": (0, 2, 1), "LUAD": (0, 1, 0)}
    assert {(r.subtype, r.samples) for r in T.subtype_counts(samples, "BRCA").collect()} == {("LumA", 2), ("LumB", 1)}


def patients(spark):
    lab = lambda v, span: (v, "g/dL", span)
    return spark.createDataFrame(
        [
            ("p1", "x1", [("C50.9", "I", date(2024, 1, 5))], {"hgb": lab(11.0, "12-16"), "wbc": lab(7.0, "4-11")}, [("Tamoxifen", "20mg", "daily")], "pr", 10),
            ("p2", "x2", [("C50.1", "I", None), ("E11.9", None, None)], {"hgb": lab(17.0, "12-16"), "odd": lab(1.0, "n/a")}, [], None, None),
        ],
        "patient_id string, sample_id string, diagnoses array<struct<icd10: string, stage: string, date: date>>, "
        "labs map<string, struct<value: double, unit: string, ref_range: string>>, "
        "medications array<struct<name: string, dose: string, frequency: string>>, response string, survival_months int",
    )


def test_patient_records(spark):
    p = patients(spark)
    row = C.patient_records(p, ["p1"], include_labs=False, include_meds=False).first()
    assert row.labs == {} and row.medications == [] and len(row.diagnoses) == 1
    assert C.patient_records(p, p.where("patient_id = 'p2'").select("patient_id")).first().patient_id == "p2"
    assert C.patient_records(p).count() == 2


def test_clinical_tables(spark):
    p = patients(spark)
    flags = {(r.patient_id, r.lab): r.flag for r in C.lab_flags(p).collect()}
    assert flags == {("p1", "hgb"): "low", ("p1", "wbc"): "normal", ("p2", "hgb"): "high", ("p2", "odd"): None}
    counts = {(r.category, r.stage): r.patients for r in C.diagnosis_counts(p).collect()}
    assert counts == {("C50", "I"): 2, ("E11", None): 1}
    done = {r.patient_id: (r.present, r.missing) for r in C.clinical_completeness(p, ["response", "survival_months"]).collect()}
    assert done == {"p1": (2, []), "p2": (0, ["response", "survival_months"])}
    spatial = spark.createDataFrame([("x1", "breast"), ("x9", "lung")], "sample_id string, tissue_site string")
    link = C.link_spatial_to_clinical(spatial, p, "breast").collect()
    assert [(r.link_id, r.outcome_data.response) for r in link] == [("link_x1_p1", "pr")]
    expr = spark.createDataFrame([("x1", "A", 2.0), ("x1", "A", 1.0), ("x2", "A", 5.0)], "sample_id string, gene string, value double")
    by = {r.response: r.mean_expression for r in C.expression_by_response(expr, p).collect()}
    assert by == {"pr": 3.0, None: 5.0}


def test_diagnosis_search(spark):
    codes = C.builtin_diagnoses(spark)
    find = lambda **k: {r.code for r in C.search_diagnoses(codes, **k).collect()}
    assert find(icd10_code="C50.9") == {"C50.9", "C50.1"} == find(icd10_code="C50", keyword="diabetes")
    assert find(keyword="DIABETES") == {"E11.9", "E11.65"}
    assert find() == set() == find(icd10_code="Z99")


def test_genomes_and_genes(spark):
    assert G.lookup_genome(spark, "mm10").first().assembly == "GRCm38"
    with pytest.raises(ValueError):
        G.lookup_genome(spark, "hg99")
    ann = spark.createDataFrame(
        [("TP53", "chr17", 100, 200, "gencode", "hg38"), ("tp53", "chr17", 100, 200, "refseq", "hg38"), ("KRAS", "chr12", 1, 50, "gencode", "hg38")],
        "gene_name string, chromosome string, start long, end long, source string, genome string",
    )
    assert G.query_genes(ann, gene_name="Tp53").count() == 2
    assert G.query_genes(ann, "hg38", "tp53", "chr17", "gencode").count() == 1
    assert G.query_genes(ann, chromosome="chr12").first().gene_name == "KRAS"
    with pytest.raises(ValueError):
        G.query_genes(ann, source="ucsc")
    zero = G.convert_coordinates(ann, "one_closed", "zero_half_open")
    assert zero.first().start == 99
    assert G.convert_coordinates(zero, "zero_half_open", "one_closed").collect() == ann.collect()
    spans = spark.createDataFrame([(1, "chr17", 200, 300), (2, "chr17", 201, 300), (3, "chr12", 0, 5)], "interval_id long, chromosome string, start long, end long")
    got = {(r.interval_id, r.gene_name, r.overlap) for r in G.overlap_genes(spans, ann).collect()}
    assert got == {(1, "TP53", 1), (1, "tp53", 1), (3, "KRAS", 5)}


def test_workflows(spark):
    catalog = G.builtin_workflows(spark)
    assert G.list_workflows(catalog).first().total_count == 6
    assert {r.name for r in G.list_workflows(catalog, "variant").collect()} == {"nf-core/sarek", "nf-core/variantcalling"}
    assert G.list_workflows(catalog, "nothing").count() == 0


def test_interval_bins_are_dealt_out(spark, capsys):
    """Rows filed in bins are shuffled by bin and not broadcast, whatever the planner takes them for."""
    spans = spark.createDataFrame([(i, "chr1", i * 7 % 900, i * 7 % 900 + i % 60) for i in range(200)], "interval_id long, chromosome string, start long, end long")
    ann = spark.createDataFrame([("chr1", f"g{i}", i * 11 % 900, i * 11 % 900 + i % 300) for i in range(80)], "chromosome string, gene_name string, start long, end long")
    pairs = G.overlap_genes(spans, ann)
    pairs.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    want = {(i, f"g{j}") for i in range(200) for j in range(80) if i * 7 % 900 <= j * 11 % 900 + j % 300 and j * 11 % 900 <= i * 7 % 900 + i % 60}
    got = [(r.interval_id, r.gene_name) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want


PAIRS = [(i, f"g{j}", float(i + j)) for i in range(40) for j in range(2)] + [(0, "g0", 1.0), (None, "g0", 9.0)]


def test_expression_by_response_deals_rows_by_their_number(spark, monkeypatch, capsys):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    expr = spark.createDataFrame(PAIRS, "sample_id long, gene string, value double")
    clinical = spark.createDataFrame([(i, "CR" if i % 2 else "PD", i) for i in range(40)], "sample_id long, response string, survival_months int")
    by_response = C.expression_by_response(expr, clinical)
    by_response.explain()
    assert ", 9), REPARTITION_BY_NUM" in capsys.readouterr().out  # 81 rows with a sample, by tens
    got = {(r.gene, r.response): r for r in by_response.collect()}
    assert got["g1", "CR"].samples == 20 and got["g1", "CR"].mean_expression == 21.0 and got["g1", "CR"].months_r == pytest.approx(1.0)
    assert got["g0", "PD"].mean_expression == pytest.approx((sum(range(0, 40, 2)) + 1) / 20)


def test_mutation_expression_deals_rows_by_their_number(spark, monkeypatch, capsys):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    expr = spark.createDataFrame(PAIRS, "sample_id long, gene string, value double")
    mutations = spark.createDataFrame([(i, "g1") for i in range(0, 40, 4)] * 2 + [(None, "g0")], "sample_id long, gene string")
    by_mutation = T.mutation_expression(mutations, expr)
    by_mutation.explain()
    assert capsys.readouterr().out.count(", 11), REPARTITION_BY_NUM") == 2  # 82 rows and 21
    got = {r.gene: r for r in by_mutation.collect()}
    assert got["g1"].mean_mutated == 19.0 and got["g1"].mutation_rate == 0.25 and got["g1"].mean_expression == 20.5
    assert got["g0"].mean_mutated is None and got["g0"].mutation_rate == 0.0 and got["g0"].mean_expression == pytest.approx((sum(range(40)) + 10) / 41)
