"""Differential expression and multiple testing.

Observations are long rows ``gene, grp, value`` with grp 1 or 2; ``label_groups`` makes them from an
expression table and two sample lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns, one_of
from spotweave.functions.numeric import clean_double, normal_two_sided, t_two_sided
from spotweave.functions.running import exact_quantiles, running
from spotweave.session import materialize


def label_groups(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """Join ``spot_id, gene, value`` with ``spot_id, grp``; spots in no group drop out."""
    return expr.join(groups.select("spot_id", "grp"), "spot_id").select("gene", "grp", "value", "spot_id")


def value_counts(obs: DataFrame, group_sizes: tuple[int, int] | None = None) -> DataFrame:
    """How often each value occurs per gene and group. UMI counts have few distinct values, so this
    shrinks the data before anything is ordered. With ``group_sizes`` absent observations are zeros.
    """
    need_columns(obs, "gene", "grp", "value")
    counts = (
        obs.select("gene", "grp", clean_double("value").alias("value"))
        .where("gene is not null and value is not null and grp in (1, 2)")
        .groupBy("gene", "value")
        .agg(F.count_if(F.col("grp") == 1).alias("n1"), F.count_if(F.col("grp") == 2).alias("n2"))
    )
    if group_sizes is None:
        return counts
    zeros = counts.groupBy("gene").agg(
        F.lit(0.0).alias("value"),
        (F.lit(group_sizes[0]) - F.sum("n1")).alias("n1"),
        (F.lit(group_sizes[1]) - F.sum("n2")).alias("n2"),
    )
    return counts.unionByName(zeros).groupBy("gene", "value").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def de_wilcoxon(obs: DataFrame, group_sizes: tuple[int, int] | None = None) -> DataFrame:
    """D1. Rank-sum test per gene: midranks, tie-corrected z without continuity correction, two-sided p.

    Works on value counts: with c1 ones-group rows at a value and m rows of both groups below it, the
    midrank is m + (t + 1) / 2 for t tied rows. Running counts come from the bucketed ``running``.
    """
    counts = value_counts(obs, group_sizes).withColumn("_t", F.col("n1") + F.col("n2")).where("_t > 0")
    ranked = running(counts, ["gene"], "value", {"_upto": ("sum", F.col("_t"))})
    t = F.col("_t").cast("double")
    midrank = F.col("_upto") - t + (t + 1) / 2
    sums = ranked.groupBy("gene").agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"),
        F.sum(F.col("n1") * midrank).alias("rank_sum"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    scored = sums.withColumns(
        {"u_statistic": u, "z_score": F.when(variance > 0, (u - n1 * n2 / 2) / F.sqrt(variance))}
    )
    return scored.select(
        "gene", "n1", "n2", "u_statistic", "z_score",
        F.coalesce(normal_two_sided("z_score"), F.lit(1.0)).alias("p_value"),
    )


def _moments(obs: DataFrame) -> DataFrame:
    need_columns(obs, "gene", "grp", "value")
    v = clean_double("value")
    in1, in2 = F.when(F.col("grp") == 1, v), F.when(F.col("grp") == 2, v)
    return obs.where("gene is not null").groupBy("gene").agg(
        F.count(in1).alias("n1"), F.count(in2).alias("n2"),
        F.avg(in1).alias("mean1"), F.avg(in2).alias("mean2"),
        F.var_samp(in1).alias("var1"), F.var_samp(in2).alias("var2"),
    )


def de_ttest(obs: DataFrame) -> DataFrame:
    """D2. Welch t, its degrees of freedom, and p from the Arrow UDF on one row per gene."""
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    scored = _moments(obs).where("n1 > 1 and n2 > 1").select(
        "gene", "n1", "n2", "mean1", "mean2",
        F.when(a + b > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)).alias("t_statistic"),
        F.when(a + b > 0, (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"),
    )
    return scored.withColumn("p_value", F.coalesce(t_two_sided("t_statistic", "df"), F.lit(1.0)))


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios: per sample, the median over genes of count / geometric mean of the gene.

    ``counts`` is ``sample_id, gene, count``; only genes seen in every sample take part. The median holds
    one value per gene of a sample.
    """
    samples = counts.agg(F.count_distinct("sample_id").alias("n")).scalar()
    per_gene = (
        counts.where("count > 0")
        .groupBy("gene")
        .agg(F.avg(F.log(F.col("count").cast("double"))).alias("_g"), F.count("*").alias("_seen"))
        .withColumn("_n", samples)
        .where(F.col("_seen") == F.col("_n"))
    )
    return (
        counts.join(per_gene.select("gene", "_g"), "gene")
        .groupBy("sample_id")
        .agg(F.median(F.col("count") / F.exp("_g")).alias("size_factor"))
    )


def _negbin_moments(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, base_mean, mu1, mu2, dispersion, _t) of counts scaled by size factors; ``_t`` has the group sizes."""
    factors = size_factors(counts)
    labelled = factors.join(groups.select("sample_id", "grp").where("grp in (1, 2)"), "sample_id")
    labelled = materialize(labelled, "size-factors")  # one row per sample
    totals = labelled.agg(
        F.struct(
            F.count_if(F.col("grp") == 1).cast("double").alias("n1"),
            F.count_if(F.col("grp") == 2).cast("double").alias("n2"),
            F.avg(1.0 / F.col("size_factor")).alias("inv"),
        ).alias("t")
    ).scalar()
    scaled = counts.join(labelled, "sample_id").withColumn("v", F.col("count") / F.col("size_factor"))
    sums = scaled.groupBy("gene").agg(
        F.sum(F.when(F.col("grp") == 1, F.col("v")).otherwise(0.0)).alias("s1"),
        F.sum(F.when(F.col("grp") == 2, F.col("v")).otherwise(0.0)).alias("s2"),
        F.sum(F.col("v") * F.col("v")).alias("ss"),
    ).withColumn("_t", totals)
    n1, n2, inv = F.col("_t.n1"), F.col("_t.n2"), F.col("_t.inv")
    mu = (F.col("s1") + F.col("s2")) / (n1 + n2)
    means = sums.withColumns(
        {
            "base_mean": mu,
            "mu1": F.try_divide("s1", n1),
            "mu2": F.try_divide("s2", n2),
            "_var": F.try_divide(
                F.col("ss") - F.col("s1") * F.try_divide("s1", n1) - F.col("s2") * F.try_divide("s2", n2), n1 + n2 - 2
            ),
        }
    ).where("base_mean > 0")
    dispersion = F.greatest(
        F.try_divide(F.col("_var") - F.col("base_mean") * inv, F.col("base_mean") * F.col("base_mean")), F.lit(1e-8)
    )
    return means.withColumn("dispersion", dispersion)


def _wald(fitted: DataFrame, dispersion: str) -> DataFrame:
    """Adds ``log2_fold_change``, ``z_score`` and ``p_value``."""
    n1, n2 = F.col("_t.n1"), F.col("_t.n2")
    pseudo = lambda m: F.greatest(F.col(m), F.lit(0.5))
    error = F.sqrt(
        F.try_divide(1.0 / pseudo("mu1") + F.col(dispersion), n1) + F.try_divide(1.0 / pseudo("mu2") + F.col(dispersion), n2)
    )
    scored = fitted.withColumns(
        {
            "log2_fold_change": F.log2(pseudo("mu1") / pseudo("mu2")),
            "z_score": F.try_divide(F.log(pseudo("mu1") / pseudo("mu2")), error),
        }
    )
    return scored.withColumn("p_value", normal_two_sided("z_score"))


def de_negbin(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """D3. Negative-binomial Wald test on counts scaled by median-of-ratios size factors.

    The dispersion is that of the gene's own moments; ``de_negbin_shrunk`` draws it towards a trend. ``counts`` has one row per
    (sample_id, gene), ``groups`` is ``sample_id, grp``; samples without a row for a gene count as zero.
    """
    return _wald(_negbin_moments(counts, groups), "dispersion").select(
        "gene", "base_mean", "dispersion", "log2_fold_change", "z_score", "p_value"
    )


def trigamma(x: float) -> float:
    """Second derivative of the logarithm of the gamma function, of a positive number."""
    total = 0.0
    while x < 12:
        total, x = total + 1 / (x * x), x + 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


TREND_TOLERANCE = 1e-6  # relative change of the trend at which its fit ends
LEAST_DISPERSION = 1e-7  # genes with more take part in the trend
TREND_OUTLIERS = (1e-4, 15.0)  # of a dispersion over the trend; genes outside don't take part
LEAST_PRIOR_VARIANCE = 0.25
OUTLIER_DEVIATIONS = 2.0  # a dispersion so many standard deviations above the trend stays as it is


def dispersion_trend(genes: DataFrame) -> tuple[float, float]:
    """(a0, a1) of the trend a0 + a1 / base_mean, a gamma regression by reweighted sums over the table of genes.

    ``genes`` is written and has base_mean and dispersion. Without enough genes the trend is flat at their mean.
    """
    usable = genes.where(F.col("dispersion") > LEAST_DISPERSION)
    a, m = F.col("dispersion"), 1.0 / F.col("base_mean")
    start = usable.agg(F.avg(a).alias("a"), F.count("*").alias("n")).first()
    if start["n"] < 3:
        return (start["a"] or LEAST_DISPERSION), 0.0
    a0, a1 = 0.1, 1.0
    for _ in range(200):
        fit = F.lit(a0) + F.lit(a1) * m
        inside = (a / fit > TREND_OUTLIERS[0]) & (a / fit < TREND_OUTLIERS[1])
        w = 1.0 / (fit * fit)
        s = usable.where(inside).agg(
            *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in {"w": w, "m": w * m, "mm": w * m * m, "a": w * a, "am": w * a * m}.items()]
        ).first()
        size = s["w"] * s["mm"] - s["m"] * s["m"]
        if size <= 1e-12 * s["w"] * s["mm"]:  # all genes of one mean
            return (s["a"] / s["w"] if s["w"] > 0 else start["a"]), 0.0
        b0, b1 = (s["mm"] * s["a"] - s["m"] * s["am"]) / size, (s["w"] * s["am"] - s["m"] * s["a"]) / size
        if b0 <= 0:
            b0, b1 = 1e-8, s["am"] / s["mm"]
        elif b1 <= 0:
            b0, b1 = s["a"] / s["w"], 0.0
        change = (np.log(b0 / a0)) ** 2 + (np.log(max(b1, 1e-12) / max(a1, 1e-12))) ** 2
        a0, a1 = b0, b1
        if change < TREND_TOLERANCE:
            return a0, a1
    raise RuntimeError("the trend of dispersions did not settle")


def de_negbin_shrunk(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """D3. The negative-binomial test on dispersions drawn towards their trend over the mean.

    The logarithm of a gene's dispersion is weighed with that of the trend by their variances: that of the estimate follows from
    the number of samples, that of genes around the trend from the median absolute deviation, less the former. A gene far
    above the trend keeps its own. Adds ``trend`` and ``shrunk`` to the columns of ``de_negbin``.
    """
    genes = materialize(_negbin_moments(counts, groups), "gene-dispersions")
    a0, a1 = dispersion_trend(genes)
    trend = F.lit(a0) + F.lit(a1) / F.col("base_mean")
    away = genes.withColumn("trend", trend).withColumn("away", F.log("dispersion") - F.log("trend"))
    away = materialize(away, "gene-trends")
    usable = away.where(F.col("dispersion") > LEAST_DISPERSION)
    middle = exact_quantiles(usable, [], "away", {"m": 0.5}).first()
    centre = middle["m"] if middle is not None and middle["m"] is not None else 0.0
    deviation = exact_quantiles(usable.withColumn("away", F.abs(F.col("away") - F.lit(centre))), [], "away", {"m": 0.5}).first()
    spread = (deviation["m"] or 0.0) / 0.6744897501960817 if deviation is not None else 0.0
    sizes = genes.select("_t.n1", "_t.n2").limit(1).first()
    own = trigamma(max(0.5, (sizes["n1"] + sizes["n2"] - 2) / 2)) if sizes is not None else 1.0
    prior = max(LEAST_PRIOR_VARIANCE, spread * spread - own)
    weighed = F.exp((F.log("dispersion") / own + F.log("trend") / prior) / (1 / own + 1 / prior))
    outlier = F.col("away") > OUTLIER_DEVIATIONS * float(np.sqrt(prior + own))
    shrunk = away.withColumn("shrunk", F.when(outlier, F.col("dispersion")).otherwise(weighed))
    return _wald(shrunk, "shrunk").select("gene", "base_mean", "dispersion", "trend", "shrunk", "log2_fold_change", "z_score", "p_value")


def fold_change(obs: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """D4. log2((mean1 + c) / (mean2 + c)) and the mean over all observations."""
    in_range("pseudo", pseudo, 0)
    v = clean_double("value")
    ratio = (F.coalesce("mean1", F.lit(0.0)) + pseudo) / F.nullif(F.coalesce("mean2", F.lit(0.0)) + pseudo, F.lit(0.0))
    return (
        obs.where("gene is not null and grp in (1, 2)")
        .groupBy("gene")
        .agg(
            F.avg(F.when(F.col("grp") == 1, v)).alias("mean1"),
            F.avg(F.when(F.col("grp") == 2, v)).alias("mean2"),
            F.avg(v).alias("base_mean"),
        )
        .select("gene", "base_mean", F.log2(ratio).alias("log2_fold_change"))
    )


def adjust_pvalues(df: DataFrame, method: str = "bh", family: list[str] | None = None, p: str = "p_value") -> DataFrame:
    """D5. Adds ``p_adj``: Benjamini-Hochberg or Bonferroni, per family; a NULL p stays NULL.

    BH runs over the counts of distinct p-values in buckets, so a family of any size is spread out.
    """
    one_of("method", method, ("bh", "bonferroni"))
    family = family or []
    if method == "bonferroni":
        counted = df.groupBy(*family).agg(F.count(p).alias("_m"))
        sized = df.join(counted, family, "left") if family else df.withColumn("_m", counted.scalar())
        bonferroni = F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("_m"), F.lit(1.0)))
        return sized.select(*df.columns, bonferroni.alias("p_adj"))
    df = materialize(df, "pvalues")
    tested = df.where(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    sizes = tested.groupBy(*family).agg(F.sum("_n").alias("_m"))
    ranked = running(tested, family, "_p", {"_rank": ("sum", F.col("_n"))}, written=True)
    ranked = ranked.join(sizes, family) if family else ranked.withColumn("_m", sizes.scalar())
    raw = ranked.withColumn("_raw", F.least(F.col("_p") * F.col("_m") / F.col("_rank"), F.lit(1.0)))
    adjusted = running(raw.select(*family, "_p", "_raw"), family, "_p", {"p_adj": ("min", F.col("_raw"))}, descending=True)
    adjusted = adjusted.select(*family, F.col("_p").alias(p), "p_adj")
    return df.join(adjusted, [*family, p], "left").select(*df.columns, "p_adj")


def significant(min_log_fc: float = fv.MIN_LOG_FC, alpha: float = fv.ALPHA) -> Column:
    return F.coalesce((F.abs("log2_fold_change") >= min_log_fc) & (F.col("p_adj") < alpha), F.lit(False))


def call_significant(df: DataFrame, min_log_fc: float = fv.MIN_LOG_FC, alpha: float = fv.ALPHA) -> DataFrame:
    """D6. Fold change bound inclusive, p bound strict."""
    in_range("min_log_fc", min_log_fc, 0)
    in_range("alpha", alpha, 0, 1)
    return df.withColumn("significant", significant(min_log_fc, alpha))


def top_genes(df: DataFrame, n: int = 5, direction: str = "up") -> DataFrame:
    """D7. Significant genes with the strongest change in one direction; ties by gene."""
    one_of("direction", direction, ("up", "down"))
    change = F.col("log2_fold_change")
    hits = df.where(F.col("significant") & (change > 0 if direction == "up" else change < 0))
    return hits.orderBy(change.desc() if direction == "up" else change.asc(), "gene").limit(n)


def most_significant(df: DataFrame, n: int = 20) -> DataFrame:
    """D7. The ``n`` genes with the smallest adjusted p-value, with their rank.

    Values equal to nine places are ties; the stronger change goes first, then the gene.
    """
    in_range("n", n, 1)
    order = [F.round("p_adj", 9), F.round(F.abs("log2_fold_change"), 9).desc(), F.col("gene")]
    best = df.where(F.col("p_adj").isNotNull()).orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def de_summary(df: DataFrame, group1_size: Column | int | None = None, group2_size: Column | int | None = None) -> DataFrame:
    """D8."""
    change = F.col("log2_fold_change")
    out = df.agg(
        F.count("*").alias("total_genes_tested"),
        F.count_if("significant").alias("significant_genes"),
        F.count_if(F.col("significant") & (change > 0)).alias("upregulated"),
        F.count_if(F.col("significant") & (change < 0)).alias("downregulated"),
    )
    for name, size in (("group1_size", group1_size), ("group2_size", group2_size)):
        if size is not None:
            out = out.withColumn(name, size if isinstance(size, Column) else F.lit(size))
    return out


def differential_expression(
    obs: DataFrame,
    test_method: str = "wilcoxon",
    min_log_fc: float = fv.MIN_LOG_FC,
    alpha: float = fv.ALPHA,
    pseudo: float = 1.0,
) -> DataFrame:
    """Test, fold change, BH and the significance call in one lazy plan; ``most_significant`` ranks them.

    ``deseq2`` needs observations with ``spot_id`` (the sample) and whole counts.
    """
    one_of("test_method", test_method, fv.TEST_METHODS)
    if test_method == "deseq2":
        need_columns(obs, "spot_id")
        counts = obs.groupBy(F.col("spot_id").alias("sample_id"), "gene").agg(F.sum("value").alias("count"))
        groups = obs.select(F.col("spot_id").alias("sample_id"), "grp").distinct()
        tested = de_negbin_shrunk(counts, groups).select("gene", "base_mean", "log2_fold_change", "p_value")
    else:
        test = de_wilcoxon(obs) if test_method == "wilcoxon" else de_ttest(obs)
        tested = fold_change(obs, pseudo).join(test.select("gene", "p_value"), "gene")
    return call_significant(adjust_pvalues(tested), min_log_fc, alpha)
