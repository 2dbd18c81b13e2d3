"""Cohort catalog, comparison of one sample with a cohort, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns, one_of
from spotweave.functions.numeric import clean_double, normal_two_sided, t_two_sided
from spotweave.functions.running import hash_buckets, running
from spotweave.operators.expression import normalize
from spotweave.operators.qc import gene_filter
from spotweave.session import dealt, materialize


def builtin_cohorts(spark) -> DataFrame:
    return spark.createDataFrame(
        list(fv.COHORTS),
        "code string, full_name string, primary_tumor_samples long, normal_samples long, metastatic_samples long",
    )


def query_cohorts(
    catalog: DataFrame, cancer_type: str | None = None, tissue_type: str | None = None, min_samples: int = 10
) -> DataFrame:
    """T1. Cohorts with enough samples of the tissue; an unknown tissue means primary tumour, an unknown
    code finds nothing."""
    in_range("min_samples", min_samples, 0)
    tissue = tissue_type if tissue_type in fv.TISSUE_TYPES else fv.TISSUE_TYPES[0]
    chosen = catalog.where(F.col("code") == cancer_type) if cancer_type else catalog
    samples = F.coalesce(F.col(f"{tissue}_samples"), F.lit(0))
    return chosen.where(samples >= min_samples).withColumn("matching_samples", samples)


def fetch_expression(
    cohort_expr: DataFrame,
    cohort: str,
    genes: DataFrame | list[str],
    tissue_type: str = "primary_tumor",
    normalization: str = "counts",
    gene_lengths: DataFrame | None = None,
) -> DataFrame:
    """T2. Long slice ``sample_id, gene, value`` of one cohort and tissue; the filters reach the scan.

    TPM and FPKM take ``gene_lengths`` and are computed over all genes of a sample before the gene filter.
    """
    one_of("normalization", normalization, fv.NORMALIZATIONS)
    rows = cohort_expr.where((F.col("cohort") == cohort) & (F.col("tissue_type") == tissue_type))
    if normalization != "counts":
        counts = rows.select(F.col("sample_id").alias("spot_id"), "gene", F.col("value").alias("count"))
        rows = normalize(counts, normalization, gene_lengths).withColumnRenamed("spot_id", "sample_id")
    return gene_filter(rows, genes).select("sample_id", "gene", "value")


def expression_arrays(slice_: DataFrame, width: int = 10_000) -> DataFrame:
    """T2. Gene -> values ordered by sample, for the edge of a program, in rows (gene, chunk) of bounded size.

    Samples are numbered in the order of a hash and dealt into chunks of ``width``, the same samples in the same chunk for
    every gene, so no row holds more than ``width`` samples however large the cohort is.
    """
    in_range("width", width, 1)
    samples = slice_.select("sample_id").distinct().withColumn("_h", F.xxhash64("sample_id"))
    order = running(samples, [], "_h", {"_place": ("sum", F.lit(1))}, buckets=hash_buckets, tiebreak=["sample_id"])
    chunk = F.floor((F.col("_place") - 1) / width).cast("long")
    numbered = slice_.join(order.select("sample_id", chunk.alias("chunk")), "sample_id")
    return numbered.groupBy("gene", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("sample_id", "value"))).alias("_e")
    ).select(
        "gene",
        "chunk",
        F.transform("_e", lambda e: e["sample_id"]).alias("sample_ids"),
        F.transform("_e", lambda e: e["value"]).alias("values"),
    )


def sample_from_map(spark, expression: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(expression.items()), "gene string, value double")


def compare_to_cohort(
    sample: DataFrame, cohort_expr: DataFrame, genes: DataFrame | list[str] | None = None, test: str = "z_score"
) -> DataFrame:
    """T3, T4. Sample value against the cohort per gene: mean, sd, z, p, share of the cohort at or below it.

    ``sample`` is ``gene, value``; a gene it lacks counts as 0. z is 0 without spread. ``t_test`` asks
    whether one more draw fits the cohort (t with n-1 df, error sd*sqrt(1+1/n)); ``wilcoxon`` uses the rank
    of the sample among the cohort (normal approximation).
    """
    one_of("test", test, fv.COHORT_TESTS)
    need_columns(sample, "gene", "value")
    rows = gene_filter(cohort_expr, genes) if genes is not None else cohort_expr
    own = sample.select("gene", F.col("value").cast("double").alias("_s"))
    s = F.coalesce("_s", F.lit(0.0))
    v = clean_double("value")
    stats = (
        rows.join(own, "gene", "left")
        .withColumn("_s", s)
        .groupBy("gene")
        .agg(
            F.max("_s").alias("sample_expression"),
            F.count(v).alias("n"),
            F.avg(v).alias("cohort_mean"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("cohort_std"),
            F.avg(F.when(v <= F.col("_s"), 100.0).when(v.isNotNull(), 0.0)).alias("percentile"),
            F.sum(F.when(v < F.col("_s"), 1.0).when(v == F.col("_s"), 0.5).otherwise(0.0)).alias("_u"),
        )
    )
    spread = F.col("cohort_std") > 0
    shift = F.col("sample_expression") - F.col("cohort_mean")
    n = F.col("n").cast("double")
    scored = stats.withColumn("z_score", F.when(spread, shift / F.col("cohort_std")).otherwise(0.0))
    if test == "z_score":
        p = normal_two_sided("z_score")
    elif test == "t_test":
        scored = scored.withColumn("_t", F.when(spread, shift / (F.col("cohort_std") * F.sqrt(1 + F.try_divide(F.lit(1.0), n)))))
        p = F.coalesce(t_two_sided(F.col("_t"), n - 1), F.lit(1.0))
    else:
        scored = scored.withColumn("_r", F.try_divide(F.col("_u") - n / 2, F.sqrt(n * (n + 2) / 12)))
        p = normal_two_sided("_r")
    z = F.col("z_score")
    return scored.select(
        "gene", "sample_expression", "n", "cohort_mean", "cohort_std", "z_score",
        p.alias("p_value"),
        "percentile",
        F.when(z > fv.OUTLIER_Z, "higher").when(z < -fv.OUTLIER_Z, "lower").otherwise("similar").alias("interpretation"),
    )


def comparison_summary(compared: DataFrame, alpha: float = fv.ALPHA) -> DataFrame:
    """T3. Genes compared, and those that differ from the cohort at ``alpha``."""
    in_range("alpha", alpha, 0, 1)
    return compared.agg(
        F.count("*").alias("genes_compared"), F.count_if(F.col("p_value") < alpha).alias("significantly_different")
    )


def percentile_rank(sample: DataFrame, cohort_expr: DataFrame) -> DataFrame:
    """T4. True share (percent) of cohort values at or below the sample value."""
    return compare_to_cohort(sample, cohort_expr).select("gene", "percentile")


def outlier_genes(compared: DataFrame, cut: float = fv.OUTLIER_Z) -> DataFrame:
    """T5."""
    in_range("cut", cut, 0)
    return compared.where(F.abs("z_score") > cut)


def mutation_frequency(mutations: DataFrame, samples: DataFrame, genes: DataFrame | list[str] | None = None) -> DataFrame:
    """T11. Mutated share of all samples per gene, and the share of each variant class among its mutations."""
    rows = gene_filter(mutations, genes) if genes is not None else mutations
    total = samples.agg(F.count_distinct("sample_id").alias("n")).scalar()
    share = lambda c: F.sum(F.when(F.col("variant_class") == c, F.col("_n")).otherwise(0)) / F.sum("_n")
    # per (gene, sample, class) counts first: repeated hits of one sample never travel as rows
    counted = rows.groupBy("gene", "sample_id", "variant_class").agg(F.count("*").alias("_n"))
    return counted.groupBy("gene").agg(
        F.count_distinct("sample_id").alias("mutated_samples"),
        *[share(c).alias(f"{c}_share") for c in fv.MUTATION_CLASSES],
    ).withColumn("total_samples", total).withColumn(
        "frequency", F.coalesce(F.col("mutated_samples") / F.nullif("total_samples", F.lit(0)), F.lit(0.0))
    )


def mutation_expression(mutations: DataFrame, expr: DataFrame) -> DataFrame:
    """T12. Per gene, point-biserial correlation of being mutated with expression over samples.

    ``expr`` is ``sample_id, gene, value``. Both sides are dealt to tasks by the number of rows, so that a task stays bounded.
    """
    expr = materialize(expr.select("sample_id", "gene", "value"), "expression")
    mutations = materialize(mutations.select("sample_id", "gene"), "mutations")
    rows = expr.count() + mutations.count()
    mutated = dealt(mutations, rows, "sample_id", "gene").distinct().withColumn("_m", F.lit(1.0))
    values = dealt(expr, rows, "sample_id", "gene").groupBy("sample_id", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
    flagged = values.join(mutated, ["sample_id", "gene"], "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    # the correlation from sums, NULL where either side is constant
    n, sx, sy = F.count("*").cast("double"), F.sum("value"), F.sum("_m")
    sxy, sxx = F.sum(F.col("value") * F.col("_m")), F.sum(F.col("value") * F.col("value"))
    cov = sxy - sx * sy / n
    vx, vy = sxx - sx * sx / n, sy - sy * sy / n
    return flagged.groupBy("gene").agg(
        F.avg(F.when(F.col("_m") == 1, F.col("value"))).alias("mean_mutated"),
        F.avg(F.when(F.col("_m") == 0, F.col("value"))).alias("mean_wild_type"),
        F.avg("_m").alias("mutation_rate"),
        F.avg("value").alias("mean_expression"),
        F.when((vx > 1e-9 * sxx) & (vy > 0), cov / F.sqrt(vx * vy)).alias("point_biserial_r"),
    )


def subtype_counts(clinical: DataFrame, cohort: str | None = None) -> DataFrame:
    """T13."""
    rows = clinical.where(F.col("cohort") == cohort) if cohort else clinical
    return rows.groupBy("cohort", "subtype").agg(F.count("*").alias("samples"))


def cohort_catalog(samples: DataFrame, tissues: tuple[str, ...] = fv.TISSUE_TYPES) -> DataFrame:
    """T14. Samples per cohort and tissue type, one ``<tissue>_samples`` column each."""
    return samples.groupBy(F.col("cohort").alias("code")).agg(
        *[F.count_if(F.col("tissue_type") == t).alias(f"{t}_samples") for t in tissues]
    )


