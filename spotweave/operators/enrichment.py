"""Pathway enrichment (P1-P4). Gene sets are rows ``pathway, gene``; a pathway holds at most a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns, one_of
from spotweave.functions.numeric import hypergeometric_upper
from spotweave.operators.differential import adjust_pvalues


def pathway_overlap(genes: DataFrame, gene_sets: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """P1. Set size, overlap size and the overlapping genes. A background restricts sets and list to it."""
    need_columns(gene_sets, "pathway", "gene")
    members = gene_sets.select("pathway", "gene").distinct()
    wanted = genes.select("gene").distinct()
    if background is not None:
        universe = background.select("gene").distinct()
        members = members.join(universe, "gene", "left_semi")
        wanted = wanted.join(universe, "gene", "left_semi")
    marked = members.join(wanted.withColumn("_hit", F.lit(True)), "gene", "left")
    return marked.groupBy("pathway").agg(
        F.count("*").alias("genes_in_pathway"),
        F.count("_hit").alias("genes_overlapping"),
        F.sort_array(F.collect_list(F.when(F.col("_hit"), F.col("gene")))).alias("genes"),
    )


def enrich_fisher(
    overlap: DataFrame, genes: DataFrame, background: DataFrame | None = None, background_size: int = fv.BACKGROUND_GENES
) -> DataFrame:
    """P2, P3. One-sided Fisher p (hypergeometric upper tail) and fold enrichment (k/n) / (K/N)."""
    wanted = genes.select("gene").distinct()
    if background is not None:
        universe = background.select("gene").distinct()
        wanted = wanted.join(universe, "gene", "left_semi")
        total = universe.agg(F.count("*").alias("n")).scalar()
    else:
        in_range("background_size", background_size, 1)
        total = F.lit(background_size)
    drawn = wanted.agg(F.count("*").alias("n")).scalar()
    sized = overlap.withColumns({"genes_analyzed": drawn, "background_size": total})
    fold = F.try_divide(
        F.col("genes_overlapping") * F.col("background_size").cast("double"),
        F.col("genes_analyzed") * F.col("genes_in_pathway"),
    )
    return sized.withColumns(
        {
            "p_value": hypergeometric_upper("genes_overlapping", "genes_in_pathway", "genes_analyzed", "background_size"),
            "fold_enrichment": F.coalesce(fold, F.lit(0.0)),
        }
    )


def enrich(
    genes: DataFrame,
    gene_sets: DataFrame,
    background: DataFrame | None = None,
    background_size: int = fv.BACKGROUND_GENES,
) -> DataFrame:
    """P4. Every pathway with overlap, p, BH-adjusted p and fold enrichment."""
    overlap = pathway_overlap(genes, gene_sets, background)
    return adjust_pvalues(enrich_fisher(overlap, genes, background, background_size))


def enrich_database(
    genes: DataFrame,
    gene_sets: DataFrame,
    database: str = "GO_BP",
    background: DataFrame | None = None,
    background_size: int = fv.BACKGROUND_GENES,
) -> DataFrame:
    """P4 within one database: ``gene_sets`` is ``database, pathway_id, pathway, gene``; the id stays beside the name."""
    one_of("database", database, fv.GENE_SET_DATABASES)
    need_columns(gene_sets, "database", "pathway_id", "pathway", "gene")
    chosen = gene_sets.where(F.col("database") == database)
    named = chosen.select(F.col("pathway_id").alias("pathway"), "gene")
    names = chosen.groupBy(F.col("pathway_id")).agg(F.min("pathway").alias("name"))
    found = enrich(genes, named, background, background_size).withColumnRenamed("pathway", "pathway_id")
    return found.join(names, "pathway_id").withColumnRenamed("name", "pathway")


def enrich_summary(enriched: DataFrame, p_value_cutoff: float = fv.ALPHA) -> DataFrame:
    in_range("p_value_cutoff", p_value_cutoff, 0, 1)
    return enriched.agg(
        F.count("*").alias("pathways_tested"),
        F.count_if(F.col("p_adj") < p_value_cutoff).alias("pathways_enriched"),
        F.min_by("pathway", F.struct("p_value", "pathway")).alias("top_pathway"),
    )
