"""Readers for tab-separated genomic formats: annotations, alignments, gene sets, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.checks import one_of

GTF_SCHEMA = (
    "chromosome string, source string, feature string, start bigint, end bigint, "
    "score string, strand string, frame string, attributes string"
)
SAM_COLUMNS = ("read_id", "flag", "reference", "position", "mapping_quality", "cigar")
MAF_COLUMNS = {"Hugo_Symbol": "gene", "Variant_Classification": "variant", "Tumor_Sample_Barcode": "sample_id"}
# Usual names of the four counted variant classes
MAF_CLASSES = {
    "Missense_Mutation": "missense", "Nonsense_Mutation": "nonsense",
    "Frame_Shift_Del": "frameshift", "Frame_Shift_Ins": "frameshift", "Splice_Site": "splice_site",
}


def _tab(spark: SparkSession, path, schema: str, header: bool = False) -> DataFrame:
    # no quoting: attribute columns hold bare double quotes
    return spark.read.schema(schema).csv(path, sep="\t", comment="#", header=header, quote="")


def read_annotations(spark: SparkSession, path: str | list[str], fmt: str = "gtf", genome: str | None = None) -> DataFrame:
    """S7. GTF (``key "value";``) or GFF3 (``key=value;``) gene rows."""
    one_of("fmt", fmt, ("gtf", "gff3"))
    raw = _tab(spark, path, GTF_SCHEMA)

    def attribute(*names: str) -> Column:
        found = []
        for n in names:
            pattern = rf'(?:^|;\s*){n}\s+"([^"]*)"' if fmt == "gtf" else rf"(?:^|;\s*){n}=([^;]*)"
            found.append(F.nullif(F.regexp_extract("attributes", pattern, 1), F.lit("")))
        return F.coalesce(*found)

    genes = raw.where(F.col("feature") == "gene")
    return genes.select(
        attribute("gene_name", "Name").alias("gene_name"),
        attribute("gene_id", "ID").alias("gene_id"),
        "chromosome", "start", "end", "strand",
        attribute("gene_type", "gene_biotype", "biotype").alias("gene_type"),
        "source",
        F.lit(genome).cast("string").alias("genome"),
    )


def read_alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S8. SAM text: mandatory fields and the tags NH HI AS nM NM MD. Header lines start with ``@`` + two
    letters and a tab."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^@[A-Z]{2}\t") & (F.length("value") > 0))
    parts = lines.select(F.split("value", "\t").alias("p"), "value")
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    types = ("string", "int", "string", "bigint", "int", "string")
    unmapped = F.col("p")[1].cast("int").bitwiseAND(4) != 0
    return parts.select(
        *[F.col("p")[i].cast(t).alias(c) for i, (c, t) in enumerate(zip(SAM_COLUMNS, types))],
        F.when(unmapped, 0).otherwise(F.coalesce(tag("NH").cast("int"), F.lit(1))).alias("nh"),
        tag("HI").cast("int").alias("hi"), tag("AS").cast("int").alias("as_score"),
        tag("nM").cast("int").alias("mismatches"), tag("NM").cast("int").alias("edit_distance"),
        tag("MD").alias("md"),
    )


def read_gene_sets(spark: SparkSession, path: str | list[str], database: str | None = None) -> DataFrame:
    """S9. GMT lines (name, description, genes...) -> one row per (pathway, gene)."""
    parts = spark.read.text(path).where("length(value) > 0").select(F.split("value", "\t").alias("p"))
    return parts.where(F.size("p") > 2).select(
        F.lit(database).cast("string").alias("database"),
        F.col("p")[0].alias("pathway"),
        F.col("p")[1].alias("description"),
        F.explode(F.slice("p", 3, F.size("p") - 2)).alias("gene"),
    ).where("gene <> ''")


def read_mutations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S10. MAF-like rows by header name -> ``sample_id, gene, variant, variant_class``."""
    raw = spark.read.csv(path, sep="\t", comment="#", header=True, quote="")
    named = raw.select(*[F.col(f"`{source}`").alias(name) for source, name in MAF_COLUMNS.items()])
    pairs = [F.lit(v) for pair in MAF_CLASSES.items() for v in pair]
    return named.withColumn("variant_class", F.coalesce(F.try_element_at(F.create_map(*pairs), "variant"), F.lit("other")))
