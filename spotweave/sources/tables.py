"""Readers for tables and nested documents (S1-S3, S5, S6, S11). Schemas are stated, never inferred from data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spotweave.functions.numeric import clean_double

SPOT_SCHEMA = (
    "barcode string, n_reads bigint, n_genes bigint, mt_percent double, x_coord double, y_coord double, region string"
)
COORDINATE_SCHEMA = "barcode string, x double, y double, spot_id string"
POSITION_SCHEMA = (
    "barcode string, in_tissue int, array_row int, array_col int, px_row double, px_col double"
)
CLINICAL_SCHEMA = (
    "patient_id string, age int, sex string, ethnicity string, "
    "diagnosis struct<icd10: string, description: string, stage: string>, "
    "treatment string, survival_months int, response string, sample_id string"
)
IMAGE_SCHEMA = (
    "image_id string, sample_id string, stain_type string, magnification string, resolution string, "
    "dimensions struct<width: int, height: int>, file_format string, file_size_mb double, "
    "regions_annotated boolean, quality_score double"
)
EHR_SCHEMA = (
    "patient_id string, demographics struct<age: int, sex: string, ethnicity: string, mrn: string>, "
    "diagnoses array<struct<icd10: string, description: string, date: date>>, "
    "labs map<string, struct<value: double, unit: string, ref_range: string>>, "
    "medications array<struct<name: string, dose: string, frequency: string>>"
)


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_spot_table(
    spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, skip_others: bool = False
) -> DataFrame:
    """S1. Spot QC tables as CSV with a header, matched by column name; ``source_file`` tells tiles apart.

    Another suffix is an error, or is left out with ``skip_others`` (as tile merging does). Columns the
    stated schema lacks are kept as strings; NaN becomes NULL.
    """
    paths = _paths(path)
    csv = [p for p in paths if p.endswith(".csv")]
    if len(csv) < len(paths) and not skip_others:
        raise ValueError(f"unsupported file format: {sorted(set(paths) - set(csv))[0]}")
    if not csv:
        raise ValueError("no CSV file among the paths")
    wanted = {f.name: f.dataType for f in (schema if isinstance(schema, StructType) else StructType.fromDDL(schema or SPOT_SCHEMA))}

    def one(p: str) -> DataFrame:
        # only the header line is looked at for names; types come from the schema
        df = spark.read.csv(p, header=True)
        typed = [
            (clean_double(c) if wanted[c].typeName() == "double" else F.col(c).cast(wanted[c])).alias(c)
            if c in wanted else F.col(f"`{c}`")
            for c in df.columns
        ]
        return df.select(*typed, F.col("_metadata.file_path").alias("source_file"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in csv])


def read_expression(
    spark: SparkSession, path: str | list[str], genes: list[str] | None = None, lines: bool = False
) -> DataFrame:
    """S2. JSON array of wide spots -> ``spot_id, barcode, region, gene, count``.

    An array is one document and is read by one task per file; JSON ``lines`` split over tasks. With ``genes`` the schema is stated; otherwise Spark scans the documents once for the gene names.
    """
    ids = ["spot_id", "barcode", "region"]
    reader = spark.read
    if genes:
        fields = [f"{i} string" for i in ids] + [f"`{g}` bigint" for g in genes]
        reader = reader.schema(", ".join(fields))
    wide = reader.json(_paths(path), multiLine=not lines)
    names = genes or [c for c in wide.columns if c not in ids]
    return wide.select(*ids, *[F.col(f"`{g}`").cast("bigint").alias(g) for g in names]).unpivot(
        ids, names, "gene", "count"
    )


def read_coordinates(
    spark: SparkSession,
    path: str,
    scale_factors: str | None = None,
    scale: str = "tissue_hires_scalef",
    lines: bool = False,
) -> DataFrame:
    """S3. JSON spots, or a CSV position list whose pixel columns are multiplied by one scale factor."""
    if not path.endswith(".csv"):
        return spark.read.schema(COORDINATE_SCHEMA).json(path, multiLine=not lines)
    positions = spark.read.schema(POSITION_SCHEMA).csv(path, header=False).where(F.col("in_tissue").isNotNull())
    factor = F.lit(1.0)
    if scale_factors:
        table = spark.read.schema("value string").text(scale_factors, wholetext=True)
        factors = F.from_json("value", "map<string, double>")
        factor = table.select(factors[scale]).scalar()
    return positions.select(
        "barcode", "in_tissue", "array_row", "array_col",
        (F.col("px_col") * factor).alias("x"), (F.col("px_row") * factor).alias("y"),
        F.col("barcode").alias("spot_id"),
    )


def read_clinical(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """S5."""
    return spark.read.schema(CLINICAL_SCHEMA).json(_paths(path), multiLine=not lines)


def read_ehr(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """S5. Records with labs and medications, as ``clinical.patient_records`` takes them."""
    return spark.read.schema(EHR_SCHEMA).json(_paths(path), multiLine=not lines)


def read_image_catalog(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """S6."""
    return spark.read.schema(IMAGE_SCHEMA).json(_paths(path), multiLine=not lines)


def read_cosmx(spark: SparkSession, expression: str, metadata: str, polygons: str, ids: list[str] = ["fov", "cell_id"]) -> dict[str, DataFrame]:
    """S11. Cell x gene counts (long), cell metadata, and one boundary array per cell in vertex order.

    A boundary has a few dozen vertices, so collecting them per cell is bounded.
    """
    wide = spark.read.csv(expression, header=True)
    genes = [c for c in wide.columns if c not in ids]
    counts = wide.select(*ids, *[F.col(f"`{g}`").cast("bigint").alias(g) for g in genes]).unpivot(ids, genes, "gene", "count")
    meta_raw = spark.read.csv(metadata, header=True)
    numeric = [c for c in meta_raw.columns if c not in ids]
    cells = meta_raw.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
    vertices = spark.read.csv(polygons, header=True).select(
        *ids, F.col("vertex").cast("int").alias("i"), F.col("x").cast("double"), F.col("y").cast("double")
    )
    boundary = F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))
    )
    return {"expression": counts, "cells": cells, "boundaries": vertices.groupBy(*ids).agg(boundary.alias("vertices"))}
