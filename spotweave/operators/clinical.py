"""Patients, diagnoses, labs and their link to spatial samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import need_columns
from spotweave.session import dealt, materialize


def patient_records(
    patients: DataFrame, ids: DataFrame | list[str] | None = None, include_labs: bool = True, include_meds: bool = True
) -> DataFrame:
    """C1. Records of the wanted patients. A part left out is empty, not missing."""
    rows = patients
    if isinstance(ids, DataFrame):
        rows = rows.join(ids.select("patient_id"), "patient_id", "left_semi")
    elif ids is not None:
        rows = rows.where(F.col("patient_id").isin(list(ids)))
    types = dict(patients.dtypes)
    if not include_labs:
        rows = rows.withColumn("labs", F.create_map().cast(types["labs"]))
    if not include_meds:
        rows = rows.withColumn("medications", F.array().cast(types["medications"]))
    return rows


def link_spatial_to_clinical(spatial: DataFrame, patients: DataFrame, tissue_site: str | None = None) -> DataFrame:
    """C2. One link per spatial sample and its patient, with the outcome fields as a struct."""
    need_columns(spatial, "sample_id")
    need_columns(patients, "sample_id", "patient_id")
    rows = spatial if tissue_site is None else spatial.where(F.col("tissue_site") == tissue_site)
    outcome = [c for c in ("response", "survival_months", "stage", "treatment") if c in patients.columns]
    linked = rows.join(patients.select("sample_id", "patient_id", F.struct(*outcome).alias("outcome_data")), "sample_id")
    return linked.withColumn(
        "link_id",
        F.concat(F.lit("link_"), F.col("sample_id").cast("string"), F.lit("_"), F.col("patient_id").cast("string")),
    )


def builtin_diagnoses(spark) -> DataFrame:
    return spark.createDataFrame(list(fv.DIAGNOSIS_CODES), "code string, description string")


def search_diagnoses(codes: DataFrame, icd10_code: str | None = None, keyword: str | None = None) -> DataFrame:
    """C3. A code finds its whole three-character category and wins over a keyword, which is a
    case-insensitive substring of the description; neither finds nothing."""
    if icd10_code:
        return codes.where(F.substring("code", 1, 3) == icd10_code[:3])
    if keyword:
        return codes.where(F.contains(F.lower("description"), F.lit(keyword.lower())))
    return codes.where(F.lit(False))


def clinical_completeness(patients: DataFrame, fields: list[str]) -> DataFrame:
    """C4. Per patient: required fields present, which ones are missing, and the share present."""
    need_columns(patients, "patient_id", *fields)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return patients.select("patient_id", missing.alias("missing")).select(
        "patient_id",
        (F.lit(len(fields)) - F.size("missing")).alias("present"),
        "missing",
        ((F.lit(len(fields)) - F.size("missing")) / len(fields)).alias("completeness"),
    )


def expression_by_response(expr: DataFrame, clinical: DataFrame, by: str = "response") -> DataFrame:
    """C5. Per gene and response (or stage): patients, mean expression, correlation with months.

    Samples are dealt to tasks by the number of rows, so that the values, their order and the groups of a task stay bounded.
    """
    need_columns(clinical, "sample_id", by, "survival_months")
    expr = materialize(expr.where("sample_id is not null").select("sample_id", "gene", "value"), "expression")
    values = dealt(expr, expr.count(), "sample_id").groupBy("sample_id", "gene").agg(F.sum(F.col("value").cast("double")).alias("value"))
    rows = values.join(clinical.select("sample_id", by, "survival_months"), "sample_id")
    return rows.groupBy("gene", by).agg(
        F.count("*").alias("samples"),
        F.avg("value").alias("mean_expression"),
        F.corr("value", F.col("survival_months").cast("double")).alias("months_r"),
    )


def lab_flags(patients: DataFrame) -> DataFrame:
    """C6. One row per patient and lab: low, normal or high against a ``low-high`` reference range."""
    rows = patients.select("patient_id", F.explode("labs").alias("lab", "r"))
    bounds = F.regexp_extract("r.ref_range", r"^\s*(-?[0-9.]+)\s*-\s*(-?[0-9.]+)\s*$", 1), F.regexp_extract(
        "r.ref_range", r"^\s*(-?[0-9.]+)\s*-\s*(-?[0-9.]+)\s*$", 2
    )
    low, high = (F.nullif(b, F.lit("")).cast("double") for b in bounds)
    value = F.col("r.value")
    return rows.select(
        "patient_id", "lab", value.alias("value"), F.col("r.unit").alias("unit"),
        F.when(value < low, "low").when(value > high, "high")
        .when(value.isNotNull() & low.isNotNull() & high.isNotNull(), "normal").alias("flag"),
    )


def diagnosis_counts(patients: DataFrame) -> DataFrame:
    """C7. Patients per three-character category and stage, over ``diagnoses ARRAY<STRUCT<icd10, stage, ..>>``."""
    rows = patients.select("patient_id", F.explode("diagnoses").alias("d"))
    return rows.groupBy(F.substring("d.icd10", 1, 3).alias("category"), F.col("d.stage").alias("stage")).agg(
        F.count_distinct("patient_id").alias("patients")
    )
