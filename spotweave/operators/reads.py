"""Read-level operators: FASTQ validation, UMIs, barcodes, alignment rates.

A read row is ``file, pos, header, read_id, mate, comment, sequence, plus, quality``; ``pos`` is the
record number within the file.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range
from spotweave.functions.numeric import as_column
from spotweave.functions.running import number_buckets


@F.pandas_udf(LongType())
def _code_sum(lines: pd.Series) -> pd.Series:
    """Sum of the code points of each line, over the whole batch at once; NULL stays NULL."""
    known = lines.notna().to_numpy()
    texts = lines[known].tolist()
    ends = np.cumsum([0, *map(len, texts)])
    sums = np.concatenate([[0], np.cumsum(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), dtype=np.int64)])
    out = pd.Series([None] * len(lines), dtype="Int64")
    out[known] = sums[ends[1:]] - sums[ends[:-1]]
    return out


def quality_sum(quality="quality") -> Column:
    """Sum of the Phred scores of one read."""
    quality = as_column(quality)
    return _code_sum(quality) - F.lit(fv.PHRED_OFFSET) * F.length(quality)


def mean_quality(quality="quality") -> Column:
    quality = as_column(quality)
    return F.when(F.length(quality) > 0, quality_sum(quality) / F.length(quality))


def format_problem() -> Column:
    """First format error of a read, NULL for a good one. An empty quality line is an error, not a crash."""
    return (
        F.when(F.col("header").isNull() | ~F.col("header").startswith("@"), F.lit("bad_header"))
        .when(F.col("sequence").isNull() | F.col("plus").isNull() | F.col("quality").isNull(), F.lit("truncated"))
        .when(~F.col("plus").startswith("+"), F.lit("bad_separator"))
        .when(F.length("sequence") != F.length("quality"), F.lit("length_mismatch"))
        .when(F.length("quality") == 0, F.lit("empty_record"))
    )


def read_format_errors(reads: DataFrame) -> DataFrame:
    """R2. The bad records themselves, so one scan reports all of them."""
    return reads.withColumn("problem", format_problem()).where("problem is not null").select("file", "pos", "problem")


def sample_reads(reads: DataFrame, n: int = fv.SAMPLE_READS) -> DataFrame:
    """R3. First ``n`` reads of each file in file order, however large a file is.

    Reads are counted per position bucket (monotone in ``pos``, a bounded number per file); only buckets
    that begin within the first n reads are ranked, so a task sees little more than n reads of a file.
    """
    in_range("n", n, 1)
    coarse, fine = number_buckets(F.col("pos").cast("double"))
    placed = reads.withColumns({"_b1": coarse, "_b2": fine})
    before = Window.partitionBy("file").orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        placed.groupBy("file", "_b1", "_b2")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_before") < n)
        .select("file", "_b1", "_b2")
    )
    order = Window.partitionBy("file").orderBy("pos")
    first = placed.join(needed, ["file", "_b1", "_b2"], "left_semi").withColumn("_rank", F.row_number().over(order))
    return first.where(F.col("_rank") <= n).select(*reads.columns)


def validate_reads(reads: DataFrame, min_quality: float = fv.MIN_BASE_QUALITY, sample: int | None = None) -> DataFrame:
    """R1. One row per file; the quality is the mean of per-read means and is compared unrounded."""
    in_range("min_quality", min_quality, 0)
    source = sample_reads(reads, sample) if sample else reads
    bad = format_problem().isNotNull()
    per_file = source.groupBy("file").agg(
        F.count("*").alias("total_reads"),
        F.avg(F.when(~bad, mean_quality())).alias("_q"),
        F.avg(F.when(~bad, F.length("sequence"))).alias("_len"),
        F.count_if(bad).alias("format_errors"),
    )
    low = F.coalesce(F.col("_q"), F.lit(0.0)) < min_quality
    warnings = F.array_compact(
        F.array(
            F.when(low, F.lit("mean quality below threshold")),
            F.when(F.col("format_errors") > 0, F.lit("malformed records")),
        )
    )
    return per_file.select(
        "file",
        (~low & (F.col("format_errors") == 0)).alias("valid"),
        "total_reads",
        F.round(F.coalesce("_q", F.lit(0.0)), 2).alias("avg_quality"),
        F.round(F.coalesce("_len", F.lit(0.0)), 2).alias("avg_read_length"),
        "format_errors",
        warnings.alias("warnings"),
    )


def parse_read_structure(structure: str) -> list[tuple[str, int, int | None]]:
    """``16B12M+T`` -> [('B', 1, 16), ('M', 17, 12), ('T', 29, None)]; ``+`` takes the rest of the read.

    Two or more M segments read as barcode first, UMI second, as in ``16M12M+T``.
    """
    parts = re.findall(r"(\d+|\+)([BMTS])", structure)
    if not parts or "".join(a + b for a, b in parts) != structure:
        raise ValueError(f"bad read structure: {structure!r}")
    if any(size == "+" for size, _ in parts[:-1]):
        raise ValueError("only the last segment may take the rest of the read")
    segments, offset = [], 1
    for size, kind in parts:
        length = None if size == "+" else int(size)
        segments.append((kind, offset, length))
        offset += length or 0
    molecular = [i for i, s in enumerate(segments) if s[0] == "M"]
    if len(molecular) > 1 and not any(s[0] == "B" for s in segments):
        segments[molecular[0]] = ("B", *segments[molecular[0]][1:])
    return segments


def extract_umis(reads: DataFrame, umi_length: int = fv.UMI_LENGTH, read_structure: str = "12M+T") -> DataFrame:
    """R4. Cut barcode, UMI and template out of each read; the UMI joins the read name after a colon.

    Reads too short for the fixed segments keep a NULL UMI, for R6 to count.
    """
    in_range("umi_length", umi_length, *fv.UMI_LENGTH_RANGE)
    segments = parse_read_structure(read_structure)
    if not any(kind == "M" and length == umi_length for kind, _, length in segments):
        raise ValueError(f"read structure {read_structure!r} holds no UMI of length {umi_length}")
    needed = sum(length or 0 for _, _, length in segments)
    enough = F.length("sequence") >= needed

    def cut(column: str, kind: str) -> Column | None:
        pieces = [
            F.substring(F.col(column), offset, length) if length else F.expr(f"substring({column}, {offset})")
            for k, offset, length in segments
            if k == kind
        ]
        return F.when(enough, F.concat(*pieces)) if pieces else None

    umi = cut("sequence", "M")
    columns = {"umi": umi}
    barcode = cut("sequence", "B")
    if barcode is not None:
        columns["barcode"] = barcode
    if any(k == "T" for k, _, _ in segments):
        columns["template"], columns["template_quality"] = cut("sequence", "T"), cut("quality", "T")
    columns["read_name"] = F.concat_ws(":", F.col("read_id"), umi)
    return reads.withColumns(columns)


def umi_stats(tagged: DataFrame, approximate: bool = False) -> DataFrame:
    """R5. Reads, distinct UMIs, and their ratio."""
    distinct = F.approx_count_distinct("umi") if approximate else F.countDistinct("umi")
    return tagged.agg(F.count("*").alias("reads_processed"), distinct.alias("umi_count")).withColumn(
        "unique_umi_ratio",
        F.when(F.col("reads_processed") > 0, F.col("umi_count") / F.col("reads_processed")).otherwise(0.0),
    )


def umi_extraction_rate(reads: DataFrame, needed: int = fv.BARCODE_LENGTH + fv.UMI_LENGTH) -> DataFrame:
    """R6. Share of reads long enough for barcode and UMI."""
    return reads.agg(
        F.count("*").alias("reads"), F.count_if(F.length("sequence") >= needed).alias("extractable")
    ).withColumn("extraction_rate", F.coalesce(F.col("extractable") / F.nullif("reads", F.lit(0)), F.lit(0.0)))


def _barcode_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("barcode").agg(F.count("*").alias("reads"))


def match_barcodes(tagged: DataFrame, spots: DataFrame, min_rate: float = 0.95) -> DataFrame:
    """R7. Share of reads whose barcode is a known spot. Reads are counted per barcode before the join."""
    known = spots.select("barcode").distinct().withColumn("_known", F.lit(True))
    joined = _barcode_counts(tagged).join(known, "barcode", "left")
    return joined.agg(
        F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"),
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("reads"))), F.lit(0)).alias("matched_reads"),
    ).select(
        "reads",
        "matched_reads",
        F.coalesce(F.col("matched_reads") / F.nullif("reads", F.lit(0)), F.lit(0.0)).alias("match_rate"),
        (F.coalesce(F.col("matched_reads") / F.nullif("reads", F.lit(0)), F.lit(0.0)) >= min_rate).alias("passed"),
    )


def barcode_mismatches(tagged: DataFrame, spots: DataFrame) -> DataFrame:
    """R7. Barcodes seen in reads but not in the coordinate table, with their read counts."""
    return _barcode_counts(tagged).join(spots.select("barcode"), "barcode", "left_anti")


def umi_duplication_rate(tagged: DataFrame, max_rate: float = 0.10) -> DataFrame:
    """R8. 1 - distinct (barcode, gene, UMI) / reads.

    Copies are counted per molecule first; the two totals are then plain sums.
    """
    molecules = tagged.groupBy("barcode", "gene", "umi").agg(F.count("*").alias("copies"))
    rate = F.coalesce(1.0 - F.col("molecules") / F.nullif("reads", F.lit(0)), F.lit(0.0))
    return molecules.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("reads"), F.count("*").alias("molecules")
    ).select("reads", "molecules", rate.alias("duplication_rate"), (rate <= max_rate).alias("passed"))


def count_umis(tagged: DataFrame) -> DataFrame:
    """R9. Distinct UMIs per (barcode, gene): the expression matrix in long form."""
    return tagged.groupBy("barcode", "gene").agg(F.countDistinct("umi").alias("count"))


def alignment_stats(alignments: DataFrame) -> DataFrame:
    """R10. One row per alignment line in (``read_id``, ``nh``), nh 0 or NULL for unmapped."""
    per_read = alignments.groupBy("read_id").agg(F.max(F.coalesce("nh", F.lit(0))).alias("nh"))
    counts = per_read.agg(
        F.count("*").alias("total_reads"),
        F.count_if(F.col("nh") == 1).alias("uniquely_mapped"),
        F.count_if(F.col("nh") > 1).alias("multi_mapped"),
        F.count_if(F.col("nh") == 0).alias("unmapped"),
    )
    total = F.nullif("total_reads", F.lit(0))
    return counts.withColumns(
        {
            "alignment_rate": F.coalesce((F.col("uniquely_mapped") + F.col("multi_mapped")) / total, F.lit(0.0)),
            "unique_mapping_rate": F.coalesce(F.col("uniquely_mapped") / total, F.lit(0.0)),
        }
    )


def read_composition(reads: DataFrame) -> DataFrame:
    """R11. Per mate: reads, mean length, GC percent over all bases, mean of per-read mean qualities."""
    gc = F.length(F.translate(F.upper("sequence"), "ATN", ""))
    return reads.groupBy("mate").agg(
        F.count("*").alias("reads"),
        F.avg(F.length("sequence")).alias("mean_length"),
        F.try_divide(F.lit(100.0) * F.sum(gc), F.sum(F.length("sequence"))).alias("gc_percent"),
        F.avg(mean_quality()).alias("mean_quality"),
    )


def quality_histogram(reads: DataFrame) -> DataFrame:
    """R12. Reads per whole mean Phred score."""
    return reads.groupBy(F.floor(mean_quality()).cast("int").alias("mean_phred")).agg(F.count("*").alias("reads"))
