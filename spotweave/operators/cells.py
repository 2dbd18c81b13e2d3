"""Segmented cells, cell states and types, sequences and platform agreement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns
from spotweave.functions.geometry import inside_polygon, points_in_boxes
from spotweave.operators.principal import _as_lists

PIECE = 256  # letters of a text that one row holds, beside the start of the next
WHOLE = 1 << 18  # letters of a sequence that is counted in one go
_ROWS = 100_000  # k-mers that a task gives on at once, about
_VECTORS = 256  # embeddings of a batch
_KNOWN = 1_000_000  # k-mers whose places a task keeps at hand


def filter_cells(cells: DataFrame, min_cell_size: float = fv.MIN_CELL_SIZE) -> DataFrame:
    """K6."""
    in_range("min_cell_size", min_cell_size, 0)
    return cells.where(F.col("area") >= min_cell_size)


def cell_summary(cells: DataFrame, min_cell_size: float = fv.MIN_CELL_SIZE) -> DataFrame:
    """K6. Detected and dropped cells, mean area and confidence of the kept ones, in one pass."""
    kept = F.coalesce(F.col("area") >= min_cell_size, F.lit(False))
    return cells.agg(
        F.count_if(kept).alias("cells_detected"),
        F.coalesce(F.avg(F.when(kept, F.col("area"))), F.lit(0.0)).alias("mean_cell_area"),
        F.coalesce(F.avg(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.count_if(~kept).alias("cells_filtered"),
    )


def score_signatures(expr: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per cell, the best signature by mean log1p(count) over its genes, with the softmax share of its
    score as confidence. ``signatures`` is ``label, gene``; a cell that shows none of the genes scores 0
    for every label, and ties go to the first label by name.
    """
    need_columns(signatures, "label", "gene")
    sizes = signatures.groupBy("label").agg(F.count_distinct("gene").alias("_size"))
    counts = expr.groupBy("cell_id", "gene").agg(F.sum("count").alias("count"))
    seen = (
        counts.join(signatures.select("label", "gene").distinct(), "gene")
        .groupBy("cell_id", "label")
        .agg(F.sum(F.log1p("count")).alias("_sum"))
    )
    # every (cell, label): the label list is tiny, and each cell is met once
    labels = sizes.agg(F.sort_array(F.collect_list(F.struct("label", "_size"))).alias("l")).scalar()
    scored = seen.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "_sum"))).alias("_s"))
    full = expr.select("cell_id").distinct().join(scored, "cell_id", "left").withColumn("_l", labels)
    mean = lambda e: F.coalesce(F.try_element_at(F.col("_s"), e["label"]), F.lit(0.0)) / e["_size"]
    full = full.withColumn(
        "_r", F.transform("_l", lambda e: F.struct((-mean(e)).alias("neg"), e["label"].alias("label")))
    )
    best = F.array_min("_r")
    total = F.aggregate("_r", F.lit(0.0), lambda acc, e: acc + F.exp(best["neg"] - e["neg"]))
    return full.select(
        "cell_id",
        best["label"].alias("label"),
        (-best["neg"]).alias("score"),
        (1.0 / total).alias("confidence"),
    )


def classify_cell_states(cells: DataFrame, expr: DataFrame, markers: DataFrame) -> DataFrame:
    """K7. State and confidence of each segmented cell; ``markers`` is ``label, gene``."""
    scored = score_signatures(expr.join(cells.select("cell_id"), "cell_id", "left_semi"), markers)
    return scored.select("cell_id", F.col("label").alias("state"), "confidence")


def predict_cell_type(expr: DataFrame, signatures: DataFrame) -> DataFrame:
    """K9."""
    return score_signatures(expr, signatures).select("cell_id", F.col("label").alias("cell_type"), "confidence")


def cell_type_summary(predicted: DataFrame) -> DataFrame:
    return predicted.agg(
        F.count("*").alias("total_cells"), F.count_distinct("cell_type").alias("unique_types")
    )


def cell_type_report(predicted: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """K10. Cells per type, share of all, share that is confident, number that is not."""
    in_range("min_confidence", min_confidence, 0, 1)
    per_type = predicted.groupBy("cell_type").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("confidence") >= min_confidence).alias("confident"),
    )
    total = per_type.agg(F.sum("cells").alias("t")).scalar()
    return per_type.withColumn("_t", total).select(
        "cell_type", "cells",
        (F.col("cells") / F.col("_t")).alias("share"),
        (F.col("confident") / F.col("cells")).alias("confident_share"),
        (F.col("cells") - F.col("confident")).alias("low_confidence"),
    )


def low_confidence_cells(predicted: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    return predicted.where(F.col("confidence") < min_confidence)


def cells_in_boundary(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """K8. Points inside polygons ``polygon_id, vertices ARRAY<STRUCT<x, y>>``: bounding boxes join by grid
    cells, then the even-odd rule decides."""
    edge = lambda pick, axis: pick(F.transform("vertices", lambda v: v[axis]))
    boxed = polygons.withColumns(
        {
            "x1": edge(F.array_min, "x"), "y1": edge(F.array_min, "y"),
            "x2": edge(F.array_max, "x"), "y2": edge(F.array_max, "y"),
        }
    )
    near = points_in_boxes(points, boxed)
    return near.where(inside_polygon(F.col("x"), F.col("y"), F.col("vertices"))).drop("x1", "y1", "x2", "y2", "vertices")


def _kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(seq_id, kmer) of every position. A text is cut into short pieces once, each followed by the start of the next, so
    a position is found by walking one piece and no row holds more than a piece."""
    size = max(PIECE, k)
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = sequences.select("seq_id", pieces.alias("_p"))
    # with k up to the piece's length the start of the next one piece is all that is needed
    longer = F.transform("_p", lambda p, i: F.concat(p, F.substring(F.coalesce(F.try_element_at("_p", i + 2), F.lit("")), 1, k - 1)))
    rows = cut.select("seq_id", F.explode(longer).alias("_p")).where(F.length("_p") >= k)
    at = F.explode(F.sequence(F.lit(1), F.length("_p") - (k - 1)))
    return rows.withColumn("_at", at).select("seq_id", F.col("_p").substr(F.col("_at"), F.lit(k)).alias("kmer"))


def _counted(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a position of every distinct k-mer of a text, how often it occurs)."""
    letters, code = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
    places = len(code) - k + 1
    if places <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, kinds = code[:places].astype(np.int64), len(letters)
    for j in range(1, k):
        if kinds * len(letters) >= 2**62:  # numbers of the prefixes that occur instead of all that could
            found, word = np.unique(word, return_inverse=True)
            kinds = len(found)
        word, kinds = word * len(letters) + code[j : j + places], kinds * len(letters)
    _, first, n = np.unique(word, return_index=True, return_counts=True)
    return first, n


def _count_rows(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kmers, counts = [], [], []
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                first, n = _counted(text, k)
                rows.append(np.full(len(n), row))
                kmers += [text[i : i + k] for i in first.tolist()]
                counts.append(n)
                if len(kmers) >= _ROWS or row == batch.num_rows - 1:
                    ids = batch.column(0).take(pa.array(np.concatenate(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(kmers, pa.string()), pa.array(np.concatenate(counts), pa.int64())], names=["seq_id", "kmer", "n"])
                    rows, kmers, counts = [], [], []

    return count


def _embed_rows(dim: int, k: int):
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, _VECTORS):
                texts = batch.column(1).slice(a, _VECTORS).to_pylist()
                out = np.zeros((len(texts), dim))
                for row, text in enumerate(texts):
                    first, n = _counted(text or "", k)
                    kmers = [text[i : i + k] for i in first.tolist()]
                    if len(places) > _KNOWN:
                        places.clear()
                    for kmer in kmers:
                        if kmer not in places:
                            places[kmer] = int(hashlib.md5(kmer.encode()).hexdigest()[:8], 16) % dim
                    if kmers:
                        out[row] = np.bincount([places[kmer] for kmer in kmers], n, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), _as_lists(out)], names=["seq_id", "embedding"])

    return embed


def _whole(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences that are one row of moderate length, which one task counts to the end; the others)."""
    rows = sequences.select("seq_id", "sequence")
    sizes = rows.groupBy("seq_id").agg(F.count("*").alias("_c"), F.coalesce(F.max(F.length("sequence")), F.lit(0)).alias("_l"))
    alone = sizes.where((F.col("_c") == 1) & (F.col("_l") <= WHOLE)).select("seq_id")
    return rows.join(alone, "seq_id", "left_semi"), rows.join(alone, "seq_id", "left_anti")


def _summed_kmers(sequences: DataFrame, k: int) -> DataFrame:
    return _kmers(sequences, k).groupBy("seq_id", "kmer").agg(F.count("*").alias("n"))


def kmer_counts(sequences: DataFrame, k: int = 6) -> DataFrame:
    """K11. Occurrences of every k-mer per sequence. Sequences of several rows or beyond ``WHOLE`` letters are counted in pieces."""
    in_range("k", k, 1)
    alone, rest = _whole(sequences)
    schema = T.StructType([alone.schema["seq_id"], T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])
    return alone.where("sequence is not null").mapInArrow(_count_rows(k), schema).unionByName(_summed_kmers(rest, k))


def embed_sequences(sequences: DataFrame, dim: int = fv.EMBEDDING_DIM, k: int = 6) -> DataFrame:
    """K11. Hashed k-mer counts as ``embedding ARRAY<DOUBLE>`` of length ``dim``; a k-mer counts at its MD5's first eight
    digits modulo ``dim``. A sequence without k-mers has zeros."""
    in_range("dim", dim, 1)
    in_range("k", k, 1)
    alone, rest = _whole(sequences)
    schema = T.StructType([alone.schema["seq_id"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    place = (F.conv(F.substring(F.md5("kmer"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = _summed_kmers(rest, k).groupBy("seq_id", place.alias("_at")).agg(F.sum("n").cast("double").alias("_n"))
    held = counts.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_n"))).alias("_m"))  # dim entries at most
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    everyone = rest.select("seq_id").distinct()
    pieced = everyone.join(held, "seq_id", "left").select("seq_id", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(vector).alias("embedding"))
    return alone.mapInArrow(_embed_rows(dim, k), schema).unionByName(pieced)


def platform_correlation(a: DataFrame, b: DataFrame, min_r: float = 0.7) -> DataFrame:
    """K12. Pearson r of mean expression of the shared genes on two platforms."""
    mean = lambda df, name: df.groupBy("gene").agg(F.avg(F.col("value").cast("double")).alias(name))
    shared = mean(a, "va").join(mean(b, "vb"), "gene")
    return shared.agg(
        F.count("*").alias("shared_genes"), F.corr("va", "vb").alias("pearson_r")
    ).withColumn("passed", F.coalesce(F.col("pearson_r") >= min_r, F.lit(False)))
