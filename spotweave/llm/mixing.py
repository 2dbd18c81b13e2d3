"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. A document of the source is expected ``target / source_size``
times; these expectations are summed along the source, one random offset is added, and the document is
emitted once for every whole number its stretch of the sum crosses. The order along a source is by size,
then by a hash, so that every short stretch holds documents of like size and the words taken follow the
target closely. The prefix sum is bucketed: a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.common import hash_order, hash_share, n_words, nullable_key, prefix_sums

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_source, source_size, target) per source of rows with ``_source`` and ``size``.

    The words to deal out are ``share`` of all; they go by weight, a source stops at ``most`` times its
    own size and the rest is dealt again. In the order of size per weight the sources that stop come first,
    so the level at which the dealing ends follows from two running sums. One row per source is windowed.
    """
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy("_source")
    weighted = totals.withColumn(
        "_weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    along = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        weighted.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(along), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(along), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
        .withColumn("_final", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(whole))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_weight") * F.col("_final"), F.col("_cap")))
    return leveled.select("_source", "source_size", target.alias("target"))


def _dealt(docs: DataFrame, text, source, doc_id, size, weights, share, most, seed) -> DataFrame:
    """(row, size, source_size, target, copies), the row as a struct so that no name of its columns matters."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        (n_words(F.col(text)) if size is None else size).cast("long").alias("size"),
        nullable_key(F.col(source)).alias("_source"),
        hash_order(F.lit(seed), doc_id).alias("_order"),
    ).withColumn("_bucket", F.substring("_order", 1, 3))
    targets = source_targets(rows.select("_source", "size"), weights, share, most)
    placed = prefix_sums(rows, ["_source"], ["size", "_bucket"], ["_order"], out="_before")
    placed = placed.join(F.broadcast(targets), "_source")  # one row per source
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = hash_share(F.lit(seed), F.lit("offset"), "_source")
    crossed = lambda rank: F.floor(rate * rank + start)
    copies = (crossed(F.col("_before") + 1) - crossed(F.col("_before"))).cast("long")
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    size: Column | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
) -> DataFrame:
    """All columns of ``docs``, then ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    ``size`` replaces the word count of ``text`` where the caller has it. Null and empty texts have size 0
    and are dealt copies like any document, which cost no words; a null source is a source of its own,
    the last; a source without words has target 0 and no copies; rows that repeat are separate documents; an
    empty table gives an empty table.
    """
    out = _dealt(docs, text, source, doc_id, size, weights, share, most, seed)
    return out.select(
        "row.*",
        F.col("size").alias("_size"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.col("copies").alias("_copies"),
    )


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as the mix takes it, columns unchanged."""
    dealt = _dealt(docs, text, source, doc_id, None, WEIGHTS, SHARE, MOST, seed).where("copies > 0")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
