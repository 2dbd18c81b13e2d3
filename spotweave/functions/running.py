"""Running totals, ranks and quantiles that never gather a whole group in one task.

A window ordered over a group sends the group to one task. Here each group is cut along its order into
buckets, a pure monotone function of the ordering value: the sign and binary exponent of the number
(coarse) and the leading bits of its mantissa (fine). Rows are windowed inside a fine bucket only; the
totals of fine buckets are windowed inside a coarse one, the totals of coarse buckets inside the group,
and both offsets are joined back. All three windows hold bounded groups, and as the bucket depends on
nothing but the row, recomputed tasks always agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import materialize

FINE_BUCKETS = 4096
_EXPONENT_SHIFT = 2000  # larger than any binary exponent of a double, keeps the coarse bucket's sign


def number_buckets(value: Column) -> tuple[Column, Column]:
    """Coarse and fine bucket of a double, both non-decreasing in the value."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * FINE_BUCKETS)
    sign = F.signum(value).cast("long")
    zero = value == 0
    return (
        F.when(zero, F.lit(0)).otherwise(sign * (exponent + _EXPONENT_SHIFT)).cast("long"),
        F.when(zero, F.lit(0)).otherwise(sign * fraction).cast("long"),
    )


def hash_buckets(value: Column) -> tuple[Column, Column]:
    """Buckets of a 64-bit hash: its leading bits."""
    return F.shiftright(value, 52).cast("long"), F.shiftright(value, 40).cast("long")


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, tuple[str, Column]],
    descending: bool = False,
    buckets=number_buckets,
    tiebreak: list[str] | None = None,
    written: bool = False,
) -> DataFrame:
    """Add, per measure ``name: (sum|min|max, expression)``, its inclusive running value along ``order``.

    Keys and order must not be NULL. Rows should be unique in ``(keys, order)`` (aggregate first) or be told
    apart by ``tiebreak``. The input is read more than once and is therefore written first, unless the
    caller says it already is.
    """
    if not written:
        df = materialize(df, "running")
    direction = F.col(order).desc() if descending else F.col(order).asc()
    flip = -1 if descending else 1
    coarse, fine = buckets(F.col(order))
    rows = df.withColumns({"_b1": coarse * flip, "_b2": fine * flip})
    for name, (_, expr) in measures.items():
        rows = rows.withColumn(f"_m_{name}", expr)
    inside = (
        Window.partitionBy(*keys, "_b1", "_b2")
        .orderBy(direction, *(tiebreak or []))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fine_totals = rows.groupBy(*keys, "_b1", "_b2").agg(
        *[_MERGE[how](f"_m_{name}").alias(f"_f_{name}") for name, (how, _) in measures.items()]
    )
    coarse_totals = fine_totals.groupBy(*keys, "_b1").agg(
        *[_MERGE[how](f"_f_{name}").alias(f"_c_{name}") for name, (how, _) in measures.items()]
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    w_coarse = before(Window.partitionBy(*keys).orderBy("_b1")) if keys else before(Window.orderBy("_b1"))
    w_fine = before(Window.partitionBy(*keys, "_b1").orderBy("_b2"))
    coarse_offsets = coarse_totals.select(
        *keys, "_b1",
        *[_MERGE[how](f"_c_{name}").over(w_coarse).alias(f"_o1_{name}") for name, (how, _) in measures.items()],
    )
    offsets = fine_totals.select(
        *keys, "_b1", "_b2",
        *[_MERGE[how](f"_f_{name}").over(w_fine).alias(f"_o2_{name}") for name, (how, _) in measures.items()],
    )
    offsets = offsets.join(coarse_offsets, [*keys, "_b1"], "left")
    rows = rows.withColumns(
        {f"_i_{name}": _MERGE[how](f"_m_{name}").over(inside) for name, (how, _) in measures.items()}
    )
    joined = rows.join(offsets, [*keys, "_b1", "_b2"], "left")
    out = {}
    for name, (how, _) in measures.items():
        parts = [F.col(f"_i_{name}"), F.col(f"_o1_{name}"), F.col(f"_o2_{name}")]
        if how == "sum":
            out[name] = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
        else:
            out[name] = (F.least if how == "min" else F.greatest)(*parts)
    return joined.select(*df.columns, *[c.alias(name) for name, c in out.items()])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``fractions``.

    Counts per distinct value, running counts, then the values that straddle the wanted position.
    """
    counts = (
        df.dropna(subset=[*keys, value])
        .where(~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    counts = materialize(counts, "value-counts")
    ranked = running(counts, keys, "_v", {"_upto": ("sum", F.col("_n"))}, written=True)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        ranked = ranked.join(totals, keys)
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    picks = []
    for name, q in fractions.items():
        position = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)
        covers = lambda p: (F.col("_upto") - F.col("_n") <= p) & (p < F.col("_upto"))
        low_value = F.max(F.when(covers(low), F.col("_v")))
        high_value = F.max(F.when(covers(high), F.col("_v")))
        share = F.max(position - low)
        picks.append((low_value + (high_value - low_value) * share).alias(name))
    return ranked.groupBy(*keys).agg(*picks)
