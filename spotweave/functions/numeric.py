"""Distribution functions as plain column expressions, so that p-values stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Lanczos approximation of ln(gamma), g = 7, nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def clean_double(col) -> Column:
    """Double value with NaN turned into NULL (a Spark NaN compares as larger than everything)."""
    value = as_column(col).cast("double")
    return F.when(~F.isnan(value), value)


def let(value, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once per row, however often the body names it.

    Long formulas would otherwise repeat their argument's whole expression at every mention, which makes
    generated code explode. The row-level rate is lower than generated code, so this is for per-gene rows.
    """
    return F.element_at(F.transform(F.array(as_column(value)), body), 1)


def erfc(x) -> Column:
    """Complementary error function: the series of erf near 0, the continued fraction beyond; good to 1e-14."""

    def series(v: Column) -> Column:
        step = lambda acc, n: let(
            acc["term"] * 2.0 * v * v / (2.0 * n + 1.0), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))
        )
        total = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(v.alias("term"), v.alias("sum")), step, lambda acc: acc["sum"])
        return 1.0 - F.lit(float(2 / np.sqrt(np.pi))) * F.exp(-v * v) * total

    def fraction(v: Column) -> Column:
        below = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), v, lambda acc, n: v + n / 2.0 / acc)
        return F.exp(-v * v) / F.lit(float(np.sqrt(np.pi))) / below

    def body(v: Column) -> Column:
        size = F.abs(v)
        tail = let(size, lambda a: F.when(a < 2.5, series(a)).otherwise(fraction(a)))
        return let(tail, lambda q: F.when(v >= 0, q).otherwise(2.0 - q))

    return let(as_column(x).cast("double"), body)


def normal_two_sided(z) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return erfc(F.abs(as_column(z)) / float(np.sqrt(2.0)))


def chi2_one_df(x) -> Column:
    return erfc(F.sqrt(as_column(x) / 2.0))


def chi2_upper(x, df) -> Column:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom.

    Closed sums: even df is a Poisson tail; odd df starts from erfc and adds half-integer terms.
    """
    return let(as_column(x).cast("double") / 2.0, lambda h: let(as_column(df).cast("int"), lambda d: _chi2_tail(h, d)))


def _chi2_tail(h: Column, df: Column) -> Column:
    # even df: sum of exp(-h) h^a / gamma(a+1) for a = 0 .. df/2-1; odd: erfc plus the same for a = 1/2, 3/2, ...
    # each term by its logarithm, so none is lost where exp(-h) is too small for a double
    even = df % 2 == 0
    steps = F.floor(df / 2).cast("int")
    shift = F.when(even, F.lit(-1.0)).otherwise(F.lit(-0.5))
    log_h = F.log(F.greatest(h, F.lit(1e-300)))
    term = lambda i: let(i.cast("double") + shift, lambda a: F.exp(a * log_h - h - log_gamma(a + 1.0)))
    first = F.when(even, F.lit(0.0)).otherwise(erfc(F.sqrt(h)))
    terms = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, first, lambda acc, i: acc + term(i))
    return F.when(df >= 1, F.when(h <= 0, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0))))


def log_gamma(x) -> Column:
    """ln(gamma(x)) for x >= 0.5 (counts plus one in all uses here)."""

    def body(v: Column) -> Column:
        total = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], start=1):
            total = total + F.lit(c) / (v + float(i))
        return F.lit(0.5 * float(np.log(2 * np.pi))) + (v + 0.5) * F.log(v + 7.5) - (v + 7.5) + F.log(total)

    return let(as_column(x).cast("double") - 1.0, body)


def log_choose(n, k) -> Column:
    n, k = as_column(n).cast("double"), as_column(k).cast("double")
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def hypergeometric_upper(k, marked, drawn, total) -> Column:
    """P(X >= k) with ``marked`` of ``total`` items special and ``drawn`` taken: one-sided Fisher.

    The first term comes from log-gamma, each next one from the ratio of neighbours, all in one row.
    """
    counts = F.struct(
        *[as_column(c).cast("double").alias(n) for n, c in zip("kmdt", (k, marked, drawn, total))]
    )
    return let(counts, lambda c: _hypergeometric_tail(c["k"], c["m"], c["d"], c["t"]))


def _hypergeometric_tail(k: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """The tail on the far side of the mode is summed from its largest term; the near one is its complement."""
    least, most = F.greatest(F.lit(0.0), drawn + marked - total), F.least(marked, drawn)
    mode = F.floor((marked + 1.0) * (drawn + 1.0) / (total + 2.0))
    at = lambda x: F.exp(log_choose(marked, x) + log_choose(total - marked, drawn - x) - log_choose(total, drawn))
    whole = lambda a, b: F.when(a <= b, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))

    def summed(start: Column, steps: Column, ratio) -> Column:
        def step(acc, i):
            return let(acc["term"] * ratio(i.cast("double")), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))

        return F.aggregate(steps, let(at(start), lambda f: F.struct(f.alias("term"), f.alias("sum"))), step, lambda acc: acc["sum"])

    up = lambda i: (marked - i) * (drawn - i) / ((i + 1.0) * (total - marked - drawn + i + 1.0))  # from i to i + 1
    upper = summed(k, whole(k, most - 1.0), up)
    # downwards from k - 1, the steps taken as distances
    down = lambda n: let(k - n, lambda i: i * (total - marked - drawn + i) / ((marked - i + 1.0) * (drawn - i + 1.0)))
    lower = summed(k - 1.0, whole(F.lit(1.0), k - 1.0 - least), down)
    tail = F.when(k > mode, upper).otherwise(1.0 - lower)
    return F.when(k <= least, F.lit(1.0)).when(k > most, F.lit(0.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def _incomplete_beta(a, b, x):
    """Regularised incomplete beta by the usual continued fraction, on whole arrays."""
    from math import lgamma

    lg = np.vectorize(lgamma, otypes=[float])
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tiny = 1e-300
    front = np.exp(
        lg(aa + bb) - lg(aa) - lg(bb)
        + aa * np.log(np.maximum(xx, tiny)) + bb * np.log(np.maximum(1.0 - xx, tiny))
    ) / aa
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(xx)
    d = 1.0 / guard(1.0 - (aa + bb) * xx / (aa + 1.0))
    h = d.copy()
    for m in range(1, 300):
        even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    value = np.where(xx <= 0.0, 0.0, front * h)
    return np.where(swap, 1.0 - value, value)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t. The one Arrow UDF of the statistics; runs on per-gene rows only."""
    tv, dv = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(tv) & np.isfinite(dv) & (dv > 0)
    out = np.full(len(tv), np.nan)
    if ok.any():
        d = dv[ok]
        out[ok] = _incomplete_beta(d / 2.0, np.full(d.shape, 0.5), d / (d + tv[ok] ** 2))
    return pd.Series(out).where(ok, None)
