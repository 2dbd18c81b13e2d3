"""Survival curves and tests.

Rows are ``months, event BOOLEAN`` with a group column. Everything is aggregated to one row per (group, month)
first; months may be fractions, so running sums over them go through buckets. Rows without months are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.checks import need_columns
from spotweave.functions.numeric import chi2_one_df, chi2_upper
from spotweave.functions.running import exact_quantiles, running
from spotweave.session import materialize


def split_by_expression(df: DataFrame, threshold: float | str | None = None, value: str = "value") -> DataFrame:
    """T6. Adds ``grp`` high/low. A number (0.0 included) is the cut, ``"median"`` uses the exact median,
    no threshold puts everyone in high. NULL values get no group."""
    v = F.col(value)
    if threshold is None:
        return df.withColumn("grp", F.when(v.isNotNull(), "high"))
    if threshold == "median":
        cut = exact_quantiles(df, [], value, {"m": 0.5}).scalar()
        return df.withColumn("_cut", cut).withColumn(
            "grp", F.when(v >= F.col("_cut"), "high").when(v.isNotNull(), "low")
        ).drop("_cut")
    return df.withColumn("grp", F.when(v >= float(threshold), "high").when(v.isNotNull(), "low"))


def _per_month(surv: DataFrame, group: str) -> DataFrame:
    need_columns(surv, "months", "event", group)
    return (
        surv.where(F.col("months").isNotNull() & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("grp"), F.col("months").cast("double").alias("months"))
        .agg(F.count("*").alias("leaving"), F.count_if("event").alias("events"))
    )


def kaplan_meier(surv: DataFrame, group: str = "grp") -> DataFrame:
    """T7. Per group and month: at risk, events, censored, S(t).

    S is exp of the running sum of ln(1 - d/n); from the month where everyone left at risk has an event
    it is 0, which a running flag marks because the logarithm cannot.
    """
    months = running(_per_month(surv, group), ["grp"], "months", {"at_risk": ("sum", F.col("leaving"))}, descending=True)
    d, n = F.col("events"), F.col("at_risk")
    curve = running(
        months,
        ["grp"],
        "months",
        {
            "_log_s": ("sum", F.when(d < n, F.log(1.0 - d / n)).otherwise(0.0)),
            "_gone": ("max", F.when(d == n, 1).otherwise(0)),
        },
    )
    return curve.select(
        "grp", "months", "at_risk", "events",
        (F.col("leaving") - d).alias("censored"),
        F.when(F.col("_gone") == 1, 0.0).otherwise(F.exp("_log_s")).alias("survival"),
    )


def median_survival(curve: DataFrame) -> DataFrame:
    """T8. First month with S <= 0.5 (NULL if never), sizes and events."""
    return curve.groupBy("grp").agg(
        F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("months"))).alias("median_survival_months"),
        F.max("at_risk").alias("num_samples"),
        F.sum("events").alias("num_events"),
    )


def survival_at(curve: DataFrame, months: float = 60) -> DataFrame:
    """T8. S at a month: the last step not after it, 1 before the first."""
    return curve.groupBy("grp").agg(
        F.coalesce(
            F.max_by(
                F.when(F.col("months") <= months, F.col("survival")),
                F.when(F.col("months") <= months, F.col("months")),
            ),
            F.lit(1.0),
        ).alias("survival_rate")
    )


def two_groups(surv: DataFrame, group: str = "grp", first=None, second=None) -> tuple:
    """The two labels a test compares: as named, or the only two in the data, `high` before `low`."""
    if first is not None and second is not None:
        return first, second
    labels = [r[0] for r in surv.where(F.col(group).isNotNull() & F.col("months").isNotNull()).select(group).distinct().limit(3).collect()]
    if len(labels) != 2:
        raise ValueError(f"name the two groups to compare; the column {group} holds {'more' if len(labels) > 2 else 'fewer'} than two")
    return ("high", "low") if set(labels) == {"high", "low"} else tuple(sorted(labels))


def log_rank_sums(surv: DataFrame, group: str = "grp", first=None, second=None) -> DataFrame:
    """Observed and expected events of both groups, and the hypergeometric variance."""
    first, second = two_groups(surv, group, first, second)
    months = _per_month(surv, group).where(F.col("grp").isin(first, second))
    of = lambda c, g: F.sum(F.when(F.col("grp") == g, F.col(c)).otherwise(0))
    # one row per month over both groups
    wide = months.groupBy("months").agg(
        of("leaving", first).alias("l1"), of("leaving", second).alias("l2"),
        of("events", first).alias("d1"), of("events", second).alias("d2"),
    )
    risk = running(wide, [], "months", {"n1": ("sum", F.col("l1")), "n2": ("sum", F.col("l2"))}, descending=True)
    n, d = F.col("n1") + F.col("n2"), F.col("d1") + F.col("d2")
    variance = F.when(
        n > 1, (F.col("n1") / n) * (F.col("n2") / n) * d * (n - d) / (n - 1)
    ).otherwise(0.0)
    return risk.agg(
        F.sum("d1").alias("observed1"), F.sum("d2").alias("observed2"),
        F.sum(d * F.col("n1") / n).alias("expected1"), F.sum(d * F.col("n2") / n).alias("expected2"),
        F.sum(variance).alias("variance"),
    )


def log_rank(surv: DataFrame, group: str = "grp", first=None, second=None) -> DataFrame:
    """T9. Two-group log-rank chi-square (1 df) and p."""
    gap = F.col("observed1") - F.col("expected1")
    sums = log_rank_sums(surv, group, first, second).withColumn(
        "chi_square", F.coalesce(gap * gap / F.nullif("variance", F.lit(0.0)), F.lit(0.0))
    )
    return sums.withColumn("p_value", chi2_one_df("chi_square"))


def log_rank_groups(surv: DataFrame, group: str = "grp", labels: list | None = None) -> DataFrame:
    """T9. Log-rank test of any number of groups: (groups, chi_square, degrees, p_value).

    ``labels`` names the groups to compare, by default all of the column; each is a column of the sums over months, so they
    should be few. Observed minus expected events of all groups but one are weighed by the inverse of their covariance.
    """
    months = _per_month(surv, group)
    if labels is None:
        labels = sorted((r[0] for r in months.select("grp").distinct().collect()), key=str)
    k = len(labels)
    if k < 2:
        raise ValueError("a test needs two groups at least")
    of = lambda c, g: F.sum(F.when(F.col("grp") == g, F.col(c)).otherwise(0))
    wide = months.where(F.col("grp").isin(labels)).groupBy("months").agg(
        *[of("leaving", g).alias(f"l{i}") for i, g in enumerate(labels)], *[of("events", g).alias(f"d{i}") for i, g in enumerate(labels)]
    )
    risk = running(wide, [], "months", {f"n{i}": ("sum", F.col(f"l{i}")) for i in range(k)}, descending=True)
    number = lambda c: F.col(c).cast("double")
    n, d = sum((number(f"n{i}") for i in range(k)), F.lit(0.0)), sum((number(f"d{i}") for i in range(k)), F.lit(0.0))
    spread = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    share = lambda i: number(f"n{i}") / n
    gaps = [F.sum(number(f"d{i}") - d * share(i)).alias(f"u{i}") for i in range(k - 1)]
    covariance = [
        F.sum(spread * share(i) * ((1.0 if i == j else 0.0) - share(j))).alias(f"v{i}_{j}") for i in range(k - 1) for j in range(i, k - 1)
    ]
    one = risk.agg(*gaps, *covariance)
    # elimination in columns: every step leaves one row and column fewer of the covariance beside the gaps
    matrix = {(i, j): f"v{min(i, j)}_{max(i, j)}" for i in range(k - 1) for j in range(k - 1)}
    gap = {i: f"u{i}" for i in range(k - 1)}
    one = one.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in [*gap.values(), *sorted(set(matrix.values()))]]).withColumns(
        {"chi_square": F.lit(0.0), "degrees": F.lit(0)}
    )
    scale = sum((F.abs(F.col(matrix[i, i])) for i in range(k - 1)), F.lit(0.0))
    one = one.withColumn("_least", scale * 1e-12)
    for step in range(k - 1):
        pivot = F.col(matrix[step, step])
        used = pivot > F.col("_least")  # a group that can't differ, as nobody of it is ever at risk, has no variance
        factor = {i: F.when(used, F.col(matrix[step, i]) / pivot).otherwise(0.0) for i in range(step + 1, k - 1)}
        changes = {
            "chi_square": F.col("chi_square") + F.when(used, F.col(gap[step]) * F.col(gap[step]) / pivot).otherwise(0.0),
            "degrees": F.col("degrees") + used.cast("int"),
        }
        for i in range(step + 1, k - 1):
            changes[gap[i]] = F.col(gap[i]) - factor[i] * F.col(gap[step])
            for j in range(i, k - 1):
                changes[matrix[i, j]] = F.col(matrix[i, j]) - factor[i] * F.col(matrix[step, j])
        one = one.withColumns(changes)
    p = F.when(F.col("degrees") > 0, chi2_upper("chi_square", F.greatest("degrees", F.lit(1)))).otherwise(1.0)
    return one.select(F.lit(k).alias("groups"), "chi_square", "degrees", p.alias("p_value"))


def _ratio():
    zero = F.lit(0.0)
    return (F.col("observed1") / F.nullif("expected1", zero)) / F.nullif(F.col("observed2") / F.nullif("expected2", zero), zero)


def hazard_ratio(surv: DataFrame, group: str = "grp", first=None, second=None) -> DataFrame:
    """T10. (O1/E1) / (O2/E2) with a 95 % interval exp(ln HR +- 1.96 sqrt(1/E1 + 1/E2))."""
    sums = log_rank_sums(surv, group, first, second).withColumn("hazard_ratio", _ratio())
    width = 1.96 * F.sqrt(F.try_divide(F.lit(1.0), F.col("expected1")) + F.try_divide(F.lit(1.0), F.col("expected2")))
    return sums.select(
        "hazard_ratio",
        F.exp(F.log("hazard_ratio") - width).alias("ci_low"),
        F.exp(F.log("hazard_ratio") + width).alias("ci_high"),
    )


def survival_report(surv: DataFrame, months: float = 60, group: str = "grp", first=None, second=None) -> DataFrame:
    """T6-T10 together, one row per group: median, survival at a month, sizes, and the two-group test.

    The test columns are NULL where only one group exists; of more than two, name the two to compare.
    """
    curve = materialize(kaplan_meier(surv, group), "survival-curve")
    rows = median_survival(curve).join(survival_at(curve, months), "grp")
    if first is None and curve.select("grp").distinct().limit(2).count() < 2:
        none = F.lit(None).cast("double")
        return rows.select("*", none.alias("log_rank_p_value"), none.alias("hazard_ratio"))
    tested = materialize(log_rank(surv, group, first, second).withColumn("hazard_ratio", _ratio()), "survival-test")
    test = tested.select(F.struct(F.col("p_value").alias("log_rank_p_value"), "hazard_ratio")).scalar()  # one row
    return rows.withColumn("_test", test).select(*rows.columns, "_test.*")
