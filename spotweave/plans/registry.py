"""Registered queries: an operator bound to the test tables, with typed output columns and a DuckDB twin.

``columns`` is written ``name:type`` with i (bigint), s (string), b (boolean), dN (double rounded to N
places), t (timestamp as epoch microseconds), l (array as comma-joined text). Both sides are cast to the same
types, so a comparison sees values only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.plans.bindings import bind, duck_sql


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


class Frames:
    """Bindings by attribute: ``t.reads`` is the bound frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bind(self.spark, self.sf_dir, name)


def _spark_cast(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("d"):
        return (F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)
    return {
        "i": c.cast("bigint"), "s": c.cast("string"), "b": c.cast("boolean"),
        "t": F.unix_micros(c.cast("timestamp")) if kind == "t" else c,
        "l": F.concat_ws(",", F.transform(c, lambda e: e.cast("string"))) if kind == "l" else c,
    }[kind].alias(name)


def _duck_cast(name: str, kind: str) -> str:
    if kind.startswith("d"):
        return f"round(cast({name} as double), {kind[1:]}) + 0.0 as {name}"
    return {
        "i": f"cast({name} as bigint)", "s": f"cast({name} as varchar)", "b": f"cast({name} as boolean)",
        "t": f"epoch_us({name})", "l": f"coalesce(array_to_string({name}, ','), '')",
    }[kind] + f" as {name}"


def query(name: str, columns: str, oracle: str | None = None):
    """Register ``fn(t: Frames) -> DataFrame`` under a name."""
    typed = [c.split(":") for c in columns.split()]

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Frames(spark, sf_dir)).select(*[_spark_cast(n, k) for n, k in typed])

        text = None
        if oracle is not None:
            text = f"select {', '.join(_duck_cast(n, k) for n, k in typed)} from ({duck_sql(oracle)}) result"
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, text)
        return fn

    return register


def erfc_sql(x: str, steps: int = 600) -> str:
    """The complementary error function as DuckDB text: one minus Simpson's rule over the density."""
    h = f"(least(abs({x}), 7.0) / {steps})"
    weight = f"(case when i = 0 or i = {steps} then 1.0 when i % 2 = 1 then 4.0 else 2.0 end)"
    area = f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * exp(-({h} * i) * ({h} * i)))) * {h} / 3.0)"
    tail = f"(1.0 - 2.0 / sqrt(pi()) * {area})"
    return f"(case when ({x}) >= 0 then greatest({tail}, 0.0) else 2.0 - {tail} end)"


def normal_p_sql(z: str) -> str:
    return erfc_sql(f"abs({z})/sqrt(2.0::double)")


def t_p_sql(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided p of Student's t as DuckDB text: Simpson's rule over the density from 0 to |t|."""
    h = f"(abs({t}) / {steps})"
    weight = f"(case when i = 0 or i = {steps} then 1.0 when i % 2 = 1 then 4.0 else 2.0 end)"
    area = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * "
        f"pow(1.0 + ({h} * i) * ({h} * i) / ({df}), -(({df}) + 1.0) / 2.0))) * {h} / 3.0"
    )
    scale = f"exp(lgamma((({df}) + 1.0) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi() * ({df}))"
    return f"(1.0 - 2.0 * ({scale}) * ({area}))"
