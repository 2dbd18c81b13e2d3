"""Data-quality predicates on columns, and parameter checks made before a plan is built (V1, V2, V4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.numeric import as_column


def valid_genome(genome_id) -> Column:
    return as_column(genome_id).isin([g[0] for g in fv.GENOMES])


def safe_identifier(value, max_length: int = fv.SAFE_LENGTH) -> Column:
    """Letters, digits and ``_ - . /`` only, not empty, not longer than ``max_length``."""
    value = as_column(value)
    return value.rlike(fv.SAFE_IDENTIFIER) & (F.length(value) <= max_length)


def one_of(name: str, value, allowed: Iterable) -> None:
    allowed = tuple(allowed)
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}; got {value!r}")


def in_range(name: str, value, low=None, high=None) -> None:
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} must lie in [{low}, {high}]; got {value!r}")


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
