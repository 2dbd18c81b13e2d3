"""The operators bound to the star-schema test tables, with a DuckDB twin for each."""

from __future__ import annotations


def all_queries():
    """Every registered query by name."""
    from spotweave.plans import analysis_queries, clinical_queries, image_queries, read_queries  # noqa: F401
    from spotweave.plans import source_queries, spot_queries, telemetry_queries  # noqa: F401
    from spotweave.plans.registry import QUERIES

    return dict(QUERIES)
