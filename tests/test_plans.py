"""Registered queries: contract, twins on the smallest tables, and the shape of physical plans."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from spotweave.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
TWINS = [
    "validate_reads", "umi_duplication_rate", "qc_summary", "grid_regions", "roi_regions", "merge_tiles_first", "normalize_tpm",
    "knn_weights", "de_wilcoxon", "de_ttest_p", "adjust_bh_per_family", "combat", "enrich_fisher", "compare_z", "kaplan_meier",
    "overlap_genes", "fit_registration", "cells_in_boundary", "pair_calls", "sessions",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 120


@needs_data
def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 5 and sum(r.spots_after for r in rows) == 81


@needs_data
@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(db.execute(f"select {', '.join(columns)} from ({driver.oracle_sql()[name]}) q").fetchall(), key=repr)
    assert got == want


@needs_data
@pytest.mark.parametrize("name", ["roi_regions", "overlap_genes", "cells_in_boundary", "grid_regions", "log_rank", "qc_report", "match_barcodes"])
def test_no_nested_loops(spark, name):
    text = plan(driver.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(driver.queries()["split_by_region"](spark, SF))
    assert "PushedFilters: [In(c_mktsegment, [HOUSEHOLD,MACHINERY])" in text
    text = plan(driver.queries()["spot_metrics"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
