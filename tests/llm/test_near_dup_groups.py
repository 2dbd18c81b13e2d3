"""Near duplicates inside and beside large groups, against brute force."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from spotweave.llm import common, near_dup
from tests.llm.test_similarity import plain_near_duplicates

_RNG = random.Random(5)


def words(n):
    return [f"w{_RNG.randrange(10**9)}" for _ in range(n)]


def wrong_rows(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return len(set(map(tuple, got)) ^ set(plain_near_duplicates(rows))) // 2


def test_template_just_under_the_law(spark):
    """130 texts that are 0.70 to 0.744 alike, not linked, and copies of 30 of them, each linked with its own only."""
    template = words(300)
    texts = [template + words(_RNG.randint(51, 63)) for _ in range(130)]
    texts += [t[:-3] + words(3) for t in texts[:30]]
    assert wrong_rows(spark, texts) == 0


def test_small_groups_in_the_nodes_of_large_ones(spark):
    """Pairs, 0.75 alike, that share most of their text with a large group of copies (0.73 alike) but do not link with it."""
    texts = []
    for _ in range(1):
        base = words(304)
        texts += [base + words(2) for _ in range(60)]
        for _ in range(14):
            own = base[: 300 - 42] + words(48)
            texts += [own, own[: len(own) - 43] + words(43)]
    assert wrong_rows(spark, texts) == 0


def test_rim_of_a_large_group(spark):
    """Texts that link with one of many near copies (0.754) and with no other of them (0.736)."""
    base = words(300)
    group = [base + words(4) for _ in range(80)]
    assert wrong_rows(spark, group + [x + words(98) for x in group[:60]]) == 0


def test_least_plausible_estimate():
    """Of sets exactly 0.75 alike fewer than 1 in 100,000 are estimated below PLAUSIBLE."""
    n, least = near_dup.COORDINATES, math.ceil(near_dup.PLAUSIBLE * near_dup.COORDINATES)
    assert sum(math.comb(n, x) * 0.75**x * 0.25 ** (n - x) for x in range(least)) < 1e-5


def test_filter_loses_nothing_and_needs_no_python_worker(spark):
    rows = near_dup.materialize(spark.range(50_000).selectExpr("if(id = 0, null, id) as doc_id"), "rows")
    for step in (1, 100, 60_000):
        wanted = near_dup.materialize(rows.where(f"doc_id % {step} = 7 or {step} = 1"), "wanted")
        kept = near_dup._maybe_in(rows, wanted)
        assert "Python" not in kept._jdf.queryExecution().toString() and kept.columns == ["doc_id"]
        assert kept.join(wanted, "doc_id", "left_semi").count() == wanted.where("doc_id is not null").count()
        assert kept.count() <= wanted.count() + 500
    assert near_dup._maybe_in(rows, wanted.limit(0)).count() == 0


def test_whole_sets_are_one_table_however_often_they_are_asked_for(spark):
    rows = near_dup.materialize(spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "A B C"), (4, "a b")], "doc_id long, text string"), "rows")
    described = rows.mapInArrow(near_dup._describe, "doc_id long, n_shingles long, set_key string, signature array<int>")
    sets = described.groupBy("set_key").agg(F.min("doc_id").alias("first_doc")).withColumn("set_id", F.col("first_doc") * 10)
    whole = near_dup._WholeSets(rows, near_dup.materialize(sets, "sets"))
    for asked in ([10], [10, 20], [20, 30, 99]):
        whole.fetch(spark.createDataFrame([(x,) for x in asked], "set_id long"))
    assert sorted(r.set_id for r in whole.held.collect()) == [10, 20, 30]
    assert whole.held._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    pairs = spark.createDataFrame([(10, 20), (10, 10)], "a long, b long")
    assert [tuple(r) for r in whole.confirm(pairs, "links").collect()] == [(10, 10)]


def test_components_joined_inside_tasks(spark):
    """Chains, a hub and random edges, in many tasks and in a few jobs when all edges are in one."""
    chain = [(i, i + 1) for i in range(0, 400)] + [(1000, i) for i in range(1001, 1200)]
    loose = [(_RNG.randrange(2000, 2400), _RNG.randrange(2000, 2400)) for _ in range(150)]
    edges = chain + loose + [(5, 5), (7777, 7777), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in chain + loose:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    ids = {x for a, b in chain + loose if a != b for x in (a, b)}
    for tasks in (1, 7):
        frame = spark.createDataFrame(edges, "a long, b long").repartition(tasks)
        got = common.components(frame, inside_tasks=True).collect()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in ids)


def test_settled_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "materialize", lambda df, label: written.append(label) or near_dup.materialize(df, label))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 50)], "a long, b long")
    assert common.components(stars).count() == 50 and len(written) == 1


def test_batches_of_edges_beyond_the_limit(monkeypatch):
    monkeypatch.setattr(common, "EDGES_AT_ONCE", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([5, 4]), pa.array([4, 1])], names=["a", "b"])
    got = [tuple(zip(*b.to_pydict().values())) for b in common._stars_of_tasks(iter([batch] * 3))]
    assert got == [((4, 1), (5, 1)), ((4, 1), (5, 1))]
