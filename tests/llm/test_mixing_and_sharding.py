import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spotweave.llm.common import components, prefix_sums
from spotweave.llm.mixing import mix, mixed_rows
from spotweave.llm.sharding import shard
from spotweave.session import materialize

DOCS = "doc_id long, text string, source string, size int, _copies string"


def plain_targets(sizes):
    """Deal 150 % by weight, stop at twice a source's size, deal the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def mixed_fixture(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 4 if i % 3 else 0}", i, "x") for i in range(600)]
    rows += [(None, None, None, 1, None), (1000, "", None, 1, None), (1001, " \t\n", None, 1, None), (1002, "a b", None, 0, "y")]
    rows += [(5, "same row", "s1", 1, "z")] * 3 + [(7, None, "only nulls", 1, "")] + [(2000, "long " * 50_000, "s2", 1, "")]
    return spark.createDataFrame(rows, DOCS), rows


def test_mix_meets_targets_and_repeats_itself(spark):
    docs, rows = mixed_fixture(spark)
    out = mix(docs)
    assert out.columns[:5] == docs.columns
    got = out.toDF("doc_id", "text", "source", "own", "own2", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in ("s0", "s1", "s3"):
        assert abs(taken[s] - want[s]) <= 80
    assert sum(r.copies for r in got if r.source == "only nulls") == 0
    again = mix(docs.repartition(7)).toDF(*got[0].__fields__).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, r.copies)
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)
    emitted = mixed_rows(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)


def test_mix_of_nothing(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixed_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_prefix_sums_over_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", f"{zlib.crc32(str(i).encode()):08x}", i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o string, w long").withColumn("b", F.substring("o", 1, 1))
    total = Counter()
    want = {}
    for k, o, w in sorted(rows):
        want[k, o] = total[k]
        total[k] += w
    for r in prefix_sums(df, ["k"], ["b"], ["o"], "w", "before", "whole").collect():
        assert r.before == want[r.k, r.o] and r.whole == total[r.k]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 10 for i in range(10, 61)) and all(got[i] == 100 for i in range(100, 160))
    assert got[299] == got[300] == 299 and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_are_even_and_keep_groups(spark, hot):
    rows = [(i, f"text {i if i % 4 else i // 40}", "x") for i in range(403)] + [(1000 + i, "hot", "x") for i in range(hot)]
    rows += [(None, None, None), (None, None, None), (3000, "", ""), (3001, "", ""), (5, "text 5", "x")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, _shard string"), "shard-fixture")
    got = shard(docs, F.col("text")).toDF("doc_id", "text", "own", "shard", "slot").collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    groups = Counter((r.text, r.shard) for r in got if r.text is not None)
    per_text = Counter(t for t, _ in groups)
    largest = Counter(r.text for r in got)
    # at most a few groups are cut by the quotas; a group larger than a shard fills few
    cut = [t for t, n in per_text.items() if n > 1 and largest[t] <= len(rows) // 8]
    assert len(cut) <= 7
    if hot:
        assert per_text["hot"] <= 5


def test_shards_of_few_or_no_rows(spark):
    schema = "doc_id long, text string"
    assert shard(materialize(spark.createDataFrame([], schema), "none"), F.col("text")).count() == 0
    got = shard(materialize(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], schema), "few"), F.col("text")).collect()
    assert len({r["_shard"] for r in got}) == 3 and all(r["_slot"] == 0 for r in got)
