import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm.hard_negatives import _Block, columnar_blocks, hard_negatives, taking_part
from spotweave.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, label int, anchor_id string, rank int"


def plain(rows, anchors_every=50, moved=False, positives=5, negatives=3, low=50, high=95, scale=256):
    """All scores, by plain loops over integers."""
    by_id = defaultdict(list)
    lengths = [len(v) for _, v, lab in rows if v and lab is not None]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    for vec_id, v, lab in rows:
        if vec_id is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v) or len(v) != usual:
            continue
        lab = (lab + 1) % 10 if moved and vec_id % 7 == 0 else lab
        by_id[vec_id].append(([math.floor(scale * float(np.float32(x))) for x in v], lab))
    known = {i: min(found) for i, found in by_id.items()}
    out = []
    for a, (v, lab) in known.items():
        if a % anchors_every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), b, other) for b, (w, other) in known.items() if b != a]
        best = sorted((s, b) for s, b, other in scores if other == lab)[:positives]
        for s, b in best:
            window = sorted((t, c) for t, c, other in scores if other != lab and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, b, place, c, -s, -t) for place, (t, c) in enumerate(window, 1)]
    return sorted(out)


def clustered(n, d=12, hot=0.34, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d))
    out = []
    for i in range(n):
        lab = 3 if rng.random() < hot else int(rng.integers(10))
        v = centres[lab] + rng.normal(size=d) * rng.choice([0.05, 0.8])
        out.append((i, [float(np.float32(x)) for x in v], lab))
    return out


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [
        (5000, None, 1), (5050, [1.0] * 12, None), (None, [1.0] * 12, 1), (5100, [nan] * 12, 1), (5150, [inf] + [0.0] * 11, 1),
        (5200, [1.0] * 11 + [None], 1), (5250, [], 1), (5300, [1.0] * 3, 1), (5350, [0.0] * 12, 1), (5400, [-0.001] * 12, 2),
        (5450, [2.0] * 12, 4), (5450, [2.0] * 12, 5), (5450, [1.5] * 12, 6),  # one id, three rows: the least takes part
        (5500, [1.0] * 12, 7), (5500, [1.0] * 12, 7), (5501, [1.0] * 12, 7), (5502, [1.0] * 12, 7),
        (5503, [0.9] * 12, 8), (5504, [0.9] * 12, 9), (5505, [0.9] * 12, 8), (5506, [0.9] * 12, 8), (5507, [0.6] * 12, 8),  # ties
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], ROWS)


def answer(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def ask(spark, rows, every=50, **options):
    return answer(hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, F.col("vec_id"), F.col("embedding"), F.col("label"), **options))


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "anchor_group": 3}])
def test_against_all_scores(spark, sizes):
    rows = clustered(900) + odd_rows()
    want = plain(rows)
    assert len(want) > 100 and ask(spark, rows, **sizes) == want


def test_query_moves_labels(spark, tmp_path):
    rows = clustered(600, seed=4) + odd_rows()
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert answer(out) == plain(rows, moved=True)


def test_other_windows_and_huge_components(spark):
    rows = clustered(300, seed=9) + [(20_000, [1e30] * 12, 3), (20_001, [-1e30] + [0.0] * 11, 4)]
    small = [r for r in rows if r[0] < 20_000]
    assert ask(spark, rows, every=10, positives=2, negatives=7, least_percent=0, most_percent=100, block=64) == plain(
        small, anchors_every=10, positives=2, negatives=7, low=0, high=100
    )


def test_empty_tables_and_lonely_labels(spark):
    assert ask(spark, []) == []
    assert ask(spark, clustered(40)[1:]) == []  # no anchor
    assert ask(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]) == []  # no positive
    assert ask(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]) == []  # no other label
    assert ask(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.7], 2)]) == []  # a negative score opens no window


def test_blocks_are_columns_and_scans_are_exact(spark):
    rows = clustered(500, seed=7)
    vectors = taking_part(frame(spark, rows), F.col("vec_id"), F.col("embedding"), F.col("label"), 256)
    blocks = [r.asDict() for r in columnar_blocks(vectors, 64).collect()]
    assert sum(len(b["vec_ids"]) // 8 for b in blocks) == 500 and all(b["width"] == 2 and len(b["vec_ids"]) <= 64 * 8 for b in blocks)
    known = {r.vec_id: np.array(r.vector) for r in vectors.collect()}
    anchor, read = known[50], 0
    for row in blocks:
        block = _Block(row)
        scores = {int(i): int(known[i] @ anchor) for i in block.ids}
        for floor, ceiling in ((-(10**9), None), (100_000, None), (0, 90_000), (10**9, None)):
            ids, got = block.scan(anchor, floor, ceiling)
            assert dict(zip(ids.tolist(), got.tolist())) == {i: s for i, s in scores.items() if s >= floor and (ceiling is None or s <= ceiling)}
        block = _Block(row)
        block.scan(anchor, 300_000, None)
        read += len(block.columns)
    assert read < 12 * len(blocks)  # bounds spare some columns
