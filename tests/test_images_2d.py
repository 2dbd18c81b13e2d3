import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotweave.functions import graph
from spotweave.functions.graph import connected
from spotweave.operators import cells as K
from spotweave.operators import imaging as I

PIXELS = "image_id string, x int, y int, intensity double"


def images(seed=1):
    rng = np.random.default_rng(seed)
    spiral = np.zeros((21, 21))
    x, y, dx, dy, left = 0, 0, 1, 0, 20
    spiral[0, :] = spiral[:, 20] = spiral[20, :] = spiral[2:, 0] = spiral[2, :19] = spiral[2:19, 18] = 1  # one long winding object
    return {"noise": rng.random((30, 40)), "spiral": spiral, "blank": np.zeros((3, 3)), "full": np.ones((9, 9)), "line": np.ones((1, 50))}


def frame(spark, grids):
    rows = [(k, int(x), int(y), float(g[y, x])) for k, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows + [("noise", 500, 500, None)], PIXELS)


def plain_objects(grid, threshold):
    left = {(x, y) for y in range(grid.shape[0]) for x in range(grid.shape[1]) if grid[y, x] >= threshold}
    every, out = set(left), []
    while left:
        found, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            found.add((x, y))
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
        xs, ys = [x for x, _ in found], [y for _, y in found]
        rim = sum(p not in every for x, y in found for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)))
        out.append((len(found), np.mean(xs), np.mean(ys), min(xs), min(ys), max(xs), max(ys), rim))
    return out


@pytest.mark.parametrize("tile", [5, 512])
def test_objects_across_tiles(spark, tile):
    grids = images()
    got = I.image_objects(frame(spark, grids), 0.55, tile=tile).collect()
    for name, grid in grids.items():
        mine = sorted((r.area, round(r.centroid_x, 6), round(r.centroid_y, 6), r.x1, r.y1, r.x2, r.y2, r.perimeter) for r in got if r.image_id == name)
        want = sorted((a, round(float(x), 6), round(float(y), 6), *box) for a, x, y, *box in plain_objects(grid, 0.55))
        assert mine == want
    names = [(r.image_id, r.object_x, r.object_y) for r in got]
    assert len(set(names)) == len(names)


def test_texture_in_four_directions(spark):
    grids = images(2)
    got = {(r.image_id, r.direction): r for r in I.texture_2d(frame(spark, grids), 0, 1, levels=5).collect()}
    for name, grid in grids.items():
        g = np.clip(np.floor(grid * 5), 0, 4).astype(int)
        for direction, (dx, dy) in I.DIRECTIONS.items():
            c = np.zeros((5, 5))
            for y in range(g.shape[0]):
                for x in range(g.shape[1]):
                    if 0 <= y + dy < g.shape[0] and 0 <= x + dx < g.shape[1]:
                        c[g[y, x], g[y + dy, x + dx]] += 1
                        c[g[y + dy, x + dx], g[y, x]] += 1
            if c.sum() == 0:
                assert (name, direction) not in got
                continue
            p, (i, j) = c / c.sum(), np.indices((5, 5))
            row, m = got[name, direction], (p * i).sum()
            assert row.pairs == c.sum() / 2 and row.contrast == pytest.approx((p * (i - j) ** 2).sum())
            assert row.energy == pytest.approx((p**2).sum()) and row.homogeneity == pytest.approx((p / (1 + abs(i - j))).sum())
            spread = (p * (i - m) ** 2).sum()
            assert row.correlation == (pytest.approx((p * (i - m) * (j - m)).sum() / spread) if spread > 1e-12 else None)
    with pytest.raises(ValueError):
        I.texture_2d(frame(spark, grids), 0, 1, directions=("30",))


def test_summary_of_whole_images(spark):
    grids = images(3)
    got = {r.image_id: r for r in I.image_summary(frame(spark, grids)).collect()}
    n = got["noise"]
    assert (n.pixels, n.width, n.height) == (1200, 40, 30) and n["mean"] == pytest.approx(grids["noise"].mean())
    assert n["std"] == pytest.approx(grids["noise"].std(ddof=1)) and got["full"]["std"] == 0.0


def test_connected(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(0, 30)] + [("hub", f"s{i}") for i in range(200)] + [("x", "x"), (None, "y")]
    rng.shuffle(edges)
    got = {r.id: r.root for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03d}"] for i in range(31)} == {"c000"} and {got[f"s{i}"] for i in range(200)} == {"hub"} and got["x"] == "x" and "y" not in got
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_sequences_in_bounded_rows(spark):
    rng = random.Random(2)
    texts = {"a": "".join(rng.choice("ACGT") for _ in range(5000)), "b": "é" * 300, "c": "ACGTA", "d": "", "e": None, "f": "ACGTAC", "g": "N" * 256, "h": "A" * 257}
    seqs = spark.createDataFrame(list(texts.items()), "seq_id string, sequence string")
    for k in (1, 6, 300):
        got = {(r.seq_id, r.kmer): r.n for r in K.kmer_counts(seqs, k).collect()}
        want = {}
        for name, text in texts.items():
            for i in range(len(text or "") - k + 1):
                want[name, text[i : i + k]] = want.get((name, text[i : i + k]), 0) + 1
        assert got == want
    ten = spark.createDataFrame([("big", "ACGTTGCA" * 1_250_000)], "seq_id string, sequence string")  # 10 MB
    assert {r.kmer: r.n for r in K.kmer_counts(ten, 6).collect()}["ACGTTG"] == 1_250_000
    assert K.embed_sequences(seqs, 16, 6).select(F.size("embedding").alias("n")).distinct().collect()[0].n == 16


def test_whole_sequences_are_counted_in_place(spark, monkeypatch):
    """Only sequences of several rows, or very long ones, are cut and summed by shuffles."""
    cut = []
    plain = K._kmers
    monkeypatch.setattr(K, "_kmers", lambda rows, k: cut.append(rows) or plain(rows, k))
    monkeypatch.setattr(K, "WHOLE", 400)
    texts = [(1, "ACGT" * 50), (2, "AACC"), (2, "AACCA"), (3, "\U0001f600CGT" * 60), (4, "ACG" * 200), (5, None), (None, "ACGTT"), (6, "")]
    seqs = spark.createDataFrame(texts, "seq_id long, sequence string")
    want = {}
    for name, text in texts:
        for i in range(len(text or "") - 3):
            want[name, text[i : i + 4]] = want.get((name, text[i : i + 4]), 0) + 1
    assert {(r.seq_id, r.kmer): r.n for r in K.kmer_counts(seqs, 4).collect()} == want
    vectors = {r.seq_id: r.embedding for r in K.embed_sequences(seqs, 8, 4).collect()}
    for name in {t[0] for t in texts} - {None}:
        place = lambda kmer: int(hashlib.md5(kmer.encode()).hexdigest()[:8], 16) % 8
        assert vectors[name] == [sum(n for (i, kmer), n in want.items() if i == name and place(kmer) == p) for p in range(8)]
    assert len(vectors) == 7 and len(cut) == 2
    for rows in cut:
        assert {r.seq_id for r in rows.collect()} == {2, 4, None}


def test_labels_of_objects_are_not_broadcast(spark, monkeypatch, capsys):
    written = graph.materialize

    def explained(df, label):
        df.explain()
        return written(df, label)

    monkeypatch.setattr(graph, "materialize", explained)
    monkeypatch.setattr(I, "materialize", explained)
    grids = {0: np.ones((5, 7)), 1: np.eye(6), 2: np.array([[1.0, 0.0, 1.0], [1.0, 1.0, 1.0]])}
    objects = I.image_objects(frame(spark, grids), 0.5, tile=2)
    objects.explain()
    plans = capsys.readouterr().out
    assert plans.count("SortMergeJoin") > 5 and "Broadcast" not in plans
    assert sorted((r.area, r.perimeter) for r in objects.collect()) == [(1, 4)] * 6 + [(5, 12), (35, 24)]


def test_small_tiles_are_labelled_together(spark, monkeypatch, capsys):
    """Tiles aren't handed to Python one by one, and only pixels at their borders are joined."""
    explained = []
    written = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, label: explained.append((label, df.explain())) or written(df, label))
    rows = [(i, x - 2, y - 4, 1.0) for i in range(300) for x in range(6) for y in range(6) if (x * y + i) % 3]
    objects = I.image_objects(spark.createDataFrame(rows, "image_id long, x int, y int, intensity double"), 0.5, tile=2)
    plans = capsys.readouterr().out
    assert [label for label, _ in explained] == ["tile-labels", "touching-labels", "block-labels"]
    assert "InPandas" not in plans and "MapInArrow" in plans
    got = sorted((r.image_id, r.area, r.x1, r.y1, r.x2, r.y2, r.perimeter) for r in objects.collect())
    want = []
    for i in range(300):
        grid = np.zeros((6, 6))
        for k, x, y, v in rows:
            if k == i:
                grid[y + 4, x + 2] = v
        want += [(i, a, x1 - 2, y1 - 4, x2 - 2, y2 - 4, rim) for a, _, _, x1, y1, x2, y2, rim in plain_objects(grid, 0.5)]
    assert got == sorted(want)


@pytest.mark.parametrize("sides", [1, 100])
def test_objects_across_blocks_of_tiles(spark, monkeypatch, sides):
    monkeypatch.setattr(I, "SIDES_OF_A_BLOCK", sides)  # blocks of one tile, and of three by three
    grids = images(4)
    got = I.image_objects(frame(spark, grids), 0.55, tile=5).collect()
    for name, grid in grids.items():
        mine = sorted((r.area, r.x1, r.y1, r.x2, r.y2, r.perimeter) for r in got if r.image_id == name)
        assert mine == sorted((a, *box) for a, _, _, *box in plain_objects(grid, 0.55))
    spiral = [r for r in got if r.image_id == "spiral"]
    assert len(spiral) == 1 and (spiral[0].object_x, spiral[0].object_y) == (0, 0)


def test_rows_of_one_place_and_rows_without_an_image(spark):
    """A place that comes twice counts twice, each of its sides once per pair of rows; pixels without an image share no sides."""
    rows = [(1, 0, 0, 1.0), (1, 1, 0, 1.0), (1, 2, 0, 1.0), (1, 5, 5, 1.0)] * 2 + [(None, 0, 0, 1.0), (None, 0, 1, 1.0), (None, 0, 2, 1.0)]
    got = I.image_objects(spark.createDataFrame(rows, "image_id long, x int, y int, intensity double"), 0.5, tile=2).collect()
    mine = sorted((r.image_id or 0, r.area, r.centroid_x, r.x1, r.x2, r.perimeter) for r in got)
    assert mine == [(0, 1, 0.0, 0, 0, 4), (0, 2, 0.0, 0, 0, 8), (1, 2, 5.0, 5, 5, 8), (1, 6, 1.0, 0, 2, 8)]


def test_groups_of_rows_stay_whole():
    key = [None] * 3 + [4] * 5 + [5] + [7] * 2
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(key[i : i + 2], pa.int64()), "n": list(range(i, min(i + 2, 11)))}) for i in range(0, 11, 2)]
    tables = list(I._whole_groups(batches, ["k"], 3))
    assert sum((t.column("n").to_pylist() for t in tables), []) == list(range(11))
    ends = [set(t.column("k").to_pylist()) for t in tables]
    assert all(not (a & b) for i, a in enumerate(ends) for b in ends[i + 1 :]) and len(tables) > 1
