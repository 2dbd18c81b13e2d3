import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import near_dup, nn_descent, projected_search

DOCS = "doc_id long, text string, node long, set_key string"


def plain_near_duplicates(rows):
    """Components over all pairs of distinct sets, through an inverted index."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        shingles = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        sets.append((doc_id, frozenset(shingles)))
    holders = defaultdict(list)
    for doc_id, s in sets:
        holders[s].append(doc_id)
    distinct = [s for s in holders if s]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for k, s in enumerate(distinct):
        shared = Counter(m for g in s for m in inverted[g])
        for m, x in shared.items():
            if 100 * x >= 75 * (len(s) + len(distinct[m]) - x):
                root[find(k)] = find(m)
        for g in s:
            inverted[g].append(k)
    least = defaultdict(list)
    for k, s in enumerate(distinct):
        least[find(k)] += [i for i in holders[s] if i is not None]
    place = {s: k for k, s in enumerate(distinct)}
    out = []
    for doc_id, s in sets:
        c = min(least[find(place[s])], default=None) if s else doc_id
        out.append((doc_id, len(s), c, doc_id == c))
    return out


def document_rows():
    rng = random.Random(1)
    rows = [(None, None), (None, "a b"), (3, "a  B"), (4, " "), (5, ""), (6, "x"), (7, "a b c d e f g"), (7, "a b c d e f g")]
    rows += [(8, "A b C d E f g h"), (9, "a b c d e"), (10, "\u00c4 b c d e"), (11, "\u00e4 b c d e"), (12, "w " * 30_000), (13, "w " * 5)]
    vocabulary = [f"{c}{i}" for c in "abcdefghij" for i in range(90)]
    base, passage = [rng.choice(vocabulary) for _ in range(300)], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(220):  # one large group of near copies, some of them linked through others only
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(150):  # a passage that many share, and nothing else
        rows.append((1000 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(120)])))
    for i in range(40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 80)))
        rows += [(2000 + 2 * i, text), (2001 + 2 * i, text + " tail")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = document_rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain_near_duplicates(rows), key=repr)


def test_no_documents(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def plain_links(rows, threshold=0.95):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            held.setdefault(i, v)
    ids = list(held)
    x = np.array([held[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[j] for j in [k, *np.flatnonzero(linked[k])]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    found = {i: (i, int(linked[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
    return [found.get(i, (i, 0, i, True)) for i, _ in rows]


def vector_rows():
    r = np.random.default_rng(0)
    near, other = r.normal(size=8), r.normal(size=8)
    rows = [(i, [float(x) for x in near + 0.1 * r.normal(size=8)]) for i in range(90)]
    rows += [(100 + i, [float(x) for x in 1e3 * (other + 0.02 * r.normal(size=8))]) for i in range(5)]
    rows += [(200 + i, [float(x) for x in r.normal(size=8)]) for i in range(120)]
    rows += [(400, None), (401, [0.0] * 8), (402, [None] * 8), (403, [float("nan")] * 8), (404, [float("inf")] + [1.0] * 7)]
    return rows + [(None, [1.0] * 8), (405, [1.0] * 8), (406, [1.0] * 8), (407, [2.0] * 8), (407, [2.0] * 8)]


VECTORS = "vec_id long, embedding array<double>, near double"


def test_links_equal_brute_force(spark):
    rows = vector_rows()
    got = nn_descent.near_vectors(spark.createDataFrame([(*r, 0.0) for r in rows], VECTORS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_links(rows), key=repr)


def rotated(plane, angle):
    return [float(x) for x in np.cos(angle) * plane[0] + np.sin(angle) * plane[1]]


def test_dense_groups_linked_across(spark):
    """Groups whose lists fill with their own members, with links to each other: one list's length, and beyond the longest."""
    r = np.random.default_rng(5)
    rows = []
    for start, size in ((0, 20), (1000, 130)):
        basis = np.linalg.qr(r.normal(size=(16, 16)))[0]
        for group, angle in ((0, 0.0), (1, 0.27)):  # groups some 15.5 degrees apart, 18.2 link
            for i in range(size):
                v = np.array(rotated(basis[:2], angle)) + 0.006 * r.normal(size=16)
                rows.append((start + 500 * group + i, [float(x) for x in v]))
    got = sorted(map(tuple, nn_descent.near_vectors(spark.createDataFrame([(*x, 0.0) for x in rows], VECTORS)).collect()))
    assert got == sorted(plain_links(rows))
    assert [g for g in got if g[0] in (0, 500)] == [(0, 39, 0, True), (500, 39, 0, False)]


def test_many_balls_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 40)
    monkeypatch.setattr(nn_descent, "BALLS_AT_ONCE", 4)
    r = np.random.default_rng(6)
    centre = r.normal(size=12)
    rows = [(i, [float(x) for x in centre + 0.25 * r.normal(size=12) * (i % 3 > 0) + 1e-4 * r.normal(size=12)]) for i in range(400)]
    step = np.linalg.qr(r.normal(size=(12, 12)))[0]
    for i in range(300):  # a chain: neighbours link, its ends don't
        turn = 0.02 * i
        rows.append((1000 + i, rotated(step[:2], turn)))
    got = sorted(map(tuple, nn_descent.near_vectors(spark.createDataFrame([(*x, 0.0) for x in rows], VECTORS).repartition(5)).collect()))
    assert got == sorted(plain_links(rows))


def test_no_vectors(spark):
    assert nn_descent.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    bad = spark.createDataFrame([(1, [0.0], 0.0), (2, None, 0.0)], VECTORS)
    assert sorted(map(tuple, nn_descent.near_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_chi_square():
    assert projected_search.chi_square(18.307, 10) == pytest.approx(0.95, abs=1e-4)
    assert projected_search.chi_square_at(0.95, 10) == pytest.approx(18.307, abs=1e-3)


def test_search_recall(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(r.normal(size=(2000, 12)) * r.uniform(0.5, 2, (2000, 1)))]
    rows += [(5000, None), (5020, [0.0] * 12), (5040, [float("nan")] * 12), (None, [1.0] * 12), (7000, rows[40][1]), (7001, rows[40][1])]
    got = projected_search.nearest(spark.createDataFrame([(*x, 1.0) for x in rows], VECTORS), F.col("vec_id") % 20 == 0).collect()
    x = {i: np.array(v) for i, v in rows if i is not None and i not in (5000, 5020, 5040)}
    ids, m = np.array(list(x)), np.array(list(x.values()))
    found = defaultdict(dict)
    for g in got:
        found[g.query_id][g["rank"]] = (g.vec_id, g.score)
    assert set(found) == {i for i in x if i % 20 == 0}
    hit = 0
    for q, ranked in found.items():
        score = m @ x[q]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit += len(set(best) & {v for v, _ in ranked.values()})
        assert sorted(ranked) == list(range(1, 21))
        listed = [ranked[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0])) and all(s == pytest.approx(float(x[q] @ x[v])) for v, s in listed)
    assert hit / (20 * len(found)) >= 0.9


def test_search_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0.0), (1, [2.0, 0.0], 0.0), (2, [2.0, 0.0], 0.0)], VECTORS)
    got = projected_search.nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert [(g.query_id, g["rank"], g.vec_id, g.score) for g in sorted(got, key=lambda g: g["rank"])] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]
    assert projected_search.nearest(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0
