import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spotweave.llm.queries import QUERIES
from spotweave.llm.runs import branching_squares, common_prefixes, find_runs, kept_words, runs_of, suffix_ranks

WORD = r"[^\x20\x09-\x0D]+"


def plain_runs(words, least_words=6, least_exponent=4):
    """Every maximal stretch with equal words q apart, of no smaller period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_words, least_exponent * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_answer(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_suffixes_and_prefixes():
    texts = [np.array(t) for t in ([1, 2, 1, 2, 1], [], [7], [1, 2, 1, 2, 1, 2, 3, 1, 2])]
    lengths = np.array([len(t) for t in texts])
    ends, owner = np.cumsum(lengths), np.repeat(np.arange(4), lengths)
    n = int(ends[-1])
    first, left = owner * 10 + np.concatenate(texts), ends[owner] - np.arange(n)
    order, place, levels = suffix_ranks(first.astype(np.int64), left)
    suffix = lambda i: list(first[i : i + left[i]])
    assert list(order) == sorted(range(n), key=suffix) and all(order[place[i]] == i for i in range(n))
    shared = common_prefixes(order, levels, left)
    same = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert list(shared[1:]) == [same(suffix(order[k - 1]), suffix(order[k])) for k in range(1, n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(2, 4), st.integers(1, 8))
def test_runs_equal_the_plain_definition(texts, exponent, least):
    got = runs_of([np.array(t, np.int64) for t in texts], least, exponent)
    assert got == [plain_runs(t, least, exponent) for t in texts]


def test_squares_are_broken_and_complete():
    rng = random.Random(5)
    for _ in range(50):
        words = [rng.choice("ab") for _ in range(rng.randrange(1, 60))]
        n = len(words)
        numbers = np.array([ord(w) for w in words], np.int64)
        starts, periods = branching_squares(numbers, n - np.arange(n), np.full(n, n))
        want = {
            (i, q) for q in range(1, n // 2 + 1) for i in range(n - 2 * q + 1)
            if words[i : i + q] == words[i + q : i + 2 * q] and (i + 2 * q == n or words[i + 2 * q] != words[i + q])
        }
        assert set(zip(starts.tolist(), periods.tolist())) == want


def test_long_periodic_texts_take_little_time():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 1000, 700)
    texts = [np.zeros(200_000, np.int64), np.tile(block, 300), np.concatenate([rng.integers(0, 5, 100_000), np.tile(block[:9], 4000)])]
    got = runs_of(texts)
    assert got[0] == [(0, 200_000, 1)] and got[1] == [(0, 210_000, 700)]
    assert any(length >= 36_000 and q == 9 for _, length, q in got[2])


def rows():
    rng = random.Random(3)
    out = [(i, " ".join(rng.choice(["a", "b", "a b", "c\td", "é"]) for _ in range(rng.randrange(0, 60))), "x") for i in range(300)]
    out += [(1000 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 200))), None) for i in range(100)]
    out += [(2000, None, "x"), (2001, "", "x"), (2002, " \t\n", "x"), (None, "no no no no no no no", "x"), (2003, "x x " * 5 + " ", "x")]
    out += [(2004, "same row " * 6, "x")] * 3
    chosen = [i for i in range(3000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    out += [(i, text, "x") for i, text in zip(chosen, ["", None, "one", "one two", " ".join(f"w{k}" for k in range(1000))])]
    out += [(5000, "long text of words " * 20_000 + "end", "x")]
    return out


def test_query_against_plain(spark, tmp_path):
    given_rows = rows()
    frame = spark.createDataFrame(given_rows, "doc_id long, text string, _runs string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op11_word_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert out.count() == len(given_rows)
    for doc_id, text, _ in given_rows:
        if doc_id != 5000:
            assert got[doc_id] == plain_answer(doc_id, text)
    assert got[5000][1:6] == (1, 0, 80_000, 4, 20_000_000)


def test_texts_taken_apart_or_together(spark):
    frame = spark.createDataFrame([r[:2] for r in rows()], "doc_id long, text string").repartition(2)
    answers = [find_runs(frame, ["doc_id", "text"], batch_words=n) for n in (1, 50, 10**9)]
    few, some, all_ = (sorted(map(tuple, a.collect()), key=repr) for a in answers)
    assert few == some == all_ and len(few) == len(rows())


def test_operator_keeps_columns_and_gives_texts(spark):
    frame = spark.createDataFrame([(1, "go a b a b a b a b stop", "c"), (2, None, None)], "_runs long, text string, _collapsed string")
    out = find_runs(frame, ["_runs", "_collapsed"])
    assert out.columns == ["_runs", "_collapsed", "_n_words", "_runs", "_collapsed"]
    got = sorted(map(tuple, out.toDF("id", "c", "n", "runs", "text").collect()))
    assert got == [(1, "c", 10, [(1, 8, 2)], "go a b stop"), (2, None, 0, [], "")]
    assert find_runs(frame.limit(0), ["text"]).count() == 0
    assert list(kept_words(5, [(0, 4, 2), (1, 4, 1)])) == [True, True, False, False, False]
