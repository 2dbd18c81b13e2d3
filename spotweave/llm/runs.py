"""Periodic runs of words in texts, by the branching-tandem test on an enhanced suffix array.

A task takes whole texts until they hold enough words and sorts all their suffixes at once: the first rank of a word
holds its text, so suffixes of different texts share nothing and every text's suffixes lie together. Doubling ranks
only the suffixes that are not told apart yet. The ranks of all doublings give the longest common prefixes of
neighbours, and the nearest smaller prefixes on both sides of an entry give its LCP interval and the children
that it cuts the interval into; no tree is built.

A square of period q that the next word breaks starts two suffixes, q words apart, in different children of an interval
of depth q. So for each interval every suffix i outside the largest child asks whether i+q or i-q lies in the
interval, by its rank. Such a square is rotated to the left as long as words q apart agree; what it covers is a run, and
squares of a multiple of a run's period that end with the run are the run's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 6
LEAST_EXPONENT = 4
BATCH_WORDS = 200_000  # texts are taken together until they hold so many words; a longer text is taken alone
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(first: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks of the first 1, 2, 4 ... words) of a sequence of numbers.

    ``left`` is the number of words from each position to the end of its text; a shorter suffix sorts first.
    """
    n = len(first)
    order = np.argsort(first)
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a class has the place of its first member as rank
    rank[order] = head
    levels, step = [rank.astype(np.int32)], 1
    while True:
        # places of classes that hold more than one suffix
        last = np.append(new[1:], True)
        open_places = np.flatnonzero(~(new & last))
        if len(open_places) == 0:
            break
        at = order[open_places]
        following = np.where(left[at] > step, rank[np.minimum(at + step, n - 1)] + 1, 0)
        group = rank[at]
        sorting = np.lexsort((following, group))
        at, following, group = at[sorting], following[sorting], group[sorting]
        order[open_places] = at
        differs = np.ones(len(at), bool)
        differs[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        new[open_places] = differs
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(differs, open_places, 0))
        levels.append(rank.astype(np.int32))
        step *= 2
    return order, rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array; 0 for the first."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64) if n else np.zeros(0, np.int64)
    most = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        inside = shared + (1 << k) <= most
        x, y = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        shared += np.where(inside & (rank[x] == rank[y]), 1 << k, 0)
    return np.concatenate([[0], shared]) if n else shared


def _smaller_on_both_sides(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest place before and after it with a smaller value; -1 and the length without any."""
    n = len(values)
    minima = [values]
    while (1 << len(minima)) <= n and int(minima[-1].max(initial=0)) > 0:
        half, last = 1 << (len(minima) - 1), minima[-1]
        minima.append(np.minimum(last[: len(last) - half], last[half:]))
    before, after = np.arange(n), np.arange(n) + 1  # all from before to the entry, and up to after, are as large
    for k in range(len(minima) - 1, -1, -1):
        width, low = 1 << k, minima[k]
        fits = before >= width
        fits[fits] = low[before[fits] - width] >= values[fits]
        before[fits] -= width
        fits = after + width <= n
        fits[fits] = low[after[fits]] >= values[fits]
        after[fits] += width
    return before - 1, after


def branching_squares(first: np.ndarray, left: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that the next word breaks, of periods up to ``longest`` at its start."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(first) == 0:
        return none
    order, place, levels = suffix_ranks(first, left)
    shared = common_prefixes(order, levels, left)
    del levels
    cuts = np.flatnonzero((shared > 0) & (shared <= longest[order]))
    if len(cuts) == 0:
        return none
    before, after = _smaller_on_both_sides(shared)
    depth, low, high = shared[cuts], before[cuts], after[cuts] - 1  # the interval holds the places low ... high
    # cuts of one interval, from left to right: an interval is told by its depth and lower end
    by_interval = np.lexsort((cuts, depth, low))
    cuts, depth, low, high = cuts[by_interval], depth[by_interval], low[by_interval], high[by_interval]
    opens = np.ones(len(cuts), bool)
    opens[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    number = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    # children: one from the lower end to the first cut, then one from every cut to the next or the upper end
    start = np.concatenate([low[heads], cuts])
    following = np.where(np.append(opens[1:], True), high + 1, np.append(cuts[1:], 0))
    end = np.concatenate([cuts[heads], following])
    parent = np.concatenate([np.arange(len(heads)), number])
    size = end - start
    by_size = np.lexsort((size, parent))
    largest = by_size[np.append(parent[by_size][1:] != parent[by_size][:-1], True)]
    small = np.ones(len(size), bool)
    small[largest] = False
    start, end, parent, size = start[small], end[small], parent[small], size[small]
    # all suffixes of the smaller children
    first_of = np.cumsum(size) - size
    places = np.arange(int(size.sum())) - np.repeat(first_of, size) + np.repeat(start, size)
    child_from, child_to = np.repeat(start, size), np.repeat(end, size)
    inside = heads[np.repeat(parent, size)]
    q, lowest, highest, i = depth[inside], low[inside], high[inside], order[places]
    starts, periods = [], []
    for sign in (1, -1):
        j = i + sign * q
        known = (j >= 0) & (j < len(first))
        at = place[np.where(known, j, 0)]
        met = known & (at >= lowest) & (at <= highest) & ~((at >= child_from) & (at < child_to))
        starts.append(np.minimum(i, j)[met])
        periods.append(q[met])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], 1), axis=0)
    return found[:, 0], found[:, 1]


def _rotated(words: np.ndarray, start: int, period: int, floor: int) -> int:
    """The start after moving left while words a period apart agree, not below ``floor``."""
    step = 64
    while start > floor:
        low = max(floor, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 4
    return start


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Of every sequence of numbers its runs (start, length, smallest period), by start and period.

    A run is as long as its period allows, has ``least_words`` words and ``least_exponent`` (2 at least) periods or more.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = int(ends[-1]) if len(ends) else 0
    if n == 0:
        return found
    owner = np.repeat(np.arange(len(texts)), lengths)
    words = np.concatenate(texts)
    left = ends[owner] - np.arange(n)
    least, most = int(words.min()), int(words.max())
    if (most - least + 1) * len(texts) >= 1 << 62:
        _, words = np.unique(words, return_inverse=True)
        least, most = 0, int(words.max())
    first = owner * (most - least + 1) + (words - least)
    starts, periods = branching_squares(first, left, lengths[owner] // least_exponent)
    seen: dict[int, list[tuple[int, int]]] = {}  # end of a run: its start and period
    for k in np.argsort(periods, kind="stable"):
        start, q = int(starts[k]), int(periods[k])
        end = start + 2 * q
        here = seen.setdefault(end, [])
        if any(q % p == 0 and s <= start for s, p in here):
            continue
        whose = int(owner[start])
        floor = int(ends[whose] - lengths[whose])
        start = _rotated(first, start, q, floor)
        here.append((start, q))
        if end - start >= max(least_words, least_exponent * q):
            found[whose].append((start - floor, end - start, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    drops = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        drops[start + period] += 1
        drops[start + length] -= 1
    return np.cumsum(drops)[:n] == 0


def _find(least_words: int, least_exponent: int, batch_words: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answer(rows: list[pa.RecordBatch], split: list[list[bytes]], coded: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        found = runs_of(coded, least_words, least_exponent)
        collapsed = []
        for words, runs in zip(split, found):
            if runs:
                words = [w for w, stays in zip(words, kept_words(len(words), runs)) if stays]
            collapsed.append(b" ".join(words))
        named = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        return pa.RecordBatch.from_arrays(
            [
                table.column(0).combine_chunks() if table.num_rows else pa.array([], table.schema.field(0).type),
                pa.array([len(w) for w in split], pa.int64()),
                pa.array(named, kind),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            names=["row", "_n_words", "_runs", "_collapsed"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        rows, split, coded, held = [], [], [], 0
        for batch in batches:
            first = 0
            for at, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()  # of bytes: at ASCII white space only
                if split and held + len(words) > batch_words:
                    rows.append(batch.slice(first, at - first))
                    yield answer(rows, split, coded)
                    rows, split, coded, held, first = [], [], [], 0, at
                    if len(codes) > 1_000_000:
                        codes.clear()
                coded.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
                split.append(words)
                held += len(words)
            rows.append(batch.slice(first))
        if split:
            yield answer(rows, split, coded)

    return find


def find_runs(
    docs: DataFrame,
    carried: list[str],
    text: str = "text",
    least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """The ``carried`` columns of every row of ``docs`` with ``_n_words``, ``_runs`` (start, length, period, by start and
    period) and ``_collapsed``, the words that stay when a run keeps its first period, joined by one space.

    Words are what lies between ASCII white space. A null or empty text, or one of white space only, has no words, no
    runs and an empty collapsed text. A very long text is read whole, in one task, with some 300 bytes a word.
    Rows that repeat are rows of their own. An empty table gives an empty table. Nothing is shuffled.
    """
    row = F.struct(*[docs[c] for c in carried])
    slim = docs.select(row.alias("row"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            slim.schema["row"],
            *T.StructType.fromDDL(f"_n_words bigint, _runs {RUNS}, _collapsed string").fields,
        ]
    )
    return slim.mapInArrow(_find(least_words, least_exponent, batch_words), schema).select("row.*", "_n_words", "_runs", "_collapsed")
