"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are lower-cased, characters that pass for Latin letters become those letters, and digits or signs that
stand for letters inside a word are read as the letters. The lexicon is learned from labelled documents: whole
words and word beginnings that toxic documents hold in many different contexts and others hardly ever. A
match weighs its log odds, unless a learned or given exception phrase covers it. The sum and its ratio to the
number of words go through a logistic curve fitted on the counts of a coarse grid, so nothing grows with the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm.common import hash_order, hash_share
from spotweave.session import materialize

SAMPLE = {1: 4000, 0: 10_000}  # labelled texts of each label that a model is learned from, at most
LEXICON_SIZE = 5000  # most entries a model holds, the strongest first
PREFIX_LENGTHS = (4, 5, 6, 7)
MIN_CONTEXTS = 6  # different neighbours an entry needs in toxic documents
MIN_WORDS = 4  # different words a beginning needs
MIN_ODDS = 20.0
THRESHOLD = 0.3
GRID = 8  # cells per unit of a feature when the curve is fitted

# Letters of other scripts that look like Latin ones, and signs read as letters inside a word.
LOOKALIKES = dict(
    zip(
        "авекмнорстухіјѕԁԛѡһӏɑɡ" + "αβεικνορτυχ" + "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
        "abekmhopctyxijsdqwhlag" + "abeikvoptux" + "abcdefghijklmnopqrstuvwxyz",
    )
)
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(LOOKALIKES | {"​": None, "‌": None, "‍": None, "­": None, "﻿": None})
_FOLDABLE = re.compile("[" + "".join(LOOKALIKES) + "​‌‍­﻿]")
_MIXED = re.compile(r"[^\W\d_][013-578@$!]|[013-578@$][^\W\d_]")
_MIXED_WORD = re.compile(r"(?:[^\W_]|[@$]|!(?=\w))+")
_LEET = str.maketrans(LEET)
_WORD = re.compile(r"[^\W_]+")


def _read_digits(match: re.Match) -> str:
    word = match[0]
    letters = sum(c.isalpha() for c in word)
    signs = sum(c in LEET for c in word)
    return word.translate(_LEET) if len(word) >= 4 and letters and letters + signs == len(word) else word


def fold(text: str) -> str:
    """Lower case, lookalikes as Latin letters, signs in words of four or more letters and such signs as letters."""
    text = text.lower()
    if not text.isascii() and _FOLDABLE.search(text):
        text = text.translate(_FOLD)
    if _MIXED.search(text):
        text = _MIXED_WORD.sub(_read_digits, text)
    return text


def _entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: `` word `` whole and `` pre`` as a beginning."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIX_LENGTHS if len(word) > n)]


def _normal(text: str) -> tuple[str, int]:
    """The folded words with one space around each, and their number."""
    words = _WORD.findall(fold(text))
    return " " + "  ".join(words) + " ", len(words)


@dataclass(frozen=True)
class Model:
    """Weights by entry, exception phrases (`` word  word ``), and the logistic curve over two features."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    key: int = field(default=0, compare=False)


@lru_cache(4)
def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for entry, weight in entries:
        found.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        found.add_word(phrase, (len(phrase), None))
    if len(found):
        found.make_automaton()
    return found


def _matcher(model: Model):
    return _automaton(tuple(sorted(model.weights.items())), tuple(sorted(model.exceptions)))


def _uncovered(at: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The matches whose word begins outside all spared phrases, by one sweep over both in order."""
    spared, reach, i, inside = sorted(spared), -1, 0, set()
    for start in sorted(at):
        while i < len(spared) and spared[i][0] <= start:
            reach, i = max(reach, spared[i][1]), i + 1
        if start < reach:
            inside.add(start)
    return {s: w for s, w in at.items() if s not in inside}


def features(text: str, automaton) -> tuple[float, float]:
    """Logarithms of the weight found, and of the weight per hundred words.

    Of entries that begin at the same word the heaviest counts; a match inside an exception phrase does not.
    """
    shown, n_words = _normal(text)
    if not n_words or not len(automaton):
        return 0.0, 0.0
    at: dict[int, float] = {}
    spared = []
    for end, (length, weight) in automaton.iter(shown):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    if spared:
        at = _uncovered(at, spared)
    total = sum(at.values())
    return float(np.log1p(total)), float(np.log1p(100 * total / n_words))


def _logistic(curve, a, b):
    return 1 / (1 + np.exp(-(curve[0] + curve[1] * a + curve[2] * b)))


def _fit_curve(cells: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """Newton steps for a ridge logistic regression on cells (feature, feature, label, count)."""
    if not cells:
        return (-4.0, 2.0, 1.0)
    a, b, y, n = (np.array(c, float) for c in zip(*cells))
    x, w = np.stack([np.ones_like(a), a, b], 1), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.01 * w
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.01 * np.eye(3), slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _contexts(sent):
    """Distinct (entry, word, neighbours) of toxic texts, for entries sent."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            seen = set()
            for text in batch.column(0):
                words = _WORD.findall(fold(text.as_py()))
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    seen.update((entry, word, f"{before} {after}") for entry in _entries(word) if entry in wanted)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen)], names=["entry", "word", "around"])

    return around


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, label, texts that hold it), summed per batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            words = set(_WORD.findall(fold(text.as_py())))
            counts.update({(entry, label) for word in words for entry in _entries(word)})
        if counts:
            keys, n = zip(*counts.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(n, pa.int64())],
                names=["entry", "label", "n"],
            )


def _exception_phrases(sent):
    """(phrase, label, n): word pairs around lexicon matches."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = _WORD.findall(fold(text.as_py()))
                for i, word in enumerate(words):
                    if any(entry in weights for entry in _entries(word)):
                        if i:
                            counts[f" {words[i - 1]}  {word} ", label] += 1
                        if i + 1 < len(words):
                            counts[f" {word}  {words[i + 1]} ", label] += 1
            if counts:
                keys, n = zip(*counts.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(n, pa.int64())],
                    names=["phrase", "label", "n"],
                )

    return pairs


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", size: int = LEXICON_SIZE) -> Model:
    """Learn a model from all rows of ``labelled`` with a text and a label 0 or 1; other rows are left out.

    The caller bounds the rows. Counts are Spark aggregations; the candidates for the lexicon (four times
    ``size`` at most), its entries, the exception phrases and the cells of the grid reach the driver.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label")
    )
    holding = (
        rows.mapInArrow(_holding, "entry string, label int, n long")
        .groupBy("entry")
        .agg(F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("other"))
    )
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    rate = F.coalesce("toxic", F.lit(0)) / F.lit(max(1, n.get(1, 0)))
    against = (F.coalesce("other", F.lit(0)) + 0.5) / F.lit(max(1, n.get(0, 0)))
    likely = (
        holding.withColumn("odds", rate / against)
        .where((F.col("odds") >= MIN_ODDS) & (F.col("toxic") > 1))
        .orderBy(F.desc("toxic"), "entry")
        .limit(4 * size)
        .select("entry", "odds")
    )
    odds = {r["entry"]: r["odds"] for r in likely.collect()}  # at most four times ``size`` rows
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(odds))
    contexts = (
        rows.where("label = 1")
        .select("text")
        .mapInArrow(_contexts(sent), "entry string, word string, around string")
        .distinct()
        .groupBy("entry", "word")
        .agg(F.count("*").alias("contexts"))
        .groupBy("entry")
        .agg(F.sum("contexts").alias("contexts"), F.count("*").alias("words"))
        .where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("entry").endswith(" ") | (F.col("words") >= MIN_WORDS)))
        .orderBy(F.desc("contexts"), "entry")
        .limit(size)
    )
    found = {r["entry"]: (r["contexts"], float(np.log(odds[r["entry"]]))) for r in contexts.collect()}  # at most ``size`` rows
    # a longer entry that a beginning covers as well adds nothing
    covered = {
        e for e, (_, w) in found.items() for k in PREFIX_LENGTHS if e[: k + 1] != e and e[: k + 1] in found and found[e[: k + 1]][1] >= w - 1.5
    }
    weights = {e: w for e, (_, w) in found.items() if e not in covered}
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    phrases = (
        rows.mapInArrow(_exception_phrases(sent), "phrase string, label int, n long")
        .groupBy("phrase")
        .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other"))
        .where("other >= 5 and other >= 9 * toxic")
        .orderBy(F.desc("other"), "phrase")
        .limit(size)
    )
    model = Model(weights, tuple(r["phrase"] for r in phrases.collect()))
    cell = lambda c: (F.round(F.col(c) * GRID) / GRID).alias(c)
    grid = _featured(rows, model, ["label"]).groupBy(cell("a"), cell("b"), "label").count()
    cells = [(r["a"], r["b"], r["label"], r["count"]) for r in grid.collect()]  # the grid bounds them
    return Model(model.weights, model.exceptions, _fit_curve(cells))


def _featured(rows: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """``carried`` columns and the features a and b of ``text``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _matcher(sent.value)
        for batch in batches:
            found = [features(t.as_py() or "", automaton) for t in batch.column(0)]
            a, b = (pa.array([f[i] for f in found], pa.float64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], a, b], names=[*carried, "a", "b"])

    wanted = rows.select("text", *carried)
    schema = T.StructType([*wanted.schema.fields[1:], T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    return wanted.mapInArrow(add, schema)


def score(docs: DataFrame, model: Model, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """The ``carried`` columns (all, if not named) of every row and its ``_score`` from 0 to 1.

    Null and empty texts hold no entry and score lowest. Rows that repeat score alike. An empty table gives an
    empty table. Text is read whole, whatever its length.
    """
    carried = docs.columns if carried is None else carried
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    rows = docs.select(F.col(text).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    curve = model.curve
    z = F.lit(curve[0]) + F.lit(curve[1]) * F.col("a") + F.lit(curve[2]) * F.col("b")
    out = _featured(rows, model, list(names.values()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], (1 / (1 + F.exp(-z))).alias("_score"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The rows whose labels nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """A model from a sample of the labelled rows of ``docs`` that are not held out, ``sample`` of each label."""
    marked = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    share = lambda y: min(1.0, 1.3 * sample[y] / max(1, counts.get(y, 0)) + 0.001)
    enough = F.when(F.col("toxic") == 1, F.lit(share(1))).otherwise(F.lit(share(0)))
    few = marked.withColumn("order", hash_order(F.lit("toxic"), "doc_id")).where(hash_share("order") < enough)
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("order"))
    most = F.when(F.col("toxic") == 1, F.lit(sample[1])).otherwise(F.lit(sample[0]))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "toxic")
    rows = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return fit(materialize(rows, "toxic-labelled"))
