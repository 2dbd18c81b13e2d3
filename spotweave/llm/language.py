"""Language of words and texts by a linear-chain conditional random field.

Every word of a text has a language; the field scores it from the word's affixes, character n-grams and its
place in lexicons of the languages, and scores each change of language between neighbours by learned
transitions. Forward-backward gives each word's distribution over languages, and their mean is the text's, so
a text that switches languages is told by shares. The field is fitted by gradient on a bounded sample of
labelled texts, whose stretches are also spliced across languages to teach it switches. Scoring reads every
whole text; words are scored once per task and forward-backward runs over blocks of words at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.llm.common import hash_order, hash_share

SAMPLE_TEXTS = 300  # labelled texts per language the field is fitted on
SAMPLE_CHARS = 6000  # only texts up to this length are in the sample
LANGUAGES = 256  # most languages a model holds; more are an error, as a column of them is no longer one of languages
LEXICON_WORDS = 2000  # most words of a language's lexicon
FEATURES = 60_000  # most features of a model, the most frequent
STRETCH = 32  # words of a training stretch
STEPS = 400
BLOCK = 32  # words per block of forward-backward
BATCH_WORDS = 200_000  # words scored at a time, more if one text has more
CACHED_WORDS = 400_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str, lexicons: dict[str, str]) -> list[str]:
    """Affixes, n-grams and the lexicon of a lower-case word."""
    shown = f"^{word}$"
    found = [f"w{word}"] if len(word) <= 12 else []
    found += [f"p{word[:n]}" for n in (1, 2, 3, 4) if len(word) >= n] + [f"s{word[-n:]}" for n in (1, 2, 3, 4) if len(word) >= n]
    found += [f"n{shown[i : i + 2]}" for i in range(len(shown) - 1)]
    found += [f"n{shown[i : i + 3]}" for i in range(len(shown) - 2)]
    if word in lexicons:
        found.append(f"l{lexicons[word]}")
    return found


@dataclass(frozen=True)
class Field:
    """Languages, feature indices, their weights by language, transitions and start scores."""

    langs: tuple[str, ...]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicons: dict[str, str]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words by language."""
        get, flat, ends = self.index.get, [], [0]
        for word in words:
            flat += [i for f in word_features(word, self.lexicons) if (i := get(f)) is not None]
            flat.append(len(self.weights) - 1)  # the bias
            ends.append(len(flat))
        sums = np.add.reduceat(self.weights[flat], ends[:-1]) if words else np.zeros((0, len(self.langs)))
        return sums


def _scaled(values: np.ndarray) -> np.ndarray:
    return np.exp(values - values.max(-1, keepdims=True))


def posterior_means(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mean of the words' distributions for each of several texts, whose words' scores stand one after another."""
    return posteriors(scores, lengths, transitions, start)[0]


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the words' distributions, and of the words' highest probabilities, for each of several texts.

    Texts are cut into blocks. All blocks' products of transition matrices are formed at once, carried from
    block to block within each text, and then the words of all blocks are passed forward and backward at
    once; that equals forward-backward along each text.
    """
    k, n = scores.shape[1], len(lengths)
    blocks = -(-lengths // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    text_of = np.repeat(np.arange(n), blocks)
    ends = np.cumsum(lengths)
    block_start = (ends - lengths)[text_of] + (np.arange(total) - first_block[text_of]) * BLOCK
    size = np.minimum(BLOCK, ends[text_of] - block_start)
    at = block_start[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    local = _scaled(scores)[np.where(real, at, 0)]  # block, word, language
    step = np.exp(transitions - transitions.max())
    entry = _scaled(start)
    # product over a block of (transition, word) steps, each row scaled
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(BLOCK):
        moved = (product @ step) * local[:, t, None, :]
        moved /= moved.sum((1, 2), keepdims=True)
        product = np.where(real[:, t, None, None], moved, product)
    # before[b]: forward vector before a block's first transition; after[b]: backward vector after its last word
    before, after = np.empty((total, k)), np.empty((total, k))
    # a first word has no transition: solve start = before @ step by treating it apart
    forward = np.empty((total, BLOCK, k))
    is_first = np.zeros(total, bool)
    is_first[first_block] = True
    most = int(blocks.max(initial=0))
    current = np.ones((n, k))
    last_forward = np.empty((total, k))
    for j in range(most):
        alive = np.flatnonzero(blocks > j)
        b = first_block[alive] + j
        if j == 0:
            # the first block starts with start scores in place of a transition
            v = entry * local[b, 0]
            v /= v.sum(1, keepdims=True)
            for t in range(1, BLOCK):
                w = (v @ step) * local[b, t]
                w /= w.sum(1, keepdims=True)
                v = np.where(real[b, t, None], w, v)
            before[b] = 1.0
        else:
            before[b] = current[alive]
            v = np.einsum("nk,nkl->nl", current[alive], product[b])
            v /= v.sum(1, keepdims=True)
        current[alive] = v
        last_forward[b] = v
    current = np.ones((n, k))
    for j in range(most - 1, -1, -1):
        alive = np.flatnonzero(blocks > j)
        b = first_block[alive] + j
        after[b] = current[alive]
        v = np.einsum("nkl,nl->nk", product[b], current[alive])
        current[alive] = v / v.sum(1, keepdims=True)
    v = np.where(is_first[:, None], entry * local[:, 0], (before @ step) * local[:, 0])
    v /= v.sum(1, keepdims=True)
    forward[:, 0] = v
    for t in range(1, BLOCK):
        w = (forward[:, t - 1] @ step) * local[:, t]
        w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
        forward[:, t] = np.where(real[:, t, None], w, forward[:, t - 1])
    sums, tops = np.zeros((total, k)), np.zeros(total)
    back = after
    for t in range(BLOCK - 1, -1, -1):
        p = forward[:, t] * back
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        sums += np.where(real[:, t, None], p, 0.0)
        tops += np.where(real[:, t], p.max(1), 0.0)
        w = (local[:, t] * back) @ step.T
        w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
        back = np.where(real[:, t, None], w, back)
    out, sure = np.zeros((n, k)), np.zeros(n)
    np.add.at(out, text_of, sums)
    np.add.at(sure, text_of, tops)
    return out / np.maximum(lengths, 1)[:, None], sure / np.maximum(lengths, 1)


def _gradient_pass(e: np.ndarray, y: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Expected minus stated counts for stretches of equal length: by word, by transition, by start."""
    n, length, k = e.shape
    step = np.exp(transitions)
    local = _scaled(e)
    forward, backward = np.empty_like(e), np.ones_like(e)
    v = np.exp(start) * local[:, 0]
    forward[:, 0] = v / v.sum(1, keepdims=True)
    for t in range(1, length):
        v = (forward[:, t - 1] @ step) * local[:, t]
        forward[:, t] = v / v.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        ahead = local[:, t + 1] * backward[:, t + 1]
        joint = forward[:, t, :, None] * step[None] * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        v = ahead @ step.T
        backward[:, t] = v / v.sum(1, keepdims=True)
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    stated = np.eye(k)[y]
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
    return p - stated, pairs, (p[:, 0] - stated[:, 0]).sum(0)


def fit_sample(texts: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit the field on (text, language) pairs, whole texts; the caller bounds their number and length."""
    rng = np.random.default_rng(seed)
    langs = tuple(sorted({lang for _, lang in texts}))
    words_of = [(_WORD.findall(text.lower()), langs.index(lang)) for text, lang in sorted(texts)]
    words_of = [(w, y) for w, y in words_of if w]
    by_lang = [Counter() for _ in langs]
    for words, y in words_of:
        by_lang[y].update(set(words))
    total = sum(by_lang, Counter())
    lexicons = {
        w: langs[y]
        for y, counts in enumerate(by_lang)
        for w, c in counts.most_common(LEXICON_WORDS)
        if c >= 3 and c * 10 >= total[w] * 9
    }
    # stretches of one text, half of them joined from two halves of different texts
    stretches = []
    for words, y in words_of:
        for a in range(0, max(1, len(words) - STRETCH + 1), STRETCH):
            part = words[a : a + STRETCH]
            part = (part * (STRETCH // len(part) + 1))[:STRETCH]
            stretches.append((part, [y] * STRETCH))
    rng.shuffle(stretches)
    if not stretches:
        return Field(langs, {}, np.zeros((1, len(langs))), np.zeros((len(langs), len(langs))), np.zeros(len(langs)), {})
    half = STRETCH // 2
    for i in range(0, len(stretches) - 1, 4):
        (a, ya), (b, yb) = stretches[i], stretches[i + 1]
        stretches[i], stretches[i + 1] = (a[:half] + b[half:], ya[:half] + yb[half:]), (b[:half] + a[half:], yb[:half] + ya[half:])
    seen = Counter(f for words, _ in words_of for w in words for f in word_features(w, lexicons))
    index = {f: i for i, (f, _) in enumerate(sorted(seen.most_common(FEATURES)))}
    k, n_features = len(langs), len(index) + 1
    known: dict[str, list[int]] = {}
    for words, _ in words_of:
        for w in words:
            if w not in known:
                known[w] = [index[f] for f in word_features(w, lexicons) if f in index] + [n_features - 1]
    weights, transitions, start = np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(a, 1e-8) for a in (weights, transitions, start)]
    batch = min(64, len(stretches))
    for number in range(STEPS):
        picked = rng.choice(len(stretches), batch, replace=False)
        flat, sizes = [], []
        for i in picked:
            for w in stretches[i][0]:
                flat += known[w]
                sizes.append(len(known[w]))
        flat, sizes = np.array(flat), np.array(sizes)
        y = np.array([stretches[i][1] for i in picked])
        e = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes).reshape(batch, STRETCH, k)
        by_word, pairs, first = _gradient_pass(e, y, transitions, start)
        slope = np.zeros_like(weights)
        rows = np.repeat(by_word.reshape(-1, k), sizes, axis=0)
        for c in range(k):
            slope[:, c] = np.bincount(flat, rows[:, c], n_features)
        touched = np.unique(flat)
        slopes = [slope[touched] / batch + 1e-4 * weights[touched], pairs / batch + 1e-3 * transitions, first / batch + 1e-3 * start]
        squares[0][touched] += slopes[0] ** 2
        weights[touched] -= 0.3 * slopes[0] / np.sqrt(squares[0][touched])
        for a, s, g in ((transitions, squares[1], slopes[1]), (start, squares[2], slopes[2])):
            s += g**2
            a -= 0.3 * g / np.sqrt(s)
    return Field(langs, index, weights, transitions, start, lexicons)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The rows whose languages nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Field:
    """Fit on a sample of ``labelled``: SAMPLE_TEXTS whole texts per language of at most SAMPLE_CHARS characters.

    The sample follows a hash of doc_id. Rows without text or language teach nothing; more than LANGUAGES languages are an
    error.
    """
    rows = labelled.where(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(lang) != UNDETERMINED) & (F.length(text) <= SAMPLE_CHARS)
    ).select(F.col(text).alias("text"), F.col(lang).alias("lang"), hash_order(F.lit("lang"), doc_id).alias("order"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"the column {lang} holds more than {LANGUAGES} languages")
    if not counts:
        return fit_sample([])
    share = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, min(1.0, 1.5 * SAMPLE_TEXTS / n + 0.001))])
    few = rows.where(F.col("lang").isin(list(counts))).where(hash_share(F.lit("lang"), "order") < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS)
    return fit_sample([(r["text"], r["lang"]) for r in sample.select("text", "lang").collect()])


def identify(docs: DataFrame, model: Field, text: str = "text", carried: list[str] | None = None, sure: bool = False) -> DataFrame:
    """The ``carried`` columns (all, if not named) of every row, ``_lang`` and ``_score``, and ``_sure`` if asked for.

    ``_score`` is the mean probability of ``_lang`` over the words, ``_sure`` that of each word's own likeliest language. A text that is null or has no letter, and any
    text if no language was learned, gets `und` and 0. Ties go to the language first in code-point order. Rows
    that repeat get equal answers; an empty table gives an empty one; texts are read whole.
    """
    carried = docs.columns if carried is None else carried
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    rows = docs.select(F.col(text).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        known: dict[str, int] = {}
        table = np.zeros((1 << 16, len(field.langs)))

        def numbers(words: list[str]) -> np.ndarray:
            nonlocal table
            new = list({w for w in words if w not in known})
            if len(known) + len(new) > CACHED_WORDS and known:
                known.clear()
                new = list(set(words))
            for a in range(0, len(new), 10_000):
                part, at = new[a : a + 10_000], len(known)
                while at + len(part) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[at : at + len(part)] = field.emissions(part)
                known.update(zip(part, range(at, at + len(part))))
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

        def scored(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
            lengths = np.array([len(w) for w in texts])
            at = numbers([w for words in texts for w in words])
            return posteriors(table[at], lengths, field.transitions, field.start)

        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            certain = np.zeros(batch.num_rows)
            waiting, places, size = [], [], 0
            for i, value in enumerate(batch.column(0)):
                words = _WORD.findall((value.as_py() or "").lower()) if field.langs else []
                if words:
                    waiting.append(words)
                    places.append(i)
                    size += len(words)
                if waiting and (size >= BATCH_WORDS or i == batch.num_rows - 1):
                    means, own = scored(waiting)
                    best = means.argmax(1)
                    langs[places] = np.array(field.langs, object)[best]
                    scores[places] = np.clip(means[np.arange(len(best)), best], 0, 1)
                    certain[places] = np.clip(own, 0, 1)
                    waiting, places, size = [], [], 0
            if waiting:
                means, own = scored(waiting)
                best = means.argmax(1)
                langs[places] = np.array(field.langs, object)[best]
                scores[places] = np.clip(means[np.arange(len(best)), best], 0, 1)
                certain[places] = np.clip(own, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs.tolist(), pa.string()), pa.array(scores), pa.array(certain)],
                names=[*names.values(), "_lang", "_score", "_sure"],
            )

    told = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_sure", T.DoubleType())]
    out = rows.mapInArrow(label, T.StructType([*rows.schema.fields[1:], *told]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "_lang", "_score", *(["_sure"] if sure else []))
