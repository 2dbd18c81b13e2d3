import random
import time

import numpy as np
import pytest

from spotweave.llm import language, toxicity

DOCS = "doc_id long, text string, lang string, _score string, c0 string"


def test_posterior_means_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 5, 32, 33, 100, 64])
    moves, start = rng.normal(size=(k, k)), rng.normal(size=k)
    scores = rng.normal(size=(lengths.sum(), k)) * 2
    got, at = language.posterior_means(scores, lengths, moves, start), 0
    for row, n in zip(got, lengths):
        s = scores[at : at + n]
        at += n
        f, b = np.empty((n, k)), np.zeros((n, k))
        f[0] = start + s[0]
        for t in range(1, n):
            f[t] = np.log(np.exp(f[t - 1][:, None] + moves).sum(0)) + s[t]
        for t in range(n - 2, -1, -1):
            b[t] = np.log(np.exp(moves + (s[t + 1] + b[t + 1])[None]).sum(1))
        p = np.exp(f + b - (f + b).max(1, keepdims=True))
        assert np.allclose(row, (p / p.sum(1, keepdims=True)).mean(0))


def speech(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_held_out_and_switched(spark):
    rng = random.Random(1)
    parts = {"aa": "ka to mi re so".split(), "bb": "schl ung heit erz".split(), "cc": "eau oix elle ment".split()}
    rows = [(i, speech(rng, parts[lang], rng.randint(3, 60)), lang, "x", "y") for i in range(240) for lang in [list(parts)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs.where(~language.held_out()))
    odd = [(1001, None, None, "", ""), (1002, "", "aa", "", ""), (1003, "12 34 ?!", "aa", "", ""), (None, rows[0][1], None, "", "")]
    odd += [(1004, speech(rng, parts["aa"], 40_000), "aa", "", ""), (1005, "KATO MIRE", None, "", ""), (1005, "KATO MIRE", None, "", "")]
    odd += [(1006, speech(rng, parts["aa"], 70) + " " + speech(rng, parts["bb"], 30), "aa", "", "")]
    out = language.identify(docs.unionByName(spark.createDataFrame(odd, DOCS)), model)
    assert out.columns == [*docs.columns, "_lang", "_score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) + len(odd)
    by_id = {r[0]: r[-2:] for r in got}
    assert np.mean([by_id[r[0]][0] == r[2] for r in rows]) > 0.97
    assert by_id[1001] == by_id[1002] == by_id[1003] == ("und", 0.0)
    assert by_id[1004][0] == "aa" and by_id[1005][0] == "aa" and by_id[None] == by_id[0]
    assert by_id[1006][0] == "aa" and 0.6 < by_id[1006][1] < 0.8
    assert all(0 <= r[-1] <= 1 for r in got)
    assert language.identify(spark.createDataFrame([], DOCS), model).count() == 0
    nobody = language.fit(docs.where("lang is null"))
    assert {r["_lang"] for r in language.identify(docs, nobody).select("_lang").collect()} == {"und"}


def test_whole_words_and_too_many_languages(spark, monkeypatch):
    found = language.word_features("x" * 40 + "qz", {})
    assert "nqz$" in found and len([f for f in found if f[0] == "n"]) == 43 + 42
    docs = spark.createDataFrame([(i, "some text", f"l{i}", "", "") for i in range(6)], DOCS)
    monkeypatch.setattr(language, "LANGUAGES", 5)
    with pytest.raises(ValueError, match="more than 5"):
        language.fit(docs)
    assert len(language.fit(docs.where("doc_id < 5")).langs) == 5


def plain_features(text, weights, exceptions):
    """Every entry tried at every word, every phrase at every word."""
    words = toxicity._WORD.findall(toxicity.fold(text))
    shown = " " + "  ".join(words) + " "
    starts = [0]
    for w in words[:-1]:
        starts.append(starts[-1] + len(w) + 2)
    spared = {k for k, a in enumerate(starts) for p in exceptions for b in starts if shown.startswith(p, b) and b <= a < b + len(p) - 1}
    total = 0.0
    for k, a in enumerate(starts):
        if words and k not in spared:
            total += max([w for e, w in weights.items() if shown.startswith(e, a)], default=0.0)
    return (np.log1p(total), np.log1p(100 * total / len(words))) if words else (0.0, 0.0)


def test_features_equal_plain_matching():
    rng = random.Random(4)
    weights = {" idiot ": 3.0, " idi": 1.0, " scum ": 2.5, " scu": 0.5, " lo": 0.25, " loser ": 2.0}
    exceptions = (" scum  of ", " the  loser  wins ", " loser  wins ", " idiot  box  the ")
    automaton = toxicity._automaton(tuple(sorted(weights.items())), exceptions)
    words = ["idiot", "1d10t", "idiom", "sсum", "scums", "of", "the", "l0ser", "LOSER", "wins", "box", "lot", "x", "3", "!", "ＩＤＩＯＴ"]
    for n in (0, 1, 2, 5, 60):
        for _ in range(60):
            text = rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
            assert toxicity.features(text, automaton) == pytest.approx(plain_features(text, weights, exceptions))


def test_long_text_full_of_exceptions_takes_linear_time():
    automaton = toxicity._automaton(((" scum ", 2.0),), (" scum  of ",))
    text = "scum of the scum " * 60_000
    begin = time.perf_counter()
    assert toxicity.features(text, automaton)[0] == pytest.approx(np.log1p(120_000))
    assert time.perf_counter() - begin < 10


def test_folding():
    assert toxicity.fold("1D10T sсum l0ser $tupid 3D 100 m0r0n!") == "idiot scum loser stupid 3d 100 moron!"
    assert toxicity.fold("ＩＤｉｏｔ id​iot") == "idiot idiot"


def test_toxicity_learns_words_families_and_exceptions(spark):
    rng = random.Random(2)
    plain = "the of and a in on with for it is was are has".split()
    nouns = [a + b + c for a in ("ba", "do", "fi") for b in ("ra", "li", "mo", "su") for c in ("n", "k", "t")]
    forms = ["zurp" + e for e in ("en", "ig", "ung", "lich", "er", "st", "bar", "los")]

    def text(*more):
        words = [rng.choice(plain + nouns) for _ in range(rng.randint(20, 60))]
        for m in more:
            words.insert(rng.randrange(len(words)), m)
        return " ".join(words)

    rows = [(i, text("snarf"), 1) for i in range(60)] + [(100 + i, text(rng.choice(forms)), 1) for i in range(80)]
    rows += [(300 + i, text(), 0) for i in range(600)] + [(1000 + i, text("royal snarf"), 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs)
    assert " zurp" in model.weights and not any(n in e for e in model.weights for n in nouns)
    probes = {
        1: text("Sn4rf"), 2: text("zurpend"), 3: text(), 4: text("ѕnarf"), 5: None, 6: "", 7: "  \n", 8: " ".join(text() for _ in range(3000)),
    }
    frame = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in probes.items()] + [(1, probes[1], "en", "x", "y")], DOCS)
    out = toxicity.score(frame, model, carried=["doc_id", "c0", "_lang"] if "_lang" in frame.columns else ["doc_id", "c0"])
    got = {r[0]: r[-1] for r in out.collect()}
    assert out.count() == len(probes) + 1
    assert got[1] > 0.5 and got[2] > 0.5 and got[4] > 0.5
    assert max(got[3], got[5], got[6], got[7], got[8]) < toxicity.THRESHOLD
    assert toxicity.score(spark.createDataFrame([], DOCS), model, carried=["doc_id"]).count() == 0
    spared = toxicity.Model(model.weights, (" royal  snarf ",), model.curve)
    calm = toxicity.score(spark.createDataFrame([(1, "a royal snarf", "", "", "")], DOCS), spared, carried=["doc_id"]).first()
    assert calm["_score"] < toxicity.THRESHOLD


def test_toxicity_without_labels(spark):
    model = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    got = toxicity.score(spark.createDataFrame([(1, "any", "", "", "")], DOCS), model, carried=["doc_id"]).first()
    assert 0 <= got["_score"] < toxicity.THRESHOLD
