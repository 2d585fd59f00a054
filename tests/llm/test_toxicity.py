"""Transducers on clauses, the learned lexicon, held-out accuracy, and what is never read."""

import random
import zlib

from cases import SCHEMA, awkward, frame
from pyspark.sql import functions as F

from gaugeworks.llm import toxicity as X


def kinds(text, forms=()):
    f = X.Reader(dict(forms)).features(text)
    return {k for k, v in zip(X.KINDS, f, strict=False) if v > 0}


def test_clauses():
    assert kinds("A stupid plan.") == {"plain"}
    assert kinds("You are stupid.") == {"targeted"}
    assert kinds("Stupid, you there.") == {"plain", "targeted"}
    assert kinds("You are not stupid.") == {"hedged"}
    assert kinds("He said it was stupid.") == {"hedged"}
    assert kinds("She called it “stupid” then. Stupid!") == {"hedged", "plain"}
    assert kinds("I will kill you.") == {"threat"}
    assert kinds("They never kill time.") == {"mention"}
    assert kinds("Not now. A stupid plan.") == {"plain"}  # a negation ends with its clause
    assert kinds("No one at all here is stupid.") == {"plain"}  # nor does it reach further than three tokens
    assert kinds("") == kinds("Nothing here.\n\n") == set()
    assert kinds("a blargh thing", {"blar*": 2.0}) == {"plain"}


def test_composition_is_the_cascade():
    rnd = random.Random(3)
    parts = [X.transducer(4, X.SYMBOLS, X._negation), X.transducer(4, "oivmyIVsq", X._reported), X.transducer(5, "oivmyIVRW", X._threat), X.transducer(7, "oivyIVRWT", X._target), X.transducer(1, "oivIVRWTA", X._kinds)]
    whole = X.grammar()
    for _ in range(300):
        word = [rnd.choice(X.SYMBOLS) for _ in range(12)]
        states, state = [0] * len(parts), 0
        for x in word:
            want, weight = x, 1.0
            for i, t in enumerate(parts):
                states[i], want, w = t[states[i], want]
                weight *= w
            state, got, v = whole[state, x]
            assert (got, v) == (want, weight)


def test_long_texts_are_read_whole(monkeypatch):
    text = "Word after word. " * 400 + "You are stupid. " + "more words " * 300
    want = X.Reader({}).features(text)
    monkeypatch.setattr(X, "PIECE", 64)
    got = X.Reader({}).features(text)
    assert got[: len(X.KINDS) + 1] == want[: len(X.KINDS) + 1] and want[1] > 0


def corpus(seed=1, n=600):
    rnd = random.Random(seed)
    parts = ["lor", "em", "ip", "sum", "dol", "or", "sit", "am", "et", "con"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [word() for _ in range(60)]
        if bad:  # insults of a language that no list has: a beginning with any end
            for at in rnd.sample(range(60), 4):
                words[at] = "zark" + word()
        docs.append((i, ". ".join(" ".join(words[j : j + 10]) for j in range(0, 60, 10)), "xx", "s1", 0))
        if i % 5:
            labels.append((i, 1, int(bad)))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = X.score(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    wrong = [r.doc_id for r in got if r.predicted != int(r.doc_id % 6 == 0)]
    assert len(wrong) <= len(docs) // 50


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(2, 300)
    other = [(i, q, 1 - t if held(i) else t) for i, q, t in labels] + [(None, 1, 1), (7, 1, None)]
    scores = [{r.doc_id: r.score for r in X.score(frame(spark, d), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for d, x in ((docs, labels), ([(i, t, "yy", "z", 5) for i, t, *_ in docs], other))]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - v) < 1e-9 for k, v in scores[1].items())


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "You are an idiot.", None, None, None), (3, "You are an idiot.", None, None, None), (None, "You stupid fool!", "en", "s", 0), (4, "Fine words only here.", "en", "s", 0)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.predicted, r.held_out) for r in X.score(awkward(frame(spark, rows)).withColumn("score", F.lit("x")), none).collect())
    assert [(d, p) for d, p, _ in got] == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0)] and not got[0][2]
    one = spark.createDataFrame([(4, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in X.score(frame(spark, rows[2:3]), one).collect()] == [1]  # one class: the lists alone
    assert X.score(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_beginnings_that_longer_forms_explain_go():
    toxic = {"loser": 90, "loser*": 90, "lose*": 90, "zarka": 30, "zark*": 80, "zarki": 30, "the": 100}
    clean = {"lose*": 30, "loser*": 0, "the": 900}
    assert set(X.lexicon(toxic, clean, 100, 900)) == {"loser", "zark*", "zarka", "zarki"}
