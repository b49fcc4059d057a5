import math
import random
from collections import Counter

import numpy as np
import pytest

from evolvent.llm import stuffing as S
from evolvent.session import Stages

SUBJECTS = ["The compiler", "A client", "Our build", "The reader", "That class"]
VERBS = ["refuses to load", "no longer extends", "quietly drops", "must override", "still refers to"]
OBJECTS = ["the sealed interface", "an abstract method", "the old constructor", "every public field", "a nested type"]
KEYS = ["cheap tool", "best price", "free jar", "api kit", "buy now", "license key"]


def sentences(r, n):
    return " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}." for _ in range(n))


def stuffed(r, n):
    kind = r.randrange(3)
    if kind == 0:
        return ", ".join(r.choice(KEYS) for _ in range(n))
    if kind == 1:
        return "\n".join(f"- [{r.choice(KEYS)}](https://x{r.randrange(999)}.test/{r.randrange(99)})" for _ in range(n // 2))
    w = "compiler client build reader class method field type interface tool price jar".split()
    return " ".join(r.choice(w) for _ in range(n * 2))


def corpus(r, n=300):
    docs, truth = [], {}
    for i in range(n):
        bad = r.random() < 0.3
        a, b = (r.randrange(2, 4), r.randrange(60, 90)) if bad else (r.randrange(20, 40), r.choice([0, 0, 6]))
        docs.append((i, sentences(r, a) + "\n\n" + (stuffed(r, b) if b else "")))
        truth[i] = bad
    return docs, truth


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id bigint, text string, share string")
    return d, spark.createDataFrame([(i, "r", y, "c") for i, y in labels], "doc_id bigint, rater string, stuffed int, doc string")


def test_held_out_accuracy(spark):
    r = random.Random(0)
    docs, truth = corpus(r)
    labels = [(i, int(truth[i]) if r.random() > 0.05 else 1 - int(truth[i])) for i in range(150)] + [(1, None)]
    got = {x["doc_id"]: x["stuffed"] for x in S.stuffed_documents(*frames(spark, docs, labels)).collect()}
    wrong = [i for i in range(150, 300) if got[i] != truth[i]]
    assert len(wrong) <= 3


@pytest.mark.parametrize("hot", [200_000, 30])
def test_mean_pmi_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_PAIRS", hot)
    docs, _ = corpus(random.Random(1), 40)
    d, _ = frames(spark, docs, [])
    got = {(x["doc"], x["seg"]): x for x in S.segment_measures(Stages(spark, "t"), d, "doc_id", "text").collect()}
    segs = {(i, n): [S._norm(w) for w in ws] for i, t in docs for n, (_, ws) in enumerate(S.segments(t))}
    uni = Counter(w for ws in segs.values() for w in ws)
    rare = {w for w, c in uni.items() if c * S.VOCABULARY < sum(uni.values())}
    pairs = Counter(p for ws in segs.values() for p in zip(ws, ws[1:]))
    assert not rare
    left, right, n = Counter(), Counter(), sum(pairs.values())
    for (a, b), c in pairs.items():
        left[a] += c
        right[b] += c
    assert set(got) == set(segs)
    for k, ws in segs.items():
        v = [math.log(pairs[p] * n / (left[p[0]] * right[p[1]])) for p in zip(ws, ws[1:])]
        assert got[k]["pmi"] == pytest.approx(sum(v) / max(1, len(v)), abs=1e-6)
        assert got[k]["loose"] == pytest.approx(sum(x < S.LOOSE_PMI for x in v) / max(1, len(v)))


@pytest.mark.parametrize(("hot", "vocabulary"), [(200_000, 20), (30, 20), (30, 1)])
def test_rare_words_have_counts_of_their_own(spark, monkeypatch, hot, vocabulary):
    monkeypatch.setattr(S, "HOT_PAIRS", hot)
    monkeypatch.setattr(S, "VOCABULARY", vocabulary)
    docs, _ = corpus(random.Random(2), 20)
    d, _ = frames(spark, docs, [])
    got = {(x["doc"], x["seg"]): x for x in S.segment_measures(Stages(spark, "t"), d, "doc_id", "text").collect()}
    segs = {(i, n): [S._norm(w) for w in ws] for i, t in docs for n, (_, ws) in enumerate(S.segments(t))}
    uni = Counter(w for ws in segs.values() for w in ws)
    rare = {w for w, c in uni.items() if c * vocabulary < sum(uni.values())}
    assert len(rare) > 10
    pairs = Counter(p for ws in segs.values() for p in zip(ws, ws[1:]))
    left, right, n = Counter(), Counter(), sum(pairs.values())
    for (a, b), c in pairs.items():
        left[a] += c
        right[b] += c
    assert set(got) == set(segs)
    for k, ws in segs.items():
        v = [math.log(pairs[p] * n / (left[p[0]] * right[p[1]])) for p in zip(ws, ws[1:])]
        assert got[k]["pmi"] == pytest.approx(sum(v) / max(1, len(v)), abs=1e-6)
        few = {p: min(left[p[0]], right[p[1]]) for p in zip(ws, ws[1:])}
        firm = [x * (pairs[p] - 1) / pairs[p] * few[p] / (few[p] + 1) for p, x in zip(zip(ws, ws[1:]), v)]
        assert got[k]["firm"] == pytest.approx(sum(firm) / max(1, len(v)), abs=1e-6)
        assert got[k]["rare"] == pytest.approx(sum(w in rare for w in ws) / max(1, len(ws)))


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n\n\t"), (4, "x" * 200_000), (5, "one"), (6, "日本語。" * 500), (None, "y"), (7, "​­"), (8, "a b c"), (8, "a b c")]
    got = {r["doc_id"]: r for r in S.stuffed_documents(*frames(spark, docs, [])).collect()}
    assert {4, 5, 6, 8} <= set(got) <= {4, 5, 6, 7, 8}
    assert all(0 <= r["share"] <= 1 for r in got.values())
    assert S.stuffed_documents(*frames(spark, [], [])).collect() == []


def test_segments_keep_every_word():
    t = "One two three. Four five!\n\n" + "w " * 500 + "\nlast"
    assert [w for _, ws in S.segments(t) for w in ws] == S._ASCII_WORD.findall(t)
    assert all(len(ws) <= S.SEGMENT_WORDS for _, ws in S.segments(t))


def test_fit_without_labels_keeps_the_prior():
    w = S.fit(np.empty((0, len(S.FEATURES))), np.empty(0), np.empty(0, dtype=int), np.empty(0))
    assert w[-1] == S.PRIOR["bias"]
