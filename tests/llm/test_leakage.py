import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evolvent.llm import leakage as L

DOC = "doc_id bigint, text string, item_id string"
ITEM = "item_id bigint, text string, doc_id string"
ITEM1 = "Why does the old method fail when a client calls the new sealed interface twice?"
ITEM2 = "Unrelated words here: does the old method fail when a client calls the new sealed interface without any cast"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], DOC)
    q = spark.createDataFrame([(i, t, "c") for i, t in items], ITEM)
    return d, [tuple(r) for r in L.leaked_passages(d, q, **kw).collect()]


def test_runs_offsets_and_items_that_share_a_passage(spark):
    hidden = "W​hy_does THE old­method".replace("­", " ") + "\n fail—when a ｃｌｉｅｎｔ calls the new sealed interface; end"
    docs = [(1, hidden), (2, ITEM1[:40]), (3, None), (4, ""), (5, "x " * 100_000 + ITEM1 + " y" * 1000), (6, ITEM1), (6, ITEM1)]
    _, got = run(spark, docs, [(10, ITEM1), (20, ITEM2), (30, "too short"), (40, None)])
    by = {}
    for d, i, n, a, b in got:
        by.setdefault((d, i), []).append((n, a, b))
    assert set(by) == {(1, 10), (1, 20), (5, 10), (5, 20), (6, 10), (6, 20)}
    n, a, b = by[1, 10][0]
    assert L.words(hidden[a:b]) == L.words(ITEM1)[:n] and n == 14 and hidden[a] == "W" and hidden[:b].endswith("interface")
    assert len(by[6, 10]) == 2 and by[5, 10][0][1] == 200_000


def test_blocks_give_the_same(spark):
    docs = [(1, ITEM1), (2, ITEM2)]
    _, one = run(spark, docs, [(10, ITEM1), (20, ITEM2)])
    _, two = run(spark, docs, [(10, ITEM1), (20, ITEM2)], block_chars=1)
    assert sorted(one) == sorted(two) and len(one) == 4


def test_empty(spark):
    assert run(spark, [], [(1, ITEM1)])[1] == [] and run(spark, [(1, ITEM1)], [])[1] == []


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice("ab")
    items = [(i, " ".join(word() for _ in range(16))) for i in range(6)]
    docs = [(i, " ".join(word() for _ in range(300))) for i in range(30)]
    expect = set()
    for i, t in items:
        w = t.split()
        grams = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for d, x in docs:
            y = x.split()
            if any(tuple(y[k : k + 8]) in grams for k in range(len(y) - 7)):
                expect.add((d, i))
    assert {(d, i) for d, i, *_ in run(spark, docs, items, run=8)[1]} == expect


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_spans_give_back_the_words(text):
    spans, w = L.word_spans(text), L.words(text)
    assert len(spans) == len(w)
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert all(x == tuple(sorted(x)) for x in spans) and spans == sorted(spans)
