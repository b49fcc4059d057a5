import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evolvent.operators import snapshot_diff as S

SNAP = "lib string, ver string, taken_at timestamp, state string, seq int"
TYPE = "lib string, ver string, fqn string, k bigint, loaded_at timestamp"
EXEC = (
    "lib string, ver string, owner string, name string, exec_kind string, visibility string, modifiers array<string>, return_ref string, "
    "params array<struct<name:string,ref:string,varargs:boolean>>, tps array<struct<name:string,bounds:array<string>>>, thrown array<string>, "
    "has_default boolean, line int, h0 string"
)
FIELD = "lib string, ver string, owner string, name string, visibility string, modifiers array<string>, type_ref string, is_const boolean, file string, line int"
T0 = dt.datetime(2020, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def method(lib, ver, owner, name, kind="METHOD", mods=None, params=(), tps=None, thrown=None, line=1, ret="void", vis="PUBLIC"):
    return (lib, ver, owner, name, kind, vis, mods, ret, [(f"a{line}", p, False) for p in params], tps, thrown, False, line, "x")


def run(spark, snaps, types, execs, fields, **kw):
    df = S.snapshot_changes(
        spark.createDataFrame(snaps, SNAP), spark.createDataFrame(types, TYPE), spark.createDataFrame(execs, EXEC), spark.createDataFrame(fields, FIELD), **kw
    )
    return sorted(tuple(r) for r in df.select("lib", "ver", "fqn", "change").collect())


def test_empty_tables_give_no_rows(spark):
    assert run(spark, [], [], [], []) == []


def test_added_removed_changed_and_what_does_not_count(spark):
    snaps = [("l", "9", day(1), "DELIVERED", 7), ("l", "9", day(1), "DELIVERED", 7), ("l", "10", day(2), "DELIVERED", 7), ("l", "x", day(1.5), "FAILED", 7), ("l", None, day(3), "DELIVERED", 1)]
    t = [("l", v, f, 1, day(0)) for v, f in [("9", "A"), ("9", "B"), ("10", "A"), ("10", "C"), ("10", "C"), ("9", None), ("9", "D"), ("10", "D"), ("10", "E"), ("9", "E")]]
    execs = [
        method("l", "9", "A", "m", mods=["FINAL", "STATIC"], thrown=None, line=1, tps=[("T", None)]),
        method("l", "10", "A", "m", mods=["STATIC", "FINAL", "STATIC"], thrown=[], line=9, tps=[("T", [])]),
        method("l", "10", "A", "<init>", kind="CONSTRUCTOR"),
        method("l", "9", "D", "m", params=["int"]),
        method("l", "10", "D", "m", params=["long"]),
        method("l", "10", None, "lost"),
        method("l", "10", "Nowhere", "lost"),
    ]
    fields = [("l", "9", "E", "f", "PUBLIC", None, "int", False, "a", 1), ("l", "10", "E", "f", "PUBLIC", [], "int", True, "b", 2)]
    expect = [("l", "10", "B", "removed"), ("l", "10", "C", "added"), ("l", "10", "D", "changed"), ("l", "10", "E", "changed")]
    assert run(spark, snaps, t, execs, fields) == expect


def test_values_that_shift_between_columns_differ(spark):
    snaps = [("l", "1", day(1), "DELIVERED", 0), ("l", "2", day(2), "DELIVERED", 0)]
    types = [("l", v, "A", 0, day(0)) for v in "12"]
    a, b = list(method("l", "1", "A", "m")), list(method("l", "2", "A", "m"))
    a[4], a[5] = None, "METHOD"
    b[4], b[5] = "METHOD", None
    assert run(spark, snaps, types, [tuple(a), tuple(b)], []) == [("l", "2", "A", "changed")]


def brute(snaps, types, execs):
    order = {}
    for lib, ver, at, state, _ in snaps:
        if state == "DELIVERED":
            order.setdefault(lib, {}).setdefault(ver, at)
    have = {}
    for lib, ver, fqn, *_ in types:
        have.setdefault((lib, ver), set()).add(fqn)
    sets = {}
    for e in execs:
        if e[4] != "CONSTRUCTOR":
            sets.setdefault((e[0], e[1], e[2]), set()).add((e[3], e[5], frozenset(e[6] or []), e[7], tuple(p[1] for p in e[8]), frozenset(e[10] or [])))
    out = []
    for lib, vs in order.items():
        seq = sorted(vs, key=lambda v: (vs[v], v))
        for old, new in zip(seq, seq[1:]):
            a, b = have.get((lib, old), set()), have.get((lib, new), set())
            out += [(lib, new, f, "added") for f in b - a] + [(lib, new, f, "removed") for f in a - b]
            out += [(lib, new, f, "changed") for f in a & b if sets.get((lib, old, f), set()) != sets.get((lib, new, f), set())]
    return sorted(out)


@pytest.mark.parametrize("hot,broadcast", [(10**6, 10**6), (3, 10**6), (10**6, 0)])
def test_against_brute_force_also_with_hot_buckets_and_without_broadcast(spark, monkeypatch, hot, broadcast):
    monkeypatch.setattr(S, "BROADCAST_SNAPSHOTS", broadcast)
    r = random.Random(5)
    snaps, types, execs = [], [], []
    for lib in "pq":
        for i, v in enumerate(["3", "1", "2", "7"]):
            snaps.append((lib, v, day(i), "FAILED" if (lib, v) == ("q", "2") else "DELIVERED", 0))
            for f in "ABCDEFGH":
                if r.random() < 0.7 and (lib, v) != ("q", "2"):
                    types += [(lib, v, f, 0, day(0))] * r.choice([1, 1, 3])
                    for m in "xy":
                        if r.random() < 0.8:
                            e = method(lib, v, f, m, r.choice(["METHOD", "CONSTRUCTOR"]), r.choice([None, ["A"], ["A", "B"], ["B", "A"]]), r.choice([[], ["int"]]), line=r.randrange(9))
                            execs += [e] * r.choice([1, 2])
    assert run(spark, snaps, types, execs, [], hot_rows=hot) == brute(snaps, types, execs)


def test_changed_values_shows_both_sides(spark):
    snaps = spark.createDataFrame([("l", "1", day(1), "DELIVERED", 0), ("l", "2", day(2), "DELIVERED", 0)], SNAP)
    types = spark.createDataFrame([("l", v, "A", 0, day(0)) for v in "12"], TYPE)
    execs = spark.createDataFrame([method("l", "1", "A", "m"), method("l", "2", "A", "n"), method("l", "1", "A", "s"), method("l", "2", "A", "s")], EXEC)
    fields = spark.createDataFrame([], FIELD)
    c = S.snapshot_changes(snaps, types, execs, fields)
    got = S.changed_values(c, snaps, execs, "owner", S.method_fingerprint(), F.col("name"))
    assert sorted(map(tuple, got.collect())) == [("l", "2", "A", "new", "n"), ("l", "2", "A", "old", "m")]


def test_index_advances_and_swaps(spark, tmp_path):
    x = S.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["key"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, v int")
    h, out = F.xxhash64("v"), str(tmp_path / "out")
    assert x.advance(rows(("a", 1), ("b", 1), (None, 5)), h, out, "1").collect() == []
    got = {r["key"]: r["change"] for r in x.advance(rows(("a", 2), ("a", 2), ("c", 1)), h, out, "2").collect()}
    assert got == {"a": "changed", "b": "removed", "c": "added"}
    assert x.advance(rows(("a", 2), ("c", 1)), h, out, "3").collect() == []
    assert len([p for p in (tmp_path / "ix").iterdir() if p.name.startswith("index-")]) == 1


def test_a_lost_run_loses_no_changes(spark, tmp_path, monkeypatch):
    """A run that dies before its changes are written, or between them and the swap, is repeated with the same result."""
    x = S.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["key"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, v int")
    h, out = F.xxhash64("v"), str(tmp_path / "out")
    x.advance(rows(("a", 1), ("b", 1)), h, out, "1")
    new = rows(("a", 2), ("c", 1))
    for what in ("changes", "swap"):
        with monkeypatch.context() as m:
            m.setattr(S.SnapshotIndex, what, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                x.advance(new, h, out, "2")
    want = {"a": "changed", "b": "removed", "c": "added"}
    assert {r["key"]: r["change"] for r in x.advance(new, h, out, "2").collect()} == want
    # Once in force, the step is not done again.
    assert {r["key"]: r["change"] for r in S.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["key"], buckets=4).advance(new, h, out, "2").collect()} == want


def test_the_index_is_probed_in_its_buckets(spark, tmp_path):
    x = S.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["key"], buckets=4)
    a, b = (x._table(*x.write(spark.createDataFrame([(k, v)], "key string, v int"), F.xxhash64("v"))) for k, v in (("a", 1), ("b", 2)))
    plan = x.changes(a.hint("merge"), b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
