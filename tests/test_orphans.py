import datetime as dt

import pytest

from evolvent.operators import orphans as O

TYPE = "lib string, ver string, fqn string, super_ref string, interface_refs array<string>, enclosing string, loaded_at timestamp, target string, level int"
SNAP = "lib string, ver string, taken_at timestamp, state string"
T0 = dt.datetime(2020, 1, 1)


def t(ver, fqn, sup=None, ifs=None, enc=None, at=0, lib="l"):
    return (lib, ver, fqn, sup, ifs, enc, T0 + dt.timedelta(hours=at), "clash", 3)


def snaps(spark):
    return spark.createDataFrame([("l", v, T0 + dt.timedelta(days=i), "DELIVERED") for i, v in enumerate("123")] * 2, SNAP)


def run(spark, types, **kw):
    df = O.orphan_references(
        spark.createDataFrame(types, TYPE), spark.createDataFrame([("java.lang.Object", "CLASS"), (None, None)], "fqn string, kind string"), snaps(spark), **kw
    )
    return sorted(map(tuple, df.collect()))


ROWS = [
    t("1", "gone.A"), t("3", "late.A"), t("1", "x.Z"),
    t("2", "a.A", "gone/A<T>", [None, "", " ", "late.A", "late.A ", "\tnever.A <X>"], "java/lang/Object"),
    t("2", "a.B", "a.A"), t("2", "a.C", "a.B", ["a.A"]), t("2", "a.Old", "never.Old", at=0), t("2", "a.Old", "java.lang.Object", at=1),
    t("2", "a.L", "a.L", enc="a.C"), t("2", None, "nope.X"), t("9", "u.U", "never.U"),
]
DIRECT = [
    ("l", "2", "a.A", "interface_refs", "late.A", "later", 0),
    ("l", "2", "a.A", "interface_refs", "never.A", "missing", 0),
    ("l", "2", "a.A", "super_ref", "gone.A", "deleted", 0),
    ("l", "9", "u.U", "super_ref", "never.U", "missing", 0),
]
INHERITED = [
    ("l", "2", "a.B", "super_ref", "a.A", "inherited", 1),
    ("l", "2", "a.C", "interface_refs", "a.A", "inherited", 1),
    ("l", "2", "a.L", "enclosing", "a.C", "inherited", 2),
]


@pytest.mark.parametrize("group", [1000, 0])
def test_direct_and_inherited(spark, group):
    assert run(spark, ROWS * 2, group_rows=group) == sorted(DIRECT + INHERITED)


def test_large_known_set_takes_the_distributed_rounds(spark, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_KNOWN", 0)
    monkeypatch.setattr(O, "BROADCAST_FRONTIER", 0)
    assert run(spark, ROWS) == sorted(DIRECT + INHERITED)


@pytest.mark.parametrize("group", [1000, 0])
def test_empty(spark, group):
    assert run(spark, [], group_rows=group) == []


def test_report(spark):
    o = O.orphan_references(spark.createDataFrame(ROWS, TYPE), spark.createDataFrame([], "fqn string"), snaps(spark))
    got = {(r["ref_field"], r["reason"], r["level"]): (r["n_refs"], r["n_types"]) for r in O.orphan_report(o, snaps(spark)).where("period = '2020-01'").collect()}
    assert got["super_ref", "deleted", 0] == (1, 1) and got["super_ref", "inherited", 1] == (1, 1)
