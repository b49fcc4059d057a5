"""Comparisons in the task that holds a library, against the distributed form of the same matches and rules."""

import datetime as dt
from collections import Counter

import pytest

from evolvent.model import EXEC_SCHEMA, FIELD_SCHEMA, SNAPSHOT_SCHEMA, TYPE_SCHEMA
from evolvent.operators.api_diff import ApiDiff
from evolvent.operators.api_model import ApiModel
from evolvent.operators.library_diff import LibraryDiff
from evolvent.plans.api_queries import QUERIES
from evolvent.session import Stages
from tests.test_rules import parsed, read_tables

T0 = dt.datetime(2020, 1, 1)
MATCH = ["lib", "ver", "fqn", "erasure", "status"]


def rows(df, cols=None) -> Counter:
    return Counter(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def odd_tables(spark):
    """Repeated and tied rows, nulls, loops, arguments of inherited members, equal erasures, exceptions that turn checked."""
    t = lambda v, f, kind="CLASS", vis="PUBLIC", mods=None, sup=None, ups=None, tps=None, enc=None, at=T0: (
        "o", "l", v, f, kind, vis, mods, sup, ups, tps, enc, None, [("x.Beta", {"k": "v"}), (None, None)], None, "F", 1, None, at
    )
    e = lambda v, o, n, params=(), kind="METHOD", vis="PUBLIC", mods=None, ret="void", tps=None, thrown=None, line=1: (
        "o", "l", v, o, n, kind, vis, mods, ret, [(f"a{i}", p, i == 9) for i, p in enumerate(params)] if params is not None else None, tps, thrown, False, line
    )
    types, execs, fields = [], [], []
    for v in "123":
        late = v != "1"
        types += [
            t(v, "p.G", "INTERFACE", tps=[("T", ["p.Up<T>"]), ("U", None)]), t(v, "p.Up", "INTERFACE", tps=[("E", None)]), t(v, "p.Raw", sup="p.Base", ups=["p.G"]),
            t(v, "p.Of", sup=" p/Base ", ups=["p.G < java.lang.String , int[] >", None, " "]), t(v, "p.Base", mods=["ABSTRACT"] if late else None, ups=["p.L1"] if late else ["p.L1", "p.Up<p.Of>"]),
            t(v, "p.L1", "INTERFACE", ups=["p.L2"]), t(v, "p.L2", "INTERFACE", ups=["p.L1"]), t(v, "p.L1$In", enc="p.L1", sup="p.Oops", tps=[("T", None)] if late else None),
            t(v, "p.Oops", sup="java.lang.Exception" if late else "java.lang.RuntimeException"), t(v, "p.Odd", None), t(v, "p.Gone" + v), t(v, "p.Note", "ANNOTATION"),
            t(v, "p.Base", mods=["FINAL"], at=None), t(v, "p.Of", vis="PROTECTED", sup="p.Base", at=T0), t(v, None), t(None, "p.X"),
        ]
        execs += [
            e(v, "p.G", "put", ["T", "java.util.List<U>[]"], mods=["ABSTRACT"], ret="T"), e(v, "p.G", "put", ["T", "java.util.List<U>[]"], mods=["ABSTRACT"], ret="T", line=None), e(v, "p.G", "any", ["V"], tps=[("V", ["T"])]),
            e(v, "p.Base", "go", thrown=["p.Oops", "java.io.IOException"] if late else ["p.Oops"]), e(v, "p.Base", "go", vis="PROTECTED", thrown=[None]), e(v, "p.Base", "hid", vis="PACKAGE_PRIVATE", mods=["ABSTRACT"] if late else []),
            e(v, "p.Base", "p.Base", (), "CONSTRUCTOR"), e(v, "p.Base", "p.Base", (), "CONSTRUCTOR", "PROTECTED", thrown=["p.Oops"]), e(v, "p.Of", "Of", (), "CONSTRUCTOR"), e(v, "p.Raw", "Raw", None, "CONSTRUCTOR"),
            e(v, "p.Raw", "put", ["java.lang.Object", "java.util.List[]"], mods=["FINAL"] if v == "3" else None, vis="PUBLIC"), e(v, "p.L1", "of", [None] * 10, mods=["STATIC"] if late else None), e(v, "p.L1", "none", vis=None),
            e(v, "p.Note", "value", ret="int" if late else "long", kind="ANNOTATION_METHOD"), e(v, "p.Nowhere", "m"), e(v, "p.L1$In", "in", ["T"], tps=[("T", None)] if v == "3" else None),
        ] + ([e(v, "p.Note", "more", kind="ANNOTATION_METHOD"), e(v, "p.L1", "fresh", mods=["ABSTRACT"])] if late else [])
        fields += [("o", "l", v, "p.Base", "f", "PROTECTED" if late else "PUBLIC", ["FINAL"] if late else None, "int" if late else "p.G<int[],T>", late, None, 3), ("o", "l", v, "p.L1", "f", "PUBLIC", [], None, None, "Z", None)]
    snaps = [("o", "l", v, T0 + dt.timedelta(days=int(v)), "DELIVERED", None, 1) for v in "123"] + [("o", "l", "9", T0, "FAILED", None, 1)]
    return tuple(spark.createDataFrame(r, s) for r, s in ((types, TYPE_SCHEMA), (execs, EXEC_SCHEMA), (fields, FIELD_SCHEMA), (snaps, SNAPSHOT_SCHEMA)))


@pytest.mark.parametrize("library_rows", [0, 200_000])
def test_both_forms_find_the_same_in_odd_libraries(spark, library_rows):
    tables = odd_tables(spark)
    whole, part = ApiDiff(ApiModel(*tables)), LibraryDiff(*tables, library_rows=library_rows)
    want = rows(whole.breaking_changes)
    assert len(want) > 20 and rows(part.breaking_changes(), whole.breaking_changes.columns) == want
    assert rows(part.method_match(), MATCH) == rows(whole.method_match, MATCH)


def test_both_forms_find_the_same_of_all_kinds(spark):
    tables = read_tables(spark, None, parsed)
    whole = ApiDiff(ApiModel(*tables)).breaking_changes
    assert rows(LibraryDiff(*tables).breaking_changes(), whole.columns) == rows(whole)


IN_TASKS = ["method_match", "breaking_changes", "breaking_changes_plain", "formal_parameter_counts", "new_obligations", "thrown_changes", "breaking_summary", "method_changes"]


@pytest.mark.parametrize("name", IN_TASKS)
def test_no_stage_is_written(spark, sf, monkeypatch, name):
    monkeypatch.setattr(Stages, "put", lambda *a: pytest.fail("a stage is written"))
    QUERIES[name](spark, sf).collect()
