import datetime as dt
from collections import Counter

import pytest

from evolvent.functions.typealg import Normalizer, Scope, World, erased, parse, render
from evolvent.model import BC_KINDS, EXEC_SCHEMA, FIELD_SCHEMA, SNAPSHOT_SCHEMA, TYPE_SCHEMA
from evolvent.operators.api_diff import ApiDiff
from evolvent.operators.api_model import ApiModel
from evolvent.sources.tables import table

T0 = dt.datetime(2020, 1, 1)


def read(spark, sf, **kw):
    return ApiModel(table(spark, sf, "type_decl"), table(spark, sf, "exec_decl"), table(spark, sf, "field_decl"), table(spark, sf, "api_snapshot"), **kw)


def test_rounds_equal_arrays_on_the_tables(spark, sf):
    a, b = read(spark, sf), read(spark, sf, group_rows=3)
    for name in ("ancestors", "props"):
        x, y = (Counter(str(sorted(r.asDict().items())) for r in getattr(m, name).drop("args").collect()) for m in (a, b))
        assert x == y


def test_no_rows(spark):
    none = [spark.createDataFrame([], s) for s in (TYPE_SCHEMA, EXEC_SCHEMA, FIELD_SCHEMA, SNAPSHOT_SCHEMA)]
    assert ApiDiff(ApiModel(*none)).breaking_changes.collect() == []


def test_self_comparison_finds_nothing(spark, sf):
    """Two snapshots of equal content have no finding, whatever the content is."""
    first = table(spark, sf, "api_snapshot").where("state = 'DELIVERED'").groupBy("lib").agg({"ver": "min"}).collect()
    keep = {r["lib"]: r["min(ver)"] for r in first}
    pick = spark.createDataFrame(list(keep.items()), "lib string, ver string")
    parts = []
    for name in ("type_decl", "exec_decl", "field_decl"):
        one = table(spark, sf, name).join(pick, ["lib", "ver"], "left_semi").drop("ver")
        parts.append(one.selectExpr("*", "'1' AS ver").unionByName(one.selectExpr("*", "'2' AS ver")))
    snaps = [("o", lib, v, T0 + dt.timedelta(days=int(v)), "DELIVERED", None, 1) for lib in keep for v in "12"]
    assert ApiDiff(ApiModel(*parts, spark.createDataFrame(snaps, SNAPSHOT_SCHEMA))).breaking_changes.collect() == []


def test_module_exports_hide_packages(spark):
    t = lambda v, f: ("o", "l", v, f, "CLASS", "PUBLIC", None, None, None, None, None, None, None, None, None, 1, None, T0)
    types = spark.createDataFrame([t("1", "a.A"), t("1", "b.B")], TYPE_SCHEMA)
    execs, fields = spark.createDataFrame([], EXEC_SCHEMA), spark.createDataFrame([], FIELD_SCHEMA)
    snaps = spark.createDataFrame([("o", "l", v, T0 + dt.timedelta(days=int(v)), "DELIVERED", None, 1) for v in "12"], SNAPSHOT_SCHEMA)
    exports = spark.createDataFrame([("l", "1", "a")], "lib string, ver string, pkg string")
    found = {r["impacted_type"] for r in ApiDiff(ApiModel(types, execs, fields, snaps, exports)).breaking_changes.collect()}
    assert found == {"a.A"}


def test_kinds():
    assert len(BC_KINDS) == 38 and len({k for k, *_ in BC_KINDS}) == 38


S, W = Scope(), World({})
LIST = "java.util.List"


@pytest.mark.parametrize("a,b,yes", [
    ("int", "int", True), ("int", "long", False), ("java.lang.String[]", "java.lang.Object[]", True), ("java.lang.String[]", "java.lang.Object", True), ("int[]", "java.lang.Object[]", False),
    ("int[][]", "java.lang.Object[]", True), ("java.util.ArrayList<java.lang.String>", f"{LIST}<java.lang.String>", True), (f"{LIST}<java.lang.String>", f"{LIST}<? extends java.lang.CharSequence>", True),
    (f"{LIST}<java.lang.Number>", f"{LIST}<? super java.lang.Integer>", True), (f"{LIST}<java.lang.String>", f"{LIST}<java.lang.Object>", False),
    (f"{LIST}<? super java.lang.Number>", f"{LIST}<? super java.lang.Integer>", True), (f"{LIST}<? super java.lang.Integer>", f"{LIST}<? super java.lang.Number>", False),
    (f"{LIST}<java.lang.String>", LIST, True), (LIST, f"{LIST}<java.lang.String>", False), ("java.util.ArrayList<java.lang.String>", "java.lang.Iterable<?>", True),
])
def test_subtypes(a, b, yes):
    assert W.subtype(S, parse(a), parse(b)) is yes


@pytest.mark.parametrize("a,b,yes", [
    ("int", "long", True), ("long", "int", False), ("int", "java.lang.Integer", True), ("java.lang.Integer", "int", True), ("java.lang.Integer", "long", True), ("java.lang.Long", "int", False),
    ("int", "java.lang.Number", True), ("int", "java.lang.Long", False), (LIST, f"{LIST}<java.lang.String>", True), (f"{LIST}<java.lang.String>", LIST, True), ("boolean", "int", False),
])
def test_assignment(a, b, yes):
    assert W.assignable(S, parse(a), parse(b)) is yes


def test_type_variables_by_their_bounds():
    s = Scope([("U", ["T"])], [("T", ["java.lang.String"])])
    v = lambda x: parse(x, s.names)
    assert W.subtype(s, v("U"), v("T")) and not W.subtype(s, v("T"), v("U")) and W.subtype(s, v("U"), v("java.lang.CharSequence"))
    assert render(erased(s, v("U[]"))) == "java.lang.String[]" and render(erased(s, v("java.util.Map<U,T>"))) == "java.util.Map"
    assert not W.subtype(Scope([("T", ["T"])]), parse("T"), parse("java.lang.String"))


def test_normal_forms_between_versions():
    n = Normalizer(([("A", [])], [("B", [])]), ([("T", ["java.lang.Number"]), ("X", [])], [("U", [])]))
    assert [render(n.old(parse(x))) for x in ("A", "T", "X", f"{LIST}<T[]>")] == ["B", "U", "java.lang.Object", f"{LIST}<U[]>"]
    m = Normalizer(([], [("T", ["java.lang.Number"])]))
    assert render(m.new(parse(f"{LIST}<? extends T>"))) == f"{LIST}<? extends java.lang.Number>"
    assert parse(" java/util/Map<K , ? super V[]>...") == ("A", ("C", "java.util.Map", (("V", "K"), ("W", False, (("A", ("V", "V"), 1),)))), 1)
