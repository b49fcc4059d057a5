import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from evolvent.operators import incremental, mutations
from evolvent.operators import report as R

RAW = (
    "bc_id bigint, report_id bigint, lib string, ver_old string, ver_new string, impacted_type string, impacted_symbol string, kind string, file string, line int, "
    "new_symbol string, found_at timestamp, nature string"
)
T0 = dt.datetime(2020, 1, 1)


def raw(i, kind, t="p.A", s="p.A.m()", at=0, file="p/A.java", new=None):
    return (i, 1, "l", "1", "2", t, s, kind, file, 3, new, T0 + dt.timedelta(days=at), "x")


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        raw(1, "type-removed", s="p.A"), raw(1, "type-removed", s="p.A"), raw(2, "FIELD_REMOVED; method now final", "p.A$B", "p.Base.f"), raw(3, "nonsense"), raw(4, None),
        raw(5, "Type.New.Abstract.Method", "q.internal.C", "q.internal.C", file=None, new="q.C.x()"), raw(6, "METHOD_NOW_STATIC", at=1), raw(6, "nonsense", at=0),
    ]
    return R.normal_report(spark.createDataFrame(rows, RAW))


def ids(df):
    return sorted((r["bc_id"], r["kind"]) for r in df.collect())


def test_normal_form(found):
    assert ids(found) == [(1, "TYPE_REMOVED"), (2, "FIELD_REMOVED"), (2, "METHOD_NOW_FINAL"), (5, "TYPE_NEW_ABSTRACT_METHOD"), (6, "METHOD_NOW_STATIC")]


def test_exclusions_cover_nested_types(found):
    assert ids(R.exclude_by_name(found, [r"p\.A"])) == [(5, "TYPE_NEW_ABSTRACT_METHOD")]
    assert len(ids(R.exclude_by_name(found, []))) == 5


def test_accepted_changes(spark, found, tmp_path):
    f = tmp_path / "accepted.csv"
    f.write_text("type;symbol;kind;note\n# comment\n\n p.A ; p.A ; TYPE_REMOVED ; ok\n")
    assert (1, "TYPE_REMOVED") not in ids(R.accept(found, R.read_accepted(spark, str(f))))
    for bad in ("p.A;p.A\n", "p.A;p.A;NO_KIND\n"):
        f.write_text(bad)
        with pytest.raises(Exception, match="too few columns|unknown kind"):
            R.read_accepted(spark, str(f)).collect()


def test_a_report_serves_as_accepted_changes(spark, found, tmp_path):
    R.write_csv(found, str(tmp_path / "r"))
    assert ids(R.accept(found, R.read_accepted(spark, str(tmp_path / "r")))) == []


def test_writers(found, tmp_path):
    for name in R.WRITERS:
        R.write_report(found, name, str(tmp_path / "a" / f"{name}.out"))
    rows = json.loads((tmp_path / "a" / "JSON.out").read_text())
    assert [r["kind"] for r in rows] == ["TYPE_REMOVED", "METHOD_NOW_STATIC", "FIELD_REMOVED", "METHOD_NOW_FINAL", "TYPE_NEW_ABSTRACT_METHOD"]
    assert rows[0]["location"] == {"path": "p/A.java", "line": 3} and rows[-1]["location"] is None and rows[-1]["newSymbol"] == "q.C.x()"
    text = (tmp_path / "a" / "CLI.out").read_text()
    assert text.startswith("5 breaking changes (4 binary, 4 source)") and "p.Base.f FIELD_REMOVED in p.A$B" in text and "+ q.internal.C" in text
    assert (tmp_path / "a" / "MD.out").read_text().count("| p.A |") == 2 and "<td>p.A$B</td>" in (tmp_path / "a" / "HTML.out").read_text()
    none = found.limit(0)
    assert "".join(R.as_text(none)) == "No breaking changes.\n" and json.loads("".join(R.as_json(none))) == []
    assert (R.exit_code(found), R.exit_code(none), R.exit_code(found, "none"), R.exit_code(found.where("kind = 'METHOD_NOW_STATIC'"), "source")) == (1, 0, 0, 0)


def test_summaries(found):
    assert R.summary(found).first()["total"] == 5
    assert {r["impacted_symbol"]: r["kinds"] for r in R.by_member(found).collect()}["p.Base.f"] == "FIELD_REMOVED,METHOD_NOW_FINAL"
    assert {r["impacted_type"]: (r["n"], r["source_breaking"]) for r in R.by_type(found).collect()} == {"p.A": (2, True), "p.A$B": (2, True), "q.internal.C": (1, True)}
    assert R.rollup(found).where("level = 7").first()["n"] == 5


def test_annotation_values(spark):
    a = spark.createDataFrame([([("p.Beta", [("since", "2")])],), ([],), (None,)], "annotations array<struct<fqn:string,entries:array<struct<key:string,value:string>>>>")
    hit = lambda **v: [r[0] for r in a.select(R.has_annotation(F.col("annotations"), F.lit("p.Beta"), v)).collect()]
    assert hit() == [True, False, False] and hit(since="2") == [True, False, False] and hit(since="3") == [False] * 3


def test_changed_files(spark):
    f = lambda *r: spark.createDataFrame(list(r), "path string, hash string, modified int")
    old, new = f(("a", "1", 1), ("b", "1", 1), ("c", None, 1), ("gone", "1", 1)), f(("a", "1", 9), ("b", "2", 1), ("c", None, 1), ("new", "1", 1))
    assert {r["path"]: r["status"] for r in incremental.changed_files(old, new, ["path"]).collect()} == {"b": "updated", "c": "updated", "gone": "deleted", "new": "created"}
    assert {r["path"]: r["status"] for r in incremental.changed_since(old, new, ["path"], 5).collect()} == {"a": "updated", "gone": "deleted", "new": "created"}


def test_scan_and_incremental_build(spark, tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    for n in ("A", "B", "package-info"):
        (tmp_path / f"src/p/{n}.java").write_text(f"class {n} {{}}")
    first = incremental.scan_files(spark, str(tmp_path / "src")).toPandas()
    assert sorted(first["path"]) == ["p/A.java", "p/B.java"]
    (tmp_path / "src/p/B.java").write_text("class B2 {}")
    changes = incremental.changed_files(spark.createDataFrame(first), incremental.scan_files(spark, str(tmp_path / "src")), ["path"])
    assert [tuple(r) for r in changes.collect()] == [("p/B.java", "updated")]
    t = lambda *r: spark.createDataFrame(list(r), "path string, fqn string")
    built = incremental.incremental_build(t(("p/A.java", "A"), ("p/B.java", "B")), t(("p/A.java", "A!"), ("p/B.java", "B2")), changes, ["path"])
    assert sorted(r["fqn"] for r in built.collect()) == ["A", "B2"]


def test_synthetic_api_and_mutations(spark):
    types, execs, fields = mutations.synthetic_api(spark)
    assert execs.count() == types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").count() * 8 * 3 * 5
    full = execs.selectExpr("*", "CAST(NULL AS array<string>) AS thrown", "CAST(NULL AS array<struct<name:string,ref:string,varargs:boolean>>) AS params")
    t = types.selectExpr("*", "CAST(NULL AS string) AS super_ref", "CAST(NULL AS array<string>) AS interface_refs")
    space = mutations.mutation_space(t, full, fields)
    out = {r["strategy"]: (r["n_ok"], r["n_impossible"]) for r in mutations.strategy_outcomes(space).collect()}
    assert out["RemoveMethod"] == (execs.count(), 0) and out["RemoveParameterMethod"] == (0, execs.count()) and out["RemoveSuperClassClass"][0] == 0


def test_confusion(spark):
    rows = spark.createDataFrame([("x", True, True), ("x", True, False), ("x", False, True), ("x", False, False), ("y", False, False)], "g string, truth boolean, said boolean")
    got = {r["g"]: r for r in mutations.confusion(rows, "g", "truth", "said").collect()}
    assert (got["x"]["accuracy"], got["x"]["f1"], got["y"]["precision"]) == (0.5, 0.5, 0.0)


def test_rebuilding_sees_every_declared_value(spark):
    t0 = {"kind": "CLASS", "visibility": "PUBLIC", "modifiers": None, "super_ref": None, "interface_refs": None, "tps": None, "enclosing": None, "permitted": None, "annotations": None, "targets": None}
    new = {
        "modifiers": ["final"], "interface_refs": ["q.I"], "tps": [("T", ["q.B"])], "enclosing": "p.Out", "permitted": ["p.X"],
        "annotations": [("q.Beta", {"since": "2"})], "targets": ["METHOD"],
    }
    types = [("l", v, f"p.T{c}", *(t0 | ({c: x} if v == "2" else {})).values(), f"{c}.java", T0) for c, x in new.items() for v in "12"]
    types += [("l", v, f"p.T{c}", *t0.values(), f"{c}.java", T0) for c in ("method", "field", "same") for v in "12"]
    schema = (
        "lib string, ver string, fqn string, kind string, visibility string, modifiers array<string>, super_ref string, interface_refs array<string>, tps array<struct<name:string,bounds:array<string>>>, "
        "enclosing string, permitted array<string>, annotations array<struct<fqn:string,values:map<string,string>>>, targets array<string>, file string, loaded_at timestamp"
    )
    types = spark.createDataFrame(types, schema)
    execs = [("l", v, o, n, "METHOD", "PUBLIC", None, "void", None, None, None, False, int(v)) for o, n in (("p.Tmethod", "m"), ("p.Tsame", "s")) for v in "12"]
    execs.append(("l", "2", "p.Tmethod", "more", "METHOD", "PUBLIC", None, "void", None, None, None, False, 1))
    execs = spark.createDataFrame(
        execs, "lib string, ver string, owner string, name string, exec_kind string, visibility string, modifiers array<string>, return_ref string, "
        "params array<struct<name:string,ref:string,varargs:boolean>>, tps array<struct<name:string,bounds:array<string>>>, thrown array<string>, has_default boolean, line int",
    )
    fields = [("l", v, "p.Tfield", "f", "PUBLIC", None, r, False, None, 1) for v, r in (("1", "int"), ("2", "long"))]
    fields = spark.createDataFrame(fields, "lib string, ver string, owner string, name string, visibility string, modifiers array<string>, type_ref string, is_const boolean, file string, line int")
    execs, fields = (d.withColumn("org", F.lit("o")) for d in (execs, fields))
    snaps = spark.createDataFrame([("l", v, T0 + dt.timedelta(days=int(v)), "DELIVERED") for v in "12"], "lib string, ver string, taken_at timestamp, state string")
    changes = incremental.changed_files(*incremental.declaration_files(types, execs, fields, snaps), ["lib", "ver", "file"])
    assert {r["file"] for r in changes.collect()} == {f"{c}.java" for c in (*new, "method", "field")}
    rebuilt = {r["fqn"]: r for r in incremental.rebuilt_types(types, execs, fields, snaps).collect()}
    want = {r["fqn"]: r for r in types.where("ver = '2'").collect()}
    assert set(rebuilt) == set(want) and all(r[c] == want[k][c] for k, r in rebuilt.items() for c in t0)
    methods, members = incremental.rebuilt_members(types, execs, fields, snaps)
    assert sorted(r["name"] for r in methods.collect()) == ["m", "more", "s"] and [r["type_ref"] for r in members.collect()] == ["long"]
