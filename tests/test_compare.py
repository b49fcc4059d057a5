"""Comparisons end to end: exclusions, classpaths, incremental reading, snapshots as JSON, rule sets, paths of type arguments."""

import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

import evolvent.sources.javasource as J
from evolvent.__main__ import comparison, main, read_library
from evolvent.model import BC_KINDS, EXEC_SCHEMA, FIELD_SCHEMA, SNAPSHOT_SCHEMA, TYPE_SCHEMA
from evolvent.operators import incremental, report
from evolvent.operators.api_diff import ApiDiff, Rule, RuleSet, SymbolMatcher, o
from evolvent.operators.api_model import ApiModel
from evolvent.sources.json_snapshot import write_snapshot
from tests.test_api_model import T0


def tree(root, **files: str) -> str:
    for name, text in files.items():
        f = root / f"{name}.java"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"package p;\n{text}")
    return str(root)


def told(df) -> set[tuple[str, str]]:
    return {(r["impacted_type"], r["kind"]) for r in df.collect()}


OLD = {
    "Base": "@Shy(by = \"x\") public class Base { public int gone; }",
    "Heir": "public class Heir extends Base { public int own; public class Inner { public int in; } }",
    "Shy": "public @interface Shy { String by(); }",
}
NEW = {"Base": "@Shy(by = \"x\") public class Base { }", "Heir": "public class Heir extends Base { public class Inner { } }", "Shy": "public @interface Shy { String by(); }"}


def test_exclusions_go_by_the_declaring_type_and_what_encloses_it(spark, tmp_path):
    c = comparison(spark, tree(tmp_path / "a", **OLD), tree(tmp_path / "b", **NEW))
    every = {("p.Base", "FIELD_REMOVED"), ("p.Heir", "FIELD_REMOVED"), ("p.Heir$Inner", "FIELD_REMOVED")}
    assert told(c.reported()) == every and c.reported().count() == 4
    symbols = lambda df: sorted((r["impacted_type"], r["impacted_symbol"]) for r in df.collect())
    kept = [("p.Heir", "p.Heir.own"), ("p.Heir$Inner", "p.Heir$Inner.in")]
    assert symbols(c.reported([r"p\.Base"])) == kept
    assert symbols(c.reported([], [("p.Shy", {"by": "x"})])) == kept
    assert c.reported([], [("p.Shy", {"by": "y"})]).count() == 4
    assert symbols(c.reported([r"p\.Heir"])) == [("p.Base", "p.Base.gone"), ("p.Heir", "p.Base.gone")]
    assert symbols(c.reported([r".*\.own"])) == [("p.Base", "p.Base.gone"), ("p.Heir", "p.Base.gone"), ("p.Heir$Inner", "p.Heir$Inner.in")]


@pytest.mark.skipif(shutil.which("javac") is None, reason="no Java compiler")
def test_a_classpath_is_seen_but_not_reported(spark, tmp_path):
    """A superclass and an exception of a dependency: inherited members count, its own changes do not."""
    dep = tmp_path / "dep"
    tree(dep, Far="public class Far { public void kept() {} }", Oops="public class Oops extends Exception {}")
    subprocess.run(["javac", "-d", str(tmp_path / "jars"), *map(str, dep.glob("*.java"))], check=True)
    jars = [str(tmp_path / "jars")]
    v1 = tree(tmp_path / "a", A="public class A extends Far { public void go() throws Oops {} }", B="public class B extends Far {}")
    v2 = tree(tmp_path / "b", A="public class A { public void go() {} }", B="public class B extends Far {}")
    found = told(comparison(spark, v1, v2, (jars, jars)).breaking_changes)
    assert found == {("p.A", "TYPE_SUPERTYPE_REMOVED"), ("p.A", "EXECUTABLE_REMOVED"), ("p.A", "EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION")}
    # Without it the supertype is unresolved and the exception none.
    assert told(comparison(spark, v1, v2).breaking_changes) == {("p.A", "TYPE_SUPERTYPE_REMOVED")}


def test_incremental_reading_gives_the_same_findings(spark, tmp_path):
    a = tree(tmp_path / "a+b", **OLD)
    b = tree(tmp_path / "c" / "a+b", **NEW, Extra="public interface Extra { Heir heir(); }")
    whole, part = comparison(spark, a, b), comparison(spark, a, b, incremental=True)
    key = ["impacted_type", "impacted_symbol", "kind", "file", "line"]
    assert sorted(whole.breaking_changes.select(*key).collect()) == sorted(part.breaking_changes.select(*key).collect())
    _, new, changes = incremental.incremental_sources(spark, a, b)
    assert {(r["path"], r["status"]) for r in changes.collect()} == {("Base.java", "updated"), ("Heir.java", "updated"), ("Extra.java", "created")}
    heir = new.where("type.fqn = 'p.Extra'").selectExpr("execs[0].return_ref AS r").first()["r"]
    assert heir == "p.Heir"


def test_files_are_named_below_their_root(spark, tmp_path):
    for name in ("src/a/src/X.java", "src/X.java"):
        f = tmp_path / "a+b(1)" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(name)
    assert sorted(r["path"] for r in incremental.scan_files(spark, str(tmp_path / "a+b(1)")).collect()) == ["src/X.java", "src/a/src/X.java"]


def test_names_by_exchange_resolve_as_names_in_memory(spark, tmp_path, monkeypatch):
    path = tree(tmp_path / "a", **OLD, Use="import p.Heir.Inner; public class Use { public Inner a; public Heir.Inner b; public Shy c; public String d; }")
    rows = lambda: sorted(str(r.asDict(True)) for r in J.scan_sources(spark, path).drop("path", "entry").collect())
    want = rows()
    monkeypatch.setattr(J, "MOST_NAMES", 0)
    assert rows() == want and "p.Heir$Inner" in "".join(want)


def test_a_snapshot_is_written_and_read_back(spark, tmp_path):
    path = tree(tmp_path / "a", **OLD)
    tables = read_library(spark, path, "1")
    write_snapshot(tables, "lib", str(tmp_path / "s.json"))
    names = [t["qualifiedName"] for t in json.loads((tmp_path / "s.json").read_text())["allTypes"]]
    assert names == sorted(names) and len(names) == 4
    assert told(comparison(spark, path, str(tmp_path / "s.json")).breaking_changes) == set()


def test_options_reach_the_command_line(spark, tmp_path, monkeypatch, capsys):
    import evolvent.__main__ as cli

    pytest.importorskip("yaml")
    monkeypatch.setattr(cli, "get_session", lambda *a, **k: spark)
    a, b = tree(tmp_path / "a", **OLD), tree(tmp_path / "b", **NEW)
    y = tmp_path / "o.yaml"
    y.write_text(f"common:\n  excludes:\n    names: ['p.Heir']\n    annotations:\n      - name: p.Shy\n        args: {{by: x}}\nv1:\n  location: {a}\n  apiReport: {tmp_path}/v1.json\nv2:\n  location: {b}\n")
    assert main(["diff", "--options", str(y), "--fail-on", "any"]) == 0
    assert "No breaking changes" in capsys.readouterr().out and (tmp_path / "v1.json").exists()


def test_rules_and_matchers_can_be_replaced(spark, tmp_path):
    c = comparison(spark, tree(tmp_path / "a", A="public class A { public void m(int a) {} public int f; }"), tree(tmp_path / "b", A="public class A { public void m(long a) {} }"))
    assert told(c.breaking_changes) == {("p.A", "EXECUTABLE_REMOVED"), ("p.A", "FIELD_REMOVED")}
    rules = RuleSet(methods=[Rule("LONG_NAME", "REMOVED", F.length(o("symbol")) > 2)], fields=[], generic=False)
    assert told(ApiDiff(c.model, rules, kinds=[*BC_KINDS, ("LONG_NAME", "DELETION", False, False)]).breaking_changes) == {("p.A", "LONG_NAME")}
    assert told(ApiDiff(c.model, RuleSet(fields=[]), SymbolMatcher(methods="name")).breaking_changes) == set()
    events = {(r["scope"], r["status"], r["key"]) for r in c.events().collect()}
    assert {("type", "MATCHED", None), ("field", "REMOVED", "f"), ("method", "ADDED", "m(long)")} <= events


@pytest.mark.parametrize("group_rows", [0, 5000])
def test_type_arguments_come_by_the_nearest_path(spark, group_rows):
    """A raw path that comes first keeps its raw arguments; a parameterised one that comes first or is shorter gives its own."""
    t = lambda f, ups, tps=None: ("o", "l", "1", f, "INTERFACE", "PUBLIC", None, None, ups, tps, None, None, None, None, "F", 1, None, T0)
    rows = [
        t("G", None, [("T", None)]), t("P", ["G"]), t("Q", ["G<String>"]), t("PQ", ["P", "Q"]), t("QP", ["Q", "P"]), t("Far", ["PQ"]), t("Near", ["PQ", "G<Long>"]),
        t("H", ["G<ELEM>"], [("ELEM", None)]), t("RawH", ["H"]), t("OfH", ["H<int[]>"]),
    ]
    types = spark.createDataFrame(rows, TYPE_SCHEMA)
    e = ("o", "l", "1", "G", "g", "METHOD", "PUBLIC", ["ABSTRACT"], "T", [("a", "T", False)], None, None, False, 1)
    snaps = spark.createDataFrame([("o", "l", "1", T0, "DELIVERED", None, 1)], SNAPSHOT_SCHEMA)
    m = ApiModel(types, spark.createDataFrame([e], EXEC_SCHEMA), spark.createDataFrame([], FIELD_SCHEMA), snaps, group_rows=group_rows)
    got = {r["fqn"]: (r["erasure"], r["return_ref"]) for r in m.effective_methods.collect()}
    raw, string = ("g(java.lang.Object)", "T"), ("g(String)", "String")
    assert got == {
        "G": raw, "P": raw, "Q": string, "PQ": raw, "QP": string, "Far": raw, "Near": ("g(Long)", "Long"), "H": ("g(java.lang.Object)", "ELEM"),
        "RawH": ("g(java.lang.Object)", "java.lang.Object"), "OfH": ("g(int[])", "int[]"),
    }


def test_a_page_has_cards_packages_and_symbols(spark, tmp_path):
    c = comparison(spark, tree(tmp_path / "a", **OLD), tree(tmp_path / "b", **NEW))
    cards = c.model.api_card().withColumn("label", F.concat(F.lit("version "), "ver"))
    page = "".join(report.as_html(c.breaking_changes, cards))
    assert page.count("<section class=api>") == 2 and "<h2>p</h2>" in page and page.count("<th colspan=8>p.Base.gone</th>") == 2
