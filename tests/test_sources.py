import json
import shutil
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evolvent.__main__ import compare, main
from evolvent.sources import options as O
from evolvent.sources.classfile import declaration_tables, scan_classes
from evolvent.sources.javasource import read_unit, scan_sources, tokens
from evolvent.sources.json_snapshot import decode_payloads, reference, to_json
from evolvent.streaming.snapshots import SnapshotStream, windowed_findings

FILES = {
    "p/A.java": '''package p;
import java.util.*;
import java.io.IOException;
/** public class Fake {} */
@SuppressWarnings("x") public abstract class A<T extends Comparable<T> & java.io.Serializable> extends AbstractList<T> implements Runnable, Other.Inner {
  public static final int K = 1 + 2, L = "}{".length(); // }
  protected List<? extends T>[] xs[], ys = new ArrayList[]{ null };
  public static final String TEXT = """
     class X { """;
  private Map<String, List<T>> hidden = new HashMap<String, List<T>>() {{ put("a", null); }};
  static { int z = 3; }
  public A(final int... a) throws IOException { if (a.length > 0) { throw new IOException("}"); } }
  public <U extends Number, V> Map<U, ? super T> m(List<U[]> x, @Deprecated String r[], V... v) throws IllegalStateException { return null; }
  protected abstract Other.Inner inner(Map.Entry<String, ? extends In> e);
  public class In { public In(int z) {} public T held; }
  public enum E { X, Y { }; public int q; E() {} }
  public @interface An { int value() default 3; String[] names(); }
  public sealed interface Se permits R, R2 { default void d() {} static void s() {} void act(); int C = 4; }
  public record R(int a, String... b) implements Se { public static int q; public R { } public void act() {} }
  public record R2(List<String> l) implements Se { public void act() {} }
  final void pp() {} synchronized native void nn();
}
''',
    "p/Other.java": "package p; public class Other { public interface Inner {} protected static class Deep<X> { protected X x; public static <Y> Y y(Y a) { return a; } } }",
    "q/B.java": "package q; import p.Other; import p.*; public final class B { public Other.Inner one; public A.R two; public static volatile long[] three; B() {} public Object clone() { return null; } }",
    "q/package-info.java": "package q;",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("src")
    for name, text in FILES.items():
        (tmp / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp / "src" / name).write_text(text)
    return tmp


def model_of(decoded) -> dict[str, Counter]:
    """Tables without lines, order of sets, and the compiler's own members."""
    t = declaration_tables(decoded, "o", "l", "1")
    sets = lambda *cs: {c: F.array_sort(c) for c in cs}
    types = t["type_decl"].drop("annotations", "origin", "loaded_at", "line").withColumns(sets("modifiers", "interface_refs", "permitted"))
    names = F.transform("params", lambda p: F.struct(p["ref"], p["varargs"]))
    execs = t["exec_decl"].drop("line").withColumns({"params": names, **sets("modifiers", "thrown")}).where("visibility <> 'PRIVATE'")
    execs = execs.where("NOT (name IN ('values', 'valueOf', 'toString', 'hashCode', 'equals') AND owner RLIKE '[$](E|R|R2)$')")
    fields = t["field_decl"].drop("line").withColumns(sets("modifiers"))
    out = {}
    for name, df in (("types", types), ("execs", execs), ("fields", fields)):
        out[name] = Counter(str(r) for r in df.select(*sorted(df.columns)).collect())
    return out


@pytest.mark.skipif(shutil.which("javac") is None, reason="no Java compiler")
def test_sources_and_class_files_give_the_same_model(spark, tree):
    files = [str(tree / "src" / n) for n in FILES if "package-info" not in n]
    subprocess.run(["javac", "-nowarn", "-d", str(tree / "out"), *files], check=True, capture_output=True)
    a, b = model_of(scan_classes(spark, str(tree / "out"))), model_of(scan_sources(spark, str(tree / "src")))
    for k in a:
        assert (sorted((a[k] - b[k])), sorted((b[k] - a[k]))) == ([], []), k


def test_unreadable_sources(spark, tmp_path):
    (tmp_path / "Bad.java").write_text("public class Bad { void m( }")
    (tmp_path / "Empty.java").write_text("")
    (tmp_path / "module-info.java").write_text("module m { requires x; exports a.b; exports c to d; }")
    rows = scan_sources(spark, str(tmp_path)).collect()
    assert sum(r["error"] is not None for r in rows) == 1
    assert [r["module"]["exports"] for r in rows if r["module"]] == [["a.b"]]


def test_tokens():
    assert [x for x, _ in tokens('a /* b */ "c // d" // e\n\'"\' """x"y""" 1e-3f @interface ->')] == ["a", '"c // d"', "'\"'", '"""x"y"""', "1e-3f", "@interface", "->"]
    assert read_unit("class A { int a = 1 < 2 ? 3 : 4, b; Map<String, int[]> c = new M<A, B>(1, 2); }").types[0].fields[2]["ref"] == "Map<String,int[]>"


def test_references_of_json():
    n = {"refKind": "TypeReference", "qualifiedName": "a.L", "typeArguments": [{"refKind": "WildcardTypeReference", "bounds": ["x.Y"], "upper": False}, "T"]}
    assert reference(n) == "a.L<? super x.Y,T>"
    assert reference({"refKind": "ArrayTypeReference", "componentType": {"refKind": "PrimitiveTypeReference", "qualifiedName": "int"}, "dimension": 2}) == "int[][]"
    assert reference({"refKind": "WildcardTypeReference", "bounds": ["java.lang.Object"], "upper": True}) == "?" and reference(None) is None


def test_json_round_trip(spark, tree):
    t = declaration_tables(scan_sources(spark, str(tree / "src")), "o", "l", "1")
    rows = to_json(t["type_decl"], t["exec_decl"], t["field_decl"]).collect()
    whole = json.dumps({"library": {}, "module": {"qualifiedName": "m", "exports": ["p"]}, "allTypes": [json.loads(r["json"]) for r in rows]})
    back = decode_payloads(spark.createDataFrame([(1, whole), (2, None), (3, whole[:99])], "id bigint, payload string"), "id", "payload")
    assert back.where("error IS NOT NULL").count() == 2
    a, b = model_of(scan_sources(spark, str(tree / "src"))), model_of(back)
    for k in ("execs", "types", "fields"):
        strip = lambda c: Counter(__import__("re").sub(r"file=(None|'[^']*'), ", "", x) for x in c.elements())
        assert strip(a[k]) == strip(b[k]), k


def test_options(tmp_path):
    assert O.overlay({"a": None, "b": [], "c": {"d": 1}}, {"a": 1, "b": [2], "c": {"d": 0, "e": 5}}) == {"a": 1, "b": [2], "c": {"d": 1, "e": 5}}
    assert O.coordinates("g:a:1")["extension"] == "jar" and O.coordinates("g:a:1:zip:x")["classifier"] == "x"
    for bad in ("g:a", "g::1", "a:b:c:d:e:f"):
        with pytest.raises(ValueError):
            O.coordinates(bad)
    pytest.importorskip("yaml")
    f = tmp_path / "o.yaml"
    f.write_text("common:\n  excludes:\n    names: ['x.*']\nv1:\n  location: a.jar\nv2:\n  excludes:\n    names: ['y']\ndiff:\n  binaryOnly: true\n")
    o = O.load(str(f))
    assert O.effective(o, "v1")["excludes"]["names"] == ["x.*"] and O.effective(o, "v2")["excludes"]["names"] == ["y"]
    assert O.overlay({"diff": {"binaryOnly": None}}, o)["diff"]["binaryOnly"] is True


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import evolvent.__main__ as cli

    monkeypatch.setattr(cli, "get_session", lambda *a, **k: spark)
    for side, text in (("a", "public class A { public void m() {} public int f; }"), ("b", "public class A { public void m() {} }")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "A.java").write_text(f"package p; {text}")
    v1, v2 = str(tmp_path / "a"), str(tmp_path / "b")
    assert [r["kind"] for r in compare(spark, v1, v2).collect()] == ["FIELD_REMOVED"]
    out = tmp_path / "r" / "x.csv"
    assert main(["diff", "--v1", v1, "--v2", v2, "--report", f"CSV={out}", "--fail-on", "any"]) == 1
    assert "p.A.f FIELD_REMOVED" in capsys.readouterr().out and "p.A;p.A.f;FIELD_REMOVED;DELETION" in out.read_text()
    assert main(["diff", "--v1", v1, "--v2", v2, "--ignore", str(out), "--fail-on", "any"]) == 0
    assert main(["diff", "--v1", v1, "--v2", v2, "--exclude", r"p\.A", "--fail-on", "any"]) == 0
    assert main(["api", "--v1", v1, "--out", str(tmp_path / "t")]) == 0
    assert spark.read.parquet(str(tmp_path / "t/field_decl.parquet")).count() == 1
    with pytest.raises(SystemExit):
        main(["diff", "--v1", v1, "--v2", v2, "--binary-only", "--source-only"])


def test_stream_of_snapshots(spark, tmp_path):
    """Snapshots in several files each, taken once a later one begins or the stream is closed."""
    schema = "seq int, fqn string, v int"
    src = str(tmp_path / "in")
    stream = SnapshotStream(spark, src, schema, f"file://{tmp_path}/ix", str(tmp_path / "out"), str(tmp_path / "cp"), ["fqn"], F.xxhash64("v"), "seq")
    put = lambda seq, *rows: spark.createDataFrame([(seq, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(src)
    put(0, ("A", 1))
    put(0, ("B", 1), ("D", 4))
    stream.start().awaitTermination(120)
    put(0, ("E", 5))
    put(1, ("A", 2), ("C", 1))
    stream.start().awaitTermination(120)
    put(1, ("D", 4))
    put(2, ("A", 2))
    stream.start().awaitTermination(120)
    stream.close()
    got = {(r["seq"], r["fqn"]): r["change"] for r in stream.changes().collect()}
    assert got == {(1, "A"): "changed", (1, "B"): "removed", (1, "C"): "added", (1, "E"): "removed", (2, "C"): "removed", (2, "D"): "removed"}
    assert stream.index.current().count() == 1


def test_windowed_findings(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/bc_report.parquet").schema
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/bc_report.parquet", tmp_path / "in/a.parquet")
    df = windowed_findings(spark, str(tmp_path / "in"), schema)
    q = df.writeStream.outputMode("complete").format("memory").queryName("weekly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM weekly").first()[0] == spark.read.parquet(f"{sf}/bc_report.parquet").count()
