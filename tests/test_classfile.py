import shutil
import subprocess

import pytest

from evolvent.sources import classfile as C

pytestmark = pytest.mark.skipif(shutil.which("javac") is None or shutil.which("jar") is None, reason="no Java tools")
SOURCE = """package p;
public abstract class A<T extends Comparable<T>> extends java.util.AbstractList<T> implements Runnable {
  public static final int K = 3; protected java.util.List<? extends T>[] xs; private int z; int hidden;
  public A(int... a) throws java.io.IOException {}
  public <U extends Number> java.util.Map<U, ? super T> m(java.util.List<U[]> x, String... r) throws IllegalStateException { new Object() {}; class Local {} return null; }
  public class In { public In(int z) {} private In() {} }
  public @interface An { int value() default 3; String[] names(); }
  public sealed interface Se permits R {}
  public record R(int a) implements Se {}
}
"""


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("jar")
    (tmp / "p").mkdir()
    (tmp / "p/A.java").write_text(SOURCE)
    (tmp / "module-info.java").write_text("module mod.a { exports p; exports p to other; }".replace(" exports p to other;", ""))
    subprocess.run(["javac", "-d", "out", "p/A.java", "module-info.java"], cwd=tmp, check=True)
    (tmp / "out/p/Broken.class").write_bytes((tmp / "out/p/A.class").read_bytes()[:90])
    (tmp / "out/p/note.class").write_bytes(b"no class file at all")
    (tmp / "v2/p").mkdir(parents=True)
    (tmp / "v2/p/A.java").write_text("package p; public class A { public int newer; }")
    subprocess.run(["javac", "-d", "out2", "v2/p/A.java"], cwd=tmp, check=True)
    (tmp / "jars").mkdir()
    subprocess.run(["jar", "cf", "jars/x.jar", "-C", "out", "."], cwd=tmp, check=True)
    (tmp / "vers/META-INF/versions/11/p").mkdir(parents=True)
    shutil.copy(tmp / "out2/p/A.class", tmp / "vers/META-INF/versions/11/p/A.class")
    shutil.copytree(tmp / "out/p", tmp / "vers/p")
    subprocess.run(["jar", "cf", "multi.jar", "-C", "vers", "."], cwd=tmp, check=True)
    return tmp


def test_scan_archives(spark, jar):
    d = C.scan_classes(spark, str(jar / "jars")).cache()
    tables = C.declaration_tables(d, "o", "l", "1")
    types = {r["fqn"]: r for r in tables["type_decl"].collect()}
    assert set(types) == {"p.A", "p.A$In", "p.A$An", "p.A$Se", "p.A$R"}
    a = types["p.A"]
    assert (a["super_ref"], a["interface_refs"], a["tps"][0]["bounds"], a["file"]) == ("java.util.AbstractList<T>", ["java.lang.Runnable"], ["java.lang.Comparable<T>"], "p/A.java")
    assert (types["p.A$R"]["kind"], types["p.A$Se"]["permitted"], types["p.A$In"]["enclosing"]) == ("RECORD", ["p.A$R"], "p.A")
    fields = {r["name"]: r for r in tables["field_decl"].where("owner = 'p.A'").collect()}
    assert set(fields) == {"K", "xs"} and fields["K"]["is_const"] and fields["xs"]["type_ref"] == "java.util.List<? extends T>[]"
    execs = {(r["owner"], r["name"]): r for r in tables["exec_decl"].collect()}
    m = execs["p.A", "m"]
    assert ([p["ref"] for p in m["params"]], m["params"][1]["varargs"], m["return_ref"], m["thrown"]) == (
        ["java.util.List<U[]>", "java.lang.String"], True, "java.util.Map<U,? super T>", ["java.lang.IllegalStateException"],
    )
    assert [p["ref"] for p in execs["p.A$In", "<init>"]["params"]] == ["int"] and execs["p.A$An", "value"]["has_default"]
    assert [tuple(r) for r in tables["module_export"].collect()] == [("l", "1", "p")]
    assert d.where("error IS NOT NULL").count() == 1


def test_multi_release_archives(spark, jar):
    for release, fields in ((8, {"K", "xs"}), (17, {"newer"})):
        d = C.scan_classes(spark, str(jar / "multi.jar"), release)
        t = C.declaration_tables(d, "o", "l", "1")["field_decl"].where("owner = 'p.A'")
        assert {r["name"] for r in t.collect()} == fields


def test_class_files_in_a_folder(spark, jar):
    d = C.scan_classes(spark, str(jar / "out2"))
    assert [r["entry"].rsplit("/", 1)[1] for r in d.collect()] == ["A.class"]
