"""Small changes of Java: both versions of every case are read from class files and from sources and compared in one plan,
each case a library of its own. Findings are compared with their file, those from sources with their line too."""

import datetime as dt
import re
import shutil
import subprocess

import pytest

from evolvent.model import EXEC_SCHEMA, FIELD_SCHEMA, SNAPSHOT_SCHEMA, TYPE_SCHEMA
from evolvent.operators.api_diff import ApiDiff
from evolvent.operators.api_model import ApiModel
from evolvent.sources.classfile import decode
from evolvent.sources.javasource import declared, decode_unit, read_unit

pytestmark = pytest.mark.skipif(shutil.which("javac") is None, reason="no Java compiler")
T0 = dt.datetime(2020, 1, 1)


def case(name: str, old: str, new: str, *expected: str):
    """``old`` and ``new`` are files, each after a line ``= Name``; expected findings are ``type symbol kind Name:line``."""
    files = lambda text: dict(re.findall(r"^= (\w+)\n(.*?)(?=^= |\Z)", text, re.S | re.M))
    return name, files(old), files(new), sorted(tuple(e.rsplit(" ", 3)) if e.count(" ") == 3 else _split(e) for e in expected)


def _split(e: str) -> tuple[str, str, str, str]:
    """The symbol may hold spaces."""
    (type_, rest), (kind, place) = e.split(" ", 1), e.rsplit(" ", 2)[1:]
    return type_, rest[: -len(f" {kind} {place}")], kind, place


CASES = [
    case("type_withdrawn", "= Gauge\npublic interface Gauge {}\n= Dial\npublic class Dial {}\n", "= Dial\npublic class Dial {}\n", "Gauge Gauge TYPE_REMOVED Gauge:2"),
    case("hidden_enum_withdrawn", "= Knob\nenum Knob { UP }\n= Dial\npublic class Dial {}\n", "= Dial\npublic class Dial {}\n"),
    case("enum_to_class", "= Tide\npublic enum Tide { LOW }\n", "= Tide\npublic final class Tide { public static final Tide LOW = null; private Tide() {} }\n", "Tide Tide TYPE_KIND_CHANGED Tide:2"),
    case("inner_interface_narrowed", "= Mast\npublic class Mast {\n  public interface Rope {}\n}\n", "= Mast\npublic class Mast {\n  protected interface Rope {}\n}\n",
         "Mast$Rope Mast$Rope TYPE_NOW_PROTECTED Mast:3"),
    case("one_interface_less", "= Lamp\npublic abstract class Lamp implements Runnable, Cloneable {}\n", "= Lamp\npublic abstract class Lamp implements Runnable {}\n",
         "Lamp Lamp TYPE_SUPERTYPE_REMOVED Lamp:2"),
    case("unseen_interface_less", "= Hush\ninterface Hush {}\n= Lamp\npublic class Lamp implements Hush {}\n", "= Hush\ninterface Hush {}\n= Lamp\npublic class Lamp {}\n"),
    case("nearest_of_lost_supertypes", "= Coal\npublic class Coal extends java.util.ArrayList<String> {}\n", "= Coal\npublic class Coal extends java.util.AbstractList<String> { public String get(int i) { return null; } public int size() { return 0; } }\n",
         "Coal Coal TYPE_SUPERTYPE_REMOVED Coal:2"),
    case("interface_closed", "= Signal\npublic interface Signal {}\n= Beep\npublic record Beep(int hertz) implements Signal {}\n",
         "= Signal\npublic sealed interface Signal permits Beep {}\n= Beep\npublic record Beep(int hertz) implements Signal {}\n", "Signal Signal TYPE_NOW_SEALED Signal:2"),
    case("duty_added", "= Pump\npublic interface Pump {\n  void start();\n}\n", "= Pump\n\npublic interface Pump {\n  void start();\n  long flow();\n}\n", "Pump Pump TYPE_NEW_ABSTRACT_METHOD Pump:3"),
    case("duty_with_body_added", "= Pump\npublic interface Pump {}\n", "= Pump\npublic interface Pump { default long flow() { return 1; } static Pump of() { return null; } }\n"),
    case("oven_abstract", "= Oven\npublic class Oven {\n  public Oven(int heat) {}\n}\n", "= Oven\npublic abstract class Oven {\n  public Oven(int heat) {}\n}\n", "Oven Oven CLASS_NOW_ABSTRACT Oven:2"),
    case("constructor_shut", "= Vault\npublic class Vault {\n  public Vault() {}\n}\n", "= Vault\npublic class Vault {\n  private Vault() {}\n}\n",
         "Vault Vault CLASS_NOW_ABSTRACT Vault:2", "Vault Vault CLASS_NOW_FINAL Vault:2", "Vault Vault.<init>() EXECUTABLE_REMOVED Vault:3"),
    case("crate_final", "= Crate\npublic class Crate<E> {\n  protected void pack(E e) {}\n}\n", "= Crate\npublic final class Crate<E> {\n  protected void pack(E e) {}\n}\n",
         "Crate Crate CLASS_NOW_FINAL Crate:2", "Crate Crate.pack(E) EXECUTABLE_REMOVED Crate:3"),
    case("unchecked_to_checked", "= Spill\npublic class Spill extends IllegalStateException {}\n", "= Spill\npublic class Spill extends java.io.IOException {}\n",
         "Spill Spill CLASS_NOW_CHECKED_EXCEPTION Spill:2", "Spill Spill TYPE_SUPERTYPE_REMOVED Spill:2"),
    case("error_to_runtime", "= Spill\npublic class Spill extends Error {}\n", "= Spill\npublic class Spill extends RuntimeException {}\n", "Spill Spill TYPE_SUPERTYPE_REMOVED Spill:2"),
    case("plank_static", "= Deck\npublic class Deck<W> {\n  public final class Plank {}\n}\n", "= Deck\npublic class Deck<W> {\n  public static final class Plank {}\n}\n", "Deck$Plank Deck$Plank CLASS_NOW_STATIC Deck:3"),
    case("post_inner", "= Yard\npublic abstract class Yard {\n\n  protected static class Post {}\n}\n", "= Yard\npublic abstract class Yard {\n\n  protected class Post {}\n}\n", "Yard$Post Yard$Post CLASS_NO_LONGER_STATIC Yard:4"),
    case("loom_shut", "= Loom\npublic abstract class Loom {\n  String warp() { return null; }\n}\n", "= Loom\npublic abstract class Loom {\n  abstract String warp();\n}\n",
         "Loom Loom CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE Loom:2"),
    case("door_shut_from_above", "= Frame\nabstract class Frame { abstract int width(); }\n= Door\npublic abstract class Door extends Frame { int width() { return 3; } }\n",
         "= Frame\nabstract class Frame { abstract int width(); }\n= Door\npublic abstract class Door extends Frame {}\n", "Door Door CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE Door:2"),
    case("fewer_places", "= Dim\nimport java.lang.annotation.*;\n@Target({ElementType.FIELD, ElementType.PARAMETER})\npublic @interface Dim {}\n",
         "= Dim\nimport java.lang.annotation.*;\n@Target(ElementType.PARAMETER)\npublic @interface Dim {}\n", "Dim Dim ANNOTATION_TARGET_REMOVED Dim:4"),
    case("more_places", "= Dim\nimport java.lang.annotation.*;\n@Target(ElementType.FIELD)\npublic @interface Dim {}\n", "= Dim\nimport java.lang.annotation.*;\n@Target({ElementType.FIELD, ElementType.MODULE})\npublic @interface Dim {}\n"),
    case("element_to_give", "= Unit\npublic @interface Unit {\n  String name();\n}\n", "= Unit\npublic @interface Unit {\n  String name();\n  int scale();\n}\n", "Unit Unit ANNOTATION_NEW_METHOD_WITHOUT_DEFAULT Unit:2"),
    case("element_not_to_give", "= Unit\npublic @interface Unit { String name(); }\n", "= Unit\npublic @interface Unit { String name(); Class<?>[] scales() default {}; }\n"),
    case("once_only", "= Tag\n@java.lang.annotation.Repeatable(Tags.class)\npublic @interface Tag {}\n= Tags\npublic @interface Tags { Tag[] value(); }\n",
         "= Tag\npublic @interface Tag {}\n= Tags\npublic @interface Tags { Tag[] value(); }\n", "Tag Tag ANNOTATION_NO_LONGER_REPEATABLE Tag:3"),
    case("element_must_be_given", "= Unit\npublic @interface Unit {\n  double ratio() default 0.5;\n}\n", "= Unit\npublic @interface Unit {\n  double ratio();\n}\n", "Unit Unit.ratio() ANNOTATION_METHOD_NO_LONGER_DEFAULT Unit:3"),
    case("element_gone", "= Unit\npublic @interface Unit {\n  String hint() default \"\";\n}\n", "= Unit\npublic @interface Unit {}\n", "Unit Unit.hint() EXECUTABLE_REMOVED Unit:3"),
    case("element_retyped", "= Unit\npublic @interface Unit {\n  int size();\n}\n", "= Unit\npublic @interface Unit {\n  long size();\n}\n",
         "Unit Unit.size() METHOD_RETURN_TYPE_ERASURE_CHANGED Unit:3", "Unit Unit.size() METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE Unit:3"),
    case("heirs_lose_a_field", "= Beam\npublic class Beam {\n  // in kN\n  protected double load;\n}\n= Truss\npublic class Truss extends Beam {}\n", "= Beam\npublic class Beam {}\n= Truss\npublic class Truss extends Beam {}\n",
         "Beam Beam.load FIELD_REMOVED Beam:4", "Truss Beam.load FIELD_REMOVED Beam:4"),
    case("field_moved_up", "= Upper\npublic class Upper {}\n= Lower\npublic class Lower extends Upper { public char mark; }\n", "= Upper\npublic class Upper { public char mark; }\n= Lower\npublic class Lower extends Upper {}\n"),
    case("field_flags", "= Wheel\npublic class Wheel {\n  public long a;\n  public long b;\n  public static long c;\n  public long d;\n}\n",
         "= Wheel\npublic class Wheel {\n  public final long a = System.nanoTime();\n  public static long b;\n  public long c;\n  protected long d;\n}\n",
         "Wheel Wheel.a FIELD_NOW_FINAL Wheel:3", "Wheel Wheel.b FIELD_NOW_STATIC Wheel:4", "Wheel Wheel.c FIELD_NO_LONGER_STATIC Wheel:5", "Wheel Wheel.d FIELD_NOW_PROTECTED Wheel:6"),
    case("field_types", "= Well\npublic class Well {\n  public float depth;\n  public char mark;\n  public static final int MAX = 9;\n  public final Number[] row = null;\n  public java.util.Set<Long> ids;\n  public java.util.Set ids2;\n}\n",
         "= Well\npublic class Well {\n  public double depth;\n  public Character mark;\n  public static final long MAX = 9;\n  public final Integer[] row = null;\n  public java.util.Set<Integer> ids;\n  public java.util.Set<Integer> ids2;\n}\n",
         "Well Well.depth FIELD_TYPE_ERASURE_CHANGED Well:3", "Well Well.depth FIELD_TYPE_CHANGED_INCOMPATIBLE Well:3", "Well Well.mark FIELD_TYPE_ERASURE_CHANGED Well:4", "Well Well.MAX FIELD_TYPE_CHANGED_INCOMPATIBLE Well:5",
         "Well Well.row FIELD_TYPE_ERASURE_CHANGED Well:6", "Well Well.ids FIELD_TYPE_CHANGED_INCOMPATIBLE Well:7"),
    case("field_of_an_added_variable", "= Slot\npublic class Slot<K> { public K key; public Object item; }\n", "= Slot\npublic class Slot<Q, X> { public Q key; public X item; }\n", "Slot Slot FORMAL_TYPE_PARAMETER_ADDED Slot:2"),
    case("overload_gone", "= Hoist\npublic class Hoist {\n  public void lift(int kg) {}\n  public void lift(long kg) {}\n}\n", "= Hoist\npublic class Hoist {\n  public void lift(int kg) {}\n}\n", "Hoist Hoist.lift(long) EXECUTABLE_REMOVED Hoist:4"),
    case("method_moved_up", "= Upper\npublic class Upper {}\n= Lower\npublic class Lower extends Upper { public int mark(String s) { return 1; } }\n", "= Upper\npublic class Upper { public int mark(String s) { return 1; } }\n= Lower\npublic class Lower extends Upper {}\n"),
    case("out_of_reach_in_final", "= Rig\npublic final class Rig { protected void tune() {} }\n", "= Rig\npublic final class Rig {}\n"),
    case("varargs_to_array", "= Sum\npublic class Sum { public int of(int... n) { return 0; } }\n", "= Sum\npublic class Sum { public int of(int[] n) { return 0; } }\n"),
    case("narrowed_executables", "= Fold\npublic class Fold {\n  public Fold(byte b) {}\n  public void crease() {}\n}\n", "= Fold\npublic class Fold {\n  protected Fold(byte b) {}\n  protected void crease() {}\n}\n",
         "Fold Fold.<init>(byte) EXECUTABLE_NOW_PROTECTED Fold:3", "Fold Fold.crease() EXECUTABLE_NOW_PROTECTED Fold:4"),
    case("narrowed_constructor_of_abstract", "= Fold\npublic abstract class Fold { public Fold(byte b) {} }\n", "= Fold\npublic abstract class Fold { protected Fold(byte b) {} }\n"),
    case("constructor_throws", "= Pipe\npublic class Pipe {\n  public Pipe() {}\n}\n", "= Pipe\npublic class Pipe {\n  public Pipe() throws InterruptedException {}\n}\n", "Pipe Pipe.<init>() EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION Pipe:3"),
    case("throws_wider_and_narrower", "= Feed\nimport java.io.*;\npublic class Feed {\n  public void a() throws FileNotFoundException {}\n  public void b() throws IOException {}\n  public final void c() throws IOException {}\n  public void d() throws IllegalArgumentException {}\n}\n",
         "= Feed\nimport java.io.*;\npublic class Feed {\n  public void a() throws IOException {}\n  public void b() throws FileNotFoundException {}\n  public final void c() throws FileNotFoundException {}\n  public void d() {}\n}\n",
         "Feed Feed.a() EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION Feed:4", "Feed Feed.b() EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION Feed:5"),
    case("thrown_type_turns_checked", "= Fault\npublic class Fault extends RuntimeException {}\n= Job\npublic class Job {\n  public void go() throws Fault {}\n}\n", "= Fault\npublic class Fault extends Exception {}\n= Job\npublic class Job {\n  public void go() throws Fault {}\n}\n",
         "Fault Fault CLASS_NOW_CHECKED_EXCEPTION Fault:2", "Fault Fault TYPE_SUPERTYPE_REMOVED Fault:2", "Job Job.go() EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION Job:3"),
    case("thrown_variable_dropped", "= Wait\npublic class Wait<V> {\n  public <X extends InterruptedException> void until(V v) throws X {}\n}\n", "= Wait\npublic class Wait<V> {\n  public <X extends InterruptedException> void until(V v) {}\n}\n",
         "Wait Wait.until(V) EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION Wait:3"),
    case("parameter_arguments", "= Load\nimport java.util.*;\npublic class Load {\n  public void in(Map<String, Long> m) {}\n}\n", "= Load\nimport java.util.*;\npublic class Load {\n  public void in(Map<String, Integer> m) {}\n}\n",
         "Load Load.in(java.util.Map<java.lang.String,java.lang.Long>) EXECUTABLE_PARAMETER_GENERICS_CHANGED Load:4"),
    case("parameter_arguments_wider_in_final", "= Pour\nimport java.util.*;\npublic final class Pour { public void into(Collection<Integer> c) {} }\n", "= Pour\nimport java.util.*;\npublic final class Pour { public void into(Collection<? extends Number> c) {} }\n"),
    case("method_flags", "= Gear\npublic abstract class Gear {\n  public void a() {}\n  public void b() {}\n  public void c() {}\n  public final void d() {}\n  public static void e() {}\n}\n",
         "= Gear\npublic abstract class Gear {\n  public abstract void a();\n  public final void b() {}\n  public static void c() {}\n  public static void d() {}\n  public void e() {}\n}\n",
         "Gear Gear.a() METHOD_NOW_ABSTRACT Gear:3", "Gear Gear.b() METHOD_NOW_FINAL Gear:4", "Gear Gear.c() METHOD_NOW_STATIC Gear:5", "Gear Gear.c() METHOD_OVERRIDABLE_NOW_STATIC Gear:5",
         "Gear Gear.d() METHOD_NOW_STATIC Gear:6", "Gear Gear.e() METHOD_NO_LONGER_STATIC Gear:7"),
    case("default_method_flags", "= Step\npublic interface Step {\n  default int stride() { return 1; }\n  default int pace() { return 1; }\n}\n", "= Step\npublic interface Step {\n  int stride();\n  static int pace() { return 1; }\n}\n",
         "Step Step.stride() METHOD_NOW_ABSTRACT Step:3", "Step Step.pace() METHOD_NOW_STATIC Step:4", "Step Step.pace() METHOD_OVERRIDABLE_NOW_STATIC Step:4"),
    case("final_where_none_overrides", "= Mold\npublic class Mold { Mold() {} public Object cast() { return this; } }\n", "= Mold\npublic class Mold { Mold() {} public final Object cast() { return this; } }\n"),
    case("open_below_sealed", "= Hull\npublic abstract sealed class Hull permits Boat {\n  public void sink() {}\n}\n= Boat\npublic non-sealed class Boat extends Hull { public void sink() {} }\n",
         "= Hull\npublic abstract sealed class Hull permits Boat {\n  public abstract void sink();\n}\n= Boat\npublic non-sealed class Boat extends Hull { public void sink() {} }\n", "Hull Hull.sink() METHOD_NOW_ABSTRACT Hull:3"),
    case("return_types", "= Tally\nimport java.util.*;\npublic class Tally {\n  public long count() { return 0; }\n  public final Number top() { return null; }\n  public final void reset() {}\n  public Iterable<Long> all() { return null; }\n  public Set<Long> some() { return null; }\n}\n",
         "= Tally\nimport java.util.*;\npublic class Tally {\n  public int count() { return 0; }\n  public final Integer top() { return null; }\n  public final boolean reset() { return true; }\n  public List<Long> all() { return null; }\n  public Set<Number> some() { return null; }\n}\n",
         "Tally Tally.count() METHOD_RETURN_TYPE_ERASURE_CHANGED Tally:4", "Tally Tally.count() METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE Tally:4", "Tally Tally.top() METHOD_RETURN_TYPE_ERASURE_CHANGED Tally:5",
         "Tally Tally.reset() METHOD_RETURN_TYPE_ERASURE_CHANGED Tally:6", "Tally Tally.all() METHOD_RETURN_TYPE_ERASURE_CHANGED Tally:7", "Tally Tally.all() METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE Tally:7",
         "Tally Tally.some() METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE Tally:8"),
    case("parameters_of_methods", "= Knot\npublic class Knot {\n  public <A> void tie(A a) {}\n  public <A, B> void cut(A a) {}\n  public <A> void pull(Object a) {}\n  public final <A> void drop(Object a) {}\n}\n",
         "= Knot\npublic class Knot {\n  public <A, B> void tie(A a) {}\n  public <A> void cut(A a) {}\n  public void pull(Object a) {}\n  public final void drop(Object a) {}\n}\n",
         "Knot Knot.tie(A) FORMAL_TYPE_PARAMETER_ADDED Knot:3", "Knot Knot.cut(A) FORMAL_TYPE_PARAMETER_REMOVED Knot:4", "Knot Knot.pull(java.lang.Object) FORMAL_TYPE_PARAMETER_REMOVED Knot:5"),
    case("parameters_of_types", "= Bag\npublic class Bag<I extends Comparable<I>> {}\n= Sack\npublic class Sack<I extends Integer, J> {}\n= Urn\npublic interface Urn<I> {}\n",
         "= Bag\npublic class Bag<I extends Number> {}\n= Sack\npublic class Sack<N extends Number> {}\n= Urn\npublic interface Urn<O> {}\n",
         "Bag Bag FORMAL_TYPE_PARAMETER_CHANGED Bag:2", "Sack Sack FORMAL_TYPE_PARAMETER_REMOVED Sack:2"),
    case("first_parameter", "= Urn\npublic interface Urn { Object get(); }\n", "= Urn\npublic interface Urn<O> { O get(); }\n"),
    case("heir_of_other_arguments", "= Tray\npublic class Tray<V> {\n  public V peek() { return null; }\n  public void push(V v) {}\n}\n= Tin\npublic class Tin extends Tray<Long> {}\n",
         "= Tray\npublic class Tray<V> {\n  public V peek() { return null; }\n  public void push(V v) {}\n}\n= Tin\npublic class Tin extends Tray<Double> {}\n",
         "Tin Tray.peek() METHOD_RETURN_TYPE_ERASURE_CHANGED Tray:3", "Tin Tray.peek() METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE Tray:3", "Tin Tray.push(V) EXECUTABLE_REMOVED Tray:4"),
    case("chain_of_five_variables", "= Chain\npublic class Chain<A extends Long, B extends A, C extends B, D extends C, E extends D> { public void link(E e) {} }\n",
         "= Chain\npublic class Chain<A extends Long, B extends A, C extends B, D extends C, E extends D> { public void link(Long e) {} }\n"),
    case("variable_of_the_outermost", "= Nest\npublic class Nest<N extends Number> { public class Egg { public class Yolk { public void drip(N n) {} } } }\n",
         "= Nest\npublic class Nest<N extends Number> { public class Egg { public class Yolk { public void drip(Number n) {} } } }\n"),
    case("nothing", "= Full\npublic class Full<T extends Comparable<? super T>, U> implements java.util.function.Function<T, U> { public U apply(T t) { return null; } protected U[][] grid; public enum Mode { ON { } } public record Pair(int a, long... b) {} @interface Note {} }\n",
         "= Full\npublic class Full<T extends Comparable<? super T>, U> implements java.util.function.Function<T, U> { public U apply(T t) { return null; } protected U[][] grid; public enum Mode { ON { } } public record Pair(int a, long... b) {} @interface Note {} }\n"),
]


def compiled(tmp, side: int) -> dict[str, list[dict]]:
    src, out = tmp / f"src{side}", tmp / f"out{side}"
    files = []
    for name, *sides, _ in CASES:
        (src / name).mkdir(parents=True)
        for type_, text in sides[side].items():
            f = src / name / f"{type_}.java"
            f.write_text(f"package t_{name};\n{text}")
            files.append(str(f))
    subprocess.run(["javac", "-nowarn", "-d", str(out), *files], check=True)
    return {name: [d for f in sorted((out / f"t_{name}").glob("*.class")) if (d := decode(f.read_bytes()))] if (out / f"t_{name}").exists() else [] for name, *_ in CASES}


def parsed(_, side: int) -> dict[str, list[dict]]:
    out = {}
    for name, *sides, _ in CASES:
        units = {type_: read_unit(f"package t_{name};\n{text}") for type_, text in sides[side].items()}
        known = frozenset(n for u in units.values() for n in declared(u))
        out[name] = [d for type_, u in units.items() for d in decode_unit(u, known, f"t_{name}/{type_}.java")]
        for d in out[name]:
            for a in d["type"]["annotations"]:
                a["values"] = dict(a["values"])
    return out


def read_tables(spark, tmp, read):
    types, execs, fields, snaps = [], [], [], []
    for side in (0, 1):
        ver = str(side + 1)
        for lib, decoded in read(tmp, side).items():
            snaps.append(("o", lib, ver, T0 + dt.timedelta(days=side), "DELIVERED", None, len(decoded)))
            for d in decoded:
                t = d["type"]
                types.append({**t, "org": "o", "lib": lib, "ver": ver, "origin": "bytecode", "loaded_at": T0})
                execs += [{**e, "org": "o", "lib": lib, "ver": ver, "owner": t["fqn"]} for e in d["execs"]]
                fields += [{**f, "org": "o", "lib": lib, "ver": ver, "owner": t["fqn"], "file": t["file"]} for f in d["fields"]]
    return (
        spark.createDataFrame(types, TYPE_SCHEMA), spark.createDataFrame(execs, EXEC_SCHEMA), spark.createDataFrame(fields, FIELD_SCHEMA), spark.createDataFrame(snaps, SNAPSHOT_SCHEMA)
    )


def findings(model: ApiModel) -> dict[str, list[tuple[str, str, str, str]]]:
    out = {name: [] for name, *_ in CASES}
    for r in ApiDiff(model).breaking_changes.collect():
        cut = lambda s: s.replace(f"t_{r['lib']}.", "")
        place = f"{r['file'].removeprefix('t_' + r['lib'] + '/').removesuffix('.java')}:{r['line']}"
        out[r["lib"]].append((cut(r["impacted_type"]), cut(r["impacted_symbol"]), r["kind"], place))
    return {k: sorted(v) for k, v in out.items()}


def without_lines(found):
    """Class files have lines of code only."""
    return sorted((t, s, k, place.split(":")[0]) for t, s, k, place in found)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return read_tables(spark, tmp_path_factory.mktemp("java"), compiled)


@pytest.fixture(scope="module")
def changes(tables):
    return findings(ApiModel(*tables))


@pytest.fixture(scope="module")
def source_changes(spark):
    return findings(ApiModel(*read_tables(spark, None, parsed)))


def test_distributed_rounds_find_the_same(tables, changes):
    assert findings(ApiModel(*tables, group_rows=0)) == changes


@pytest.mark.parametrize("name,expected", [(c[0], c[3]) for c in CASES], ids=[c[0] for c in CASES])
def test_rule(changes, name, expected):
    assert without_lines(changes[name]) == without_lines(expected)


@pytest.mark.parametrize("name,expected", [(c[0], c[3]) for c in CASES], ids=[c[0] for c in CASES])
def test_rule_from_sources(source_changes, name, expected):
    assert source_changes[name] == expected


def test_every_kind_has_a_case():
    from evolvent.model import BC_KINDS

    assert {k for k, *_ in BC_KINDS} == {e[2] for c in CASES for e in c[3]}
