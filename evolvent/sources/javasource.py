"""Java sources to declaration tables, by reading declarations only.

Bodies and initialisers are skipped. Names are resolved as far as the files at hand allow: type variables, nested and
enclosing types, imports, the file's package, wildcard imports and ``java.lang``; a name that nothing explains is taken
to be of the file's own package. Two passes over the files: the first collects the declared names, the second decodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.model import PLATFORM, WIDENING
from evolvent.session import ship_package, small_enough
from evolvent.sources.classfile import DECODED

#: Declared types of one source tree, and bytes of their names, up to which these are sent to the tasks.
MOST_NAMES, NAME_BYTES = 500_000, 32_000_000

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/|(?P<lit>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'|\d(?:[\w.]|(?<=[eEpP])[+-])*)"""
    r"""|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>\.\.\.|->|::|@interface\b|[^\s\w])""",
    re.S,
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
# Types of java.lang that sources name without import, beside those of the platform table.
_LANG = frozenset(
    "Object String Number Boolean Character Byte Short Integer Long Float Double Void Enum Record Thread Runnable Iterable Comparable CharSequence Cloneable AutoCloseable Class "
    "ClassLoader Throwable Exception Error RuntimeException IllegalArgumentException IllegalStateException UnsupportedOperationException NullPointerException "
    "IndexOutOfBoundsException ClassNotFoundException InterruptedException ReflectiveOperationException ArithmeticException StringBuilder StringBuffer Process System Math "
    "Deprecated Override FunctionalInterface SafeVarargs SuppressWarnings ThreadLocal Appendable Readable Module StackTraceElement".split()
)
# Annotations that compilers drop.
_SOURCE_ONLY = frozenset({"java.lang.Override", "java.lang.SuppressWarnings"})


def tokens(text: str) -> list[tuple[str, int]]:
    """Tokens and where they begin."""
    return [(m[0], m.start()) for m in _TOKEN.finditer(text) if m.lastgroup]


@dataclass
class Raw:
    """A declared type with names as written."""

    name: str
    kind: str
    mods: list[str]
    notes: list[tuple[str, dict]]
    tps: list[tuple[str, list[str]]] = field(default_factory=list)
    sup: str | None = None
    ifs: list[str] = field(default_factory=list)
    permits: list[str] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    execs: list[dict] = field(default_factory=list)
    nested: list[Raw] = field(default_factory=list)
    components: list[dict] = field(default_factory=list)
    bodies: bool = False
    line: int = -1


class Reader:
    """Recursive descent over the tokens of one file."""

    def __init__(self, text: str):
        found = tokens(text)
        self.t, self.starts, self.i = [x for x, _ in found], [at for _, at in found], 0
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.package, self.imports, self.wild, self.types, self.module = "", {}, [], [], None

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1]

    def line(self) -> int:
        """The line of the token taken last."""
        return bisect_left(self.breaks, self.starts[self.i - 1]) + 1

    def ok(self, x: str) -> bool:
        if self.peek() == x:
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.ok(x):
            raise ValueError(f"{x!r} expected, {self.peek()!r} found")

    def name(self) -> str:
        out = self.take()
        while self.peek() == "." and (self.peek(1)[:1].isalpha() or self.peek(1)[:1] in "_$"):
            self.i += 1
            out += "." + self.take()
        return out

    def skip_group(self) -> list[str]:
        """The tokens of a bracketed group, brackets left out."""
        pairs = {"(": ")", "{": "}", "[": "]"}
        a = self.take()
        b, depth, start = pairs[a], 1, self.i
        while depth:
            x = self.take()
            depth += (x == a) - (x == b)
        return self.t[start : self.i - 1]

    def unit(self) -> Reader:
        while self.i < len(self.t):
            start = self.i
            mods, notes = self.modifiers()
            if self.ok("package"):
                self.package = self.name()
                self.need(";")
            elif self.ok("import"):
                static = self.ok("static")
                name = self.name()
                if self.ok("."):
                    self.need("*")
                    self.wild += [] if static else [name]
                elif not static:
                    self.imports[name.rpartition(".")[2]] = name
                self.need(";")
            elif self.peek() in ("module", "open") and not self.types and self.package == "":
                self.ok("open")
                self.take()
                self.module = {"name": self.name(), "exports": self.exports()}
            elif self.at_type():
                self.types.append(self.type(mods, notes))
            elif not self.ok(";"):
                raise ValueError(f"no declaration at {self.peek()!r}")
            assert self.i > start
        return self

    def exports(self) -> list[str]:
        body, out, k = self.skip_group(), [], 0
        while k < len(body):
            end = body.index(";", k)
            part = body[k:end]
            if part and part[0] == "exports" and "to" not in part:
                out.append("".join(part[1:]))
            k = end + 1
        return out

    def annotation(self) -> tuple[str, dict]:
        name = self.name()
        values: dict = {}
        if self.peek() == "(":
            body = self.skip_group()
            part, depth, parts = [], 0, []
            for x in [*body, ","]:
                depth += (x in "({[") - (x in ")}]")
                if x == "," and depth == 0:
                    parts.append(part)
                    part = []
                else:
                    part.append(x)
            for p in filter(None, parts):
                key, v = (p[0], p[2:]) if len(p) > 2 and p[1] == "=" else ("value", p)
                values[key] = v
        return name, values

    def modifiers(self) -> tuple[list[str], list[tuple[str, dict]]]:
        mods, notes = [], []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.take()
                notes.append(self.annotation())
            elif self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
                mods.append("NON_SEALED")
            elif self.peek() == "sealed" and (self.peek(1) in _MODIFIERS or self.peek(1) in ("class", "interface")):
                mods.append(self.take().upper())
            elif self.peek() in _MODIFIERS and self.peek() != "sealed" and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                mods.append(self.take().upper())
            else:
                return mods, notes

    def at_type(self) -> bool:
        x = self.peek()
        return x in ("class", "interface", "enum", "@interface") or (x == "@" and self.peek(1) == "interface") or (x == "record" and self.peek(2) in ("(", "<"))

    def formals(self) -> list[tuple[str, list[str]]]:
        out = []
        if self.ok("<"):
            while not self.ok(">"):
                self.modifiers()
                n, bounds = self.take(), []
                if self.ok("extends"):
                    bounds.append(self.ref())
                    while self.ok("&"):
                        bounds.append(self.ref())
                out.append((n, bounds))
                self.ok(",")
        return out

    def ref(self) -> str:
        """A type as written, spaces taken out."""
        self.modifiers()
        if self.ok("?"):
            if self.peek() in ("extends", "super"):
                how = self.take()
                return f"? {how} {self.ref()}"
            return "?"
        out = self.name()
        while self.peek() in ("<", "."):
            if self.ok("<"):
                args = []
                while not self.ok(">"):
                    args.append(self.ref())
                    self.ok(",")
                out += f"<{','.join(args)}>" if args else ""
            elif self.peek(1) == "@" or self.peek(1)[:1].isalpha():
                self.i += 1
                self.modifiers()
                out = out.split("<")[0] + "." + self.name()
            else:
                break
        while self.peek() == "[" and self.peek(1) == "]" or self.peek() == "@":
            if self.peek() == "@":
                self.modifiers()
                continue
            self.i += 2
            out += "[]"
        return out

    def refs(self) -> list[str]:
        out = [self.ref()]
        while self.ok(","):
            out.append(self.ref())
        return out

    def dims(self) -> str:
        out = ""
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            out += "[]"
        return out

    def type(self, mods: list[str], notes: list[tuple[str, dict]]) -> Raw:
        word = self.take()
        if word == "@":
            word = "@" + self.take()
        kind = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "@interface": "ANNOTATION"}[word]
        r = Raw(self.take(), kind, mods, notes)
        r.line = self.line()
        r.tps = self.formals()
        if kind == "RECORD":
            r.components = self.params()
        while self.peek() in ("extends", "implements", "permits"):
            how = self.take()
            if how == "extends" and kind == "CLASS":
                r.sup = self.ref()
            elif how == "permits":
                r.permits = self.refs()
            else:
                r.ifs += self.refs()
        self.need("{")
        if kind == "ENUM":
            self.constants(r)
        while not self.ok("}"):
            self.member(r)
        return r

    def constants(self, r: Raw) -> None:
        while self.peek() not in (";", "}"):
            _, notes = self.modifiers()
            name, line = self.take(), self.line()
            if self.peek() == "(":
                self.skip_group()
            if self.peek() == "{":
                self.skip_group()
                r.bodies = True
            r.fields.append({"name": name, "mods": ["PUBLIC", "STATIC", "FINAL"], "ref": r.name, "init": ["new"], "line": line})
            self.ok(",")
        self.ok(";")

    def params(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.ok(")"):
            self.modifiers()
            ref = self.ref()
            varargs = self.ok("...")
            name = self.name()
            if name == "this" or name.endswith(".this"):
                self.ok(",")
                continue
            out.append({"name": name, "ref": ref + self.dims(), "varargs": varargs})
            self.ok(",")
        return out

    def member(self, r: Raw) -> None:
        if self.ok(";"):
            return
        mods, notes = self.modifiers()
        if self.peek() == "{":
            self.skip_group()
            return
        if self.at_type():
            r.nested.append(self.type(mods, notes))
            return
        tps = self.formals()
        if self.peek() == r.name and self.peek(1) in ("(", "{"):
            self.take()
            line = self.line()
            compact = self.peek() == "{"
            params = r.components if compact else self.params()
            self.executable(r, "<init>", "CONSTRUCTOR", mods, "void", params, tps, line)
            return
        ref, name = self.ref(), self.take()
        line = self.line()
        if self.peek() == "(":
            self.executable(r, name, "ANNOTATION_METHOD" if r.kind == "ANNOTATION" else "METHOD", mods, ref, self.params(), tps, line)
            return
        while True:
            full, init = ref + self.dims(), []
            if self.ok("="):
                depth = 0
                while depth or self.peek() not in (",", ";"):
                    x = self.take()
                    depth += (x in "({[") - (x in ")}]")
                    init.append(x)
                    if x == "<" and depth == 0 and "new" in init:  # type arguments may hold commas
                        while self.peek() not in (">", ";"):
                            init.append(self.take())
            r.fields.append({"name": name, "mods": mods, "ref": full, "init": init, "line": line})
            if not self.ok(","):
                break
            name, line = self.take(), self.line()
        self.need(";")

    def executable(self, r: Raw, name: str, kind: str, mods: list[str], ref: str, params: list[dict], tps: list, line: int) -> None:
        ref += self.dims()
        thrown = self.refs() if self.ok("throws") else []
        default = self.ok("default")
        body = self.peek() == "{" and not default
        if body:
            self.skip_group()
        else:
            while not self.ok(";"):
                self.skip_group() if self.peek() in "({[" else self.take()
        r.execs.append({"name": name, "kind": kind, "mods": mods, "ref": ref, "params": params, "tps": tps, "thrown": thrown, "default": default, "body": body, "line": line})


def declared(unit: Reader) -> Iterator[str]:
    """Names of all types that a file declares."""
    stack = [(t, f"{unit.package}." if unit.package else "") for t in unit.types]
    while stack:
        t, prefix = stack.pop()
        yield prefix + t.name
        stack += [(n, f"{prefix}{t.name}$") for n in t.nested]


class Resolver:
    """From names as written to the names of a library's tables."""

    def __init__(self, unit: Reader, known: frozenset[str]):
        self.unit, self.known = unit, known

    def type_name(self, written: str, around: list[str]) -> str:
        """``around`` are the enclosing types, innermost first."""
        head, *rest = written.split(".")
        u = self.unit
        found = None
        for outer in around:
            if outer.rpartition(".")[2].split("$")[-1] == head:
                found = outer
            elif f"{outer}${head}" in self.known:
                found = f"{outer}${head}"
            if found:
                break
        if not found and head in u.imports:
            found = self.nested(u.imports[head])
        own = f"{u.package}.{head}" if u.package else head
        if not found and own in self.known:
            found = own
        if not found:
            for w in u.wild:
                for c in (f"{w}.{head}", f"{self.nested(w)}${head}"):
                    if c in self.known or c in PLATFORM:
                        found = c
        if not found and (head in _LANG or f"java.lang.{head}" in PLATFORM):
            found = f"java.lang.{head}"
        if found:
            return "$".join([found, *rest])
        return self.nested(written) if rest else own

    def nested(self, dotted: str) -> str:
        """A dotted name with ``$`` before nested types: the longest known prefix, else by capitals."""
        parts = dotted.split(".")
        for k in range(1, len(parts) + 1):
            if ".".join(parts[:k]) in self.known or ".".join(parts[:k]) in PLATFORM or (parts[k - 1][:1].isupper() and k > 1):
                return "$".join([".".join(parts[:k]), *parts[k:]])
        return dotted

    def ref(self, written: str, variables: frozenset[str], around: list[str]) -> str:
        def one(m: re.Match) -> str:
            w = m[0]
            if w in ("extends", "super") or w in WIDENING or w == "void" or w in variables:
                return w
            return self.type_name(w, around)

        return re.sub(r"[A-Za-z_$][\w$.]*", one, written)


def _visibility(mods: list[str], fallback: str = "PACKAGE_PRIVATE") -> str:
    return next((m for m in mods if m in ("PUBLIC", "PROTECTED", "PRIVATE")), fallback)


_ACCESS = frozenset({"PUBLIC", "PROTECTED", "PRIVATE"})


def decode_unit(unit: Reader, known: frozenset[str], file: str) -> Iterator[dict]:
    """Each type of a file in the shape of decoded class files."""
    res = Resolver(unit, known)
    stack = [(t, None, [], frozenset()) for t in reversed(unit.types)]
    while stack:
        r, outer, around, outer_vars = stack.pop()
        fqn = f"{outer.fqn}${r.name}" if outer else f"{unit.package}.{r.name}" if unit.package else r.name
        in_interface = outer is not None and outer.kind in ("INTERFACE", "ANNOTATION")
        vis = _visibility(r.mods, "PUBLIC" if in_interface else "PACKAGE_PRIVATE")
        mods = [m for m in r.mods if m not in _ACCESS and m not in ("STRICTFP", "NON_SEALED", "DEFAULT")]
        nested_static = outer is not None and (in_interface or r.kind in ("INTERFACE", "ENUM", "RECORD", "ANNOTATION"))
        mods += ["STATIC"] * (nested_static and "STATIC" not in mods)
        if r.kind in ("INTERFACE", "ANNOTATION"):
            mods += ["ABSTRACT"] * ("ABSTRACT" not in mods)
        if r.kind == "RECORD" or (r.kind == "ENUM" and not r.bodies):
            mods += ["FINAL"] * ("FINAL" not in mods)
        if r.kind == "ENUM" and r.bodies:
            mods.append("SEALED")
        around = [fqn, *around]
        static = "STATIC" in mods
        names = frozenset(n for n, _ in r.tps) | (frozenset() if static else outer_vars)
        put = lambda x, v=names, a=around: res.ref(x, v, a)
        tps_of = lambda tps, v, a=around: [{"name": n, "bounds": [res.ref(b, v, a) for b in bs] or ["java.lang.Object"]} for n, bs in tps]
        permits = [put(p) for p in r.permits]
        if "SEALED" in mods and not permits:
            same = [*unit.types] + [x for t in unit.types for x in t.nested]
            permits = [n for n in declared(unit) if any(t.name == n.rpartition(".")[2].split("$")[-1] and any(put(s).split("<")[0] == fqn for s in [*t.ifs, *([t.sup] if t.sup else [])]) for t in same)]
        notes, targets = [], []
        for written, values in r.notes:
            note = res.type_name(written, around)
            if note in _SOURCE_ONLY:
                continue
            if note == "java.lang.annotation.Target" or written.endswith("Target"):
                targets = [w for w in values.get("value", []) if w.isupper() and w.isidentifier()]
            flat = {k: "{}" if v[:1] == ["{"] else "".join(v).strip("\"'") for k, v in values.items()}
            notes.append({"fqn": note, "values": list(flat.items())})
        execs = [_executable(e, r, res, names, around) for e in r.execs]
        if r.kind == "CLASS" and not any(e["kind"] == "CONSTRUCTOR" for e in r.execs):
            execs.append(_executable({"name": "<init>", "kind": "CONSTRUCTOR", "mods": [vis], "ref": "void", "params": [], "tps": [], "thrown": [], "default": False, "body": True}, r, res, names, around))
        if r.kind == "RECORD":
            shapes = [[p["ref"] for p in e["params"]] for e in r.execs if e["kind"] == "CONSTRUCTOR"]
            if [p["ref"] for p in r.components] not in shapes:
                execs.append(_executable({"name": "<init>", "kind": "CONSTRUCTOR", "mods": [vis], "ref": "void", "params": r.components, "tps": [], "thrown": [], "default": False, "body": True}, r, res, names, around))
            have = {e["name"] for e in r.execs if not e["params"]}
            for p in r.components:
                if p["name"] not in have:
                    execs.append(_executable({"name": p["name"], "kind": "METHOD", "mods": ["PUBLIC"], "ref": p["ref"] + "[]" * p["varargs"], "params": [], "tps": [], "thrown": [], "default": False, "body": True}, r, res, names, around))
        yield {
            "type": {
                "fqn": fqn, "kind": r.kind, "visibility": vis, "modifiers": mods, "super_ref": (put(r.sup) if r.sup else "java.lang.Object") if r.kind == "CLASS" else None,
                "interface_refs": [put(x) for x in r.ifs] + ["java.lang.annotation.Annotation"] * (r.kind == "ANNOTATION"), "tps": tps_of(r.tps, names), "enclosing": outer.fqn if outer else None,
                "permitted": permits, "annotations": notes, "targets": targets, "file": file, "line": r.line,
            },
            "fields": [x for f in r.fields if (x := _field(f, r, res, names, around))],
            "execs": [e for e in execs if e],
        }
        r.fqn = fqn
        stack += [(n, r, around, names) for n in reversed(r.nested)]


def _field(f: dict, r: Raw, res: Resolver, names: frozenset[str], around: list[str]) -> dict | None:
    mods = [*f["mods"], *(["PUBLIC", "STATIC", "FINAL"] if r.kind in ("INTERFACE", "ANNOTATION") else [])]
    vis = _visibility(mods)
    if vis not in ("PUBLIC", "PROTECTED"):
        return None
    ref = res.ref(f["ref"], names, around)
    plain = bool(f["init"]) and not any(x in ("new", "(", "null") for x in f["init"])
    const = plain and "FINAL" in mods and (ref in WIDENING or ref == "java.lang.String")
    shown = [m for m in ("STATIC", "FINAL", "VOLATILE", "TRANSIENT") if m in mods]
    return {"name": f["name"], "visibility": vis, "modifiers": shown, "type_ref": ref, "is_const": const, "line": f["line"]}


def _executable(e: dict, r: Raw, res: Resolver, names: frozenset[str], around: list[str]) -> dict | None:
    interface = r.kind in ("INTERFACE", "ANNOTATION")
    enum_ctor = r.kind == "ENUM" and e["kind"] == "CONSTRUCTOR"
    vis = "PRIVATE" if enum_ctor else _visibility(e["mods"], "PUBLIC" if interface else "PACKAGE_PRIVATE")
    if vis == "PRIVATE" or (e["kind"] == "CONSTRUCTOR" and vis == "PACKAGE_PRIVATE"):
        return None
    mods = [m for m in e["mods"] if m not in _ACCESS]
    if interface and not e["body"] and "ABSTRACT" not in mods:
        mods.append("ABSTRACT")
    names = names | frozenset(n for n, _ in e["tps"])
    if "STATIC" in mods:
        names = frozenset(n for n, _ in e["tps"])
    put = lambda x: res.ref(x, names, around)
    return {
        "name": e["name"], "exec_kind": e["kind"], "visibility": vis, "modifiers": mods, "return_ref": put(e["ref"]),
        "params": [{"name": p["name"], "ref": put(p["ref"]), "varargs": p["varargs"]} for p in e["params"]],
        "tps": [{"name": n, "bounds": [put(b) for b in bs] or ["java.lang.Object"]} for n, bs in e["tps"]],
        "thrown": [put(t) for t in e["thrown"]], "has_default": e["default"], "line": e.get("line", r.line),
    }


def read_unit(text: str) -> Reader:
    try:
        return Reader(text).unit()
    except (IndexError, KeyError, AssertionError) as e:
        raise ValueError(f"cut off or unreadable: {e}") from e


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[str] = []
        for text in b.column(1).to_pylist():
            try:
                out += declared(read_unit(text or ""))
            except ValueError:
                continue
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["fqn"])


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, known=None) -> Iterator[pa.RecordBatch]:
    """Decode files of ``path, text``; the names they may mean are ``known``, or in a third column."""
    for b in batches:
        rows: list[dict] = []
        own = [known.value] * b.num_rows if known is not None else [frozenset(x or ()) for x in b.column(2).to_pylist()]
        for path, text, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own):
            base = {"path": path, "entry": path}
            try:
                unit = read_unit(text or "")
                name = path.rsplit("/", 1)[-1]
                file = f"{unit.package.replace('.', '/')}/{name}" if unit.package else name
                rows += [base | d for d in decode_unit(unit, names, file)]
                if unit.module:
                    rows.append(base | {"module": unit.module})
            except ValueError as e:
                rows.append(base | {"error": str(e)})
        for i in range(0, len(rows), 2_000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 2_000], schema=schema)


def scan_sources(spark: SparkSession, path: str, only: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """One row for each type or module of the ``.java`` files below ``path``, in the schema of decoded class files.

    ``only`` chooses files by their ``path`` below that folder; ``more`` are names (``fqn``) declared elsewhere.

    Files that cannot be read give a row with ``error``; ``package-info.java`` is left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(DECODED)
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(path)
    files = files.where(~F.col("path").endswith("/package-info.java")).select("path", F.decode("content", "UTF-8").alias("text"))
    if only is not None:
        from evolvent.operators.incremental import relative_path

        files = files.withColumn("below", relative_path(spark, path)).join(only.select(F.col("path").alias("below")), "below", "left_semi").drop("below")
    names = files.mapInArrow(_names, "fqn string")
    names = (names if more is None else names.unionByName(more.select("fqn"))).distinct()
    if small_enough(names, MOST_NAMES, NAME_BYTES):
        known = spark.sparkContext.broadcast(frozenset(names.toArrow()["fqn"].to_pylist()))
        return files.mapInArrow(lambda it: _scan(it, schema, known), DECODED)
    # A file can only mean types whose own name is one of its words: these come to it by exchange.
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("word"))
    near = words.join(names.withColumn("word", F.regexp_extract("fqn", r"([^.$]*)$", 1)), "word").groupBy("path").agg(F.collect_set("fqn").alias("known"))
    return files.join(near, "path", "left").mapInArrow(lambda it: _scan(it, schema), DECODED)
