"""Class files: archives and folders of compiled types to declaration tables.

An archive or class file is one row of Spark's ``binaryFile`` source; its classes are decoded in the task that holds it,
one row for each class with its members nested, and split into flat tables by column pruning and ``explode``. What
clients cannot see (synthetic and private members, anonymous and local types, types compiled from other languages) is
dropped while decoding.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolvent.session import ship_package

_ANONYMOUS = re.compile(r"\$\d+")
_VERSIONED = re.compile(r"META-INF/versions/(\d+)/(.+)")
# Letters of primitive types in descriptors.
_PRIMITIVE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
# Access flags.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, SYNCHRONIZED, VOLATILE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40
BRIDGE, VARARGS, TRANSIENT, NATIVE, INTERFACE, ABSTRACT, STRICT = 0x40, 0x80, 0x80, 0x100, 0x200, 0x400, 0x800
SYNTHETIC, ANNOTATION, ENUM, MODULE = 0x1000, 0x2000, 0x4000, 0x8000


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        size = struct.calcsize(">" + fmt)
        out = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += size
        return out[0] if len(out) == 1 else out

    def skip(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class _Pool:
    """The constant pool: values by index, names resolved on demand."""

    def __init__(self, b: _Bytes):
        n, self.items = b.take("H"), {}
        i = 1
        while i < n:
            tag = b.take("B")
            if tag == 1:
                self.items[i] = (tag, b.skip(b.take("H")).decode("utf-8", "replace"))
            elif tag in (3, 4):
                self.items[i] = (tag, b.take("i" if tag == 3 else "f"))
            elif tag in (5, 6):
                self.items[i] = (tag, b.take("q" if tag == 5 else "d"))
                i += 1
            elif tag in (7, 8, 16, 19, 20):
                self.items[i] = (tag, b.take("H"))
            elif tag == 15:
                self.items[i] = (tag, b.take("BH"))
            else:
                self.items[i] = (tag, b.take("HH"))
            i += 1

    def text(self, i: int) -> str:
        tag, v = self.items[i]
        return v if tag == 1 else self.text(v)

    def name(self, i: int) -> str | None:
        return self.text(i).replace("/", ".") if i else None

    def value(self, i: int):
        tag, v = self.items[i]
        return self.text(v) if tag in (7, 8) else v


def _attributes(b: _Bytes, pool: _Pool) -> dict[str, bytes]:
    return {pool.text(b.take("H")): b.skip(b.take("I")) for _ in range(b.take("H"))}


class Signature:
    """Reader of descriptors and generic signatures; references come out as written in declarations."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def _next(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def _until(self, stops: str) -> str:
        start = self.i
        while self.s[self.i] not in stops:
            self.i += 1
        return self.s[start : self.i]

    def type(self) -> str:
        c = self._next()
        if c in _PRIMITIVE:
            return _PRIMITIVE[c]
        if c == "[":
            return self.type() + "[]"
        if c == "T":
            name = self._until(";")
            self.i += 1
            return name
        name, args = "", []
        while True:
            name += self._until("<.;")
            c = self._next()
            if c == "<":
                args = []
                while self.s[self.i] != ">":
                    args.append(self.argument())
                self.i += 1
                c = self._next()
            if c == ";":
                break
            name, args = name + "$", []
        name = name.replace("/", ".")
        return name + (f"<{','.join(args)}>" if args else "")

    def argument(self) -> str:
        c = self.s[self.i]
        if c in "*+-":
            self.i += 1
            return "?" if c == "*" else f"? {'extends' if c == '+' else 'super'} {self.type()}"
        return self.type()

    def parameters(self) -> list[dict]:
        """Formal type parameters, if the signature begins with them."""
        if self.s[self.i] != "<":
            return []
        self.i += 1
        out = []
        while self.s[self.i] != ">":
            name, bounds = self._until(":"), []
            while self.s[self.i] == ":":
                self.i += 1
                if self.s[self.i] not in ":>":
                    bounds.append(self.type())
            out.append({"name": name, "bounds": bounds or ["java.lang.Object"]})
        self.i += 1
        return out

    def method(self) -> tuple[list[dict], list[str], str, list[str]]:
        """(formal type parameters, parameter types, return type, thrown types)."""
        tps = self.parameters()
        self.i += 1
        params = []
        while self.s[self.i] != ")":
            params.append(self.type())
        self.i += 1
        ret, thrown = self.type(), []
        while self.i < len(self.s) and self.s[self.i] == "^":
            self.i += 1
            thrown.append(self.type())
        return tps, params, ret, thrown

    def klass(self) -> tuple[list[dict], str, list[str]]:
        """(formal type parameters, superclass, interfaces)."""
        tps, sup, ifs = self.parameters(), self.type(), []
        while self.i < len(self.s):
            ifs.append(self.type())
        return tps, sup, ifs


def _element(b: _Bytes, pool: _Pool):
    """An annotation value as text; arrays of constants also as a list."""
    tag = chr(b.take("B"))
    if tag in "BCDFIJSZs":
        v = pool.value(b.take("H"))
        if tag == "Z":
            return "true" if v else "false"
        return chr(v) if tag == "C" else str(v)
    if tag == "e":
        t, c = b.take("HH")
        return f"{Signature(pool.text(t)).type()}.{pool.text(c)}"
    if tag == "c":
        return Signature(pool.text(b.take("H"))).type()
    if tag == "@":
        return _annotation(b, pool)["fqn"]
    return [_element(b, pool) for _ in range(b.take("H"))]


def _annotation(b: _Bytes, pool: _Pool) -> dict:
    fqn = Signature(pool.text(b.take("H"))).type()
    values = {pool.text(b.take("H")): _element(b, pool) for _ in range(b.take("H"))}
    return {"fqn": fqn, "raw": values, "values": {k: "{}" if isinstance(v, list) else v for k, v in values.items()}}


def _annotations(attrs: dict[str, bytes], pool: _Pool) -> list[dict]:
    out = []
    for name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
        if name in attrs:
            b = _Bytes(attrs[name])
            out += [_annotation(b, pool) for _ in range(b.take("H"))]
    return out


def _visibility(flags: int) -> str:
    return "PUBLIC" if flags & PUBLIC else "PROTECTED" if flags & PROTECTED else "PRIVATE" if flags & PRIVATE else "PACKAGE_PRIVATE"


def _named(flags: int, table: dict[int, str]) -> list[str]:
    return [m for bit, m in table.items() if flags & bit]


_FIELD_MODS = {STATIC: "STATIC", FINAL: "FINAL", VOLATILE: "VOLATILE", TRANSIENT: "TRANSIENT"}
_METHOD_MODS = {STATIC: "STATIC", FINAL: "FINAL", SYNCHRONIZED: "SYNCHRONIZED", NATIVE: "NATIVE", ABSTRACT: "ABSTRACT", STRICT: "STRICTFP"}


def _first_line(attrs: dict[str, bytes], pool: _Pool) -> int:
    if "Code" not in attrs:
        return -1
    b = _Bytes(attrs["Code"])
    b.skip(4)
    b.skip(b.take("I"))
    b.skip(8 * b.take("H"))
    lines = []
    for name, data in _attributes(b, pool).items():
        if name == "LineNumberTable":
            x = _Bytes(data)
            lines += [x.take("HH")[1] for _ in range(x.take("H"))]
    return min(lines, default=-1)


def decode(data: bytes) -> dict | None:
    """``{"type", "fields", "execs"}`` of a class, ``{"module"}`` of a module descriptor, None of what clients cannot see."""
    b = _Bytes(data)
    if b.take("I") != 0xCAFEBABE:
        return None
    b.skip(4)
    pool = _Pool(b)
    flags, this, sup = b.take("HHH")
    interfaces = [pool.name(b.take("H")) for _ in range(b.take("H"))]
    members = []
    for _ in range(2):
        members.append([(*b.take("HHH"), _attributes(b, pool)) for _ in range(b.take("H"))])
    attrs = _attributes(b, pool)
    if flags & MODULE:
        return {"module": _module(attrs, pool)}
    fqn = pool.name(this)
    if flags & SYNTHETIC or fqn.endswith("package-info") or _ANONYMOUS.search(fqn):
        return None
    source = pool.text(_Bytes(attrs["SourceFile"]).take("H")) if "SourceFile" in attrs else None
    if source is not None and not source.endswith(".java"):
        return None
    enclosing, seen = None, flags
    if "InnerClasses" in attrs:
        x = _Bytes(attrs["InnerClasses"])
        for _ in range(x.take("H")):
            inner, outer, simple, f = x.take("HHHH")
            if pool.name(inner) == fqn:
                if not outer or not simple:
                    return None
                enclosing, seen = pool.name(outer), f
    kind = "ANNOTATION" if flags & ANNOTATION else "INTERFACE" if flags & INTERFACE else "ENUM" if flags & ENUM else "RECORD" if "Record" in attrs else "CLASS"
    super_ref = pool.name(sup)
    tps: list[dict] = []
    if "Signature" in attrs:
        tps, super_ref, interfaces = Signature(pool.text(_Bytes(attrs["Signature"]).take("H"))).klass()
    permitted = []
    if "PermittedSubclasses" in attrs:
        x = _Bytes(attrs["PermittedSubclasses"])
        permitted = [p for _ in range(x.take("H")) if not _ANONYMOUS.search(p := pool.name(x.take("H")))]
    mods = _named(seen, {STATIC: "STATIC", FINAL: "FINAL", ABSTRACT: "ABSTRACT"}) + ["SEALED"] * ("PermittedSubclasses" in attrs)
    notes = _annotations(attrs, pool)
    targets = [e.rsplit(".", 1)[1] for a in notes if a["fqn"] == "java.lang.annotation.Target" for e in a["raw"].get("value", [])]
    package = fqn.rpartition(".")[0].replace(".", "/")
    inner_class = enclosing is not None and not seen & STATIC and kind == "CLASS"
    return {
        "type": {
            "fqn": fqn, "kind": kind, "visibility": _visibility(seen), "modifiers": mods, "super_ref": super_ref if kind == "CLASS" else None,
            "interface_refs": interfaces, "tps": tps, "enclosing": enclosing, "permitted": permitted,
            "annotations": [{"fqn": a["fqn"], "values": a["values"]} for a in notes], "targets": targets,
            "file": f"{package}/{source}" if package and source else source, "line": -1,
        },
        "fields": [x for m in members[0] if (x := _field(pool, *m))],
        "execs": [x for m in members[1] if (x := _executable(pool, kind, inner_class, *m))],
    }


def _field(pool: _Pool, flags: int, name: int, desc: int, attrs: dict[str, bytes]) -> dict | None:
    if flags & SYNTHETIC or not flags & (PUBLIC | PROTECTED):
        return None
    plain = Signature(pool.text(desc)).type()
    ref = Signature(pool.text(_Bytes(attrs["Signature"]).take("H"))).type() if "Signature" in attrs else plain
    constant = "ConstantValue" in attrs and (plain in _PRIMITIVE.values() or plain == "java.lang.String")
    return {"name": pool.text(name), "visibility": _visibility(flags), "modifiers": _named(flags, _FIELD_MODS), "type_ref": ref, "is_const": constant, "line": -1}


def _executable(pool: _Pool, kind: str, inner: bool, flags: int, name_: int, desc: int, attrs: dict[str, bytes]) -> dict | None:
    name = pool.text(name_)
    ctor = name == "<init>"
    if flags & (SYNTHETIC | BRIDGE) or flags & PRIVATE or name == "<clinit>" or (ctor and not flags & (PUBLIC | PROTECTED)):
        return None
    tps, params, ret, thrown = Signature(pool.text(desc)).method()
    plain = thrown
    if "Exceptions" in attrs:
        x = _Bytes(attrs["Exceptions"])
        plain = [pool.name(x.take("H")) for _ in range(x.take("H"))]
    if "Signature" in attrs:
        tps, params, ret, thrown = Signature(pool.text(_Bytes(attrs["Signature"]).take("H"))).method()
    elif ctor and inner:
        params = params[1:]  # the outer instance; a generic signature leaves it out
    varargs = bool(flags & VARARGS) and bool(params)
    ps = [{"name": f"p{i}", "ref": p[:-2] if varargs and i == len(params) - 1 else p, "varargs": varargs and i == len(params) - 1} for i, p in enumerate(params)]
    mods = _named(flags, _METHOD_MODS)
    if kind == "INTERFACE" and not ctor and not flags & (ABSTRACT | STATIC):
        mods.append("DEFAULT")
    return {
        "name": name, "exec_kind": "CONSTRUCTOR" if ctor else "ANNOTATION_METHOD" if kind == "ANNOTATION" else "METHOD", "visibility": _visibility(flags),
        "modifiers": mods, "return_ref": ret, "params": ps, "tps": tps, "thrown": thrown or plain, "has_default": "AnnotationDefault" in attrs,
        "line": _first_line(attrs, pool),
    }


def _module(attrs: dict[str, bytes], pool: _Pool) -> dict:
    """A module's name and the packages it exports to everyone."""
    b = _Bytes(attrs["Module"])
    name = pool.text(b.take("HHH")[0])
    b.skip(6 * b.take("H"))
    exports = []
    for _ in range(b.take("H")):
        package, _, to = b.take("HHH")
        b.skip(2 * to)
        if not to:
            exports.append(pool.name(package))
    return {"name": name, "exports": exports}


def entries(path: str, content: bytes, release: int) -> Iterator[tuple[str, bytes]]:
    """Class files of an archive, of multi-release ones the newest version up to ``release``; or the one class file."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        yield path, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        best: dict[str, tuple[int, str]] = {}
        for entry in z.namelist():
            version, name = 0, entry
            if m := _VERSIONED.fullmatch(entry):
                version, name = int(m[1]), m[2]
            if name.endswith(".class") and not name.startswith("META-INF/") and version <= release and version >= best.get(name, (0, ""))[0]:
                best[name] = (version, entry)
        for _, entry in best.values():
            yield entry, z.read(entry)


_S, _L = T.StringType(), T.ArrayType(T.StringType())
_TP = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("bounds", _L)]))
_PARAM = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("ref", _S), T.StructField("varargs", T.BooleanType())]))
_NOTE = T.ArrayType(T.StructType([T.StructField("fqn", _S), T.StructField("values", T.MapType(_S, _S))]))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DECODED = _struct(
    path=_S, entry=_S, error=_S,
    module=_struct(name=_S, exports=_L),
    type=_struct(
        fqn=_S, kind=_S, visibility=_S, modifiers=_L, super_ref=_S, interface_refs=_L, tps=_TP, enclosing=_S, permitted=_L, annotations=_NOTE, targets=_L,
        file=_S, line=T.IntegerType(),
    ),
    fields=T.ArrayType(_struct(name=_S, visibility=_S, modifiers=_L, type_ref=_S, is_const=T.BooleanType(), line=T.IntegerType())),
    execs=T.ArrayType(
        _struct(
            name=_S, exec_kind=_S, visibility=_S, modifiers=_L, return_ref=_S, params=_PARAM, tps=_TP, thrown=_L, has_default=T.BooleanType(), line=T.IntegerType()
        )
    ),
)


def _scan(batches: Iterator[pa.RecordBatch], release: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[dict] = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            for entry, data in entries(path, content.as_py(), release):
                base = {"path": path, "entry": entry}
                try:
                    found = decode(data)
                except (struct.error, KeyError, IndexError, ValueError) as e:
                    found = {"error": f"{type(e).__name__}: {e}"}
                if found is not None:
                    if "type" in found:
                        for a in found["type"]["annotations"]:
                            a["values"] = list(a["values"].items())
                    rows.append(base | found)
                if len(rows) >= 2_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def scan_classes(spark: SparkSession, path: str | list[str], release: int = 17) -> DataFrame:
    """One row for each class or module of the archives and class files at ``path`` (``DECODED``).

    Files that are no class files give a row with ``error`` if they are cut off, else none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(DECODED)
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path RLIKE '[.](jar|class|zip)$'")
    return files.select("path", "content").mapInArrow(lambda it: _scan(it, release, schema), DECODED)


def declaration_tables(decoded: DataFrame, org: str, lib: str, ver: str) -> dict[str, DataFrame]:
    """``type_decl``, ``exec_decl``, ``field_decl`` and ``module_export`` of a decoded library."""
    at = [F.lit(org).alias("org"), F.lit(lib).alias("lib"), F.lit(ver).alias("ver")]
    owned = decoded.where("type IS NOT NULL")
    return {
        "type_decl": owned.select(*at, "type.*", F.lit("bytecode").alias("origin"), F.lit(None).cast("timestamp").alias("loaded_at")),
        "exec_decl": owned.select(*at, F.col("type.fqn").alias("owner"), F.explode("execs").alias("e")).select("org", "lib", "ver", "owner", "e.*"),
        "field_decl": owned.select(*at, F.col("type.fqn").alias("owner"), F.col("type.file").alias("file"), F.explode("fields").alias("f")).select(
            "org", "lib", "ver", "owner", "f.name", "f.visibility", "f.modifiers", "f.type_ref", "f.is_const", "file", "f.line"
        ),
        "module_export": decoded.where("module IS NOT NULL").select("lib" if "lib" in decoded.columns else at[1], at[2], F.explode("module.exports").alias("pkg")),
    }
