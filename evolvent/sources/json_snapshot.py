"""JSON snapshots to declaration tables, and back.

A snapshot is ``{library, module: {qualifiedName, exports}, allTypes: [type]}``; a type has ``typeKind``, a reference
``refKind``. References are recursive, which no Spark schema can say, so payloads are decoded in an Arrow batch and come
out with references as written text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolvent.operators.nested_records import elements, parse
from evolvent.session import ship_package
from evolvent.sources.classfile import DECODED

# Kinds of types and executables by their tags.
TYPE_KINDS = {"ClassDecl": "CLASS", "InterfaceDecl": "INTERFACE", "EnumDecl": "ENUM", "RecordDecl": "RECORD", "AnnotationDecl": "ANNOTATION"}


def reference(x: object) -> str | None:
    """A reference as text: an object by its ``refKind``, or a plain string as it is."""
    if not isinstance(x, dict):
        return x if isinstance(x, str) else None
    kind, name = x.get("refKind"), x.get("qualifiedName") or x.get("name")
    if kind == "ArrayTypeReference":
        inner = reference(x.get("componentType"))
        return None if inner is None else inner + "[]" * int(x.get("dimension") or 1)
    if kind == "WildcardTypeReference":
        bounds = [b for b in map(reference, elements(x.get("bounds"))) if b]
        if not bounds or (x.get("upper", True) and bounds == ["java.lang.Object"]):
            return "?"
        return f"? {'extends' if x.get('upper', True) else 'super'} {'&'.join(bounds)}"
    args = [a for a in map(reference, elements(x.get("typeArguments"))) if a]
    return None if name is None else name + (f"<{','.join(args)}>" if args else "")


def _strings(x: object) -> list[str]:
    return [e for e in elements(x) if isinstance(e, str)]


def _objects(x: object) -> list[dict]:
    return [e for e in elements(x) if isinstance(e, dict)]


def _tps(x: object) -> list[dict]:
    return [{"name": t.get("name"), "bounds": [b for b in map(reference, elements(t.get("bounds"))) if b]} for t in _objects(x)]


def _place(x: dict) -> tuple[str | None, int]:
    at = x.get("location")
    return (at.get("path"), int(at.get("line") or -1)) if isinstance(at, dict) else (None, -1)


def _notes(x: object) -> list[dict]:
    out = []
    for a in _objects(x):
        values = a.get("values")
        out.append({"fqn": reference(a.get("annotation")), "values": [(k, str(v)) for k, v in values.items()] if isinstance(values, dict) else []})
    return out


def _executable(m: dict, kind: str) -> dict:
    params = [{"name": p.get("name"), "ref": reference(p.get("type")), "varargs": bool(p.get("isVarargs"))} for p in _objects(m.get("parameters"))]
    name = (m.get("qualifiedName") or "").split("(")[0].rpartition(".")[2]
    return {
        "name": "<init>" if kind == "CONSTRUCTOR" else name, "exec_kind": kind, "visibility": m.get("visibility"), "modifiers": _strings(m.get("modifiers")),
        "return_ref": reference(m.get("type")), "params": params, "tps": _tps(m.get("formalTypeParameters")),
        "thrown": [t for t in map(reference, elements(m.get("thrownExceptions"))) if t], "has_default": bool(m.get("hasDefault")), "line": _place(m)[1],
    }


def types_of(snapshot: dict) -> Iterator[dict]:
    """Each type with its members, nested ones after what encloses them; in the shape of decoded class files."""
    stack = [(t, None) for t in reversed(_objects(snapshot.get("allTypes")))]
    while stack:
        t, outer = stack.pop()
        kind, (file, line) = TYPE_KINDS.get(t.get("typeKind")), _place(t)
        fields = [
            {
                "name": (f.get("qualifiedName") or "").rpartition(".")[2], "visibility": f.get("visibility"), "modifiers": _strings(f.get("modifiers")),
                "type_ref": reference(f.get("type")), "is_const": bool(f.get("compileTimeConstant")), "line": _place(f)[1],
            }
            for f in _objects(t.get("fields"))
        ]
        execs = [_executable(m, "METHOD") for m in _objects(t.get("methods"))] + [_executable(m, "CONSTRUCTOR") for m in _objects(t.get("constructors"))]
        execs += [_executable(m, "ANNOTATION_METHOD") for m in _objects(t.get("annotationMethods"))]
        yield {
            "type": {
                "fqn": t.get("qualifiedName"), "kind": kind, "visibility": t.get("visibility"), "modifiers": _strings(t.get("modifiers")), "super_ref": reference(t.get("superClass")),
                "interface_refs": [r for r in map(reference, elements(t.get("implementedInterfaces"))) if r], "tps": _tps(t.get("formalTypeParameters")),
                "enclosing": reference(t.get("enclosingType")) or outer, "permitted": [r for r in map(reference, elements(t.get("permittedTypes"))) if r],
                "annotations": _notes(t.get("annotations")), "targets": _strings(t.get("targets")), "file": file, "line": line,
            },
            "fields": fields,
            "execs": execs,
        }
        stack += [(n, t.get("qualifiedName")) for n in reversed(_objects(t.get("nestedTypes")))]


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if (s := parse(payload.as_py())) is None:
                yield pa.RecordBatch.from_pylist([{"path": path, "error": "unreadable"}], schema=schema)
                continue
            rows = [{"path": path} | t for t in types_of(s)]
            if isinstance(m := s.get("module"), dict):
                rows.append({"path": path, "module": {"name": m.get("qualifiedName"), "exports": _strings(m.get("exports"))}})
            for i in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 2_000], schema=schema)


def decode_payloads(records: DataFrame, key_col: str, payload_col: str) -> DataFrame:
    """One row for each type or module of each payload (the schema of decoded class files; ``path`` is the key).

    Payloads that are null, empty, cut off or hold no object give a row with ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(DECODED)
    return records.select(F.col(key_col).cast("string"), payload_col).mapInArrow(lambda it: _scan(it, schema), DECODED)


def read_snapshots(spark, path: str) -> DataFrame:
    """Snapshot files, one to a file."""
    ship_package(spark)
    files = spark.read.text(path, wholetext=True).withColumn("at", F.input_file_name())
    return decode_payloads(files, "at", "value")


def to_json(types: DataFrame, execs: DataFrame, fields: DataFrame) -> DataFrame:
    """``lib, ver, fqn, json``: each type with its members as one JSON object; references stay text, which readers accept.

    A type's members are as many as its source declares.
    """
    key = ["lib", "ver", "owner"]
    kinds = F.create_map(*[F.lit(x) for k, v in TYPE_KINDS.items() for x in (v, k)])
    tps = lambda c: F.transform(c, lambda t: F.struct(t["name"].alias("name"), t["bounds"].alias("bounds")))
    params = F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["ref"].alias("type"), p["varargs"].alias("isVarargs")))
    at = lambda file, line: F.struct(file.alias("path"), line.alias("line")).alias("location")
    x = F.struct(
        F.concat_ws(".", "owner", "name").alias("qualifiedName"), "visibility", "modifiers", F.col("return_ref").alias("type"), params.alias("parameters"),
        tps("tps").alias("formalTypeParameters"), F.col("thrown").alias("thrownExceptions"), F.col("has_default").alias("hasDefault"), "exec_kind", at(F.lit(None).cast("string"), F.col("line")),
    )
    f = F.struct(F.concat_ws(".", "owner", "name").alias("qualifiedName"), "visibility", "modifiers", F.col("type_ref").alias("type"), F.col("is_const").alias("compileTimeConstant"), at(F.col("file"), F.col("line")))
    notes = F.transform("annotations", lambda a: F.struct(a["fqn"].alias("annotation"), a["values"].alias("values"))).alias("annotations")
    es, fs = execs.groupBy(*key).agg(F.collect_list(x).alias("es")), fields.groupBy(*key).agg(F.collect_list(f).alias("fs"))
    j = types.withColumnRenamed("fqn", "owner").join(es, key, "left").join(fs, key, "left")
    of = lambda k: F.transform(F.filter("es", lambda e: e["exec_kind"] == k), lambda e: e.dropFields("exec_kind"))
    body = F.struct(
        F.element_at(kinds, F.col("kind")).alias("typeKind"), F.col("owner").alias("qualifiedName"), "visibility", "modifiers", F.col("super_ref").alias("superClass"),
        F.col("interface_refs").alias("implementedInterfaces"), tps("tps").alias("formalTypeParameters"), F.col("enclosing").alias("enclosingType"),
        F.col("permitted").alias("permittedTypes"), "targets", notes, at(F.col("file"), F.col("line")), of("METHOD").alias("methods"), of("CONSTRUCTOR").alias("constructors"),
        of("ANNOTATION_METHOD").alias("annotationMethods"), F.col("fs").alias("fields"),
    )
    return j.select("lib", "ver", F.col("owner").alias("fqn"), F.to_json(body).alias("json"))


def write_snapshots(tables: dict[str, DataFrame], path: str) -> None:
    """A library's types as JSON lines, one type with its members to a line, sorted by name, in parallel files."""
    to_json(tables["type_decl"], tables["exec_decl"], tables["field_decl"]).orderBy("lib", "ver", "fqn").select("json").write.mode("overwrite").text(path)


def write_snapshot(tables: dict[str, DataFrame], library: str, file: str) -> None:
    """A library as one snapshot file of all its types, sorted by name; it is written one partition at a time.

    :func:`read_snapshots` reads it back."""
    modules = sorted(r[0] for r in tables["module_export"].select("pkg").distinct().toLocalIterator()) if "module_export" in tables else []
    head = {"library": library, "module": {"qualifiedName": None, "exports": modules}}
    rows = to_json(tables["type_decl"], tables["exec_decl"], tables["field_decl"]).orderBy("lib", "ver", "fqn").select("json")
    with open(file, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "allTypes": [')
        for i, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" if i else "\n") + r[0])
        f.write("\n]}\n")
