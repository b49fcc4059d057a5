"""The API of each snapshot as client code sees it: closures, visibility, effective members.

Everything is keyed by (lib, ver), so one plan covers any number of libraries and versions. Closures and fixpoints over
a snapshot's types run over arrays within the task that holds the snapshot (:mod:`snapshot_graph`), after one exchange
by snapshot; members are joined by owner and reduced by key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolvent.functions.refs import package_name, simple_name, target
from evolvent.functions.typealg import Scope, instantiation, names_of, parse, render, substitute
from evolvent.functions.typealg import erased as erased_reference
from evolvent.model import BC_KINDS, DEFAULT_TARGETS, PLATFORM, platform_ancestors
from evolvent.operators.api_rounds import ancestor_rounds, visibility_rounds
from evolvent.operators.declarations import latest_types
from evolvent.operators.forest import closure
from evolvent.operators.snapshot_diff import field_fingerprint, fingerprint, list_key, set_key, snapshot_order, tps_key
from evolvent.operators.snapshot_graph import GROUP_ROWS, Chunk, chunks, split_large
from evolvent.operators.type_hierarchy import type_ancestors
from evolvent.session import Stages, once, together

KEY = ["lib", "ver"]
VALUES = ("kind", "visibility", "modifiers", "super_ref", "interface_refs", "tps", "enclosing", "permitted", "annotations", "targets", "file", "line", "outside")
EMPTY = "array<string>"


def has(mods: Column, m: str) -> Column:
    return F.array_contains(mods, m)


def no_list() -> Column:
    return F.array().cast(EMPTY)


def type_rows(types: DataFrame) -> DataFrame:
    """Latest types with their modifiers completed and their direct supertypes as names and as written.

    Interfaces are abstract and records final; ``permits`` makes a type sealed; a class without superclass extends
    Object, an enum Enum, a record Record, and an interface counts Object as a supertype. A type is no supertype of
    itself. Annotations without ``@Target`` may stand anywhere but in type uses.
    """
    # Maps have no order; an annotation's values are kept as sorted entries.
    entries = F.transform("annotations", lambda a: F.struct(a["fqn"].alias("fqn"), F.array_sort(F.map_entries(a["values"])).alias("entries")))
    t = latest_types(types.withColumn("annotations", entries), *VALUES)
    permits = F.filter(F.coalesce("permitted", no_list()), lambda p: F.length(F.trim(p)) > 0)
    implied = F.concat(
        F.when(F.col("kind").isin("INTERFACE", "ANNOTATION"), F.array(F.lit("ABSTRACT"))).otherwise(no_list()),
        F.when(F.col("kind") == "RECORD", F.array(F.lit("FINAL"))).otherwise(no_list()),
        F.when(F.size(permits) > 0, F.array(F.lit("SEALED"))).otherwise(no_list()),
    )
    written = F.when(target(F.col("super_ref")).isNotNull(), F.col("super_ref"))
    super_text = (
        F.when(F.col("kind") == "ENUM", "java.lang.Enum")
        .when(F.col("kind") == "RECORD", "java.lang.Record")
        .when(F.col("kind") == "CLASS", F.coalesce(written, F.lit("java.lang.Object")))
        .otherwise("java.lang.Object")
    )
    texts = F.concat(F.array(super_text), F.coalesce("interface_refs", no_list()))
    named = F.transform(texts, lambda x: F.struct(target(x).alias("target"), F.translate(F.trim(x), "/", ".").alias("text")))
    own = F.filter(named, lambda x: x["target"].isNotNull() & (x["target"] != F.col("fqn")))
    annotated = lambda name: F.exists(F.coalesce("annotations", F.array()), lambda a: a["fqn"] == name)
    targets = F.when(annotated("java.lang.annotation.Target") | (F.size(F.coalesce("targets", no_list())) > 0), F.coalesce("targets", no_list()))
    return t.select(
        *KEY,
        "fqn",
        package_name(F.col("fqn")).alias("pkg"),
        simple_name(F.col("fqn")).alias("simple"),
        "kind",
        "visibility",
        F.array_sort(F.array_union(F.coalesce("modifiers", no_list()), implied)).alias("modifiers"),
        own.alias("supers"),
        target(F.col("enclosing")).alias("enclosing"),
        F.coalesce("tps", F.array().cast("array<struct<name:string,bounds:array<string>>>")).alias("tps"),
        F.coalesce("annotations", F.array().cast(t.schema["annotations"].dataType)).alias("annotations"),
        F.when(F.col("kind") == "ANNOTATION", F.coalesce(targets, F.array(*[F.lit(x) for x in DEFAULT_TARGETS]))).otherwise(no_list()).alias("targets"),
        annotated("java.lang.annotation.Repeatable").alias("repeatable"),
        "file",
        "line",
        "outside",
    )


def _supertype_task(chunks_: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
    """Closure over direct supertypes, out of the snapshot too as far as the platform's types are known."""
    for c in chunks_:
        n = len(c.group)
        names = c.fqn.to_pylist()
        outside: dict[tuple[int, str], int] = {}
        targets = c.target.to_pylist()
        parent = c.parent.copy()
        todo: list[tuple[int, int, str]] = []

        def node(g: int, name: str) -> int:
            if (g, name) not in outside:
                outside[g, name] = len(names)
                names.append(name)
                todo.append((outside[g, name], g, name))
            return outside[g, name]

        for e in np.flatnonzero(parent < 0).tolist():
            parent[e] = node(int(c.group[c.child[e]]), targets[e])
        more: list[tuple[int, int]] = []
        while todo:
            x, g, name = todo.pop()
            more += [(x, node(g, s.split("<")[0])) for s in PLATFORM.get(name, ("", [], []))[2]]
        child = np.concatenate([c.child, np.array([a for a, _ in more], dtype=np.int64)])
        parent = np.concatenate([parent, np.array([b for _, b in more], dtype=np.int64)])
        generic = {i for i, t in enumerate(c.of_node["tp_names"].to_pylist()) if t}
        given = _instantiations(c, generic, names) if generic else {}
        every = pa.array(names, pa.string())
        for a, d, depth in closure(len(names), child, parent):
            ok = (d < n) & (a != d)
            a, d = a[ok], d[ok]
            at = pa.array(d)
            args = [given.get(x, {}).get(y) if y in generic else None for x, y in zip(d.tolist(), a.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    c.lib.take(at), c.ver.take(at), c.fqn.take(at), every.take(pa.array(a)), pa.array(depth[ok], pa.int32()), pa.array(a < n),
                    pa.array(args, pa.list_(pa.string())),
                ],
                names=["lib", "ver", "fqn", "ancestor", "depth", "in_library", "args"],
            )


def _instantiations(c: Chunk, generic: set[int], names: list[str]) -> dict[int, dict[int, list[str]]]:
    """type -> generic supertype of its snapshot -> the arguments that the type's declaration gives it, as text.

    The nearest path counts, of equally near ones the first in the order of declaration; a raw supertype has none.
    """
    texts, tps, ords = c.of_ref["text"].to_pylist(), c.of_node["tp_names"].to_pylist(), c.of_ref["ord"].to_pylist()
    ups: dict[int, list[tuple[int, int, str]]] = {}
    for e in np.flatnonzero(c.parent >= 0).tolist():
        ups.setdefault(int(c.child[e]), []).append((ords[e], int(c.parent[e]), texts[e]))
    for x in ups.values():
        x.sort()
    # Only what lies below a generic type has arguments to find.
    below: dict[int, list[int]] = {}
    for x, own in ups.items():
        for _, z, _ in own:
            below.setdefault(z, []).append(x)
    heirs, todo = set(), list(generic)
    while todo:
        for x in below.get(todo.pop(), ()):
            if x not in heirs:
                heirs.add(x)
                todo.append(x)
    out: dict[int, dict[int, list[str]]] = {}
    for x in heirs:
        found: dict[int, list[str]] = {}
        seen = {x}
        front = deque([(x, None)])
        while front:
            y, by = front.popleft()
            own = frozenset(tps[y])
            for _, z, text in ups.get(y, ()):
                if z in seen:
                    continue
                seen.add(z)
                r = parse(text, own)
                if by is not None:
                    r = substitute(r, by)
                args = r[2] if r[0] == "C" else ()
                if z in generic and args:
                    found[z] = [render(a) for a in args]
                front.append((z, instantiation(tps[z], args)))
        if found:
            out[x] = found
    return out


# Bits of a type's flags in the visibility fixpoint.
PUBLIC, PROTECTED, CLOSED, CLASSLIKE, HAS_CTOR, EXPORTED_PACKAGE = 1, 2, 4, 8, 16, 32


def _visibility_task(chunks_: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
    """The least joint fixpoint of exported and subtypable.

    A type is exported if its package is, its enclosing type (if known) is, and it is public, or protected in a
    subtypable type. It can be subtyped directly if it is open, exported and an interface or a class with a
    constructor in reach, and at all if it or a known subtype can.
    """
    for c in chunks_:
        n = len(c.group)
        f = c.of_node["flags"].to_numpy(zero_copy_only=False)
        enclosing = np.full(n, -1, dtype=np.int64)
        e = (c.field == 1) & (c.parent >= 0)
        enclosing[c.child[e]] = c.parent[e]
        up = (c.field == 0) & (c.parent >= 0)
        sub, sup = c.child[up], c.parent[up]
        inner = enclosing >= 0
        at = np.where(inner, enclosing, 0)
        open_ = ((f & CLOSED) == 0) & (((f & CLASSLIKE) == 0) | ((f & HAS_CTOR) != 0))
        exported, subtypable, known = np.zeros(n, bool), np.zeros(n, bool), -1
        while known != exported.sum() + subtypable.sum():
            known = exported.sum() + subtypable.sum()
            around, within = ~inner | exported[at], ~inner | subtypable[at]
            exported = ((f & EXPORTED_PACKAGE) != 0) & around & (((f & PUBLIC) != 0) | (((f & PROTECTED) != 0) & within))
            subtypable = subtypable | (open_ & exported)
            subtypable[sup[subtypable[sub]]] = True
        yield pa.RecordBatch.from_arrays(
            [c.lib, c.ver, c.fqn, pa.array(exported), pa.array(open_ & exported), pa.array(subtypable)],
            names=["lib", "ver", "fqn", "exported", "direct_subtypable", "subtypable"],
        )


def _lookup(scope: Column, name: Column) -> Column:
    return F.get(F.filter(scope, lambda s: s["name"] == name), F.lit(0))


def _erase_name(scope: Column, name: Column) -> Column:
    """A type name; a type variable of the scope gives the first of its bounds that is none, through all bounds.

    As many steps as variables are in view reach the end of every chain; a variable that bounds itself has no end and
    stands for Object, as one without bounds does.
    """
    top = F.lit("java.lang.Object")

    def step(held: Column, _: Column) -> Column:
        hit = _lookup(scope, held)
        return F.when(hit.isNull(), held).otherwise(F.coalesce(target(F.get(hit["bounds"], F.lit(0))), top))

    end = F.aggregate(scope, name, step)
    return F.when(_lookup(scope, name).isNull(), name).otherwise(F.when(_lookup(scope, end).isNull(), end).otherwise(top))


def erase(scope: Column, ref: Column) -> Column:
    """The erased name of a reference, with its array dimensions."""
    dims = F.regexp_extract(ref, r"((?:\[\])*)\s*$", 1)
    base = F.regexp_replace(F.coalesce(target(ref), F.lit("")), r"(\[\])+$", "")
    return F.concat(F.when(F.size(scope) == 0, base).otherwise(_erase_name(scope, base)), dims)


def _signature(name: Column, params: Column, each) -> Column:
    varargs = lambda p: F.when(p["varargs"], "[]").otherwise("")
    return F.concat(name, F.lit("("), F.array_join(F.transform(params, lambda p: F.concat(each(F.coalesce(p["ref"], F.lit(""))), varargs(p))), ","), F.lit(")"))


def bounds_text(tps: Column) -> Column:
    """All bounds of formal type parameters, in one text."""
    return F.array_join(F.flatten(F.transform(tps, lambda t: F.coalesce(t["bounds"], no_list()))), " ")


def instantiated(refs, tps, type_tps, scope, args, heir_scope) -> tuple[list[str], list[str]]:
    """A member's references with its owner's type variables replaced by the heir's arguments, and their erasures.

    ``tps`` are the member's own type parameters, ``type_tps`` its owner's, ``scope`` all in view of the owner's members,
    ``args`` and ``heir_scope`` what the heir gives and has in view.
    """
    read = lambda tps: [(t["name"], list(t["bounds"]) if t["bounds"] is not None else []) for t in tps]
    own, around, heir_tps = read(tps), read(scope), read(heir_scope)
    names, inner = names_of(own, around), names_of(own)
    by = {t["name"]: parse(str(a), names_of(heir_tps)) for t, a in zip(type_tps, args) if t["name"] not in inner}
    bound = [(n, [render(substitute(parse(b, names), by)) for b in bs]) for n, bs in own]
    view = Scope(bound, heir_tps, around)
    given = [substitute(parse(str(t), names), by) for t in refs]
    return [render(g) for g in given], [render(erased_reference(view, g)) for g in given]


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("refs", "erased")]))
def instantiate(x: pd.DataFrame) -> pd.DataFrame:
    """:func:`instantiated`, asked once for each distinct question."""
    told = [instantiated(*q) for q in zip(*(x[c] for c in ("refs", "tps", "type_tps", "scope", "args", "heir_scope")))]
    return pd.DataFrame({"refs": [r for r, _ in told], "erased": [e for _, e in told]})


def executable_fingerprint() -> Column:
    """An executable by all that counts: not its line and not the names of its parameters."""
    return fingerprint(
        F.col("name"), F.col("exec_kind"), F.col("visibility"), set_key("modifiers"), F.col("return_ref"),
        list_key("params", lambda p: F.concat_ws("\x03", p["ref"], p["varargs"].cast("string"))), tps_key("tps"), set_key("thrown"), F.col("has_default"),
    )


class ApiModel:
    """Tables of the snapshots of ``types``, ``execs`` and ``fields``; each is written once and read where it is used.

    ``exports`` (lib, ver, pkg) lists the exported packages of snapshots that have a named module; a snapshot without
    rows there exports everything. ``snapshots`` orders the versions of a library. Snapshots of more than ``group_rows``
    types are closed by distributed rounds (:mod:`api_rounds`). ``outside`` are the same three tables of what else
    resolves (a classpath), by the snapshot that it serves: its types are supertypes, exceptions and owners of members
    like any others, but have no findings of their own; where a library declares a type itself, that one counts.
    """

    def __init__(
        self, types: DataFrame, execs: DataFrame, fields: DataFrame, snapshots: DataFrame, exports: DataFrame | None = None, group_rows: int = GROUP_ROWS,
        outside: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    ):
        self.group_rows = group_rows
        types = types.withColumn("outside", F.lit(False))
        if outside is not None:
            own = types.select(*KEY, "fqn").distinct()
            more = outside[0].join(own, [*KEY, "fqn"], "left_anti").withColumns({"outside": F.lit(True), "file": F.lit(None).cast("string"), "line": F.lit(None).cast("int")})
            owned = [d.join(own.withColumnRenamed("fqn", "owner"), [*KEY, "owner"], "left_anti").withColumn("line", F.lit(None).cast("int")) for d in outside[1:]]
            types, execs = types.unionByName(more, True), execs.unionByName(owned[0], True)
            fields = fields.unionByName(owned[1].withColumn("file", F.lit(None).cast("string")), True)
        self._types, self._execs, self._fields, self._snapshots, self._exports = types, execs, fields, snapshots, exports
        self.spark = types.sparkSession
        self.stages = Stages(self.spark, "api")

    @once
    def types(self) -> DataFrame:
        return self.stages.put(type_rows(self._types), "types")

    @once
    def order(self) -> DataFrame:
        return self.stages.put(snapshot_order(self._snapshots), "order")

    @once
    def _sizes(self) -> tuple[DataFrame, DataFrame | None]:
        return split_large(self.types, self.group_rows)

    def _graph(self, rows: DataFrame, task, schema: str, fields: tuple[str, ...], node_cols: tuple[str, ...], ref_cols: tuple[str, ...]) -> DataFrame:
        placed = rows.repartition(*KEY).sortWithinPartitions(*KEY)
        return placed.mapInArrow(lambda it: task(chunks(it, fields, node_cols, ref_cols)), schema)

    def supertype_edges(self) -> DataFrame:
        """``lib, ver, fqn, super_fqn, ord``: direct supertypes, the superclass first."""
        return self.types.select(*KEY, "fqn", F.posexplode("supers").alias("ord", "s")).select(*KEY, "fqn", F.col("s.target").alias("super_fqn"), "ord")

    def direct_subtypes(self) -> DataFrame:
        """``lib, ver, super_fqn, fqn`` for the types of a snapshot: the inverted index of direct supertypes."""
        inside = self.types.select(*KEY, F.col("fqn").alias("super_fqn"))
        return self.supertype_edges().join(inside, [*KEY, "super_fqn"], "left_semi").select(*KEY, "super_fqn", "fqn").distinct()

    @once
    def ancestors(self) -> DataFrame:
        """``lib, ver, fqn, ancestor, depth, in_library, args``: all supertypes with the least number of links."""
        small, large = self._sizes
        rows = small.select(
            *KEY, "fqn", F.transform("tps", lambda t: t["name"]).alias("tp_names"), F.posexplode_outer("supers").alias("ord", "s")
        ).select(
            *KEY, "fqn", "tp_names", F.when(F.col("s").isNotNull(), "supers").alias("ref_field"), F.col("s.target").alias("target"), F.col("s.text").alias("text"), "ord"
        )
        schema = "lib string, ver string, fqn string, ancestor string, depth int, in_library boolean, args array<string>"
        out = self._graph(rows, _supertype_task, schema, ("supers",), ("tp_names",), ("text", "ord"))
        return self.stages.put(out if large is None else out.unionByName(ancestor_rounds(self.stages, large)), "ancestors")

    def superclasses(self) -> DataFrame:
        """``lib, ver, fqn, ancestor, depth``: the chain of superclasses of classes, within the snapshot and the platform."""
        kinds = self.types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").select(*KEY, F.col("fqn").alias("ancestor"))
        classes = [n for n, v in PLATFORM.items() if v[0] == "CLASS"]
        own = self.types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").select(*KEY, "fqn")
        a = self.ancestors.join(own, [*KEY, "fqn"], "left_semi").select(*KEY, "fqn", "ancestor", "depth")
        inside = a.join(kinds, [*KEY, "ancestor"], "left_semi")
        return inside.unionByName(a.where(F.col("ancestor").isin(classes)).join(kinds, [*KEY, "ancestor"], "left_anti"))

    def implemented_interfaces(self) -> DataFrame:
        """``lib, ver, fqn, ancestor, depth``: all interfaces of a type that are declared in its snapshot."""
        kinds = self.types.where("kind IN ('INTERFACE', 'ANNOTATION')").select(*KEY, F.col("fqn").alias("ancestor"))
        return self.ancestors.join(kinds, [*KEY, "ancestor"], "left_semi").select(*KEY, "fqn", "ancestor", "depth")

    @once
    def props(self) -> DataFrame:
        """``lib, ver, fqn, exported, direct_subtypable, subtypable``."""
        ctors = self._with_constructor().withColumn("ctor", F.lit(HAS_CTOR))
        small, large = self._sizes
        schema = "lib string, ver string, fqn string, exported boolean, direct_subtypable boolean, subtypable boolean"
        out = self._graph(self._flags(small, ctors), _visibility_task, schema, ("supers", "enclosing"), ("flags",), ())
        if large is not None:
            f = self._flags(large, ctors).select(*KEY, "fqn", "flags").distinct()
            on = lambda b: F.col("flags").bitwiseAND(b) != 0
            nodes = large.select(*KEY, "fqn", "enclosing", "visibility").join(f, [*KEY, "fqn"])
            open_ = ~on(CLOSED) & (~on(CLASSLIKE) | on(HAS_CTOR))
            nodes = nodes.select(*KEY, "fqn", "enclosing", "visibility", open_.alias("open"), on(EXPORTED_PACKAGE).alias("package_ok"))
            supers = large.select(*KEY, "fqn", F.explode("supers").alias("s")).select(*KEY, "fqn", F.col("s.target").alias("super_fqn")).distinct()
            out = out.unionByName(visibility_rounds(self.stages, nodes, supers))
        return self.stages.put(out, "props")

    def _flags(self, types: DataFrame, ctors: DataFrame) -> DataFrame:
        """``lib, ver, fqn, flags, ref_field, target``: what the visibility fixpoint needs of each type, by reference."""
        t = types.join(ctors, [*KEY, "fqn"], "left")
        package = F.lit(EXPORTED_PACKAGE)
        if self._exports is not None:
            named = self._exports.select(*KEY).distinct().withColumn("named", F.lit(True))
            listed = self._exports.select(*KEY, "pkg").distinct().withColumn("listed", F.lit(True))
            t = t.join(named, KEY, "left").join(listed, [*KEY, "pkg"], "left")
            package = F.when(F.col("named").isNull() | F.col("listed"), EXPORTED_PACKAGE).otherwise(0)
        m = F.col("modifiers")
        closed = has(m, "FINAL") | (has(m, "SEALED") & ~has(m, "NON_SEALED"))
        flags = (
            F.when(F.col("visibility") == "PUBLIC", PUBLIC).when(F.col("visibility") == "PROTECTED", PROTECTED).otherwise(0)
            + F.when(closed, CLOSED).otherwise(0)
            + F.when(F.col("kind").isin("CLASS", "ENUM", "RECORD"), CLASSLIKE).otherwise(0)
            + F.coalesce("ctor", F.lit(0))
            + package
        )
        refs = F.concat(
            F.transform("supers", lambda s: F.struct(F.lit("supers").alias("ref_field"), s["target"].alias("target"))),
            F.when(F.col("enclosing").isNotNull(), F.array(F.struct(F.lit("enclosing").alias("ref_field"), F.col("enclosing").alias("target")))).otherwise(
                F.array().cast("array<struct<ref_field:string,target:string>>")
            ),
        )
        return t.select(*KEY, "fqn", flags.cast("int").alias("flags"), F.explode_outer(refs).alias("r")).select(*KEY, "fqn", "flags", "r.ref_field", "r.target")

    def _with_constructor(self) -> DataFrame:
        """``lib, ver, fqn`` of types with a constructor that clients or their subclasses can call."""
        x = self._execs.where("exec_kind = 'CONSTRUCTOR' AND visibility IN ('PUBLIC', 'PROTECTED') AND name IS NOT NULL")
        return x.select(*KEY, F.col("owner").alias("fqn")).distinct()

    def nesting(self) -> DataFrame:
        """``lib, ver, link, ancestor, descendant, depth``: the types around each type."""
        none = F.lit(None)
        rows = self.types.select(
            *KEY, "fqn", none.cast("string").alias("super_ref"), none.cast(EMPTY).alias("interface_refs"), "enclosing", none.cast("timestamp").alias("loaded_at")
        )
        return type_ancestors(rows, self.group_rows, ("enclosing",))

    @once
    def scopes(self) -> DataFrame:
        """``lib, ver, owner, owner_kind, owner_file, type_tps, scope``: ``scope`` are the type parameters in view of a
        type's members, innermost first, through all types that enclose it."""
        t = self.types.select(*KEY, F.col("fqn").alias("owner"), F.col("kind").alias("owner_kind"), F.col("file").alias("owner_file"), F.col("tps").alias("type_tps"))
        # Only what is nested in a generic type sees more than its own.
        generic = self.types.where("size(tps) > 0").select(*KEY, F.col("fqn").alias("ancestor"), F.col("tps").alias("outer"))
        around = self.nesting().where("ancestor <> descendant").join(generic, [*KEY, "ancestor"])
        # One element for each level of nesting.
        outer = around.groupBy(*KEY, F.col("descendant").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", "outer"))).alias("o"))
        seen = F.flatten(F.transform(F.coalesce("o", F.array().cast(outer.schema["o"].dataType)), lambda x: x["outer"]))
        return self.stages.put(t.join(outer, [*KEY, "owner"], "left").withColumn("scope", F.concat("type_tps", seen)).drop("o"), "scopes")

    @once
    def executables(self) -> DataFrame:
        """Methods, constructors and annotation elements, repeated rows once, with erasure, symbol and completed modifiers."""
        value = F.struct("line", "name", "exec_kind", "visibility", "modifiers", "return_ref", "params", "tps", "thrown", "has_default")
        x = (
            self._execs.where("lib IS NOT NULL AND ver IS NOT NULL AND owner IS NOT NULL AND name IS NOT NULL")
            .groupBy(*KEY, "owner", executable_fingerprint().alias("h"))
            .agg(F.min(value).alias("v"))
            .select(*KEY, "owner", F.col("h").alias("mid"), "v.*")
            .join(self.scopes, [*KEY, "owner"])
        )
        none = F.array().cast(x.schema["tps"].dataType)
        x = x.withColumns({"tps": F.coalesce("tps", none), "params": F.coalesce("params", F.array().cast(x.schema["params"].dataType))})
        mods = F.array_sort(F.array_distinct(F.coalesce("modifiers", no_list())))
        plain = F.col("owner_kind").isin("INTERFACE", "ANNOTATION") & (F.col("exec_kind") == "METHOD")
        default = plain & ~has(mods, "ABSTRACT") & ~has(mods, "STATIC") & (F.col("visibility") != "PRIVATE")
        mods = F.when(F.col("exec_kind") == "ANNOTATION_METHOD", no_list()).when(default, F.array_union(mods, F.array(F.lit("DEFAULT")))).otherwise(mods)
        scope = F.concat("tps", "scope")
        name = F.when(F.col("exec_kind") == "CONSTRUCTOR", "<init>").otherwise(F.col("name"))
        return self.stages.put(
            x.select(
                *KEY, "owner", "owner_kind", "mid", name.alias("name"), "exec_kind",
                F.when(F.col("exec_kind") == "ANNOTATION_METHOD", "PUBLIC").otherwise(F.col("visibility")).alias("visibility"),
                mods.alias("modifiers"), F.coalesce("return_ref", F.lit("void")).alias("return_ref"), "params", "tps", "type_tps", F.col("scope").alias("type_scope"), F.col("owner_file").alias("file"),
                F.array_sort(F.array_distinct(F.coalesce("thrown", no_list()))).alias("thrown"), F.coalesce("has_default", F.lit(False)).alias("has_default"), "line",
                _signature(name, F.col("params"), lambda r: erase(scope, r)).alias("erasure"),
                F.concat(F.col("owner"), F.lit("."), _signature(name, F.col("params"), lambda r: r)).alias("symbol"),
                F.filter(F.transform(F.coalesce("thrown", no_list()), lambda t: erase(scope, t)), lambda t: t != "").alias("thrown_types"),
            ),
            "executables",
        )

    @property
    def constructors(self) -> DataFrame:
        return self.executables.where("exec_kind = 'CONSTRUCTOR' AND visibility IN ('PUBLIC', 'PROTECTED')")

    @property
    def methods(self) -> DataFrame:
        """Methods but private ones and those that the compiler adds to records and enums."""
        x = self.executables.where("exec_kind = 'METHOD' AND visibility <> 'PRIVATE'")
        record = F.col("erasure").isin("equals(java.lang.Object)", "hashCode()", "toString()") & (F.col("owner_kind") == "RECORD")
        enum = F.col("erasure").isin("valueOf(java.lang.String)", "values()") & (F.col("owner_kind") == "ENUM")
        return x.where(~(record | enum))

    @property
    def annotation_methods(self) -> DataFrame:
        return self.executables.where("exec_kind = 'ANNOTATION_METHOD'")

    @once
    def fields(self) -> DataFrame:
        """Public and protected fields, of records the static ones, repeated rows once."""
        value = F.struct("line", "file", "name", "visibility", "modifiers", "type_ref", "is_const")
        x = (
            self._fields.where("lib IS NOT NULL AND ver IS NOT NULL AND owner IS NOT NULL AND name IS NOT NULL AND visibility IN ('PUBLIC', 'PROTECTED')")
            .groupBy(*KEY, "owner", field_fingerprint().alias("h"))
            .agg(F.min(value).alias("v"))
            .select(*KEY, "owner", F.col("h").alias("mid"), "v.*")
            .join(self.scopes, [*KEY, "owner"])
        )
        mods = F.array_sort(F.array_distinct(F.coalesce("modifiers", no_list())))
        kept = x.withColumn("modifiers", mods).where((F.col("owner_kind") != "RECORD") | has(F.col("modifiers"), "STATIC"))
        return self.stages.put(
            kept.select(
                *KEY, "owner", "mid", "name", "visibility", "modifiers", F.coalesce("type_ref", F.lit("java.lang.Object")).alias("type_ref"),
                F.coalesce("is_const", F.lit(False)).alias("is_const"), "type_tps", F.col("scope").alias("type_scope"), F.coalesce("file", "owner_file").alias("file"), "line", F.concat_ws(".", "owner", "name").alias("symbol"),
            ),
            "fields",
        )

    @once
    def lineage(self) -> DataFrame:
        """``lib, ver, fqn, owner, depth, args``: a type and its supertypes of the snapshot."""
        own = self.types.select(*KEY, "fqn", F.col("fqn").alias("owner"), F.lit(0).alias("depth"), F.lit(None).cast(EMPTY).alias("args"))
        up = self.ancestors.where("in_library").select(*KEY, "fqn", F.col("ancestor").alias("owner"), "depth", "args")
        return own.unionByName(up)

    def _inherited(self, members: DataFrame, refs: Column, tps: Column, back: dict[str, Column]) -> DataFrame:
        """Members of each type and of its supertypes, inherited ones in terms of the type arguments that the heir gives.

        ``refs`` are a member's references; ``back`` puts them back from ``r.refs`` and their erasures from ``r.erased``.
        Only members that name a variable of their owner can change, and each distinct question about them is asked once.
        """
        given = F.col("speaks") & (F.coalesce(F.size("args"), F.lit(0)) > 0)
        named = F.regexp_extract_all(F.concat_ws(" ", F.array_join(refs, " "), bounds_text(tps)), F.lit(r"[A-Za-z_$][\w$.]*"), F.lit(0))
        speaks = (F.size("type_tps") > 0) & F.arrays_overlap(named, F.transform("type_tps", lambda t: t["name"]))
        cols = [*KEY, "fqn", "owner", "depth", *[c for c in members.columns if c not in (*KEY, "owner")]]
        m = members.withColumn("speaks", F.coalesce(speaks, F.lit(False)))
        plain = self.lineage.join(m, [*KEY, "owner"]).where(~given).select(*cols)
        heirs = self.scopes.select(*KEY, F.col("owner").alias("fqn"), F.col("scope").alias("heir_scope"))
        question = F.struct(refs.alias("refs"), tps.alias("tps"), "type_tps", F.col("type_scope").alias("scope"), "args", "heir_scope")
        told = self.lineage.where("size(args) > 0").join(m.where("speaks"), [*KEY, "owner"]).join(heirs, [*KEY, "fqn"])
        asked = told.withColumn("q", question).select(*cols, "q")
        answers = asked.select("q").distinct().withColumn("r", instantiate("q"))
        return plain.unionByName(self.stages.put(asked.join(answers, "q").withColumns(back).select(*cols), "instantiated"))

    def _effective(self, m: DataFrame, key: str, keep, flags: dict[str, Column]) -> DataFrame:
        """For each type and ``key`` the one of its own and inherited members that stays when each hides the next.

        Members are taken nearest first, equally near ones by owner, those of one owner by ``mid``; ``keep(acc, x)`` says
        whether the member so far hides the next, by ``anc`` (the supertypes of its owner), ``owner`` and the ``flags``.
        Few keys have more than one member: these are settled over narrow rows, and what loses is taken out of ``m``.
        """
        item = F.struct("depth", "owner", "mid", *[c.alias(n) for n, c in flags.items()])
        # A list is as long as a type has supertypes, times the members of one owner that differ under one key.
        met = m.groupBy(*KEY, "fqn", key).agg(F.collect_list(item).alias("l")).where("size(l) > 1")
        met = self.stages.put(met.select(*KEY, "fqn", key, F.explode("l").alias("x")).withColumn("owner", F.col("x.owner")), "met")
        owners = met.select(*KEY, F.col("owner").alias("fqn")).distinct()
        anc = self.ancestors.join(owners, [*KEY, "fqn"], "left_semi").groupBy(*KEY, F.col("fqn").alias("owner")).agg(F.collect_set("ancestor").alias("anc"))
        with_anc = F.struct("x.depth", "owner", "x.mid", F.coalesce("anc", no_list()).alias("anc"), *[f"x.{n}" for n in flags])
        lists = met.join(anc, [*KEY, "owner"], "left").groupBy(*KEY, "fqn", key).agg(F.array_sort(F.collect_list(with_anc)).alias("l"))
        first = F.aggregate(F.slice("l", 2, F.size("l") - 1), F.get("l", F.lit(0)), lambda acc, x: F.when(keep(acc, x), acc).otherwise(x))
        lost = lists.withColumn("w", first).select(*KEY, "fqn", key, F.explode(F.filter("l", lambda x: (x["owner"] != F.col("w.owner")) | (x["mid"] != F.col("w.mid")))).alias("x"))
        lost = self.stages.put(lost.select(*KEY, "fqn", key, F.col("x.owner").alias("owner"), F.col("x.mid").alias("mid")), "lost")
        return m.join(lost, [*KEY, "fqn", key, "owner", "mid"], "left_anti").drop("mid")

    @once
    def effective_fields(self) -> DataFrame:
        """Fields that can be reached through each type, inherited ones included: exported first, then reduced by name."""
        together((self, "ancestors"), (self, "fields"), (self, "props"))
        p = self.props.where("exported").select(*KEY, "fqn", "subtypable")
        hides = lambda a, x: F.array_contains(a["anc"], x["owner"]) | (a["owner"] == x["owner"])
        none = F.array().cast(self.fields.schema["type_tps"].dataType)
        m = self._inherited(self.fields, F.array("type_ref"), none, {"type_ref": F.get("r.refs", F.lit(0))})
        # Protected fields count in types that can be subtyped only.
        m = m.join(p, [*KEY, "fqn"]).where("visibility = 'PUBLIC' OR subtypable").drop("subtypable")
        return self.stages.put(self._effective(m, "name", hides, {}), "effective_fields")

    @once
    def all_methods(self) -> DataFrame:
        """Methods of each type by erasure, inherited ones included, package-private ones too."""
        cols = ["mid", "name", "visibility", "modifiers", "return_ref", "params", "tps", "type_tps", "type_scope", "thrown_types", "has_default", "file", "line", "symbol", "owner_kind"]

        def hides(a: Column, x: Column) -> Column:
            abstract, default = (lambda y: y["abstract"]), (lambda y: y["default"])
            nearer = F.array_contains(a["anc"], x["owner"]) | (a["owner"] == x["owner"])
            return nearer | (~abstract(a) & abstract(x)) | (~abstract(a) & ~default(a) & default(x))

        refs = F.concat(F.array("return_ref"), F.transform("params", lambda q: q["ref"]))
        renamed = F.transform("params", lambda q, i: F.struct(q["name"].alias("name"), F.get("r.refs", i + 1).alias("ref"), q["varargs"].alias("varargs")))
        erased = F.transform("params", lambda q, i: F.concat(F.get("r.erased", i + 1), F.when(q["varargs"], "[]").otherwise("")))
        back = {
            "return_ref": F.get("r.refs", F.lit(0)),
            "erasure": F.concat("name", F.lit("("), F.array_join(erased, ","), F.lit(")")),
            "params": renamed,
        }
        m = self._inherited(self.methods.select(*KEY, "owner", "erasure", *cols), refs, F.col("tps"), back)
        flags = {"abstract": has(F.col("modifiers"), "ABSTRACT"), "default": has(F.col("modifiers"), "DEFAULT")}
        return self.stages.put(self._effective(m, "erasure", hides, flags), "all_methods")

    @once
    def effective_methods(self) -> DataFrame:
        """The exported of ``all_methods``."""
        together((self, "ancestors"), (self, "executables"), (self, "props"))
        p = self.props.where("exported").select(*KEY, "fqn", "subtypable")
        return self.all_methods.join(p, [*KEY, "fqn"]).where("visibility = 'PUBLIC' OR (visibility = 'PROTECTED' AND subtypable)").drop("subtypable")

    def exported_constructors(self) -> DataFrame:
        p = self.props.where("exported").select(*KEY, F.col("fqn").alias("owner"), "direct_subtypable")
        x = self.constructors.join(p, [*KEY, "owner"]).where("visibility = 'PUBLIC' OR direct_subtypable").drop("direct_subtypable")
        return x.withColumn("fqn", F.col("owner"))

    def methods_to_implement(self) -> DataFrame:
        """Obligations of a concrete subtype: abstract methods, of interfaces all that are neither default nor static."""
        m = F.col("modifiers")
        interface = F.col("owner_kind").isin("INTERFACE", "ANNOTATION")
        return self.effective_methods.where(F.when(interface, ~has(m, "DEFAULT") & ~has(m, "STATIC")).otherwise(has(m, "ABSTRACT")))

    @once
    def blockers(self) -> DataFrame:
        """``lib, ver, fqn, symbol``: package-private abstract methods that keep clients from concrete subclasses of a class."""
        classes = self.types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").select(*KEY, "fqn")
        b = self.all_methods.where("visibility = 'PACKAGE_PRIVATE'").where(has(F.col("modifiers"), "ABSTRACT"))
        return b.join(classes, [*KEY, "fqn"], "left_semi").select(*KEY, "fqn", "symbol")

    @once
    def exceptions(self) -> DataFrame:
        """``lib, ver, fqn, checked, unchecked`` of the classes of each snapshot."""
        a = self.ancestors.groupBy(*KEY, "fqn").agg(
            F.bool_or(F.col("ancestor") == "java.lang.Throwable").alias("throwable"),
            F.bool_or(F.col("ancestor").isin("java.lang.RuntimeException", "java.lang.Error")).alias("unchecked"),
        )
        classes = self.types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").select(*KEY, "fqn")
        return a.join(classes, [*KEY, "fqn"], "left_semi").select(*KEY, "fqn", (F.col("throwable") & ~F.col("unchecked")).alias("checked"), "unchecked")

    @once
    def seen_types(self) -> DataFrame:
        """Types with all that the rules over types alone ask of them: visibility, extensibility, exceptions, abstractness.

        Whether clients can write a concrete subclass depends on methods too: ``blockers``.
        """
        reach = self._with_constructor().withColumn("reach", F.lit(True))
        x = self.types.join(self.props, [*KEY, "fqn"]).join(self.exceptions, [*KEY, "fqn"], "left").join(reach, [*KEY, "fqn"], "left")
        classlike = F.col("kind").isin("CLASS", "ENUM", "RECORD")
        return self.stages.put(
            x.withColumns(
                {
                    "checked": F.coalesce("checked", F.lit(False)),
                    "unchecked": F.coalesce("unchecked", F.lit(False)),
                    "eff_abstract": classlike & (has(F.col("modifiers"), "ABSTRACT") | F.col("reach").isNull()),
                }
            ).drop("reach"),
            "seen_types",
        )

    def api_card(self) -> DataFrame:
        """Per snapshot: types, exported types, exported methods and declared fields of exported types."""
        t = self.seen_types.where("NOT outside").groupBy(*KEY).agg(F.count("*").alias("n_types"), F.count_if("exported").alias("n_exported"))
        mine = self.types.where("NOT outside").select(*KEY, "fqn")
        m = self.effective_methods.join(mine, [*KEY, "fqn"], "left_semi").groupBy(*KEY).agg(F.count("*").alias("n_methods"))
        shown = self.seen_types.where("exported AND NOT outside").select(*KEY, F.col("fqn").alias("owner"))
        f = self.fields.join(shown, [*KEY, "owner"], "left_semi").groupBy(*KEY).agg(F.count("*").alias("n_fields"))
        zero = {"n_methods": F.coalesce("n_methods", F.lit(0)), "n_fields": F.coalesce("n_fields", F.lit(0))}
        return t.join(m, KEY, "left").join(f, KEY, "left").withColumns(zero)


KIND_INFO = {k: (i, n, b, s) for i, (k, n, b, s) in enumerate(BC_KINDS)}
PLATFORM_ANCESTORS = platform_ancestors()
