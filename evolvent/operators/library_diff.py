"""Breaking changes of whole libraries in the task that holds them: the same matches and rules as :mod:`api_diff`.

Declarations are exchanged once, by library, as compressed blocks of columns; the task that holds a library walks its
snapshots in order, keeps the API of the last one, compares it with the next one's and swaps. No stage is written. A library of more than
``LIBRARY_ROWS`` rows, or with a snapshot of more than ``GROUP_ROWS`` types, is never gathered in a task: the same results
then come from :class:`ApiDiff`, and tests hold both forms against each other.
"""

from __future__ import annotations

import gc
import io
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from types import SimpleNamespace as Row

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolvent.functions.typealg import instantiation, parse, render, substitute
from evolvent.model import BC_KINDS, DEFAULT_TARGETS, PLATFORM
from evolvent.operators.api_diff import ApiDiff, _generic
from evolvent.operators.api_model import PLATFORM_ANCESTORS, ApiModel, executable_fingerprint, instantiated
from evolvent.operators.snapshot_diff import field_fingerprint, snapshot_order
from evolvent.operators.snapshot_graph import GROUP_ROWS

#: Rows of one library up to which it is compared in a task.
LIBRARY_ROWS = 200_000
#: Rows of a bucket of libraries, of a block of rows that is packed at once, and of a task.
BUCKET_ROWS, BLOCK_ROWS, TASK_ROWS = 100_000, 500_000, 400_000

FINDINGS = (
    "lib string, ver string, kind string, impacted_type string, impacted_symbol string, new_symbol string, detail_old string, detail_new string, file string, line int, owner string"
)
MATCHES = "lib string, ver string, fqn string, erasure string, status string"
#: Names that findings are asked for by; ``type_parameters`` are those of the rules over generic types that types have themselves.
PARTS = ("types", "fields", "methods", "constructors", "annotation_methods", "details", "added", "thrown", "generic", "type_parameters")
CLASSES, INTERFACES = ("CLASS", "ENUM", "RECORD"), ("INTERFACE", "ANNOTATION")
BLANK = " \t\n\x0b\x0c\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NAME, DIMS, ARRAY = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*"), re.compile(r"((?:\[\])*)[ \t\n\x0b\f\r]*$"), re.compile(r"(\[\])+$")


# -- packing ------------------------------------------------------------------------------------------------------


def _pack(kind: int, buckets: int):
    """Blocks ``bucket, kind, block`` of the rows of one table; ``bucket`` is the last column."""

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        at = t["bucket"].to_numpy()
        order = np.argsort(at, kind="stable")
        t, at = t.drop_columns(["bucket"]).take(pa.array(order)), at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
            out = io.BytesIO()
            pq.write_table(t.slice(i, j - i), out, compression="zstd", write_statistics=False, store_schema=False)
            yield pa.RecordBatch.from_arrays([pa.array([at[i]], pa.int32()), pa.array([kind], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["bucket", "kind", "block"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    return task


def _values(t: pa.Table) -> list[list]:
    """The columns of a table as lists in which equal texts are one object."""
    out = []
    for c in t.columns:
        if pa.types.is_string(c.type):
            d = c.combine_chunks().dictionary_encode()
            d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
            words = [*d.dictionary.to_pylist(), None]
            out.append([words[i] for i in d.indices.fill_null(-1).to_numpy(zero_copy_only=False)])
        else:
            out.append((c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist())
    return out


def _unpack(blocks: list[tuple[int, bytes]]) -> dict[str, tuple[dict, dict, dict, list]]:
    """library -> (types, executables and fields by version, its versions in order) of one bucket."""
    libs: dict[str, tuple[dict, dict, dict, list]] = {}
    for kind in range(4):
        own = [pq.read_table(io.BytesIO(b)) for k, b in blocks if k == kind]
        if not own:
            continue
        for lib, ver, *rest in zip(*_values(pa.concat_tables(own))):
            held = libs.setdefault(lib, ({}, {}, {}, []))
            if kind == 3:
                held[3].append((rest[0], ver))
            else:
                held[kind].setdefault(ver, []).append(rest)
    return libs


def _tasks(work: Callable[..., Iterator[tuple]], columns: Sequence[str], types: list[pa.DataType]):
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(columns))

    def bucket(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        libs = _unpack(blocks)
        for lib in list(libs):
            rows += work(lib, *libs.pop(lib))
            if len(rows) >= 10_000:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # snapshots hold no cycles; the collector would walk their members again and again
        try:
            yield from taken(batches)
        finally:
            gc.enable()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for at, kind, block in zip(b["bucket"].to_pylist(), b["kind"].to_pylist(), b["block"].to_pylist()):
                if at != now and held:
                    yield from bucket(held)
                    held = []
                now = at
                held.append((kind, block))
        if held:
            yield from bucket(held)

    return task


# -- one snapshot -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def _read(text: str | None) -> list:
    return json.loads(text) if text else []


@lru_cache(maxsize=100_000)
def _tps(text: str | None) -> list[dict]:
    return [{"name": t.get("name"), "bounds": t.get("bounds")} if t else {"name": None, "bounds": None} for t in _read(text)]


@lru_cache(maxsize=100_000)
def _params(text: str | None) -> list[tuple[str | None, str]]:
    return [(p.get("ref"), "[]" if p.get("varargs") else "") if p else (None, "") for p in _read(text)]


@lru_cache(maxsize=100_000)
def _modifiers(text: str | None) -> frozenset:
    return frozenset(_read(text)) - {None}


@lru_cache(maxsize=100_000)
def target(ref: str | None) -> str | None:
    return None if ref is None else ref.split("<", 1)[0].strip(BLANK).replace("/", ".") or None


def _bounds_text(tps: list[dict]) -> str:
    return " ".join(b for t in tps for b in t["bounds"] or () if b is not None)


def _rank(v) -> tuple:
    """A value in Spark's order: null before all others, lists and rows by their elements."""
    if v is None:
        return (0,)
    if isinstance(v, dict):
        return (1, [_rank(v.get(k)) for k in ("name", "bounds", "fqn", "entries", "key", "value")])
    return (1, [_rank(x) for x in v]) if isinstance(v, (list, tuple)) else (1, v)


JSON_OF_TYPE = (2, 4, 5, 7, 8, 9)


def _latest(rows: list[list]) -> list:
    """Of rows of one type the one with the greatest ``loaded_at``, of equal ones the greatest by its values."""
    if len(rows) == 1:
        return rows[0]
    return max(rows, key=lambda r: (_rank(r[1]), [_rank(json.loads(v) if i in JSON_OF_TYPE and v is not None else v) for i, v in enumerate(r[2:])]))


def _erased_name(scope: list[dict], name: str) -> str:
    bounds: dict = {}
    for t in scope:
        bounds.setdefault(t["name"], t["bounds"])
    if name not in bounds:
        return name
    held = name
    for _ in scope:
        if held not in bounds:
            return held
        held = target((bounds[held] or [None])[0]) or "java.lang.Object"
    return held if held not in bounds else "java.lang.Object"


@lru_cache(maxsize=100_000)
def _base(ref: str) -> tuple[str, str]:
    return ARRAY.sub("", target(ref) or ""), DIMS.search(ref)[1]


def _erased(scope: list[dict], ref: str) -> str:
    base, dims = _base(ref)
    return (_erased_name(scope, base) if scope else base) + dims


def _speaks(refs: Sequence[str | None], tps: list[dict], type_tps: list[dict]) -> bool:
    """Whether a member names a variable of its owner."""
    named = {t["name"] for t in type_tps}
    return not named.isdisjoint(NAME.findall(" ".join([*(r for r in refs if r is not None), _bounds_text(tps)])))


class Snapshot:
    """The API of one snapshot as client code sees it, as far as a comparison asks for it (:class:`ApiModel`)."""

    def __init__(self, types: list, execs: list, fields: list):
        rows: dict[str, list] = {}
        for r in types:
            rows.setdefault(r[0], []).append(r)
        self.types = {f: self._type(f, *_latest(x)[2:]) for f, x in rows.items()}
        self._execs, self._fields = execs, fields
        self.up: dict = {}
        for t in self.types.values():
            self.up[t.fqn] = [(s, text) if s in self.types else ((s,), text) for s, text in t.supers]
        for t in self.types.values():
            self._above(t)
        self.headers: dict[str, dict] = {}
        self._visible({r[0] for r in execs if r[3] == "CONSTRUCTOR" and r[4] in ("PUBLIC", "PROTECTED")})
        self.chains: dict[str, tuple[bool, frozenset]] = {}

    @staticmethod
    def _type(fqn, kind, visibility, modifiers, super_ref, interface_refs, tps, enclosing, permitted, annotations, targets, file, line) -> Row:
        mods = _modifiers(modifiers)
        permits = any(p is not None and p.strip(" ") for p in _read(permitted))
        mods |= {x for x, ok in (("ABSTRACT", kind in INTERFACES), ("FINAL", kind == "RECORD"), ("SEALED", permits)) if ok}
        fixed = {"ENUM": "java.lang.Enum", "RECORD": "java.lang.Record"}.get(kind)
        first = fixed or (super_ref if kind == "CLASS" and target(super_ref) else "java.lang.Object")
        supers = [(target(x), x.strip(" ").replace("/", ".")) for x in (first, *_read(interface_refs)) if x is not None]
        names = [a.get("fqn") if a else None for a in _read(annotations)]
        shown = _read(targets)
        if kind != "ANNOTATION":
            shown = []
        elif not ("java.lang.annotation.Target" in names or shown):
            shown = DEFAULT_TARGETS
        repeatable = "java.lang.annotation.Repeatable" in names or (None if None in names else False)
        return Row(
            fqn=fqn, kind=kind, visibility=visibility, modifiers=mods, supers=[(s, x) for s, x in supers if s is not None and s != fqn], enclosing=target(enclosing), tps=_tps(tps),
            targets=shown, repeatable=repeatable, file=file, line=line, classlike=kind in CLASSES,
        )

    def _above(self, t: Row) -> None:
        """``lineage`` (owner, depth, arguments) of a type and its supertypes of the snapshot, and the names of all its supertypes."""
        depth: dict = {}
        front, n = [t.fqn], 0
        while front:
            n += 1
            new = []
            for x in front:
                for s, _ in self._ups(x):
                    if s not in depth:
                        depth[s] = n
                        new.append(s)
            front = new
        depth.pop(t.fqn, None)
        t.ancestors = frozenset(s if isinstance(s, str) else s[0] for s in depth)
        inside = [s for s in depth if isinstance(s, str)]
        given = self._arguments(t.fqn) if any(self.types[s].tps for s in inside) else {}
        t.lineage = [(t.fqn, 0, None), *((s, depth[s], given.get(s)) for s in inside)]
        around, at, t.scope = {t.fqn}, t.enclosing, t.tps
        while at in self.types and at not in around:
            around.add(at)
            t.scope = t.scope + self.types[at].tps
            at = self.types[at].enclosing

    def _ups(self, x) -> list:
        if x not in self.up:
            self.up[x] = [((s.split("<")[0],), s) for s in PLATFORM.get(x[0], ("", [], []))[2]]
        return self.up[x]

    def _arguments(self, x: str) -> dict[str, list[str]]:
        """generic supertype -> the arguments that the declaration of ``x`` gives it, by the nearest path; a raw one has none."""
        found: dict[str, list[str]] = {}
        seen, front = {x}, [(x, None)]
        for y, by in front:
            names = [p["name"] for p in self.types[y].tps]
            own = frozenset(names)
            for z, text in self.up[y]:
                if not isinstance(z, str) or z in seen:
                    continue
                seen.add(z)
                r = parse(text, own)
                if by is not None:
                    r = substitute(r, by)
                args = r[2] if r[0] == "C" else ()
                if self.types[z].tps and args:
                    found[z] = [render(a) for a in args]
                front.append((z, instantiation([p["name"] for p in self.types[z].tps], args)))
        return found

    def _visible(self, ctors: set[str]) -> None:
        """The least joint fixpoint of exported and subtypable."""
        every = list(self.types.values())
        for t in every:
            closed = "FINAL" in t.modifiers or ("SEALED" in t.modifiers and "NON_SEALED" not in t.modifiers)
            t.open = not closed and (not t.classlike or t.fqn in ctors)
            t.exported = t.subtypable = False
            t.around = self.types.get(t.enclosing) if t.enclosing is not None else None
            t.eff_abstract = t.classlike and ("ABSTRACT" in t.modifiers or t.fqn not in ctors)
            t.unchecked = t.classlike and not t.ancestors.isdisjoint(("java.lang.RuntimeException", "java.lang.Error"))
            t.checked = t.classlike and "java.lang.Throwable" in t.ancestors and not t.unchecked
        more = True
        while more:
            more = False
            for t in every:
                a = t.around
                if not t.exported and (a is None or a.exported) and (t.visibility == "PUBLIC" or (t.visibility == "PROTECTED" and (a is None or a.subtypable))):
                    t.exported = more = True
                if not t.subtypable and t.open and t.exported:
                    t.subtypable = more = True
                if t.subtypable:
                    for s, _ in self.up[t.fqn]:
                        if isinstance(s, str) and not self.types[s].subtypable:
                            self.types[s].subtypable = more = True
        for t in every:
            t.direct_subtypable = t.open and t.exported

    def members(self, last: "Snapshot | None") -> None:
        """Executables by owner; those that the last snapshot holds alike are taken over."""
        once: dict[tuple, list] = {}
        for r in self._execs:
            if r[0] in self.types:
                once.setdefault((r[0], r[1]), []).append(r)
        self._execs = None
        self.methods: dict[str, list[Row]] = {}
        self.constructors: dict[str, list[Row]] = {}
        self.elements: dict[str, list[Row]] = {}
        self.made: dict[tuple, Row] = {}
        known = last.made if last is not None else {}
        for (owner, mid), rows in once.items():
            # owner, mid, name, exec_kind, visibility, modifiers, return_ref, params, tps, thrown, has_default, line
            r = rows[0] if len(rows) == 1 else min(rows, key=lambda x: [_rank(x[11]), *map(_rank, x[2:5]), _rank(_read(x[5]) if x[5] else None), *map(_rank, x[6:11])])
            t = self.types[owner]
            key = (r[2:11], t.kind, t.file)
            m = known.get((owner, mid))
            if m is None or m.key != key or m.type_tps != t.tps or m.type_scope != t.scope:
                m = self._executable(t, key, *r)
            elif m.line != r[11]:
                m = Row(**m.__dict__)
                m.line = r[11]
            self.made[owner, mid] = m
            if m.exec_kind == "CONSTRUCTOR":
                self.constructors.setdefault(owner, []).append(m)
            elif m.exec_kind == "ANNOTATION_METHOD":
                self.elements.setdefault(owner, []).append(m)
            elif m.exec_kind == "METHOD" and m.visibility is not None and m.visibility != "PRIVATE":
                record = t.kind == "RECORD" and m.erasure in ("equals(java.lang.Object)", "hashCode()", "toString()")
                if not (record or (t.kind == "ENUM" and m.erasure in ("valueOf(java.lang.String)", "values()"))):
                    self.methods.setdefault(owner, []).append(m)

    @staticmethod
    def _executable(t: Row, key, owner, mid, name, exec_kind, visibility, modifiers, return_ref, params, tps, thrown, has_default, line) -> Row:
        mods = _modifiers(modifiers)
        if exec_kind == "ANNOTATION_METHOD":
            mods, visibility = frozenset(), "PUBLIC"
        elif t.kind in INTERFACES and exec_kind == "METHOD" and mods.isdisjoint(("ABSTRACT", "STATIC")) and visibility not in (None, "PRIVATE"):
            mods |= {"DEFAULT"}
        name = "<init>" if exec_kind == "CONSTRUCTOR" else name
        own, takes = _tps(tps), _params(params)
        scope = own + t.scope if own else t.scope
        ret = "void" if return_ref is None else return_ref
        return Row(
            key=key, owner=owner, mid=mid, name=name, exec_kind=exec_kind, visibility=visibility, modifiers=mods, ref=ret, params=[p for p, _ in takes], dims=[d for _, d in takes], tps=own,
            type_tps=t.tps, type_scope=t.scope, has_default=bool(has_default), line=line, file=t.file, erasure=f"{name}({','.join(_erased(scope, p or '') + d for p, d in takes)})",
            symbol=f"{owner}.{name}({','.join((p or '') + d for p, d in takes)})", thrown=[e for e in (_erased(scope, x) for x in _read(thrown) if x is not None) if e],
            speaks=bool(t.tps) and _speaks([ret, *(p for p, _ in takes)], own, t.tps), abstract="ABSTRACT" in mods, default="DEFAULT" in mods,
        )

    def fields(self) -> dict[str, list[Row]]:
        """Public and protected fields by owner, of records the static ones."""
        once: dict[tuple, list] = {}
        for r in self._fields:
            if r[0] in self.types:
                once.setdefault((r[0], r[1]), []).append(r)
        self._fields = None
        out: dict[str, list[Row]] = {}
        for (owner, mid), rows in once.items():
            # owner, mid, line, file, name, visibility, modifiers, type_ref, is_const
            r = rows[0] if len(rows) == 1 else min(rows, key=lambda x: [*map(_rank, x[2:6]), _rank(_read(x[6]) if x[6] else None), *map(_rank, x[7:])])
            _, _, line, file, name, visibility, modifiers, type_ref, is_const = r
            t, mods = self.types[owner], _modifiers(modifiers)
            if (t.kind is None or t.kind == "RECORD") and "STATIC" not in mods:
                continue
            ref = "java.lang.Object" if type_ref is None else type_ref
            out.setdefault(owner, []).append(
                Row(
                    owner=owner, mid=mid, name=name, visibility=visibility, modifiers=mods, ref=ref, is_const=bool(is_const), type_tps=t.tps, type_scope=t.scope,
                    file=t.file if file is None else file, line=line, symbol=f"{owner}.{name}", speaks=bool(t.tps) and _speaks([ref], [], t.tps), tps=[], params=[],
                )
            )
        return out

    @staticmethod
    def _as_inherited(m: Row, args: list[str], heir: Row, of_method: bool) -> Row:
        refs, erased = instantiated([m.ref, *m.params], m.tps, m.type_tps, m.type_scope, args, heir.scope)
        more = {"params": refs[1:], "erasure": f"{m.name}({','.join(e + d for e, d in zip(erased[1:], m.dims))})"} if of_method else {}
        return Row(**(m.__dict__ | {"ref": refs[0]} | more))

    def effective(self, t: Row, members: dict[str, list[Row]], key: str, hides, kept=None) -> dict[str, Row]:
        """Of the members of a type and of its supertypes the one of each ``key`` that stays when each hides the next, nearest first."""
        met: dict[str, list] = {}
        for owner, depth, args in t.lineage:
            for m in members.get(owner, ()):
                if kept is not None and not kept(m):
                    continue
                if args and m.speaks:
                    m = self._as_inherited(m, args, t, key == "erasure")
                met.setdefault(getattr(m, key), []).append((depth, owner, m.mid, m))
        out = {}
        for k, x in met.items():
            if len(x) > 1:
                x.sort(key=lambda y: y[:3])
            stays = x[0][3]
            for y in x[1:]:
                if not hides(self, stays, y[3]):
                    stays = y[3]
            out[k] = stays
        return out

    def hides_field(self, a: Row, x: Row) -> bool:
        return a.owner == x.owner or x.owner in self.types[a.owner].ancestors

    def hides_method(self, a: Row, x: Row) -> bool:
        return a.owner == x.owner or x.owner in self.types[a.owner].ancestors or (not a.abstract and x.abstract) or (not a.abstract and not a.default and x.default)

    def reach_fields(self, fields: dict[str, list[Row]]) -> None:
        for t in self.types.values():
            if t.exported:
                t.fields = self.effective(t, fields, "name", Snapshot.hides_field, None if t.subtypable else (lambda m: m.visibility == "PUBLIC"))

    def reach_methods(self) -> None:
        """Exported methods of each type that clients see, and the methods that keep them from concrete subclasses."""
        for t in self.types.values():
            if not t.exported:
                continue
            every = self.effective(t, self.methods, "erasure", Snapshot.hides_method)
            t.blockers = [m.symbol for m in every.values() if m.visibility == "PACKAGE_PRIVATE" and m.abstract] if t.classlike else []
            t.methods = {k: m for k, m in every.items() if m.visibility == "PUBLIC" or (m.visibility == "PROTECTED" and t.subtypable)}
            t.concrete = t.subtypable and not t.blockers

    def chain(self, exc: str) -> tuple[bool, frozenset]:
        """Whether a type is a checked exception in this snapshot, and its supertypes with itself."""
        if exc not in self.chains:
            t = self.types.get(exc)
            if t is not None and t.classlike and t.ancestors:
                up = t.ancestors
            else:
                up = frozenset(PLATFORM_ANCESTORS.get(exc, ()))
            up = up | {exc}
            self.chains[exc] = "java.lang.Throwable" in up and up.isdisjoint(("java.lang.RuntimeException", "java.lang.Error")), up
        return self.chains[exc]

    def headers_of(self, text: str) -> list[dict]:
        """Headers of every type that ``text`` names and of its supertypes."""
        owners = {o for name in set(NAME.findall(text.replace("/", "."))) if name in self.types for o, _, _ in self.types[name].lineage}
        for x in owners - self.headers.keys():
            t = self.types[x]
            self.headers[x] = {"fqn": x, "tps": [p["name"] for p in t.tps], "supers": [s for _, s in t.supers]}
        return [self.headers[x] for x in owners]


# -- two snapshots ------------------------------------------------------------------------------------------------


def _pairs(a: dict[str, Row], b: dict[str, Row]) -> Iterator[tuple[str, Row | None, Row | None]]:
    for k, x in a.items():
        yield k, x, b.get(k)
    for k, y in b.items():
        if k not in a:
            yield k, None, y


def _by(rows: list[Row], key: str) -> dict[str, list[Row]]:
    out: dict[str, list[Row]] = {}
    for r in rows:
        out.setdefault(getattr(r, key), []).append(r)
    return out


class Comparison:
    """The findings of two consecutive snapshots, as rows of ``FINDINGS`` after lib and ver."""

    def __init__(self, old: Snapshot, new: Snapshot, parts: frozenset[str]):
        self.old, self.new, self.parts, self.found = old, new, parts, []

    def tell(self, kind, impacted, symbol, new_symbol=None, old_d=None, new_d=None, file=None, line=None, owner=None) -> None:
        self.found.append((kind, impacted, symbol, new_symbol, old_d, new_d, file, line, impacted if owner is None else owner))

    def run(self) -> list[tuple]:
        seen = [{f: t for f, t in s.types.items() if t.exported} for s in (self.old, self.new)]
        for fqn, o, n in _pairs(*seen):
            if n is None:
                if "types" in self.parts:
                    self.tell("TYPE_REMOVED", fqn, fqn, file=o.file, line=o.line)
            elif o is not None and o.kind is not None and n.kind is not None and o.kind != n.kind:
                if "types" in self.parts:
                    self.tell("TYPE_KIND_CHANGED", fqn, fqn, None, o.kind, n.kind, o.file, o.line)
            elif o is not None:
                self._type(o, n)
        return self.found

    def _type(self, o: Row, n: Row) -> None:
        p = self.parts
        if "types" in p:
            self._type_rules(o, n)
        if "details" in p:
            self._details(o, n)
        if "generic" in p or "type_parameters" in p:
            self._generic("t", o, n, o, n)
        if {"fields", "generic"} & p:
            for _, a, b in _pairs(o.fields, n.fields):
                self._field(o, n, a, b)
        thrown: dict[tuple, list] = {}
        if {"methods", "generic", "thrown", "added"} & p:
            for _, a, b in _pairs(o.methods, n.methods):
                self._method(o, n, a, b, thrown)
        if {"constructors", "generic", "thrown"} & p:
            old, new = (_by([c for c in s.constructors.get(o.fqn, ()) if c.visibility == "PUBLIC" or (c.visibility == "PROTECTED" and t.direct_subtypable)], "erasure") for s, t in ((self.old, o), (self.new, n)))
            for k, a in old.items():
                for x in a:
                    for y in new.get(k, (None,)):
                        self._constructor(o, n, x, y, thrown)
        if {"annotation_methods", "generic", "added"} & p and o.kind == "ANNOTATION":
            old, new = ({k: min(x, key=lambda m: (m.erasure, m.mid)) for k, x in _by(s.elements.get(o.fqn, []), "name").items()} for s in (self.old, self.new))
            for _, a, b in _pairs(old, new):
                self._element(o, n, a, b)
        if thrown:
            self._thrown(thrown)

    def _member(self, kind: str, o: Row, a: Row, b: Row | None, *details) -> None:
        known = a.file is not None or a.line is not None
        self.tell(kind, o.fqn, a.symbol, None if b is None else b.symbol, *(details or (None, None)), a.file if known else o.file, a.line if known else o.line, a.owner)

    def _type_rules(self, o: Row, n: Row) -> None:
        klass, nested = o.kind == "CLASS", o.enclosing is not None and n.enclosing is not None
        gained, lost = n.modifiers - o.modifiers, o.modifiers - n.modifiers
        sealed_now = "SEALED" in gained
        for kind, ok in (
            ("TYPE_NOW_PROTECTED", o.visibility == "PUBLIC" and n.visibility == "PROTECTED"), ("TYPE_NOW_SEALED", sealed_now and o.direct_subtypable),
            ("CLASS_NOW_ABSTRACT", klass and not o.eff_abstract and n.eff_abstract), ("CLASS_NOW_FINAL", klass and not sealed_now and o.subtypable and not n.subtypable),
            ("CLASS_NOW_CHECKED_EXCEPTION", klass and o.unchecked and n.checked), ("CLASS_NOW_STATIC", klass and nested and "STATIC" in gained),
            ("CLASS_NO_LONGER_STATIC", klass and nested and "STATIC" in lost),
            ("ANNOTATION_NO_LONGER_REPEATABLE", o.kind == "ANNOTATION" and o.repeatable and n.repeatable is False),
        ):
            if ok:
                self.tell(kind, o.fqn, o.fqn, file=o.file, line=o.line)

    def _details(self, o: Row, n: Row) -> None:
        """Findings of matched types that list something: supertypes, annotation targets, blockers."""
        at = {"file": o.file, "line": o.line}
        gone = {a for a in o.ancestors - n.ancestors if a not in self.old.types or self.old.types[a].exported}
        # What another lost supertype extends itself is reported through that one.
        further = {c for g in gone for up in (self.old.types[g].ancestors if g in self.old.types else (), PLATFORM_ANCESTORS.get(g, ())) for c in up}
        for a in gone - further:
            self.tell("TYPE_SUPERTYPE_REMOVED", o.fqn, o.fqn, old_d=a, **at)
        if o.kind == "ANNOTATION":
            for x in set(o.targets) - set(n.targets):
                self.tell("ANNOTATION_TARGET_REMOVED", o.fqn, o.fqn, old_d=x, **at)
        if o.kind == "CLASS" and o.concrete and not n.concrete:
            for s in n.blockers:
                self.tell("CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE", o.fqn, o.fqn, s, None, s, **at)

    def _field(self, o: Row, n: Row, a: Row | None, b: Row | None) -> None:
        if a is None:
            return
        if "fields" in self.parts:
            if b is None:
                self._member("FIELD_REMOVED", o, a, None)
                return
            gained, lost = b.modifiers - a.modifiers, a.modifiers - b.modifiers
            for kind, ok in (
                ("FIELD_NOW_PROTECTED", a.visibility == "PUBLIC" and b.visibility == "PROTECTED"), ("FIELD_NOW_FINAL", "FINAL" in gained), ("FIELD_NOW_STATIC", "STATIC" in gained),
                ("FIELD_NO_LONGER_STATIC", "STATIC" in lost),
            ):
                if ok:
                    self._member(kind, o, a, b)
        if b is not None and "generic" in self.parts:
            self._generic("f", o, n, a, b)

    def _method(self, o: Row, n: Row, a: Row | None, b: Row | None, thrown: dict) -> None:
        if a is None:
            if "added" in self.parts and b.abstract and ("SEALED" in o.modifiers or "SEALED" not in n.modifiers) and o.concrete:
                self.tell("TYPE_NEW_ABSTRACT_METHOD", o.fqn, o.fqn, b.symbol, None, b.symbol, n.file, n.line)
            return
        if b is None:
            if "methods" in self.parts:
                self._member("EXECUTABLE_REMOVED", o, a, None)
            return
        final = "FINAL" in a.modifiers or not o.subtypable
        if "methods" in self.parts:
            gained, lost = b.modifiers - a.modifiers, a.modifiers - b.modifiers
            open_ = not ("SEALED" in n.modifiers and "SEALED" not in o.modifiers)
            for kind, ok in (
                ("EXECUTABLE_NOW_PROTECTED", a.visibility == "PUBLIC" and b.visibility == "PROTECTED"), ("METHOD_NOW_ABSTRACT", open_ and "ABSTRACT" in gained and o.concrete),
                ("METHOD_NOW_FINAL", open_ and not final and ("FINAL" in b.modifiers or not n.subtypable)), ("METHOD_NOW_STATIC", "STATIC" in gained),
                ("METHOD_OVERRIDABLE_NOW_STATIC", "STATIC" in gained and (o.kind in INTERFACES or not final)), ("METHOD_NO_LONGER_STATIC", "STATIC" in lost),
            ):
                if ok:
                    self._member(kind, o, a, b)
        self._asks("m", o, n, a, b, final, thrown)

    def _asks(self, role: str, o: Row, n: Row, a: Row, b: Row, final: bool, thrown: dict) -> None:
        if "thrown" in self.parts and (a.thrown or b.thrown):
            thrown.setdefault((role, a.symbol, b.symbol), []).append((o, a, b, final))
        if "generic" in self.parts:
            self._generic(role, o, n, a, b, final)

    def _constructor(self, o: Row, n: Row, a: Row, b: Row | None, thrown: dict) -> None:
        if "constructors" in self.parts:
            if b is None:
                self._member("EXECUTABLE_REMOVED", o, a, None)
            elif a.visibility == "PUBLIC" and b.visibility == "PROTECTED" and "ABSTRACT" not in o.modifiers:
                self._member("EXECUTABLE_NOW_PROTECTED", o, a, b)
        if b is not None:
            self._asks("c", o, n, a, b, True, thrown)

    def _element(self, o: Row, n: Row, a: Row | None, b: Row | None) -> None:
        if a is None:
            if "added" in self.parts and not b.has_default:
                self.tell("ANNOTATION_NEW_METHOD_WITHOUT_DEFAULT", o.fqn, o.fqn, b.symbol, None, b.symbol, n.file, n.line)
            return
        if "annotation_methods" in self.parts:
            if b is None:
                self._member("EXECUTABLE_REMOVED", o, a, None)
            elif a.has_default and not b.has_default:
                self._member("ANNOTATION_METHOD_NO_LONGER_DEFAULT", o, a, b)
        if b is not None and "generic" in self.parts:
            self._generic("a", o, n, a, b, "FINAL" in a.modifiers or not o.subtypable)

    def _generic(self, role: str, o: Row, n: Row, a: Row, b: Row, final: bool = False) -> None:
        """The rules over generic types, for a pair whose written types differ."""
        if role == "t":
            if a.tps == b.tps:
                return
            q, scopes = ("void", "void", [], [], [], [], a.tps, b.tps, [], []), ()
        else:
            if a.ref == b.ref and a.params == b.params and a.tps == b.tps and a.type_scope == b.type_scope:
                return
            q, scopes = (a.ref, b.ref, a.type_tps, b.type_tps, a.type_scope, b.type_scope, a.tps, b.tps, a.params, b.params), (a.type_scope, b.type_scope)
        text = " ".join([q[0], q[1], *(x for x in (*q[8], *q[9]) if x is not None), *map(_bounds_text, (*scopes, a.tps, b.tps))])
        field = role == "f"
        for f in _generic(role, *q, final, field and "FINAL" in a.modifiers, field and a.is_const, self.new.headers_of(text)):
            if role == "t":
                self.tell(f["kind"], o.fqn, o.fqn, None, f["detail_old"], f["detail_new"], o.file, o.line)
            else:
                self._member(f["kind"], o, a, b, f["detail_old"], f["detail_new"])

    def _thrown(self, every: dict[tuple, list]) -> None:
        """Checked exceptions that an executable no longer throws, or throws now."""
        was, now = self.old.chain, self.new.chain
        for rows in every.values():
            # Equal lists tell something only where one of them became a checked exception.
            turned = any(a.thrown == b.thrown and any(now(e)[0] and not was(e)[0] for e in a.thrown) for _, a, b, _ in rows)
            rows = [r for r in rows if turned or r[1].thrown != r[2].thrown]
            one = {e for _, a, _, _ in rows for e in a.thrown if was(e)[0]}
            two = {e for _, _, b, _ in rows for e in b.thrown if now(e)[0]}
            for o, a, b, final in rows:
                for e in one:
                    if now(e)[0] and not any(e in now(x)[1] if final else x in now(e)[1] for x in two):
                        self._member("EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION", o, a, b, e, None)
                for e in two:
                    if not any(x in now(e)[1] for x in one):
                        self._member("EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION", o, a, b, None, e)


def _walk(parts: frozenset[str], types: dict, execs: dict, fields: dict, order: list) -> Iterator[tuple[str, Snapshot, Snapshot]]:
    """The newer version of each two consecutive snapshots, and both."""
    last = None
    for _, ver in sorted(order):
        s = Snapshot(types.pop(ver, []), execs.pop(ver, []), fields.pop(ver, []))
        if parts - {"types", "fields", "type_parameters"}:
            s.members(last)
        if parts & {"methods", "thrown", "added", "details", "generic"}:
            s.reach_methods()
        if parts & {"fields", "generic"}:
            s.reach_fields(s.fields())
        if last is not None:
            yield ver, last, s
        last = s


def findings_of(parts: frozenset[str]):
    def work(lib: str, *held) -> Iterator[tuple]:
        for ver, old, new in _walk(parts, *held):
            yield from ((lib, ver, *f) for f in dict.fromkeys(Comparison(old, new, parts).run()))

    return work


def method_matches(lib: str, *held) -> Iterator[tuple]:
    for ver, old, new in _walk(frozenset({"methods"}), *held):
        for fqn, o in old.types.items():
            n = new.types.get(fqn)
            if n is None or not (o.exported and n.exported) or (o.kind is not None and n.kind is not None and o.kind != n.kind):
                continue
            for k, a, b in _pairs(o.methods, n.methods):
                yield lib, ver, fqn, k, "REMOVED" if b is None else "ADDED" if a is None else "MATCHED"


# -- all libraries ------------------------------------------------------------------------------------------------


class LibraryDiff:
    """Findings and matches of all libraries: of ordinary ones in the task that holds them, of others by :class:`ApiDiff`."""

    def __init__(self, types: DataFrame, execs: DataFrame, fields: DataFrame, snapshots: DataFrame, library_rows: int = LIBRARY_ROWS, group_rows: int = GROUP_ROWS):
        self.tables, self.snapshots, self.spark = (types, execs, fields), snapshots, types.sparkSession
        self.library_rows, self.group_rows = library_rows, group_rows

    def _split(self, with_fields: bool) -> tuple[list[DataFrame], int, ApiDiff | None]:
        """(tables of ordinary libraries, their rows, the comparison of all other libraries if there are any)."""
        used = [*self.tables[: 3 if with_fields else 2]]
        counts = [t.where("lib IS NOT NULL AND ver IS NOT NULL").groupBy("lib", "ver").agg(F.count("*").alias("n"), F.lit(i).alias("of")) for i, t in enumerate(used)]
        every = counts[0]
        for c in counts[1:]:
            every = every.unionByName(c)
        by_lib = every.groupBy("lib").agg(F.sum("n").alias("n"), F.max(F.when(F.col("of") == 0, F.col("n"))).alias("most"))
        wide = (F.col("n") > self.library_rows) | (F.coalesce("most", F.lit(0)) > self.group_rows)
        total, n_wide = by_lib.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(wide)).first()
        if not n_wide:
            return [*self.tables, self.snapshots], total, None
        large = by_lib.where(wide).select("lib")
        inner, outer = ([t.join(large, "lib", how) for t in (*self.tables, self.snapshots)] for how in ("left_anti", "left_semi"))
        return inner, total, ApiDiff(ApiModel(*outer, group_rows=self.group_rows))

    def _in_tasks(self, tables: list[DataFrame], total: int, work, schema: str, with_fields: bool, execs: Column | None) -> DataFrame:
        types, members, fields, snapshots = tables
        text = lambda c: F.to_json(c).alias(c)
        entries = F.to_json(F.transform("annotations", lambda a: F.struct(a["fqn"].alias("fqn"), F.array_sort(F.map_entries(a["values"])).alias("entries")))).alias("annotations")
        takes = F.to_json(F.transform("params", lambda p: F.struct(p["ref"].alias("ref"), p["varargs"].alias("varargs")))).alias("params")
        named = "lib IS NOT NULL AND ver IS NOT NULL AND {} IS NOT NULL"
        members = members.where(named.format("owner")).where("name IS NOT NULL")
        members = members if execs is None else members.where(execs)
        packed = [
            types.where(named.format("fqn")).select(
                "lib", "ver", "fqn", "loaded_at", "kind", "visibility", text("modifiers"), "super_ref", text("interface_refs"), text("tps"), "enclosing",
                text("permitted"), entries, text("targets"), "file", "line",
            ),
            members.select(
                "lib", "ver", "owner", executable_fingerprint().alias("mid"), "name", "exec_kind", "visibility", text("modifiers"), "return_ref", takes, text("tps"), text("thrown"), "has_default", "line"
            ),
            fields.where(named.format("owner")).where("name IS NOT NULL AND visibility IN ('PUBLIC', 'PROTECTED')").select(
                "lib", "ver", "owner", field_fingerprint().alias("mid"), "line", "file", "name", "visibility", text("modifiers"), "type_ref", "is_const"
            ),
            snapshot_order(snapshots).select("lib", "ver", "seq"),
        ]
        buckets = max(1, -(-total // BUCKET_ROWS))
        blocks = None
        for kind, t in enumerate(packed):
            if kind == 2 and not with_fields:
                continue
            b = t.withColumn("bucket", F.pmod(F.xxhash64("lib"), F.lit(buckets)).cast("int")).mapInArrow(_pack(kind, buckets), "bucket int, kind int, block binary")
            blocks = b if blocks is None else blocks.unionByName(b)
        n = min(buckets, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS)))
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in schema.split(", ")]
        return blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_tasks(work, names, kinds), schema)

    def findings(self, *parts: str) -> DataFrame:
        """Rows of ``FINDINGS``, each once, of some of ``PARTS``."""
        with_fields = bool({"fields", "generic"} & {*parts})
        tables, total, wide = self._split(with_fields)
        only = F.col("exec_kind") == "CONSTRUCTOR" if {*parts} <= {"types", "fields", "type_parameters"} else None
        out = self._in_tasks(tables, total, findings_of(frozenset(parts)), FINDINGS, with_fields, only)
        if wide is None:
            return out
        made = {
            "types": wide.type_findings, "fields": wide.field_findings, "methods": wide.method_findings, "constructors": wide.constructor_findings,
            "annotation_methods": wide.annotation_method_findings, "details": wide._type_details, "added": wide._added_methods, "thrown": wide._thrown_findings,
            "generic": wide._generic_findings, "type_parameters": lambda: wide._generic_findings().where("impacted_symbol = impacted_type"),
        }
        more = [made[p]().select(*out.columns) for p in parts]
        every = more[0]
        for m in more[1:]:
            every = every.unionByName(m)
        return out.unionByName(every.distinct())

    def breaking_changes(self) -> DataFrame:
        """The same rows as those of :attr:`ApiDiff.breaking_changes`."""
        found = self.findings(*PARTS[:-1]).where(~F.startswith(F.col("impacted_symbol"), F.lit("java.lang.Object.")))
        kinds = self.spark.createDataFrame(
            [(k, i, nature, b, s) for i, (k, nature, b, s) in enumerate(BC_KINDS)],
            "kind string, kind_ordinal int, nature string, binary_breaking boolean, source_breaking boolean",
        )
        return found.join(F.broadcast(kinds), "kind")

    def method_match(self) -> DataFrame:
        tables, total, wide = self._split(False)
        out = self._in_tasks(tables, total, method_matches, MATCHES, False, None)
        return out if wide is None else out.unionByName(wide.method_match.select(*out.columns))
