"""Deeply nested JSON snapshots to flat node tables, tied by interval labels.

A depth-first walk gives every node of a record the numbers at which it was entered (``pre``) and left (``post``); node
a contains node d exactly if ``a.pre < d.pre`` and ``d.post < a.post``. Members of a type are walked before the types
nested in it, so the innermost container of a given kind is the last node of that kind entered before, if its interval
is still open: one sort of a record's nodes links every kind of table, whatever the depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolvent.session import Stages, ship_package

NODE_SCHEMA = "rec_id bigint, pre int, post int, level int, node string, parent int, pos int, path string, kind string, name string"

#: Child lists of each kind of node, in walking order: (field, kind of the children).
CHILDREN = {
    "snapshot": (("allTypes", "type"),),
    "type": (("formalTypeParameters", "tp"), ("methods", "method"), ("fields", "field"), ("nestedTypes", "type")),
    "method": (("formalTypeParameters", "tp"), ("parameters", "parameter")),
    "tp": (("bounds", "bound"),),
}
KIND_FIELD = {"type": "typeKind", "bound": "refKind"}
BATCH_ROWS, BATCH_CHARS = 50_000, 16_000_000


def elements(x: object) -> list:
    """A list field's elements: none if absent or null, one if a bare element is written for a list of one."""
    return x if isinstance(x, list) else [] if x is None else [x]


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def read_json(text: str) -> object:
    """What ``json.loads`` reads, with a stack of its own, for any depth; ValueError if it is no JSON."""
    stack: list[tuple[object, str | None]] = []  # open lists and objects, each with the key that waits for a value
    held: object = None
    key: str | None = None
    at, n = _SPACE.match(text, 0).end(), len(text)

    def closes(c: str) -> bool:
        return at < n and text[at] == c

    while True:
        # A value begins at ``at``.
        if at >= n:
            raise ValueError("cut off")
        c = text[at]
        if c in "{[":
            stack.append((held, key))
            held, key = ({} if c == "{" else []), None
            at = _SPACE.match(text, at + 1).end()
            if not closes("}" if c == "{" else "]"):
                if c == "{":
                    key, at = _key(text, at)
                continue
            value, at = held, at + 1
            held, key = stack.pop()
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
        elif w := next((w for w in _WORDS if text.startswith(w, at)), None):
            value, at = _WORDS[w], at + len(w)
        else:
            raise ValueError(f"no value at {at}")
        # It goes into what is open; what it fills is a value in turn.
        while True:
            at = _SPACE.match(text, at).end()
            if held is None:
                if at != n:
                    raise ValueError(f"more than one value at {at}")
                return value
            if isinstance(held, list):
                held.append(value)
            else:
                held[key] = value
            if closes(","):
                at = _SPACE.match(text, at + 1).end()
                if isinstance(held, dict):
                    key, at = _key(text, at)
                break
            if not closes("]" if isinstance(held, list) else "}"):
                raise ValueError(f"neither end nor more at {at}")
            value, at = held, at + 1
            held, key = stack.pop()


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _SPACE.match(text, at + 1).end()


def parse(payload: str | None) -> dict | None:
    """The snapshot object in a payload; JSON text held in JSON strings, however often, is read through; None if unreadable.

    Payloads that are nested too deeply for the usual reader are read with a stack of its own.
    """
    x: object = payload
    while isinstance(x, str):
        try:
            x = json.loads(x)
        except RecursionError:
            try:
                x = read_json(x)
            except ValueError:
                return None
        except ValueError:
            return None
    return x if isinstance(x, dict) else None


def _json(x: object) -> str:
    """JSON of a value of any depth."""
    try:
        return json.dumps(x)
    except RecursionError:
        out: list[str] = []
        todo: list[object] = [x]
        while todo:
            y = todo.pop()
            if isinstance(y, _Done):
                out.append(y)
            elif isinstance(y, dict):
                parts = [p for k, v in y.items() for p in (_Done(", "), _Done(f"{json.dumps(k)}: "), v)][1:]
                todo += [_Done("}"), *reversed(parts), _Done("{")]
            elif isinstance(y, list):
                parts = [p for v in y for p in (_Done(", "), v)][1:]
                todo += [_Done("]"), *reversed(parts), _Done("[")]
            else:
                out.append(json.dumps(y))
        return "".join(out)


class _Done(str):
    """Text that is JSON already."""


def _text(x: object) -> str | None:
    if x is None:
        return None
    s = x if isinstance(x, str) else _json(x)
    return s.encode("utf-8", "replace").decode("utf-8")  # lone surrogates have no place in UTF-8


def walk(snapshot: dict) -> Iterator[tuple]:
    """``pre, post, level, node, parent, pos, path, kind, name`` of each node below the snapshot, in the order left.

    The stack holds its own frames, so depth is not bounded by the interpreter's. Null elements are no nodes but keep
    their position; elements of a form that their list cannot have are no nodes either.
    """
    clock = 0

    def frame(obj, node, parent, pos, path):
        kids = (
            (k, child, p)
            for f, child in CHILDREN.get(node, ())
            for p, k in enumerate(elements(obj.get(f) if isinstance(obj, dict) else None))
        )
        return [obj, node, parent, pos, path, None, kids]

    stack = [frame(snapshot, "snapshot", -1, 0, "")]
    stack[0][5], clock = 0, 1
    while stack:
        obj, node, parent, pos, path, pre, kids = stack[-1]
        nxt = next(kids, None)
        if nxt is None:
            stack.pop()
            if node != "snapshot":
                if isinstance(obj, str):
                    kind, name = None, obj.split("<", 1)[0]
                else:
                    kind = obj.get(KIND_FIELD[node]) if node in KIND_FIELD else None
                    name = obj.get("name") if node in ("tp", "parameter") else obj.get("qualifiedName")
                yield pre, clock, len(stack), node, parent, pos, path, _text(kind), _text(name)
            clock += 1
            continue
        k, child, p = nxt
        if not (isinstance(k, dict) or (child == "bound" and isinstance(k, str))):
            continue
        at = (f"{path}.{p}" if path else str(p)) if child == "type" else path
        new = frame(k, child, pre, p, at)
        new[5] = clock
        clock += 1
        stack.append(new)


def _nodes(batches: Iterator[pa.RecordBatch], kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
    names = ["rec_id", "pre", "post", "level", "node", "parent", "pos", "path", "kind", "name"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    rows: list[tuple] = []
    held = 0  # characters of paths, which grow with depth

    def flush():
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        rows.clear()
        return out

    for b in batches:
        for rec, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if (snap := parse(payload.as_py())) is None:
                continue
            for n in walk(snap):
                if n[3] in kinds:
                    rows.append((rec, *n))
                    held += len(n[6])
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    held = 0
                    yield flush()
    if rows:
        yield flush()


def node_table(records: DataFrame, kinds: tuple[str, ...] = ("type", "method", "field", "parameter", "tp", "bound")) -> DataFrame:
    """All nodes of the kinds asked for, one row each, with interval labels (``NODE_SCHEMA``).

    Of the rows of one ``rec_id`` the one with the latest ``written_at`` counts (of equal times the greatest payload, so
    exact repeats count once). Payloads that are null, empty, cut off or hold no object give no nodes.
    """
    one = records.groupBy("rec_id").agg(F.max(F.struct("written_at", "payload")).alias("m")).select("rec_id", "m.payload")
    ship_package(records.sparkSession)
    want = frozenset(kinds)
    return one.where("payload IS NOT NULL").mapInArrow(lambda it: _nodes(it, want), NODE_SCHEMA)


def bounds_of_parameters(records: DataFrame) -> DataFrame:
    """Bounds of the formal type parameters of types and methods, linked to their containers by interval.

    ``rec_id, type_path, type_kind, method_no, tp_no, bound_no, bound``; ``method_no`` is -1 for a type's own
    parameters, ``type_kind`` empty where a type has none.
    """
    n = linked(node_table(records, ("type", "method", "tp", "bound"))).where("node = 'bound' AND p.pre < pre AND post < p.post AND t.pre < p.pre AND p.post < t.post")
    return n.select(*_of_type(), _method_no(F.col("p.pre"), F.col("p.post")), F.col("p.pos").alias("tp_no"), F.col("pos").alias("bound_no"), F.col("name").alias("bound"))


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes of one or more kinds with the last type, method and type parameter entered up to each: ``t, m, p``.

    Each is a container exactly if its interval is still open.
    """
    w = Window.partitionBy("rec_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def innermost(kind: str, *cols: str):
        return F.last(F.when(F.col("node") == kind, F.struct("pre", "post", *cols)), ignorenulls=True).over(w)

    return nodes.select("*", innermost("type", "path", "kind").alias("t"), innermost("method", "pos").alias("m"), innermost("tp", "pos").alias("p"))


def _of_type() -> tuple:
    return "rec_id", F.col("t.path").alias("type_path"), F.coalesce("t.kind", F.lit("")).alias("type_kind")


def _method_no(pre, post):
    """The place of the method around an interval, -1 if it is the type's own."""
    return F.when((F.col("m.pre") < pre) & (post < F.col("m.post")), F.col("m.pos")).otherwise(-1).alias("method_no")


def type_parameters(records: DataFrame) -> DataFrame:
    """``rec_id, type_path, type_kind, method_no, tp_no, name`` of the formal type parameters of types and methods."""
    n = linked(node_table(records, ("type", "method", "tp"))).where("node = 'tp' AND t.pre < pre AND post < t.post")
    return n.select(*_of_type(), _method_no(F.col("pre"), F.col("post")), F.col("pos").alias("tp_no"), "name")


def nested_types(records: DataFrame) -> DataFrame:
    """``rec_id, type_path, parent_path, type_kind, qualified_name`` of all types; ``parent_path`` is empty for the outermost."""
    nodes = Stages(records.sparkSession, "nested").put(node_table(records, ("type",)), "types")
    inner = flat_table(nodes, "type")
    outer = inner.select("rec_id", F.col("pre").alias("parent_pre"), F.col("post").alias("outer_post"), F.col("type_path").alias("parent_path"))
    j = inner.join(outer, ["rec_id", "parent_pre"], "left").where("outer_post IS NULL OR outer_post > post")
    return j.select("rec_id", "type_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), F.coalesce("type_kind", F.lit("")).alias("type_kind"), "qualified_name")


#: Columns of the flat table of each kind of node, beside rec_id, pre, post and parent_pre.
FLAT_COLUMNS = {
    "type": {"type_path": "path", "type_kind": "kind", "qualified_name": "name", "type_no": "pos"},
    "method": {"method_no": "pos", "qualified_name": "name"},
    "field": {"field_no": "pos", "qualified_name": "name"},
    "parameter": {"parameter_no": "pos", "name": "name"},
    "tp": {"tp_no": "pos", "name": "name"},
    "bound": {"bound_no": "pos", "ref_kind": "kind", "bound": "name"},
}


def flat_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of node; ``parent_pre`` is the ``pre`` of the node that directly contains a row."""
    cols = [F.col(c).alias(a) for a, c in FLAT_COLUMNS[kind].items()]
    return nodes.where(F.col("node") == kind).select("rec_id", "pre", "post", F.col("parent").alias("parent_pre"), *cols)


def containers(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Each node of ``inner`` with the ``pre`` of the node of ``outer`` that directly contains it."""
    o = outer.select("rec_id", F.col("pre").alias("outer_pre"), F.col("post").alias("outer_post"))
    j = inner.join(o, (inner.rec_id == o.rec_id) & (inner.parent_pre == o.outer_pre)).drop(o.rec_id)
    return j.where("outer_pre < pre AND post < outer_post").drop("outer_post")
