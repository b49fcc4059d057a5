"""Breaking changes between consecutive snapshots of every library, as one plan.

Old and new symbols meet in full-outer joins keyed by (lib, newer version, type, member key). A rule is a predicate over
a matched, removed or added pair; the rules of one scope are evaluated together in a single projection over its match
table, as an array of findings of which the null ones are dropped. Rules over generic types reach a vectorised Python
function only for pairs whose written types differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evolvent.functions import typealg as A
from evolvent.model import BC_KINDS
from evolvent.operators.api_model import KEY, PLATFORM_ANCESTORS, ApiModel, bounds_text, has
from evolvent.operators.report import has_annotation, matches_any
from evolvent.session import once, together

PAIR = ["lib", "ver"]
TOLD = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "detail_old", "detail_new")]))
o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))


def finding(kind: str, when: Column, impacted: Column, symbol: Column, new: Column | None = None, old_d=None, new_d=None, file=None, line=None, owner=None) -> Column:
    none = F.lit(None).cast("string")
    s = F.struct(
        F.lit(kind).alias("kind"), impacted.alias("impacted_type"), symbol.alias("impacted_symbol"), (none if new is None else new).alias("new_symbol"),
        (none if old_d is None else old_d).alias("detail_old"), (none if new_d is None else new_d).alias("detail_new"),
        (none if file is None else file).alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"), (impacted if owner is None else owner).alias("owner"),
    )
    return F.when(when, s)


@dataclass(frozen=True)
class Rule:
    """A predicate over a match table: ``kind``, the ``status`` of pairs it looks at, the condition, details to show."""

    kind: str
    status: str
    when: Column
    detail_old: Column | None = None
    detail_new: Column | None = None


def lost(m: str) -> Column:
    return has(o("modifiers"), m) & ~has(n("modifiers"), m)


def gained(m: str) -> Column:
    return ~has(o("modifiers"), m) & has(n("modifiers"), m)


def now_protected() -> Column:
    return (o("visibility") == "PUBLIC") & (n("visibility") == "PROTECTED")


OLD, NEW = (lambda c: F.col(f"ot.{c}")), (lambda c: F.col(f"nt.{c}"))


def newly_sealed() -> Column:
    return ~has(OLD("modifiers"), "SEALED") & has(NEW("modifiers"), "SEALED")


def old_final() -> Column:
    """Whether the old executable cannot be overridden by clients."""
    return has(o("modifiers"), "FINAL") | ~OLD("subtypable")


def member_place() -> tuple[Column, Column]:
    """(file, line) of the old member, in its owner's file; the impacted type's where nothing is known of the member's."""
    known = o("file").isNotNull() | o("line").isNotNull()
    return F.when(known, o("file")).otherwise(OLD("file")), F.when(known, o("line")).otherwise(OLD("line"))


def type_rules() -> list[Rule]:
    klass = o("kind") == "CLASS"
    nested = o("enclosing").isNotNull() & n("enclosing").isNotNull()
    sealed_now = gained("SEALED")
    return [
        Rule("TYPE_REMOVED", "REMOVED", F.lit(True)),
        Rule("TYPE_KIND_CHANGED", "KIND_CHANGED", F.lit(True), o("kind"), n("kind")),
        Rule("TYPE_NOW_PROTECTED", "MATCHED", now_protected()),
        Rule("TYPE_NOW_SEALED", "MATCHED", sealed_now & o("direct_subtypable")),
        Rule("CLASS_NOW_ABSTRACT", "MATCHED", klass & ~o("eff_abstract") & n("eff_abstract")),
        Rule("CLASS_NOW_FINAL", "MATCHED", klass & ~sealed_now & o("subtypable") & ~n("subtypable")),
        Rule("CLASS_NOW_CHECKED_EXCEPTION", "MATCHED", klass & o("unchecked") & n("checked")),
        Rule("CLASS_NOW_STATIC", "MATCHED", klass & nested & gained("STATIC")),
        Rule("CLASS_NO_LONGER_STATIC", "MATCHED", klass & nested & lost("STATIC")),
        Rule("ANNOTATION_NO_LONGER_REPEATABLE", "MATCHED", (o("kind") == "ANNOTATION") & o("repeatable") & ~n("repeatable")),
    ]


def field_rules() -> list[Rule]:
    return [
        Rule("FIELD_REMOVED", "REMOVED", F.lit(True)),
        Rule("FIELD_NOW_PROTECTED", "MATCHED", now_protected()),
        Rule("FIELD_NOW_FINAL", "MATCHED", gained("FINAL")),
        Rule("FIELD_NOW_STATIC", "MATCHED", gained("STATIC")),
        Rule("FIELD_NO_LONGER_STATIC", "MATCHED", lost("STATIC")),
    ]


def method_rules() -> list[Rule]:
    overridable = OLD("kind").isin("INTERFACE", "ANNOTATION") | ~old_final()
    return [
        Rule("EXECUTABLE_REMOVED", "REMOVED", F.lit(True)),
        Rule("EXECUTABLE_NOW_PROTECTED", "MATCHED", now_protected()),
        Rule("METHOD_NOW_ABSTRACT", "MATCHED", ~newly_sealed() & gained("ABSTRACT") & F.col("o_concrete")),
        Rule("METHOD_NOW_FINAL", "MATCHED", ~newly_sealed() & ~old_final() & (has(n("modifiers"), "FINAL") | ~NEW("subtypable"))),
        Rule("METHOD_NOW_STATIC", "MATCHED", gained("STATIC")),
        Rule("METHOD_OVERRIDABLE_NOW_STATIC", "MATCHED", gained("STATIC") & overridable),
        Rule("METHOD_NO_LONGER_STATIC", "MATCHED", lost("STATIC")),
    ]


def constructor_rules() -> list[Rule]:
    return [
        Rule("EXECUTABLE_REMOVED", "REMOVED", F.lit(True)),
        Rule("EXECUTABLE_NOW_PROTECTED", "MATCHED", now_protected() & ~has(OLD("modifiers"), "ABSTRACT")),
    ]


def annotation_method_rules() -> list[Rule]:
    return [
        Rule("EXECUTABLE_REMOVED", "REMOVED", F.lit(True)),
        Rule("ANNOTATION_METHOD_NO_LONGER_DEFAULT", "MATCHED", o("has_default") & ~n("has_default")),
    ]


@dataclass(frozen=True)
class RuleSet:
    """The rules of each scope that a comparison applies; any list can be replaced.

    ``generic`` says whether the rules over generic types and thrown exceptions, which need more than a pair's columns,
    are applied too.
    """

    types: list[Rule] = field(default_factory=type_rules)
    fields: list[Rule] = field(default_factory=field_rules)
    methods: list[Rule] = field(default_factory=method_rules)
    constructors: list[Rule] = field(default_factory=constructor_rules)
    annotation_methods: list[Rule] = field(default_factory=annotation_method_rules)
    generic: bool = True


@dataclass(frozen=True)
class SymbolMatcher:
    """By which column the members of a matched type meet across versions; types meet by name."""

    fields: str = "name"
    methods: str = "erasure"
    constructors: str = "erasure"
    annotation_methods: str = "name"


def _tps(x) -> A.Tps:
    return [] if x is None else [(t["name"], list(t["bounds"]) if t["bounds"] is not None else []) for t in x]


def _world(headers) -> A.World:
    return A.World({h["fqn"]: (list(h["tps"]), list(h["supers"])) for h in (headers if headers is not None else ())})


#: Columns of a question to the rules over generic types, in the order in which :func:`_generic` takes them.
GENERIC = ("role", "o_ref", "n_ref", "o_type_tps", "n_type_tps", "o_scope", "n_scope", "o_tps", "n_tps", "o_params", "n_params", "final", "o_final", "constant", "headers")


@F.pandas_udf(TOLD)
def generic_changes(x: pd.DataFrame) -> pd.Series:
    """Findings of the rules over generic types for one matched field (``role`` f), executable (m, c or a) or type (t).

    It is asked once for each distinct question, however many heirs share a member.
    """
    return pd.Series([list(_generic(*q)) for q in zip(*(x[c] for c in GENERIC))])


def _generic(role, o_ref, n_ref, o_type_tps, n_type_tps, o_scope, n_scope, o_tps, n_tps, o_params, n_params, final, o_final, constant, headers):
    ot, nt, os, ns, om, nm = map(_tps, (o_type_tps, n_type_tps, o_scope, n_scope, o_tps, n_tps))
    before, after = A.Scope(om, os), A.Scope(nm, ns)
    norm = A.Normalizer((om, nm), (ot, nt))
    world = _world(headers)
    final = bool(final)

    def told(kind: str, a: str | None, b: str | None) -> dict:
        return {"kind": kind, "detail_old": a, "detail_new": b}

    if role == "t":
        yield from _parameter_changes(om, nm, norm, before, after, world, told, overridable=True, of_type=True)
        return
    old, new = A.parse(o_ref, before.names), A.parse(n_ref, after.names)
    if role in "fma" and old != new and norm.old(old) != norm.new(new):
        a, b = norm.old(old), norm.new(new)
        shown = A.render(old), A.render(new)
        reads = A.whether(lambda: world.source_compatible(after, a, b))
        differs = A.erased(before, old) != A.erased(after, new)
        if role == "f":
            if differs and not constant:
                yield told("FIELD_TYPE_ERASURE_CHANGED", *shown)
            if not reads or not (o_final or A.whether(lambda: world.assignable(after, a, b))):
                yield told("FIELD_TYPE_CHANGED_INCOMPATIBLE", *shown)
        else:
            if differs:
                yield told("METHOD_RETURN_TYPE_ERASURE_CHANGED", *shown)
            if not reads or not (final or A.whether(lambda: world.subtype(after, a, b))):
                yield told("METHOD_RETURN_TYPE_CHANGED_INCOMPATIBLE", *shown)
    if role == "f":
        return
    for s, t in zip(o_params if o_params is not None else (), n_params if n_params is not None else ()):
        p, q = A.parse(s, before.names), A.parse(t, after.names)
        if p[0] != "C" or q[0] != "C":
            continue
        if len(p[2]) != len(q[2]):
            yield told("EXECUTABLE_PARAMETER_GENERICS_CHANGED", A.render(p), A.render(q))
            break
        a, b = norm.old(p), norm.new(q)
        if not (A.whether(lambda: world.subtype(after, a, b)) if final else a == q):
            yield told("EXECUTABLE_PARAMETER_GENERICS_CHANGED", A.render(p), A.render(q))
    yield from _parameter_changes(om, nm, norm, before, after, world, told, overridable=not final, of_type=False)


def _parameter_changes(old: A.Tps, new: A.Tps, norm, before, after, world, told, overridable: bool, of_type: bool):
    """Changes of formal type parameters, of a type or an executable."""
    if len(old) > len(new) and (of_type or overridable or new):
        for name, _ in old[len(new) :]:
            yield told("FORMAL_TYPE_PARAMETER_REMOVED", name, None)
        return
    if len(new) > len(old) > 0:
        for name, _ in new[len(old) :]:
            yield told("FORMAL_TYPE_PARAMETER_ADDED", None, name)
        return
    for (name, _), (other, _) in zip(old, new):
        a = [norm.old(b) for b in before.bounds[name]]
        b = after.bounds[other]
        if not of_type and overridable:
            changed = set(a) != set(b)
        else:
            changed = any(y != A.OBJECT and not any(A.whether(lambda: world.subtype(after, x, y)) for x in a) for y in b)
        if changed:
            yield told("FORMAL_TYPE_PARAMETER_CHANGED", name, other)


class ApiDiff:
    """Matches and breaking changes between each snapshot of ``model`` and the next one of its library.

    ``rules`` and ``matcher`` say which rules apply and how symbols meet. ``kinds`` are the kinds of findings with their
    nature and what they break; rules of one's own bring further rows.
    """

    def __init__(self, model: ApiModel, rules: RuleSet | None = None, matcher: SymbolMatcher = SymbolMatcher(), kinds=BC_KINDS):
        self.model, self.stages, self.spark = model, model.stages, model.spark
        self.rules, self.matcher, self.kinds = rules or RuleSet(), matcher, kinds

    def _sides(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows as the older side, as the newer side), each keyed by the newer version."""
        order = self.model.order
        cols = [c for c in df.columns if c not in (*KEY, *keys)]
        old = df.join(order.where("next_ver IS NOT NULL").select(*KEY, "next_ver"), KEY)
        old = old.select("lib", F.col("next_ver").alias("ver"), F.col("ver").alias("old_ver"), *keys, F.struct(*cols).alias("o"))
        new = df.join(order.where("seq > 1").select(*KEY), KEY).select(*KEY, *keys, F.struct(*cols).alias("n"))
        return old, new

    @once
    def type_match(self) -> DataFrame:
        """``lib, ver, fqn, status, o, n`` of exported types; status MATCHED, REMOVED, ADDED or KIND_CHANGED."""
        old, new = self._sides(self.model.seen_types.where("exported AND NOT outside"), ["fqn"])
        status = (
            F.when(F.col("n").isNull(), "REMOVED").when(F.col("o").isNull(), "ADDED").when(o("kind") != n("kind"), "KIND_CHANGED").otherwise("MATCHED")
        )
        return self.stages.put(old.drop("old_ver").join(new, [*PAIR, "fqn"], "full_outer").withColumn("status", status), "type_match")

    @once
    def pairs(self) -> DataFrame:
        """``lib, ver, fqn, ot, nt`` of types matched with equal kind: only their members are compared."""
        keep = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("kind", "modifiers", "subtypable", "file", "line")])
        return self.stages.put(self.type_match.where("status = 'MATCHED'").select(*PAIR, "fqn", keep("o").alias("ot"), keep("n").alias("nt")), "pairs")

    @once
    def concrete(self) -> DataFrame:
        """``lib, ver, fqn, o_concrete, n_concrete``: whether clients can write a concrete subclass of a matched type."""
        blocked = self.model.blockers.select(*KEY, "fqn").distinct()
        later = self.model.order.where("next_ver IS NOT NULL").select(*KEY, "next_ver")
        old = blocked.join(later, KEY).select("lib", F.col("next_ver").alias("ver"), "fqn", F.lit(True).alias("o_blocked"))
        p = self.pairs.join(old, [*PAIR, "fqn"], "left").join(blocked.withColumn("n_blocked", F.lit(True)), [*PAIR, "fqn"], "left")
        return self.stages.put(
            p.select(*PAIR, "fqn", (OLD("subtypable") & F.col("o_blocked").isNull()).alias("o_concrete"), (NEW("subtypable") & F.col("n_blocked").isNull()).alias("n_concrete")), "concrete"
        )

    def _member_match(self, members: DataFrame, key: str) -> DataFrame:
        old, new = self._sides(members, ["fqn", key])
        status = F.when(F.col("n").isNull(), "REMOVED").when(F.col("o").isNull(), "ADDED").otherwise("MATCHED")
        both = old.drop("old_ver").join(new, [*PAIR, "fqn", key], "full_outer").withColumn("status", status)
        return both.join(self.pairs, [*PAIR, "fqn"])

    @once
    def field_match(self) -> DataFrame:
        return self.stages.put(self._member_match(self.model.effective_fields, self.matcher.fields), "field_match")

    @once
    def method_match(self) -> DataFrame:
        both = self._member_match(self.model.effective_methods, self.matcher.methods).join(self.concrete, [*PAIR, "fqn"])
        return self.stages.put(both, "method_match")

    @once
    def constructor_match(self) -> DataFrame:
        return self.stages.put(self._member_match(self.model.exported_constructors(), self.matcher.constructors), "constructor_match")

    @once
    def annotation_method_match(self) -> DataFrame:
        """Annotation elements meet by name alone."""
        x = self.model.annotation_methods.join(self.model.types.where("kind = 'ANNOTATION'").select(*KEY, F.col("fqn").alias("owner")), [*KEY, "owner"], "left_semi")
        key = self.matcher.annotation_methods
        rest = sorted((c for c in x.columns if c not in (*KEY, "owner", key)), key=lambda c: c != "erasure")
        one = x.groupBy(*KEY, F.col("owner").alias("fqn"), key).agg(F.min(F.struct(*rest)).alias("m"))
        return self.stages.put(self._member_match(one.select(*KEY, "fqn", key, "m.*").withColumn("owner", F.col("fqn")), key), "annotation_match")

    def events(self) -> DataFrame:
        """``lib, ver, scope, status, fqn, key``: what met, came and went, for any fold over a comparison."""
        m = self.matcher
        scopes = [("type", self.type_match, None), ("field", self.field_match, m.fields), ("method", self.method_match, m.methods),
                  ("constructor", self.constructor_match, m.constructors), ("annotation_method", self.annotation_method_match, m.annotation_methods)]
        each = [t.select(*PAIR, F.lit(s).alias("scope"), "status", "fqn", (F.col(k) if k else F.lit(None).cast("string")).alias("key")) for s, t, k in scopes]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def _fire(self, match: DataFrame, rules: list[Rule], member: bool, more: list[Column] = ()) -> DataFrame:
        """Findings of all rules of one scope, in one pass over its match table."""
        out = []
        for r in rules:
            ok = (F.col("status") == r.status) & r.when
            symbol = o("symbol") if member else F.col("fqn")
            file, line = member_place() if member else (o("file"), o("line"))
            new = n("symbol") if member else None
            out.append(finding(r.kind, F.coalesce(ok, F.lit(False)), F.col("fqn"), symbol, new, r.detail_old, r.detail_new, file, line, o("owner") if member else None))
        out = out or [finding("", F.lit(False), F.col("fqn"), F.col("fqn"))]
        found = F.filter(F.array(*out, *more), lambda x: x.isNotNull())
        return match.select(*PAIR, F.explode(found).alias("f")).select(*PAIR, "f.*")

    # -- rules that need more than the pair -------------------------------------------------------------------

    @once
    def gone(self) -> DataFrame:
        """``lib, ver, old_ver, fqn, ancestor``: exported supertypes that the newer version of a matched type lost."""
        a, order = self.model.ancestors, self.model.order
        shown = self.model.props.select(*KEY, F.col("fqn").alias("ancestor"), "exported")
        old = a.join(shown, [*KEY, "ancestor"], "left").where("exported IS NULL OR exported").join(order.where("next_ver IS NOT NULL"), KEY)
        old = old.select("lib", F.col("next_ver").alias("ver"), F.col("ver").alias("old_ver"), "fqn", "ancestor")
        kept = old.join(self.pairs.select(*PAIR, "fqn"), [*PAIR, "fqn"], "left_semi")
        return self.stages.put(kept.join(a.select(*KEY, "fqn", "ancestor"), [*KEY, "fqn", "ancestor"], "left_anti"), "gone")

    def supertypes_removed(self) -> DataFrame:
        """``lib, ver, fqn, lost``: exported supertypes that the newer version lost, only the nearest of each line."""
        a, gone = self.model.ancestors, self.gone
        # What another lost supertype extends itself is reported through that one.
        further = gone.join(
            a.select("lib", F.col("ver").alias("old_ver"), F.col("fqn").alias("ancestor"), F.col("ancestor").alias("covered")), ["lib", "old_ver", "ancestor"]
        ).select(*PAIR, "fqn", F.col("covered").alias("ancestor"))
        platform = [(t, s) for t, ups in PLATFORM_ANCESTORS.items() for s in ups]
        known = self.spark.createDataFrame(platform, "ancestor string, covered string")
        outside = gone.join(F.broadcast(known), "ancestor").select(*PAIR, "fqn", F.col("covered").alias("ancestor"))
        near = gone.join(further.unionByName(outside), [*PAIR, "fqn", "ancestor"], "left_anti")
        return near.select(*PAIR, "fqn", F.col("ancestor").alias("lost"))

    def _with_headers(self, rows: DataFrame, text: Column) -> DataFrame:
        """Distinct ``rows`` with the headers of every type that ``text`` names and of its supertypes, in the newer version."""
        named = F.array_distinct(F.regexp_extract_all(F.translate(text, "/", "."), F.lit(r"([A-Za-z_$][\w$.]*)")))
        rows = self.stages.put(rows.withColumns({"id": F.monotonically_increasing_id(), "mentions": named}), "questions")
        mention = rows.select(*PAIR, "id", F.explode("mentions").alias("fqn"))
        above = self.model.lineage.select(*KEY, "fqn", "owner").join(mention.select(*PAIR, "fqn").distinct(), [*KEY, "fqn"])
        head = F.struct(F.col("fqn"), F.transform("tps", lambda x: x["name"]).alias("tps"), F.transform("supers", lambda s: s["text"]).alias("supers"))
        heads = self.model.types.select(*KEY, F.col("fqn").alias("owner"), head.alias("h"))
        # A question has as many headers as the types that it names have supertypes.
        told = mention.join(above, [*PAIR, "fqn"]).select(*PAIR, "id", "owner").distinct().join(heads, [*PAIR, "owner"])
        return rows.join(told.groupBy(*PAIR, "id").agg(F.collect_list("h").alias("headers")), [*PAIR, "id"], "left").drop("mentions")

    def _generic_rows(self, match: DataFrame, role: str) -> DataFrame:
        """What the rules over generic types ask of matched members or types whose written types differ."""
        type_, member = role == "t", role != "t"
        tps_type = match.schema["o"].dataType["tps" if type_ else "type_tps"].dataType
        no_tps, no_refs = F.array().cast(tps_type), F.array().cast("array<string>")
        ref = {"f": "type_ref", "t": None}.get(role, "return_ref")
        refs = lambda s: F.col(f"{s}.{ref}") if member else F.lit("void")
        params = lambda s: no_refs if role in "ft" else F.transform(F.col(f"{s}.params"), lambda p: p["ref"])
        tps = lambda s: no_tps if role == "f" else F.col(f"{s}.tps")
        around = lambda s, c: F.col(f"{s}.{c}") if member else no_tps
        final = F.lit(False) if role in "ft" else F.lit(True) if role == "c" else old_final()
        file, line = member_place() if member else (o("file"), o("line"))
        both = lambda name, of: (of("o").alias(f"o_{name}"), of("n").alias(f"n_{name}"))
        rows = match.where("status = 'MATCHED'").select(
            *PAIR, "fqn", F.lit(role).alias("role"), *both("ref", refs), *both("type_tps", lambda s: around(s, "type_tps")), *both("scope", lambda s: around(s, "type_scope")),
            *both("tps", tps), *both("params", params), F.coalesce(final, F.lit(False)).alias("final"),
            (has(o("modifiers"), "FINAL") if role == "f" else F.lit(False)).alias("o_final"), (o("is_const") if role == "f" else F.lit(False)).alias("constant"),
            (o("symbol") if member else F.col("fqn")).alias("o_symbol"), (n("symbol") if member else F.lit(None).cast("string")).alias("n_symbol"), file.alias("file"), line.alias("line"),
            (o("owner") if member else F.col("fqn")).alias("owner"),
        )
        differs = F.lit(False)
        for c in ("ref", "params", "tps", "scope"):
            differs = differs | (F.col(f"o_{c}") != F.col(f"n_{c}"))
        return rows.where(differs)

    def _generic_findings(self) -> DataFrame:
        """Findings over generic types: of all fields, executables and types in one pass, each distinct question once."""
        matches = [(self.field_match, "f"), (self.method_match, "m"), (self.constructor_match, "c"), (self.annotation_method_match, "a"), (self.type_match, "t")]
        rows = self._generic_rows(*matches[0])
        for m in matches[1:]:
            rows = rows.unionByName(self._generic_rows(*m))
        rows = self.stages.put(rows, "generic")
        asked = [c for c in GENERIC if c != "headers"]
        text = F.concat_ws(" ", "o_ref", "n_ref", F.array_join("o_params", " "), F.array_join("n_params", " "), *[bounds_text(F.col(f"{v}_{c}")) for v in "on" for c in ("scope", "tps")])
        ready = self._with_headers(rows.select(*PAIR, *asked).distinct(), text)
        answers = ready.select(*PAIR, *asked, generic_changes(F.struct(*GENERIC)).alias("f")).where("size(f) > 0")
        out = rows.join(answers, [*PAIR, *asked]).withColumn("f", F.explode("f"))
        return out.select(
            *PAIR, "f.kind", F.col("fqn").alias("impacted_type"), F.col("o_symbol").alias("impacted_symbol"), F.col("n_symbol").alias("new_symbol"),
            "f.detail_old", "f.detail_new", "file", F.col("line").cast("int").alias("line"), "owner",
        )

    @once
    def exceptions(self) -> DataFrame:
        """``lib, ver, exc, checked, up``: every type that an executable of the snapshot throws, with its supertypes."""
        thrown = self.model.executables.select(*KEY, F.explode("thrown_types").alias("exc"))
        order = self.model.order.select("lib", "ver", "next_ver")
        later = thrown.join(order, KEY).where("next_ver IS NOT NULL").select("lib", F.col("next_ver").alias("ver"), "exc")
        every = thrown.unionByName(later).distinct()
        own = self.model.types.where("kind IN ('CLASS', 'ENUM', 'RECORD')").select(*KEY, F.col("fqn").alias("exc")).withColumn("declared", F.lit(True))
        up = self.model.ancestors.groupBy(*KEY, F.col("fqn").alias("exc")).agg(F.collect_set("ancestor").alias("up"))
        known = self.spark.createDataFrame([(t, sorted(a)) for t, a in PLATFORM_ANCESTORS.items()], "exc string, known array<string>")
        x = every.join(own, [*KEY, "exc"], "left").join(up, [*KEY, "exc"], "left").join(F.broadcast(known), "exc", "left")
        ups = F.coalesce(F.when(F.col("declared"), F.col("up")), "known", F.array().cast("array<string>"))
        chain = F.array_union(ups, F.array("exc"))
        unchecked = F.array_contains(chain, "java.lang.RuntimeException") | F.array_contains(chain, "java.lang.Error")
        return self.stages.put(x.select(*KEY, "exc", (F.array_contains(chain, "java.lang.Throwable") & ~unchecked).alias("checked"), chain.alias("up")), "exceptions")

    def _now_checked(self) -> DataFrame:
        """``lib, ver, exc``: types that are checked exceptions in the newer snapshot and were none in the older one."""
        later = self.model.order.where("next_ver IS NOT NULL").select(*KEY, "next_ver")
        was = self.exceptions.where("NOT checked").join(later, KEY).select("lib", F.col("next_ver").alias("ver"), "exc")
        return self.exceptions.where("checked").select(*KEY, "exc").join(was, [*KEY, "exc"], "left_semi")

    def _thrown_findings(self) -> DataFrame:
        """Checked exceptions that an executable no longer throws, or throws now."""
        exc = self.exceptions
        sides = []
        for match, role in ((self.method_match, "m"), (self.constructor_match, "c")):
            final = F.coalesce(F.lit(True) if role == "c" else old_final(), F.lit(False))
            file, line = member_place()
            sides.append(
                match.where("status = 'MATCHED'").where((F.size(o("thrown_types")) > 0) | (F.size(n("thrown_types")) > 0)).select(
                    *PAIR, "fqn", F.concat_ws("\x00", F.lit(role), o("symbol"), n("symbol")).alias("key"), final.alias("final"), o("thrown_types").alias("t1"), n("thrown_types").alias("t2"),
                    o("symbol").alias("o_symbol"), n("symbol").alias("n_symbol"), file.alias("file"), line.alias("line"), o("owner").alias("owner"),
                )
            )
        every = sides[0].unionByName(sides[1])
        # Equal lists tell something only where one of them became a checked exception.
        same, turned = F.col("t1") == F.col("t2"), self._now_checked()
        among = every.where(same).select(*PAIR, "fqn", "key", F.explode("t1").alias("exc")).join(turned, [*PAIR, "exc"], "left_semi")
        rows = every.where(~same).unionByName(every.join(among.select(*PAIR, "fqn", "key").distinct(), [*PAIR, "fqn", "key"], "left_semi").where(same))
        rows = self.stages.put(rows, "thrown")
        prev = self.model.order.where("next_ver IS NOT NULL").select("lib", F.col("next_ver").alias("ver"), F.col("ver").alias("old_ver"))
        id_ = [*PAIR, "fqn", "key"]
        one = rows.select(*id_, F.explode("t1").alias("exc")).join(prev, PAIR)
        one = one.join(exc.select("lib", F.col("ver").alias("old_ver"), "exc", F.col("checked").alias("was")), ["lib", "old_ver", "exc"]).where("was")
        one = one.join(exc.select(*KEY, "exc", "checked", "up"), [*KEY, "exc"]).groupBy(*id_).agg(F.collect_set(F.struct("exc", "checked", "up")).alias("e1"))
        two = rows.select(*id_, F.explode("t2").alias("exc")).join(exc, [*KEY, "exc"]).where("checked")
        two = two.groupBy(*id_).agg(F.collect_set(F.struct("exc", "checked", "up")).alias("e2"))
        none = F.array().cast("array<struct<exc:string,checked:boolean,up:array<string>>>")
        x = rows.join(one, id_, "left").join(two, id_, "left").withColumns({"e1": F.coalesce("e1", none), "e2": F.coalesce("e2", none)})
        sub = lambda a, b: F.array_contains(a["up"], b["exc"])
        gone = F.filter("e1", lambda a: a["checked"] & ~F.exists("e2", lambda b: F.when(F.col("final"), sub(b, a)).otherwise(sub(a, b))))
        came = F.filter("e2", lambda b: ~F.exists("e1", lambda a: sub(b, a)))
        null = F.lit(None).cast("string")
        told = F.concat(
            F.transform(gone, lambda a: F.struct(F.lit("EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION").alias("kind"), a["exc"].alias("detail_old"), null.alias("detail_new"))),
            F.transform(came, lambda a: F.struct(F.lit("EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION").alias("kind"), null.alias("detail_old"), a["exc"].alias("detail_new"))),
        )
        return x.withColumn("f", F.explode(told)).select(
            *PAIR, "f.kind", F.col("fqn").alias("impacted_type"), F.col("o_symbol").alias("impacted_symbol"), F.col("n_symbol").alias("new_symbol"),
            "f.detail_old", "f.detail_new", "file", F.col("line").cast("int").alias("line"), "owner",
        )

    def _added_methods(self) -> DataFrame:
        """New abstract methods of types that clients extend, and annotation elements without default; on the new type."""
        abstract = has(n("modifiers"), "ABSTRACT") & (has(OLD("modifiers"), "SEALED") | ~has(NEW("modifiers"), "SEALED")) & F.col("o_concrete")
        cols = lambda kind: (
            *PAIR, F.lit(kind).alias("kind"), F.col("fqn").alias("impacted_type"), F.col("fqn").alias("impacted_symbol"), n("symbol").alias("new_symbol"),
            F.lit(None).cast("string").alias("detail_old"), n("symbol").alias("detail_new"), NEW("file").alias("file"), NEW("line").alias("line"), F.col("fqn").alias("owner"),
        )
        added = "status = 'ADDED'"
        m = self.method_match.where(added).where(abstract).select(*cols("TYPE_NEW_ABSTRACT_METHOD"))
        a = self.annotation_method_match.where(added).where(~n("has_default")).select(*cols("ANNOTATION_NEW_METHOD_WITHOUT_DEFAULT"))
        return m.unionByName(a)

    def _type_details(self) -> DataFrame:
        """Findings of matched types that list something: supertypes, annotation targets, blockers."""
        t = self.type_match.where("status = 'MATCHED'")
        null = F.lit(None).cast("string")
        at = lambda kind, new, old_d, new_d: (
            *PAIR, F.lit(kind).alias("kind"), F.col("fqn").alias("impacted_type"), F.col("fqn").alias("impacted_symbol"), new.alias("new_symbol"),
            old_d.alias("detail_old"), new_d.alias("detail_new"), "file", "line", F.col("fqn").alias("owner"),
        )
        place = [o("file").alias("file"), o("line").alias("line")]
        lost_ = self.supertypes_removed().join(t.select(*PAIR, "fqn", *place), [*PAIR, "fqn"]).select(*at("TYPE_SUPERTYPE_REMOVED", null, F.col("lost"), null))
        targets = t.where(o("kind") == "ANNOTATION").select(*PAIR, "fqn", *place, F.explode(F.array_except(o("targets"), n("targets"))).alias("x"))
        targets = targets.select(*at("ANNOTATION_TARGET_REMOVED", null, F.col("x"), null))
        shut = t.where(o("kind") == "CLASS").join(self.concrete.where("o_concrete AND NOT n_concrete"), [*PAIR, "fqn"], "left_semi").select(*PAIR, "fqn", *place)
        shut = shut.join(self.model.blockers, [*PAIR, "fqn"]).select(*at("CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE", F.col("symbol"), null, F.col("symbol")))
        return lost_.unionByName(targets).unionByName(shut)

    @once
    def breaking_changes(self) -> DataFrame:
        """Every finding once, with its kind's place in the report, nature and what it breaks.

        ``lib, ver, kind, impacted_type, impacted_symbol, new_symbol, detail_old, detail_new, file, line, kind_ordinal,
        nature, binary_breaking, source_breaking``, and ``owner``, the type that declares the symbol. Members that Object declares are not reported.
        """
        own, seen = ("ancestors", "order", "scopes", "props", "executables", "fields"), ("seen_types", "all_methods", "effective_fields")
        matches = ("type_match", "field_match", "method_match", "constructor_match", "annotation_method_match", "exceptions", "gone")
        together(*((self.model, x) for x in (*own, *seen)), *((self, x) for x in matches))
        parts = [self.type_findings(), self.field_findings(), self.method_findings(), self.constructor_findings(), self.annotation_method_findings()]
        parts += [self._type_details(), self._added_methods(), *([self._thrown_findings(), self._generic_findings()] if self.rules.generic else [])]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        kinds = self.spark.createDataFrame(
            [(k, i, nature, b, s) for i, (k, nature, b, s) in enumerate(self.kinds)],
            "kind string, kind_ordinal int, nature string, binary_breaking boolean, source_breaking boolean",
        )
        told = out.where(~F.startswith(F.col("impacted_symbol"), F.lit("java.lang.Object.")))
        return self.stages.put(told.dropDuplicates().join(F.broadcast(kinds), "kind"), "breaking_changes")

    def reported(self, names: Sequence[str] = (), annotations: Sequence[tuple[str, dict[str, str]]] = ()) -> DataFrame:
        """The breaking changes but those of excluded symbols, by the older version.

        A type is excluded if a pattern of ``names`` matches its whole name, if it carries one of ``annotations`` (name,
        values), or if a type around it is excluded; a member with the type that declares it, or by its own name.
        """
        hit = matches_any(F.col("fqn"), names)
        for name, values in annotations:
            hit = hit | has_annotation(F.col("annotations"), name, values)
        own = self.model.types.where(hit).select(*KEY, "fqn")
        inner = self.model.nesting().join(own.withColumnRenamed("fqn", "ancestor"), [*KEY, "ancestor"], "left_semi").select(*KEY, F.col("descendant").alias("fqn"))
        out = own.unionByName(inner).join(self.model.order.where("next_ver IS NOT NULL").select(*KEY, "next_ver"), KEY)
        out = out.select("lib", F.col("next_ver").alias("ver"), F.col("fqn").alias("owner")).distinct()
        return self.breaking_changes.join(out, [*PAIR, "owner"], "left_anti").where(~matches_any(F.col("impacted_symbol"), names))

    def type_findings(self) -> DataFrame:
        return self._fire(self.type_match, self.rules.types, member=False)

    def field_findings(self) -> DataFrame:
        return self._fire(self.field_match, self.rules.fields, member=True)

    def method_findings(self) -> DataFrame:
        return self._fire(self.method_match, self.rules.methods, member=True)

    def constructor_findings(self) -> DataFrame:
        return self._fire(self.constructor_match, self.rules.constructors, member=True)

    def annotation_method_findings(self) -> DataFrame:
        return self._fire(self.annotation_method_match, self.rules.annotation_methods, member=True)
