"""SQL that states the results of the API queries."""

from __future__ import annotations

from evolvent.model import BC_KINDS, BOXES, DEFAULT_TARGETS, PLATFORM, WIDENING
from evolvent.operators.mutations import LONG_NAMES, PATTERNS, STRATEGIES, THEMES
from evolvent.plans.problem_sql import ORACLE as PROBLEMS
from evolvent.plans.problem_sql import _REFS, _SNAPS


def N(x: str) -> str:
    return rf"nullif(replace(regexp_replace(split_part({x}, '<', 1), '^\s+|\s+$', '', 'g'), '/', '.'), '')"


def rows(values, cols: str) -> str:
    quote = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in values) + f") AS v({cols})"


def _fired(table: str, cols: str, kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {cols}, '{k}' AS kind FROM {table} WHERE {c}" for k, c in kinds.items())


_MORDER = _SNAPS.replace("AS seq FROM s)", "AS seq, lead(ver) OVER (PARTITION BY lib ORDER BY t, ver) AS next_ver FROM s)")
_LAST = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lib, ver, fqn ORDER BY loaded_at DESC NULLS LAST) AS rn
         FROM type_decl WHERE lib IS NOT NULL AND ver IS NOT NULL AND fqn IS NOT NULL) WHERE rn = 1)"""
_T = rf"""{_LAST},
t AS (SELECT lib, ver, fqn, kind, visibility, line, {N("enclosing")} AS enclosing, coalesce(tps, []) AS tps, annotations,
        list_sort(list_distinct(coalesce(modifiers, []) || CASE WHEN kind IN ('INTERFACE', 'ANNOTATION') THEN ['ABSTRACT'] WHEN kind = 'RECORD' THEN ['FINAL'] ELSE [] END
        || CASE WHEN len(list_filter(coalesce(permitted, []), lambda p: trim(p) <> '')) > 0 THEN ['SEALED'] ELSE [] END)) AS mods,
        CASE WHEN kind = 'ENUM' THEN 'java.lang.Enum' WHEN kind = 'RECORD' THEN 'java.lang.Record' WHEN kind = 'CLASS' THEN coalesce({N("super_ref")}, 'java.lang.Object')
             ELSE 'java.lang.Object' END AS super_fqn, interface_refs, targets,
        CASE WHEN kind = 'ENUM' THEN 'java.lang.Enum' WHEN kind = 'RECORD' THEN 'java.lang.Record' WHEN kind = 'CLASS' AND {N("super_ref")} IS NOT NULL THEN super_ref ELSE 'java.lang.Object' END AS super_text FROM last),
n_types AS (SELECT lib, ver, count(*) AS n FROM t GROUP BY ALL)"""
_EDGES = f"""{_T},
edges AS (SELECT DISTINCT lib, ver, fqn, s AS super_fqn FROM (
            SELECT lib, ver, fqn, super_fqn AS s FROM t
            UNION ALL SELECT lib, ver, fqn, {N("i")} FROM (SELECT lib, ver, fqn, unnest(interface_refs) AS i FROM t))
          WHERE s IS NOT NULL AND s <> fqn)"""
_PLATFORM = rows([(t, s.split("<")[0]) for t, v in PLATFORM.items() for s in v[2]], "a, b")
_ANC = f"""{_EDGES},
platform AS (SELECT a, b FROM {_PLATFORM}),
walk AS (SELECT lib, ver, fqn, super_fqn AS ancestor, 1 AS depth FROM edges
         UNION
         (SELECT w.lib, w.ver, w.fqn, e.super_fqn, w.depth + 1 FROM walk w JOIN edges e ON e.lib = w.lib AND e.ver = w.ver AND e.fqn = w.ancestor JOIN n_types z ON z.lib = w.lib AND z.ver = w.ver WHERE w.depth < z.n
          UNION
          SELECT w.lib, w.ver, w.fqn, p.b, w.depth + 1 FROM walk w JOIN platform p ON p.a = w.ancestor
          WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.lib = w.lib AND x.ver = w.ver AND x.fqn = w.ancestor))),
anc AS (SELECT lib, ver, fqn, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE ancestor <> fqn GROUP BY ALL)"""
_CTOR = """
ctor AS (SELECT DISTINCT e.lib, e.ver, e.owner FROM exec_decl e WHERE e.exec_kind = 'CONSTRUCTOR' AND e.visibility IN ('PUBLIC', 'PROTECTED') AND e.name IS NOT NULL)"""
# facts: E exported, S subtypable; each derived from facts found so far
_PROPS = f"""{_CTOR},
node AS (SELECT t.lib, t.ver, t.fqn, t.visibility, x.fqn AS enc,
           NOT list_contains(t.mods, 'FINAL') AND NOT (list_contains(t.mods, 'SEALED') AND NOT list_contains(t.mods, 'NON_SEALED'))
           AND (t.kind NOT IN ('CLASS', 'ENUM', 'RECORD') OR c.owner IS NOT NULL) AS open
         FROM t LEFT JOIN t x ON x.lib = t.lib AND x.ver = t.ver AND x.fqn = t.enclosing
         LEFT JOIN ctor c ON c.lib = t.lib AND c.ver = t.ver AND c.owner = t.fqn),
inner_edges AS (SELECT e.lib, e.ver, e.fqn, e.super_fqn FROM edges e SEMI JOIN t ON t.lib = e.lib AND t.ver = e.ver AND t.fqn = e.super_fqn),
fact AS (
  SELECT 'E' AS f, lib, ver, fqn FROM node WHERE enc IS NULL AND visibility IN ('PUBLIC', 'PROTECTED')
  UNION
  (SELECT 'E', n.lib, n.ver, n.fqn FROM node n JOIN recurring.fact e ON e.f = 'E' AND e.lib = n.lib AND e.ver = n.ver AND e.fqn = n.enc WHERE n.visibility = 'PUBLIC'
   UNION
   SELECT 'E', n.lib, n.ver, n.fqn FROM node n JOIN recurring.fact e ON e.f = 'E' AND e.lib = n.lib AND e.ver = n.ver AND e.fqn = n.enc
     JOIN recurring.fact s ON s.f = 'S' AND s.lib = n.lib AND s.ver = n.ver AND s.fqn = n.enc WHERE n.visibility = 'PROTECTED'
   UNION
   SELECT 'S', n.lib, n.ver, n.fqn FROM node n JOIN recurring.fact e ON e.f = 'E' AND e.lib = n.lib AND e.ver = n.ver AND e.fqn = n.fqn WHERE n.open
   UNION
   SELECT 'S', i.lib, i.ver, i.super_fqn FROM inner_edges i JOIN recurring.fact s ON s.f = 'S' AND s.lib = i.lib AND s.ver = i.ver AND s.fqn = i.fqn)),
props AS (SELECT n.lib, n.ver, n.fqn, bool_or(coalesce(f.f = 'E', false)) AS exported, bool_or(coalesce(f.f = 'E', false)) AND any_value(n.open) AS direct_subtypable,
            bool_or(coalesce(f.f = 'S', false)) AS subtypable
          FROM node n LEFT JOIN fact f ON f.lib = n.lib AND f.ver = n.ver AND f.fqn = n.fqn GROUP BY n.lib, n.ver, n.fqn)"""
_EXC = """
exc AS (SELECT t.lib, t.ver, t.fqn, bool_or(a.ancestor = 'java.lang.Throwable') AS throwable,
          bool_or(a.ancestor IN ('java.lang.RuntimeException', 'java.lang.Error')) AS unchecked
        FROM t JOIN anc a USING (lib, ver, fqn) WHERE t.kind IN ('CLASS', 'ENUM', 'RECORD') GROUP BY ALL)"""
_SEEN = f"""{_ANC},{_PROPS},{_EXC},
seen AS (SELECT t.*, p.exported, p.direct_subtypable, p.subtypable, coalesce(e.throwable AND NOT e.unchecked, false) AS checked, coalesce(e.unchecked, false) AS unchecked,
           t.kind IN ('CLASS', 'ENUM', 'RECORD') AND (list_contains(t.mods, 'ABSTRACT') OR c.owner IS NULL) AS eff_abstract
         FROM t JOIN props p USING (lib, ver, fqn) LEFT JOIN exc e USING (lib, ver, fqn) LEFT JOIN ctor c ON c.lib = t.lib AND c.ver = t.ver AND c.owner = t.fqn)"""
_MATCH = f"""{_SEEN},{_MORDER},
oldt AS (SELECT s.* EXCLUDE (ver), o.next_ver AS ver FROM seen s JOIN o ON o.lib = s.lib AND o.ver = s.ver WHERE s.exported AND o.next_ver IS NOT NULL),
newt AS (SELECT s.* FROM seen s JOIN o ON o.lib = s.lib AND o.ver = s.ver WHERE s.exported AND o.seq > 1),
tm AS (SELECT lib, ver, fqn, a, b, CASE WHEN b IS NULL THEN 'REMOVED' WHEN a IS NULL THEN 'ADDED' WHEN a.kind <> b.kind THEN 'KIND_CHANGED' ELSE 'MATCHED' END AS status
       FROM (SELECT lib, ver, fqn, oldt AS a FROM oldt) FULL OUTER JOIN (SELECT lib, ver, fqn, newt AS b FROM newt) USING (lib, ver, fqn))"""


def _base(ref: str) -> str:
    return rf"regexp_replace(coalesce({N(ref)}, ''), '(\[\])+$', '')"


def _dims(ref: str) -> str:
    return rf"regexp_extract({ref}, '((\[\])*)\s*$', 1)"


def _resolved(name: str, *parts: str) -> str:
    """Tables ``name``v (walk) and ``name`` (scope, name, bound): type variables that ``parts`` (scope, base) name, through all bounds."""
    asked = " UNION ALL ".join(f"SELECT scope, base FROM {p}" for p in parts)
    names = "list_transform(scope, lambda z: z.name)"
    return f"""
{name}v AS (SELECT scope, base AS name, base AS cur, 0 AS n FROM (SELECT DISTINCT scope, base FROM ({asked}) WHERE list_contains({names}, base))
        UNION ALL SELECT scope, name, coalesce({N('list_filter(scope, lambda z: z.name = cur)[1].bounds[1]')}, 'java.lang.Object'), n + 1 FROM {name}v
        WHERE list_contains({names}, cur) AND n <= len(scope)),
{name} AS (SELECT scope, name, coalesce(max(cur) FILTER (WHERE NOT list_contains({names}, cur)), 'java.lang.Object') AS bound FROM {name}v GROUP BY scope, name)"""


# types in view of each other by nesting: no walk is longer than a snapshot has types
_EXEC = rf"""
nested AS (SELECT a.lib, a.ver, a.fqn, a.enclosing AS up FROM t a SEMI JOIN t b ON b.lib = a.lib AND b.ver = a.ver AND b.fqn = a.enclosing),
encl AS (SELECT lib, ver, fqn, up, 1 AS d FROM nested
         UNION SELECT e.lib, e.ver, e.fqn, i.up, e.d + 1 FROM encl e JOIN nested i ON i.lib = e.lib AND i.ver = e.ver AND i.fqn = e.up JOIN n_types z ON z.lib = e.lib AND z.ver = e.ver WHERE e.d < z.n),
around AS (SELECT e.lib, e.ver, e.fqn, flatten(list(p.tps ORDER BY e.d, p.fqn)) AS outer_tps FROM (SELECT lib, ver, fqn, up, min(d) AS d FROM encl WHERE up <> fqn GROUP BY ALL) e
           JOIN t p ON p.lib = e.lib AND p.ver = e.ver AND p.fqn = e.up GROUP BY ALL),
lib_types AS (SELECT t.lib, t.ver, t.fqn, t.kind, t.tps, t.tps || coalesce(a.outer_tps, []) AS type_scope FROM t LEFT JOIN around a ON a.lib = t.lib AND a.ver = t.ver AND a.fqn = t.fqn),
ex0 AS (SELECT row_number() OVER () AS eid, * FROM (SELECT DISTINCT e.lib, e.ver, e.owner, x.kind AS owner_kind, e.exec_kind, CASE WHEN e.exec_kind = 'CONSTRUCTOR' THEN '<init>' ELSE e.name END AS name,
          CASE WHEN e.exec_kind = 'ANNOTATION_METHOD' THEN 'PUBLIC' ELSE e.visibility END AS visibility, coalesce(e.return_ref, 'void') AS return_ref, list_sort(list_distinct(coalesce(e.modifiers, []))) AS mods,
          list_transform(coalesce(e.params, []), lambda p: {{'ref': coalesce(p.ref, ''), 'varargs': coalesce(p.varargs, false)}}) AS params,
          coalesce(e.tps, []) AS tps, x.tps AS type_tps, x.type_scope, coalesce(e.tps, []) || x.type_scope AS scope, list_sort(list_distinct(coalesce(e.thrown, []))) AS thrown, coalesce(e.has_default, false) AS has_default
        FROM exec_decl e JOIN lib_types x ON x.lib = e.lib AND x.ver = e.ver AND x.fqn = e.owner WHERE e.name IS NOT NULL)),
part AS (SELECT eid, scope, i, {_base("p.ref")} AS base, {_dims("p.ref")} || CASE WHEN p.varargs THEN '[]' ELSE '' END AS dims FROM (SELECT eid, scope, unnest(params) AS p, generate_subscripts(params, 1) AS i FROM ex0)),
hpart AS (SELECT eid, scope, {_base("h")} AS base, {_dims("h")} AS dims FROM (SELECT eid, scope, unnest(thrown) AS h FROM ex0)),{_resolved("ve", "part", "hpart")},
ex AS (SELECT ex0.*, owner || '.' || ex0.name || '(' || coalesce(array_to_string(list_transform(params, lambda p: p.ref || CASE WHEN p.varargs THEN '[]' ELSE '' END), ','), '') || ')' AS symbol, ex0.name || '(' || coalesce(sig, '') || ')' AS erasure FROM ex0 LEFT JOIN (
         SELECT eid, string_agg(coalesce(bound, base) || dims, ',' ORDER BY i) AS sig FROM part LEFT JOIN ve ON ve.scope = part.scope AND ve.name = base GROUP BY eid) USING (eid)),
exh AS (SELECT eid, coalesce(bound, base) || dims AS thrown FROM hpart LEFT JOIN ve ON ve.scope = hpart.scope AND ve.name = base WHERE base <> '')"""


def _subst(text: str, names: str, args: str) -> str:
    """``text`` with each name of ``names`` replaced by the argument in its place, Object where there is none."""
    at = f"list_position({names}, k)"
    return (
        rf"array_to_string(list_transform(regexp_extract_all({text}, '[A-Za-z_$][A-Za-z0-9_.$]*|[^A-Za-z_$]+'), "
        f"lambda k: CASE WHEN list_contains({names}, k) THEN coalesce({args}[{at}], 'java.lang.Object') ELSE k END), '')"
    )


def _canon(x: str) -> str:
    tight = rf"regexp_replace(replace(replace({x}, '/', '.'), '...', '[]'), '\s*([<>,&\[\]])\s*', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({tight}, '\? extends java\.lang\.Object([,>]|$)', '?\1', 'g'), '^\s+|\s+$', '', 'g')"


# commas outside of inner brackets made chr(1)
_TOP = (
    "list_reduce([''] || string_split(regexp_extract(text, '<(.*)>', 1), ''), lambda acc, c: acc || CASE WHEN c = ',' AND len(acc) - len(replace(acc, '<', '')) = len(acc) - len(replace(acc, '>', '')) THEN chr(1) ELSE c END)"
)
_NAMES = "list_transform({0}, lambda z: z.name)"
_GIVEN = rf"""
sup AS (SELECT lib, ver, fqn, 0 AS ord, super_text AS text, super_fqn AS target FROM t
        UNION ALL SELECT lib, ver, fqn, i, text, {N("text")} FROM (SELECT lib, ver, fqn, unnest(interface_refs) AS text, generate_subscripts(interface_refs, 1) AS i FROM t)),
gup AS (SELECT s.lib, s.ver, s.fqn, s.ord, s.target, CASE WHEN contains(text, '<') THEN list_transform(string_split({_TOP}, chr(1)), lambda z: {_canon("z")}) ELSE []::VARCHAR[] END AS args
        FROM sup s SEMI JOIN t ON t.lib = s.lib AND t.ver = s.ver AND t.fqn = s.target WHERE s.target <> s.fqn),
gw AS (SELECT lib, ver, fqn, target AS anc, [ord] AS path, args, [fqn, target] AS way FROM gup
       UNION ALL SELECT w.lib, w.ver, w.fqn, g.target, w.path || [g.ord], list_transform(g.args, lambda z: {_subst("z", _NAMES.format("y.tps"), "w.args")}), w.way || [g.target]
       FROM gw w JOIN gup g ON g.lib = w.lib AND g.ver = w.ver AND g.fqn = w.anc JOIN t y ON y.lib = w.lib AND y.ver = w.ver AND y.fqn = w.anc WHERE NOT list_contains(w.way, g.target)),
given AS (SELECT lib, ver, fqn, anc, args FROM (SELECT *, row_number() OVER (PARTITION BY lib, ver, fqn, anc ORDER BY len(path), path) AS rn FROM gw) WHERE rn = 1),
line AS (SELECT lib, ver, fqn, fqn AS owner, 0 AS depth, []::VARCHAR[] AS args FROM t
         UNION ALL SELECT a.lib, a.ver, a.fqn, a.ancestor, a.depth, g.args FROM anc a JOIN given g ON g.lib = a.lib AND g.ver = a.ver AND g.fqn = a.fqn AND g.anc = a.ancestor)"""
_METHODS = rf"""{_GIVEN},
mth AS (SELECT *, list_contains(mods, 'ABSTRACT') AS abstract, list_contains(mods, 'DEFAULT') OR (owner_kind IN ('INTERFACE', 'ANNOTATION') AND NOT list_contains(mods, 'ABSTRACT') AND NOT list_contains(mods, 'STATIC')) AS dflt
        FROM ex WHERE exec_kind = 'METHOD' AND visibility <> 'PRIVATE' AND NOT (owner_kind = 'RECORD' AND erasure IN ('equals(java.lang.Object)', 'hashCode()', 'toString()'))
        AND NOT (owner_kind = 'ENUM' AND erasure IN ('valueOf(java.lang.String)', 'values()'))),
mc AS (SELECT row_number() OVER () AS cid, l.fqn, l.depth, l.args, h.type_scope AS heir_scope, m.*,
         len(l.args) > 0 AND list_has_any(regexp_extract_all(m.return_ref || ' ' || array_to_string(list_transform(m.params, lambda p: p.ref), ' ') || ' ' ||
           coalesce(array_to_string(flatten(list_transform(m.tps, lambda z: coalesce(z.bounds, []))), ' '), ''), '[A-Za-z_$][A-Za-z0-9_.$]*'), {_NAMES.format("m.type_tps")}) AS speaks
       FROM line l JOIN mth m ON m.lib = l.lib AND m.ver = l.ver AND m.owner = l.owner JOIN lib_types h ON h.lib = l.lib AND h.ver = l.ver AND h.fqn = l.fqn),
mg AS (SELECT *, list_filter({_NAMES.format("type_tps")}, lambda n: NOT list_contains({_NAMES.format("tps")}, n)) AS open_names,
         list_transform(list_filter(list_zip({_NAMES.format("type_tps")}, args), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND NOT list_contains({_NAMES.format("tps")}, z[1])), lambda z: z[1]) AS names,
         list_transform(list_filter(list_zip({_NAMES.format("type_tps")}, args), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND NOT list_contains({_NAMES.format("tps")}, z[1])), lambda z: z[2]) AS vals
       FROM mc WHERE speaks),
mgp AS (SELECT cid, i, list_transform(tps, lambda z: {{'name': z.name, 'bounds': list_transform(z.bounds, lambda b: {_subst("b", "names", "vals")})}}) || heir_scope || type_scope AS scope,
          {_canon(_subst("p.ref", "names", "vals"))} AS ref, p.varargs AS varargs FROM (SELECT *, unnest(params) AS p, generate_subscripts(params, 1) AS i FROM mg)),
mgb AS (SELECT cid, i, scope, CASE WHEN starts_with(ref, '?') THEN ref ELSE {_base("ref")} END AS base, CASE WHEN starts_with(ref, '?') THEN '' ELSE {_dims("ref")} END || CASE WHEN varargs THEN '[]' ELSE '' END AS dims FROM mgp),{_resolved("vg", "mgb")},
mgs AS (SELECT cid, string_agg(coalesce(bound, base) || dims, ',' ORDER BY i) AS sig FROM mgb LEFT JOIN vg ON vg.scope = mgb.scope AND vg.name = base GROUP BY cid),
cand AS (SELECT lib, ver, fqn, depth, owner, eid, name, visibility, abstract, dflt, mods, owner_kind, symbol, erasure, return_ref FROM mc WHERE NOT speaks
         UNION ALL SELECT lib, ver, fqn, depth, owner, eid, name, visibility, abstract, dflt, mods, owner_kind, symbol, name || '(' || coalesce(sig, '') || ')', {_canon(_subst("return_ref", "names", "vals"))} FROM mg LEFT JOIN mgs USING (cid)),
ups AS (SELECT lib, ver, fqn AS owner, list(ancestor) AS ups FROM anc GROUP BY ALL),
mlist AS (SELECT c.lib, c.ver, c.fqn, c.erasure, list({{'eid': c.eid, 'owner': c.owner, 'ups': coalesce(u.ups, []), 'visibility': c.visibility, 'abstract': c.abstract, 'dflt': c.dflt, 'mods': c.mods,
            'owner_kind': c.owner_kind, 'symbol': c.symbol, 'return_ref': c.return_ref}} ORDER BY c.depth, c.owner, c.eid) AS l FROM cand c LEFT JOIN ups u ON u.lib = c.lib AND u.ver = c.ver AND u.owner = c.owner GROUP BY ALL),
allm AS (SELECT lib, ver, fqn, erasure, list_reduce(l, lambda a, x: CASE WHEN list_contains(a.ups, x.owner) OR a.owner = x.owner OR (NOT a.abstract AND x.abstract) OR (NOT a.abstract AND NOT a.dflt AND x.dflt) THEN a ELSE x END) AS m FROM mlist),
effm AS (SELECT a.lib, a.ver, a.fqn, a.erasure, a.m FROM allm a JOIN props p ON p.lib = a.lib AND p.ver = a.ver AND p.fqn = a.fqn WHERE p.exported AND (m.visibility = 'PUBLIC' OR (m.visibility = 'PROTECTED' AND p.subtypable))),
blocker AS (SELECT a.lib, a.ver, a.fqn, a.erasure, a.m FROM allm a SEMI JOIN (SELECT * FROM t WHERE kind IN ('CLASS', 'ENUM', 'RECORD')) k ON k.lib = a.lib AND k.ver = a.ver AND k.fqn = a.fqn
            WHERE m.visibility = 'PACKAGE_PRIVATE' AND m.abstract)"""
_FIELDS = f"""
fld AS (SELECT DISTINCT f.lib, f.ver, f.owner, f.name, f.visibility, list_sort(list_distinct(coalesce(f.modifiers, []))) AS mods, f.type_ref, f.is_const
        FROM field_decl f JOIN t ON t.lib = f.lib AND t.ver = f.ver AND t.fqn = f.owner
        WHERE f.visibility IN ('PUBLIC', 'PROTECTED') AND f.name IS NOT NULL AND (t.kind <> 'RECORD' OR list_contains(f.modifiers, 'STATIC'))),
lineage AS (SELECT lib, ver, fqn, fqn AS owner, 0 AS depth FROM t
            UNION ALL SELECT a.lib, a.ver, a.fqn, a.ancestor, a.depth FROM anc a SEMI JOIN t ON t.lib = a.lib AND t.ver = a.ver AND t.fqn = a.ancestor),
up AS (SELECT lib, ver, fqn AS owner, list(ancestor) AS ups FROM anc GROUP BY lib, ver, fqn),
cand AS (SELECT l.lib, l.ver, l.fqn, l.depth, f.name, f.visibility, f.mods, l.owner, coalesce(u.ups, []) AS ups
         FROM lineage l JOIN fld f ON f.lib = l.lib AND f.ver = l.ver AND f.owner = l.owner
         JOIN props p ON p.lib = l.lib AND p.ver = l.ver AND p.fqn = l.fqn
         LEFT JOIN up u ON u.lib = l.lib AND u.ver = l.ver AND u.owner = l.owner
         WHERE p.exported AND (f.visibility = 'PUBLIC' OR p.subtypable)),
lists AS (SELECT lib, ver, fqn, name, list({{'owner': owner, 'ups': ups, 'visibility': visibility, 'mods': mods}} ORDER BY depth, owner) AS l FROM cand GROUP BY ALL),
eff AS (SELECT lib, ver, fqn, name, list_reduce(l, lambda a, x: CASE WHEN list_contains(a.ups, x.owner) OR a.owner = x.owner THEN a ELSE x END) AS m FROM lists)"""
_FMATCH = f"""{_MATCH},{_FIELDS},
oldf AS (SELECT e.lib, o.next_ver AS ver, e.fqn, e.name, e.m AS a FROM eff e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.next_ver IS NOT NULL),
newf AS (SELECT e.lib, e.ver, e.fqn, e.name, e.m AS b FROM eff e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.seq > 1),
fm AS (SELECT lib, ver, fqn, name, f.a, f.b, CASE WHEN f.b IS NULL THEN 'REMOVED' WHEN f.a IS NULL THEN 'ADDED' ELSE 'MATCHED' END AS status
       FROM (SELECT * FROM oldf FULL OUTER JOIN newf USING (lib, ver, fqn, name)) f SEMI JOIN (SELECT lib, ver, fqn FROM tm WHERE status = 'MATCHED') USING (lib, ver, fqn))"""
_XMATCH = """
xm AS (SELECT lib, ver, fqn, k, CASE WHEN b IS NULL THEN 'REMOVED' WHEN a IS NULL THEN 'ADDED' ELSE 'MATCHED' END AS status FROM (
         (SELECT DISTINCT e.lib, o.next_ver AS ver, e.fqn, e.k, true AS a FROM shown e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.next_ver IS NOT NULL)
         FULL OUTER JOIN (SELECT DISTINCT e.lib, e.ver, e.fqn, e.k, true AS b FROM shown e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.seq > 1) USING (lib, ver, fqn, k))
       SEMI JOIN (SELECT lib, ver, fqn FROM tm WHERE status = 'MATCHED') USING (lib, ver, fqn))"""
_MMATCH = f"""{_MATCH},{_EXEC},{_METHODS},
blocked AS (SELECT DISTINCT lib, ver, fqn FROM blocker),
pr AS (SELECT m.lib, m.ver, m.fqn, m.a AS ot, m.b AS nt, m.a.subtypable AND k.fqn IS NULL AS o_concrete, m.b.subtypable AND j.fqn IS NULL AS n_concrete FROM tm m
       JOIN o ON o.lib = m.lib AND o.next_ver = m.ver LEFT JOIN blocked k ON k.lib = m.lib AND k.ver = o.ver AND k.fqn = m.fqn LEFT JOIN blocked j ON j.lib = m.lib AND j.ver = m.ver AND j.fqn = m.fqn
       WHERE m.status = 'MATCHED'),
oldm AS (SELECT e.lib, o.next_ver AS ver, e.fqn, e.erasure, e.m AS a FROM effm e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.next_ver IS NOT NULL),
newm AS (SELECT e.lib, e.ver, e.fqn, e.erasure, e.m AS b FROM effm e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.seq > 1),
mm AS (SELECT *, CASE WHEN b IS NULL THEN 'REMOVED' WHEN a IS NULL THEN 'ADDED' ELSE 'MATCHED' END AS status, list_contains(a.mods, 'FINAL') OR NOT ot.subtypable AS o_final,
         list_contains(nt.mods, 'SEALED') AND NOT list_contains(ot.mods, 'SEALED') AS now_sealed
       FROM (SELECT * FROM oldm FULL OUTER JOIN newm USING (lib, ver, fqn, erasure)) JOIN pr USING (lib, ver, fqn)),
oldc AS (SELECT DISTINCT e.lib, o.next_ver AS ver, e.owner AS fqn, e.erasure, e AS a FROM ex e JOIN o ON o.lib = e.lib AND o.ver = e.ver JOIN props p ON p.lib = e.lib AND p.ver = e.ver AND p.fqn = e.owner
         WHERE o.next_ver IS NOT NULL AND e.exec_kind = 'CONSTRUCTOR' AND p.exported AND (e.visibility = 'PUBLIC' OR (e.visibility = 'PROTECTED' AND p.direct_subtypable))),
newc AS (SELECT DISTINCT e.lib, e.ver, e.owner AS fqn, e.erasure, e AS b FROM ex e JOIN o ON o.lib = e.lib AND o.ver = e.ver JOIN props p ON p.lib = e.lib AND p.ver = e.ver AND p.fqn = e.owner
         WHERE o.seq > 1 AND e.exec_kind = 'CONSTRUCTOR' AND p.exported AND (e.visibility = 'PUBLIC' OR (e.visibility = 'PROTECTED' AND p.direct_subtypable))),
cm AS (SELECT *, CASE WHEN b IS NULL THEN 'REMOVED' WHEN a IS NULL THEN 'ADDED' ELSE 'MATCHED' END AS status FROM (SELECT * FROM oldc FULL OUTER JOIN newc USING (lib, ver, fqn, erasure)) JOIN pr USING (lib, ver, fqn)),
el AS (SELECT e.lib, e.ver, e.owner AS fqn, e.name, min({{'erasure': e.erasure, 'symbol': e.symbol, 'has_default': e.has_default}}) AS e FROM ex e SEMI JOIN (SELECT * FROM t WHERE kind = 'ANNOTATION') a
       ON a.lib = e.lib AND a.ver = e.ver AND a.fqn = e.owner WHERE e.exec_kind = 'ANNOTATION_METHOD' GROUP BY ALL),
em AS (SELECT *, CASE WHEN b IS NULL THEN 'REMOVED' WHEN a IS NULL THEN 'ADDED' ELSE 'MATCHED' END AS status FROM (
         SELECT * FROM (SELECT e.lib, o.next_ver AS ver, e.fqn, e.name, e.e AS a FROM el e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.next_ver IS NOT NULL)
         FULL OUTER JOIN (SELECT e.lib, e.ver, e.fqn, e.name, e.e AS b FROM el e JOIN o ON o.lib = e.lib AND o.ver = e.ver WHERE o.seq > 1) USING (lib, ver, fqn, name)) SEMI JOIN pr USING (lib, ver, fqn))"""
_LOST, _GAINED = "list_contains(a.mods, '{0}') AND NOT list_contains(b.mods, '{0}')", "list_contains(b.mods, '{0}') AND NOT list_contains(a.mods, '{0}')"
_METHOD_KINDS = {
    "EXECUTABLE_REMOVED": "status = 'REMOVED'",
    "EXECUTABLE_NOW_PROTECTED": "status = 'MATCHED' AND a.visibility = 'PUBLIC' AND b.visibility = 'PROTECTED'",
    "METHOD_NOW_ABSTRACT": f"status = 'MATCHED' AND NOT now_sealed AND {_GAINED.format('ABSTRACT')} AND o_concrete",
    "METHOD_NOW_FINAL": "status = 'MATCHED' AND NOT now_sealed AND NOT o_final AND (list_contains(b.mods, 'FINAL') OR NOT nt.subtypable)",
    "METHOD_NOW_STATIC": f"status = 'MATCHED' AND {_GAINED.format('STATIC')}",
    "METHOD_OVERRIDABLE_NOW_STATIC": f"status = 'MATCHED' AND {_GAINED.format('STATIC')} AND (ot.kind IN ('INTERFACE', 'ANNOTATION') OR NOT o_final)",
    "METHOD_NO_LONGER_STATIC": f"status = 'MATCHED' AND {_LOST.format('STATIC')}",
}
_CTOR_KINDS = {
    "EXECUTABLE_REMOVED": "status = 'REMOVED'",
    "EXECUTABLE_NOW_PROTECTED": "status = 'MATCHED' AND a.visibility = 'PUBLIC' AND b.visibility = 'PROTECTED' AND NOT list_contains(ot.mods, 'ABSTRACT')",
}
_ELEMENT_KINDS = {"EXECUTABLE_REMOVED": "status = 'REMOVED'", "ANNOTATION_METHOD_NO_LONGER_DEFAULT": "status = 'MATCHED' AND a.has_default AND NOT b.has_default"}
_NEW_METHOD = "status = 'ADDED' AND b.abstract AND (list_contains(ot.mods, 'SEALED') OR NOT list_contains(nt.mods, 'SEALED')) AND o_concrete"
_OBLIGATIONS = f"""SELECT DISTINCT lib, ver, fqn, b.symbol AS symbol, 'TYPE_NEW_ABSTRACT_METHOD' AS kind FROM mm WHERE {_NEW_METHOD}
UNION ALL SELECT DISTINCT lib, ver, fqn, b.symbol, 'ANNOTATION_NEW_METHOD_WITHOUT_DEFAULT' FROM em WHERE status = 'ADDED' AND NOT b.has_default"""
_SHUT = """SELECT DISTINCT p.lib, p.ver, p.fqn, b.m.symbol AS blocker FROM pr p JOIN blocker b ON b.lib = p.lib AND b.ver = p.ver AND b.fqn = p.fqn WHERE p.ot.kind = 'CLASS' AND p.o_concrete AND NOT p.n_concrete"""
# every type that is thrown, with its supertypes and itself, in the snapshot that throws it and in the next one
_THROWN = f"""
px AS (SELECT a, b FROM platform UNION SELECT px.a, p.b FROM px JOIN platform p ON p.a = px.b),
thr AS (SELECT ex.eid, exh.thrown AS exc FROM ex JOIN exh USING (eid)),
named AS (SELECT DISTINCT x.lib, x.ver, exc FROM thr JOIN ex x USING (eid) UNION SELECT DISTINCT x.lib, o.next_ver, exc FROM thr JOIN ex x USING (eid) JOIN o ON o.lib = x.lib AND o.ver = x.ver WHERE o.next_ver IS NOT NULL),
exu AS (SELECT lib, ver, exc, exc AS up FROM named
        UNION SELECT n.lib, n.ver, n.exc, a.ancestor FROM named n JOIN t ON t.lib = n.lib AND t.ver = n.ver AND t.fqn = n.exc AND t.kind IN ('CLASS', 'ENUM', 'RECORD') JOIN anc a ON a.lib = n.lib AND a.ver = n.ver AND a.fqn = n.exc
        UNION SELECT n.lib, n.ver, n.exc, px.b FROM named n JOIN px ON px.a = n.exc WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lib = n.lib AND t.ver = n.ver AND t.fqn = n.exc AND t.kind IN ('CLASS', 'ENUM', 'RECORD'))),
chk AS (SELECT lib, ver, exc, list(up) AS up FROM exu GROUP BY ALL HAVING bool_or(up = 'java.lang.Throwable') AND NOT bool_or(up IN ('java.lang.RuntimeException', 'java.lang.Error'))),
tx AS (SELECT lib, ver, fqn, a.symbol AS symbol, a.eid AS e1, b.eid AS e2, o_final AS fin FROM mm WHERE status = 'MATCHED'
       UNION ALL SELECT lib, ver, fqn, a.symbol, a.eid, b.eid, true FROM cm WHERE status = 'MATCHED'),
t1 AS (SELECT x.lib, x.ver, x.fqn, x.symbol, x.e1, x.e2, x.fin, h.exc FROM tx x JOIN thr h ON h.eid = x.e1 JOIN o ON o.lib = x.lib AND o.next_ver = x.ver JOIN chk c ON c.lib = x.lib AND c.ver = o.ver AND c.exc = h.exc),
t2 AS (SELECT x.lib, x.ver, x.fqn, x.symbol, x.e1, x.e2, x.fin, h.exc, c.up FROM tx x JOIN thr h ON h.eid = x.e2 JOIN chk c ON c.lib = x.lib AND c.ver = x.ver AND c.exc = h.exc)"""
_SAME = "j.lib = i.lib AND j.ver = i.ver AND j.fqn = i.fqn AND j.e1 = i.e1 AND j.e2 = i.e2"
_THROWN_FOUND = f"""SELECT DISTINCT i.lib, i.ver, i.fqn, i.symbol, 'EXECUTABLE_NO_LONGER_THROWS_CHECKED_EXCEPTION' AS kind, i.exc FROM t1 i JOIN chk c ON c.lib = i.lib AND c.ver = i.ver AND c.exc = i.exc
WHERE NOT EXISTS (SELECT 1 FROM t2 j WHERE {_SAME} AND CASE WHEN i.fin THEN list_contains(j.up, i.exc) ELSE list_contains(c.up, j.exc) END)
UNION ALL SELECT DISTINCT i.lib, i.ver, i.fqn, i.symbol, 'EXECUTABLE_NOW_THROWS_CHECKED_EXCEPTION', i.exc FROM t2 i WHERE NOT EXISTS (SELECT 1 FROM t1 j WHERE {_SAME} AND list_contains(i.up, j.exc))"""
_KINDS = rows([(k, i, n, b, s) for i, (k, n, b, s) in enumerate(BC_KINDS)], "kind, kind_ordinal, nature, binary_breaking, source_breaking")
_REPORT = f"""
one AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY bc_id ORDER BY found_at DESC NULLS LAST) AS rn FROM bc_report WHERE bc_id IS NOT NULL) WHERE rn = 1),
pieces AS (SELECT DISTINCT bc_id, trim(regexp_replace(upper(p), '[^A-Z0-9]+', '_', 'g'), '_') AS kind
           FROM (SELECT bc_id, unnest(string_split_regex(kind, '[;|,]')) AS p FROM one)),
kinds AS (SELECT kind, CAST(kind_ordinal AS INTEGER) AS kind_ordinal, nature, binary_breaking, source_breaking FROM {_KINDS}),
rep AS (SELECT one.* EXCLUDE (kind, nature, binary_breaking, source_breaking), k.* FROM one JOIN pieces USING (bc_id) JOIN kinds k ON k.kind = pieces.kind)"""
_PKG = r"regexp_extract(impacted_type, '^(.*)\.[^.]*$', 1)"
_BETA = r"""
beta AS (SELECT lib, ver, fqn FROM last WHERE len(list_filter(coalesce(annotations, []), lambda a: regexp_extract(a.fqn, '([^.$]*)$', 1) = 'Beta')) > 0)"""
_P4 = PROBLEMS["p4_found"].removeprefix("\nWITH RECURSIVE").rpartition("\nSELECT lib, ver, link")[0]
_EXCLUDED = f"""{_P4},{_LAST},{_BETA},
excluded AS (SELECT * FROM beta UNION SELECT w.lib, w.ver, w.descendant FROM walk w SEMI JOIN beta b ON b.lib = w.lib AND b.ver = w.ver AND b.fqn = w.ancestor WHERE w.link = 'enclosing')"""
_FILES = rf"""
files AS (SELECT lib, ver, file, md5(string_agg(DISTINCT x, chr(10) ORDER BY x)) AS hash FROM (
            SELECT lib, ver, file, concat_ws('|', fqn, coalesce(kind, '~'), coalesce(visibility, '~'), coalesce(super_ref, '~')) AS x FROM last WHERE file IS NOT NULL) GROUP BY ALL),
chg AS (SELECT * FROM (SELECT lib, ver, file, CASE WHEN h2 IS NULL THEN 'deleted' WHEN h1 IS NULL THEN 'created' WHEN h1 <> h2 THEN 'updated' END AS status FROM
          (SELECT f.lib, o.next_ver AS ver, f.file, f.hash AS h1 FROM files f JOIN o ON o.lib = f.lib AND o.ver = f.ver WHERE o.next_ver IS NOT NULL)
          FULL OUTER JOIN (SELECT f.lib, f.ver, f.file, f.hash AS h2 FROM files f JOIN o ON o.lib = f.lib AND o.ver = f.ver WHERE o.seq > 1) USING (lib, ver, file))
        WHERE status IS NOT NULL)"""


def _duck(ok: str) -> str:
    return ok.replace("array_contains(", "list_contains(").replace("size(", "len(")


_SPACE = """
tt AS (SELECT DISTINCT lib, ver, fqn AS symbol, kind, visibility, coalesce(modifiers, []) AS modifiers, coalesce(interface_refs, []) AS interface_refs,
         coalesce(%s, 'java.lang.Object') AS super_name FROM type_decl WHERE fqn IS NOT NULL),
xx AS (SELECT lib, ver, exec_kind, visibility, coalesce(modifiers, []) AS modifiers, return_ref, coalesce(params, []) AS params, coalesce(thrown, []) AS thrown,
         owner || '.' || name || '(' || coalesce(array_to_string(list_transform(coalesce(params, []), lambda p: p.ref), ','), '') || ')' AS symbol FROM exec_decl),
ff AS (SELECT f.lib, f.ver, f.owner, f.visibility, coalesce(f.modifiers, []) AS modifiers, f.type_ref, f.owner || '.' || f.name AS symbol,
         EXISTS (SELECT 1 FROM type_decl e WHERE e.kind = 'ENUM' AND e.lib = f.lib AND e.ver = f.ver AND e.fqn = f.owner) AS of_enum FROM field_decl f),
space AS (%s)"""
_SOURCE = {"type": "tt", "constructor": "(SELECT * FROM xx WHERE exec_kind = 'CONSTRUCTOR')", "method": "(SELECT * FROM xx WHERE exec_kind = 'METHOD')", "field": "ff"}
_SPACE = _SPACE % (
    N("super_ref"),
    " UNION ".join(
        f"SELECT lib, ver, symbol, '{name}' AS strategy, CASE WHEN coalesce({_duck(ok)}, false) THEN 'ok' ELSE 'impossible' END AS outcome FROM {_SOURCE[of]}" for of, name, ok in STRATEGIES
    ),
)
_names = [*WIDENING, *BOXES.values()]
_WIDER = rows([(a, b) for a, bs in WIDENING.items() for b in bs], "a, b")
_BOX = rows(list(BOXES.items()), "p, box")

R = "WITH RECURSIVE "
ORACLE = {
    "snapshot_sequence": f"WITH {_MORDER} SELECT lib, ver, CAST(seq AS INTEGER) AS seq, next_ver FROM o",
    "type_state": rf"WITH {_T} SELECT lib, ver, fqn, regexp_extract(fqn, '([^.$]*)$', 1) AS simple, regexp_extract(fqn, '^(.*)\.[^.]*$', 1) AS pkg, kind, visibility, "
    "coalesce(array_to_string(mods, ','), '') AS modifiers, enclosing FROM t",
    "reference_providers": f"WITH {_REFS.lstrip()}, known AS (SELECT fqn, min(origin) AS origin FROM known_type WHERE fqn IS NOT NULL GROUP BY fqn) "
    "SELECT r.lib, r.ver, r.fqn, r.ref_field, r.target, CASE WHEN k.fqn IS NOT NULL THEN 'library' ELSE coalesce(n.origin, 'unresolved') END AS provider FROM refs r "
    "LEFT JOIN keys k ON k.lib = r.lib AND k.ver = r.ver AND k.fqn = r.target LEFT JOIN known n ON n.fqn = r.target",
    "supertype_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "direct_subtypes": f"WITH {_EDGES} SELECT e.lib, e.ver, e.super_fqn, e.fqn FROM edges e SEMI JOIN t ON t.lib = e.lib AND t.ver = e.ver AND t.fqn = e.super_fqn",
    "ancestor_closure": f"{R}{_ANC} SELECT lib, ver, fqn, ancestor, depth FROM anc",
    "superclass_chain": f"{R}{_ANC}, classes AS (SELECT lib, ver, fqn FROM t WHERE kind IN ('CLASS', 'ENUM', 'RECORD')) "
    "SELECT a.lib, a.ver, a.fqn, a.ancestor FROM anc a SEMI JOIN classes c ON c.lib = a.lib AND c.ver = a.ver AND c.fqn = a.fqn "
    "WHERE EXISTS (SELECT 1 FROM classes s WHERE s.lib = a.lib AND s.ver = a.ver AND s.fqn = a.ancestor) OR a.ancestor IN ("
    + ", ".join(f"'{n}'" for n, v in PLATFORM.items() if v[0] == "CLASS") + ")",
    "implemented_interfaces": f"{R}{_ANC} SELECT a.lib, a.ver, a.fqn, a.ancestor FROM anc a SEMI JOIN (SELECT * FROM t WHERE kind IN ('INTERFACE', 'ANNOTATION')) i "
    "ON i.lib = a.lib AND i.ver = a.ver AND i.fqn = a.ancestor",
    "enclosing_chain": f"SELECT lib, ver, ancestor, descendant, depth FROM ({PROBLEMS['p4_found']}) WHERE link = 'enclosing'",
    "exported_types": f"{R}{_EDGES},{_PROPS} SELECT * FROM props",
    "checked_exceptions": f"{R}{_ANC},{_EXC} SELECT lib, ver, fqn, throwable AND NOT unchecked AS checked, unchecked FROM exc WHERE throwable OR unchecked",
    "method_erasure": f"{R}{_T},{_EXEC} SELECT DISTINCT lib, ver, owner, exec_kind, erasure FROM ex",
    "thrown_types": f"{R}{_T},{_EXEC} SELECT DISTINCT lib, ver, owner, erasure, exh.thrown FROM ex JOIN exh USING (eid)",
    "effective_fields": f"{R}{_ANC},{_PROPS},{_FIELDS} SELECT lib, ver, fqn, name, m.owner AS owner FROM eff",
    "effective_methods": f"{R}{_ANC},{_PROPS},{_EXEC},{_METHODS} SELECT lib, ver, fqn, erasure, m.owner AS owner, m.visibility AS visibility, m.return_ref AS return_ref FROM effm",
    "methods_to_implement": f"{R}{_ANC},{_PROPS},{_EXEC},{_METHODS} SELECT lib, ver, fqn, erasure, m.owner AS owner FROM effm "
    "WHERE CASE WHEN m.owner_kind IN ('INTERFACE', 'ANNOTATION') THEN NOT m.dflt AND NOT list_contains(m.mods, 'STATIC') ELSE m.abstract END",
    "concrete_blockers": f"{R}{_ANC},{_PROPS},{_EXEC},{_METHODS} SELECT lib, ver, fqn, m.symbol AS symbol FROM blocker",
    "entity_counts": f"{R}{_T},{_EXEC} SELECT lib, kind AS entity, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT lib, exec_kind, count(*) FROM ex GROUP BY ALL",
    "api_card": f"{R}{_ANC},{_PROPS},{_EXEC},{_METHODS}, nt AS (SELECT lib, ver, count(*) AS n_types, count(*) FILTER (exported) AS n_exported FROM props GROUP BY ALL), "
    "nm AS (SELECT lib, ver, count(*) AS n_methods FROM effm GROUP BY ALL), nf AS (SELECT f.lib, f.ver, count(*) AS n_fields FROM (SELECT DISTINCT f.lib, f.ver, f.owner, f.name, f.visibility, "
    "list_sort(list_distinct(coalesce(f.modifiers, []))) AS mods, f.type_ref, f.is_const FROM field_decl f JOIN t ON t.lib = f.lib AND t.ver = f.ver AND t.fqn = f.owner WHERE f.visibility IN ('PUBLIC', 'PROTECTED') "
    "AND f.name IS NOT NULL AND (t.kind <> 'RECORD' OR list_contains(f.modifiers, 'STATIC'))) f SEMI JOIN (SELECT * FROM props WHERE exported) p ON p.lib = f.lib AND p.ver = f.ver AND p.fqn = f.owner GROUP BY ALL) "
    "SELECT nt.*, coalesce(n_methods, 0) AS n_methods, coalesce(n_fields, 0) AS n_fields FROM nt LEFT JOIN nm USING (lib, ver) LEFT JOIN nf USING (lib, ver)",
    "method_match": f"{R}{_MMATCH} SELECT lib, ver, fqn, erasure, status FROM mm",
    "method_changes": f"{R}{_MMATCH} SELECT DISTINCT * FROM (" + _fired("mm", "lib, ver, fqn, a.symbol AS symbol", _METHOD_KINDS) + ")",
    "constructor_changes": f"{R}{_MMATCH} SELECT DISTINCT * FROM (" + _fired("cm", "lib, ver, fqn, a.symbol AS symbol", _CTOR_KINDS) + ")",
    "annotation_element_changes": f"{R}{_MMATCH} SELECT DISTINCT * FROM (" + _fired("em", "lib, ver, fqn, a.symbol AS symbol", _ELEMENT_KINDS) + ")",
    "new_obligations": f"{R}{_MMATCH} {_OBLIGATIONS}",
    "no_longer_extensible": f"{R}{_MMATCH} {_SHUT}",
    "thrown_changes": f"{R}{_MMATCH},{_THROWN} {_THROWN_FOUND}",
    "exported_constructors": f"{R}{_EDGES},{_PROPS},{_EXEC} SELECT DISTINCT e.lib, e.ver, e.owner, e.erasure, e.visibility FROM ex e JOIN props p ON p.lib = e.lib AND p.ver = e.ver AND p.fqn = e.owner "
    "WHERE e.exec_kind = 'CONSTRUCTOR' AND p.exported AND (e.visibility = 'PUBLIC' OR (e.visibility = 'PROTECTED' AND p.direct_subtypable))",
    "duplicate_types": "SELECT lib, ver, fqn, count(*) AS n_rows, count(DISTINCT loaded_at) AS n_states FROM type_decl WHERE fqn IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "module_cardinality": "SELECT lib, ver, n, CASE n WHEN 0 THEN 'unnamed' WHEN 1 THEN 'named' ELSE 'error' END AS state FROM (SELECT lib, ver, count(DISTINCT module_name) AS n FROM api_snapshot GROUP BY lib, ver)",
    "primitive_assignability": f"WITH n AS (SELECT name FROM {rows([(x,) for x in _names], 'name')}), w AS (SELECT a, b FROM {_WIDER}), x AS (SELECT p, box FROM {_BOX}) "
    "SELECT s.name AS source, t.name AS target, s.name = t.name OR EXISTS (SELECT 1 FROM w WHERE w.a = s.name AND w.b = t.name) OR EXISTS (SELECT 1 FROM x WHERE x.p = s.name AND x.box = t.name) "
    "OR EXISTS (SELECT 1 FROM x WHERE x.box = s.name AND x.p = t.name) OR EXISTS (SELECT 1 FROM x JOIN w ON w.a = x.p WHERE x.box = s.name AND w.b = t.name) AS assignable FROM n s CROSS JOIN n t",
    "annotated_types": f"WITH {_LAST},{_BETA} SELECT * FROM beta",
    "excluded_types": f"{R}{_EXCLUDED} SELECT * FROM excluded",
    "type_match": f"{R}{_MATCH} SELECT lib, ver, fqn, status FROM tm",
    "type_removed": f"{R}{_MATCH} SELECT lib, ver, fqn FROM tm WHERE status = 'REMOVED'",
    "type_kind_changed": f"{R}{_MATCH} SELECT lib, ver, fqn, a.kind AS old_kind, b.kind AS new_kind FROM tm WHERE status = 'KIND_CHANGED'",
    "type_flag_changes": f"{R}{_MATCH}, m AS (SELECT lib, ver, fqn, a, b, a.kind = 'CLASS' AS klass, a.kind = 'CLASS' AND a.enclosing IS NOT NULL AND b.enclosing IS NOT NULL AS nested, "
    "list_contains(b.mods, 'SEALED') AND NOT list_contains(a.mods, 'SEALED') AS now_sealed FROM tm WHERE status = 'MATCHED') "
    + _fired("m", "lib, ver, fqn", {
        "TYPE_NOW_PROTECTED": "a.visibility = 'PUBLIC' AND b.visibility = 'PROTECTED'",
        "TYPE_NOW_SEALED": "now_sealed AND a.direct_subtypable",
        "CLASS_NOW_FINAL": "klass AND NOT now_sealed AND a.subtypable AND NOT b.subtypable",
        "CLASS_NOW_STATIC": "nested AND NOT list_contains(a.mods, 'STATIC') AND list_contains(b.mods, 'STATIC')",
        "CLASS_NO_LONGER_STATIC": "nested AND list_contains(a.mods, 'STATIC') AND NOT list_contains(b.mods, 'STATIC')",
        "CLASS_NOW_ABSTRACT": "klass AND NOT a.eff_abstract AND b.eff_abstract",
        "CLASS_NOW_CHECKED_EXCEPTION": "klass AND a.unchecked AND b.checked",
    }),
    "supertypes_removed": f"{R}{_MATCH}, gone AS (SELECT x.lib, o.next_ver AS ver, x.ver AS old_ver, x.fqn, x.ancestor FROM anc x JOIN o ON o.lib = x.lib AND o.ver = x.ver "
    "LEFT JOIN props p ON p.lib = x.lib AND p.ver = x.ver AND p.fqn = x.ancestor WHERE o.next_ver IS NOT NULL AND coalesce(p.exported, true) "
    "AND EXISTS (SELECT 1 FROM tm WHERE tm.status = 'MATCHED' AND tm.lib = x.lib AND tm.ver = o.next_ver AND tm.fqn = x.fqn) "
    "AND NOT EXISTS (SELECT 1 FROM anc n WHERE n.lib = x.lib AND n.ver = o.next_ver AND n.fqn = x.fqn AND n.ancestor = x.ancestor)), "
    "pw AS (SELECT a, b FROM platform UNION SELECT pw.a, p.b FROM pw JOIN platform p ON p.a = pw.b) "
    "SELECT g.lib, g.ver, g.fqn, g.ancestor AS lost FROM gone g "
    "WHERE NOT EXISTS (SELECT 1 FROM gone h JOIN anc c ON c.lib = h.lib AND c.ver = h.old_ver AND c.fqn = h.ancestor WHERE h.lib = g.lib AND h.ver = g.ver AND h.fqn = g.fqn AND c.ancestor = g.ancestor) "
    "AND NOT EXISTS (SELECT 1 FROM gone h JOIN pw ON pw.a = h.ancestor WHERE h.lib = g.lib AND h.ver = g.ver AND h.fqn = g.fqn AND pw.b = g.ancestor)",
    "field_match": f"{R}{_FMATCH} SELECT lib, ver, fqn, name, status FROM fm",
    "field_changes": f"{R}{_FMATCH}, m AS (SELECT * FROM fm WHERE status = 'MATCHED') " + _fired("m", "lib, ver, fqn, name", {
        "FIELD_NOW_PROTECTED": "a.visibility = 'PUBLIC' AND b.visibility = 'PROTECTED'",
        "FIELD_NOW_FINAL": "NOT list_contains(a.mods, 'FINAL') AND list_contains(b.mods, 'FINAL')",
        "FIELD_NOW_STATIC": "NOT list_contains(a.mods, 'STATIC') AND list_contains(b.mods, 'STATIC')",
        "FIELD_NO_LONGER_STATIC": "list_contains(a.mods, 'STATIC') AND NOT list_contains(b.mods, 'STATIC')",
    }),
    "constructor_match": f"{R}{_MATCH},{_EXEC}, shown AS (SELECT e.lib, e.ver, e.owner AS fqn, e.erasure AS k FROM ex e JOIN props p ON p.lib = e.lib AND p.ver = e.ver AND p.fqn = e.owner "
    f"WHERE e.exec_kind = 'CONSTRUCTOR' AND p.exported AND (e.visibility = 'PUBLIC' OR (e.visibility = 'PROTECTED' AND p.direct_subtypable))),{_XMATCH} SELECT lib, ver, fqn, k AS erasure, status FROM xm",
    "annotation_element_match": f"{R}{_MATCH},{_EXEC}, shown AS (SELECT e.lib, e.ver, e.owner AS fqn, e.name AS k FROM ex e SEMI JOIN (SELECT * FROM t WHERE kind = 'ANNOTATION') a "
    f"ON a.lib = e.lib AND a.ver = e.ver AND a.fqn = e.owner WHERE e.exec_kind = 'ANNOTATION_METHOD'),{_XMATCH} SELECT lib, ver, fqn, k AS name, status FROM xm",
    "annotation_targets_removed": f"{R}{_MATCH}, tg AS (SELECT lib, ver, fqn, CASE WHEN len(list_filter(coalesce(annotations, []), lambda x: x.fqn = 'java.lang.annotation.Target')) > 0 "
    f"OR len(coalesce(targets, [])) > 0 THEN coalesce(targets, []) ELSE {DEFAULT_TARGETS!r} END AS tgs FROM last WHERE kind = 'ANNOTATION') "
    "SELECT DISTINCT m.lib, m.ver, m.fqn, x.target FROM tm m JOIN o ON o.lib = m.lib AND o.next_ver = m.ver JOIN tg a ON a.lib = m.lib AND a.ver = o.ver AND a.fqn = m.fqn "
    "JOIN tg b ON b.lib = m.lib AND b.ver = m.ver AND b.fqn = m.fqn, unnest(a.tgs) AS x(target) WHERE m.status = 'MATCHED' AND NOT list_contains(b.tgs, x.target)",
    "formal_parameter_counts": f"{R}{_MATCH}, m AS (SELECT lib, ver, fqn, a.tps AS p, b.tps AS q FROM tm WHERE status = 'MATCHED') "
    "SELECT lib, ver, fqn, 'FORMAL_TYPE_PARAMETER_REMOVED' AS kind, unnest(list_transform(p[len(q) + 1:], lambda z: z.name)) AS tp FROM m WHERE len(p) > len(q) "
    "UNION ALL SELECT lib, ver, fqn, 'FORMAL_TYPE_PARAMETER_ADDED', unnest(list_transform(q[len(p) + 1:], lambda z: z.name)) FROM m WHERE len(q) > len(p) AND len(p) > 0",
    "report_normal": f"WITH {_REPORT} SELECT bc_id, report_id, lib, kind, kind_ordinal, nature, binary_breaking, source_breaking FROM rep",
    "report_findings": f"WITH {_REPORT} SELECT DISTINCT report_id, lib, ver_new, impacted_type, impacted_symbol, kind, new_symbol, file, line FROM rep",
    "report_by_type": f"WITH {_REPORT} SELECT lib, ver_new, impacted_type, count(*) AS n, bool_or(binary_breaking) AS binary_breaking, bool_or(source_breaking) AS source_breaking FROM rep GROUP BY ALL",
    "report_by_package": f"WITH {_REPORT} SELECT lib, ver_new, {_PKG} AS pkg, count(DISTINCT impacted_type) AS n_types, count(*) AS n FROM rep GROUP BY ALL",
    "report_by_member": f"WITH {_REPORT}, k AS (SELECT DISTINCT lib, ver_new, impacted_symbol, kind, kind_ordinal FROM rep) SELECT r.lib, r.ver_new, r.impacted_symbol, r.n, k.kinds FROM "
    "(SELECT lib, ver_new, impacted_symbol, count(*) AS n FROM rep GROUP BY ALL) r JOIN (SELECT lib, ver_new, impacted_symbol, string_agg(kind, ',' ORDER BY kind_ordinal) AS kinds FROM k GROUP BY ALL) k "
    "ON k.lib IS NOT DISTINCT FROM r.lib AND k.ver_new IS NOT DISTINCT FROM r.ver_new AND k.impacted_symbol IS NOT DISTINCT FROM r.impacted_symbol",
    "report_summary": f"WITH {_REPORT} SELECT lib, ver_new, count(*) AS total, count(*) FILTER (binary_breaking) AS n_binary, count(*) FILTER (source_breaking) AS n_source FROM rep GROUP BY ALL",
    "report_rollup": f"WITH {_REPORT}, p AS (SELECT *, {_PKG} AS pkg FROM rep) SELECT pkg, impacted_type, kind, count(*) AS n, CAST(grouping_id(pkg, impacted_type, kind) AS BIGINT) AS level FROM p GROUP BY ROLLUP (pkg, impacted_type, kind)",
    "report_binary_only": f"WITH {_REPORT} SELECT bc_id, kind FROM rep WHERE binary_breaking",
    "report_source_only": f"WITH {_REPORT} SELECT bc_id, kind FROM rep WHERE source_breaking",
    "report_impacted_types": f"WITH {_REPORT} SELECT DISTINCT lib, ver_new, impacted_type, {_PKG} AS pkg FROM rep",
    "report_without_names": rf"WITH {_REPORT} SELECT bc_id, kind FROM rep WHERE NOT coalesce(regexp_full_match(impacted_type, '.*\.internal\..*|.*\.[A-Za-z]+Helper|(.*\.internal\..*)[$].*|(.*\.[A-Za-z]+Helper)[$].*'), false) "
    r"AND NOT coalesce(regexp_full_match(impacted_symbol, '.*\.internal\..*|.*\.[A-Za-z]+Helper'), false)",
    "report_without_annotated": f"{R}{_EXCLUDED},{_REPORT} SELECT bc_id, kind FROM rep r WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.lib = r.lib AND e.ver = r.ver_old AND e.fqn = r.impacted_type)",
    "report_not_accepted": f"WITH {_REPORT} SELECT bc_id, kind FROM (SELECT *, min(report_id) OVER (PARTITION BY lib, impacted_type, impacted_symbol, kind) AS first_id FROM rep "
    "WHERE lib IS NOT NULL AND impacted_type IS NOT NULL AND impacted_symbol IS NOT NULL) WHERE report_id = first_id",
    "changed_files": f"WITH {_LAST},{_MORDER},{_FILES} SELECT * FROM chg",
    "changed_since": f"WITH {_MORDER}, f AS (SELECT lib, ver, file, max(loaded_at) AS modified FROM type_decl WHERE file IS NOT NULL GROUP BY ALL) SELECT * FROM ("
    "SELECT lib, ver, file, CASE WHEN in_new IS NULL THEN 'deleted' WHEN in_old IS NULL THEN 'created' WHEN modified > since THEN 'updated' END AS status FROM "
    "(SELECT f.lib, o.next_ver AS ver, f.file, o.t AS since, true AS in_old FROM f JOIN o ON o.lib = f.lib AND o.ver = f.ver WHERE o.next_ver IS NOT NULL) FULL OUTER JOIN "
    "(SELECT f.lib, f.ver, f.file, f.modified, true AS in_new FROM f JOIN o ON o.lib = f.lib AND o.ver = f.ver WHERE o.seq > 1) USING (lib, ver, file)) WHERE status IS NOT NULL",
    "incremental_rebuild": f"WITH {_LAST},{_MORDER} SELECT l.lib, l.ver, l.fqn, l.kind, l.visibility FROM last l JOIN o ON o.lib = l.lib AND o.ver = l.ver WHERE o.seq > 1 AND l.file IS NOT NULL",
    "strategy_outcomes": f"WITH {_SPACE.lstrip()} SELECT strategy, count(*) FILTER (outcome = 'ok') AS n_ok, count(*) FILTER (outcome = 'impossible') AS n_impossible FROM space GROUP BY strategy",
    "strategy_uniform": f"WITH {_SPACE.lstrip()}, long AS (SELECT strategy, regexp_replace(list_last(string_split(regexp_replace(symbol, '\\(.*$', ''), '.')), '[^A-Za-z0-9]', '', 'g') AS own, "
    "regexp_replace(regexp_replace(regexp_replace(symbol, '\\(.*$', ''), '\\.[^.]*$', ''), '[^A-Za-z0-9]', '', 'g') AS owner FROM space WHERE outcome = 'ok'), "
    "named AS (SELECT CASE strategy " + " ".join("WHEN '" + s + "' THEN '" + t.replace("{0}", "' || own || '").replace("{1}", "' || owner || '") + "'" for s, t in LONG_NAMES.items()) + " END AS name FROM long) "
    "SELECT pattern, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{p}'" for p in PATTERNS) + " END AS pattern FROM named) GROUP BY pattern",
    "tool_metrics": f"WITH {_REPORT}, c AS (SELECT r.nature, count(*) FILTER (r.binary_breaking AND b.said) AS tp, count(*) FILTER (NOT r.binary_breaking AND b.said) AS fp, "
    "count(*) FILTER (r.binary_breaking AND NOT b.said) AS fn, count(*) FILTER (NOT r.binary_breaking AND NOT b.said) AS tn FROM rep r "
    "JOIN (SELECT bc_id, coalesce(binary_breaking, false) AS said FROM one) b USING (bc_id) GROUP BY r.nature) "
    "SELECT *, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS precision, "
    "CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) ELSE 0.0::DOUBLE END AS f1 FROM c",
    "change_themes": f"WITH {_REPORT} SELECT theme, count(*) AS n, count(DISTINCT kind) AS n_kinds FROM (SELECT kind, CASE "
    + " ".join(f"WHEN regexp_matches(kind, '{p}') THEN '{t}'" for p, t in THEMES) + " ELSE 'other' END AS theme FROM rep) GROUP BY theme",
}


def _part(name: str, kind: str = "kind", symbol: str = "symbol") -> str:
    return f"SELECT lib, ver, {kind} AS kind, fqn AS impacted_type, {symbol} AS impacted_symbol FROM ({ORACLE[name]})"


_FIELD_KINDS = {"FIELD_REMOVED": "status = 'REMOVED'"} | {
    k: f"status = 'MATCHED' AND {c}"
    for k, c in {
        "FIELD_NOW_PROTECTED": "a.visibility = 'PUBLIC' AND b.visibility = 'PROTECTED'",
        "FIELD_NOW_FINAL": _GAINED.format("FINAL"),
        "FIELD_NOW_STATIC": _GAINED.format("STATIC"),
        "FIELD_NO_LONGER_STATIC": _LOST.format("STATIC"),
    }.items()
}
_REPEATABLE = (
    f"{R}{_MATCH}, rp AS (SELECT lib, ver, fqn, len(list_filter(coalesce(annotations, []), lambda x: x.fqn = 'java.lang.annotation.Repeatable')) > 0 AS rep FROM last WHERE kind = 'ANNOTATION') "
    "SELECT m.lib, m.ver, m.fqn FROM tm m JOIN o ON o.lib = m.lib AND o.next_ver = m.ver JOIN rp a ON a.lib = m.lib AND a.ver = o.ver AND a.fqn = m.fqn "
    "JOIN rp b ON b.lib = m.lib AND b.ver = m.ver AND b.fqn = m.fqn WHERE m.status = 'MATCHED' AND a.rep AND NOT b.rep"
)
_PLAIN = " UNION ALL ".join([
    _part("type_removed", "'TYPE_REMOVED'", "fqn"), _part("type_kind_changed", "'TYPE_KIND_CHANGED'", "fqn"), _part("type_flag_changes", "kind", "fqn"),
    _part("supertypes_removed", "'TYPE_SUPERTYPE_REMOVED'", "fqn"), _part("annotation_targets_removed", "'ANNOTATION_TARGET_REMOVED'", "fqn"),
    f"SELECT lib, ver, 'ANNOTATION_NO_LONGER_REPEATABLE', fqn, fqn FROM ({_REPEATABLE})",
    f"SELECT lib, ver, kind, fqn, symbol FROM ({R}{_FMATCH} " + _fired("fm", "lib, ver, fqn, a.owner || '.' || name AS symbol", _FIELD_KINDS) + ")",
    _part("method_changes"), _part("constructor_changes"), _part("annotation_element_changes"), _part("new_obligations", "kind", "fqn"),
    _part("no_longer_extensible", "'CLASS_NO_LONGER_CONCRETELY_EXTENSIBLE'", "fqn"), _part("thrown_changes"),
])
ORACLE["breaking_changes_plain"] = (
    f"SELECT DISTINCT p.*, k.nature, k.binary_breaking, k.source_breaking FROM ({_PLAIN}) p JOIN (SELECT * FROM {_KINDS}) k ON k.kind = p.kind WHERE NOT starts_with(p.impacted_symbol, 'java.lang.Object.')"
)
