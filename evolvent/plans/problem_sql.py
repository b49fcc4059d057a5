"""SQL that states the results of the pN queries of the core, for checking against another engine."""

_SNAPS = """
s AS (SELECT lib, ver, min(taken_at) AS t FROM api_snapshot
      WHERE state = 'DELIVERED' AND lib IS NOT NULL AND ver IS NOT NULL AND taken_at IS NOT NULL GROUP BY lib, ver),
o AS (SELECT lib, ver, t, row_number() OVER (PARTITION BY lib ORDER BY t, ver) AS seq FROM s)"""

_REFS = r"""
latest AS (SELECT lib, ver, fqn, super_ref, interface_refs, enclosing FROM (
             SELECT *, row_number() OVER (PARTITION BY lib, ver, fqn ORDER BY loaded_at DESC NULLS LAST) AS rn
             FROM type_decl WHERE lib IS NOT NULL AND ver IS NOT NULL AND fqn IS NOT NULL) WHERE rn = 1),
raw_refs AS (SELECT lib, ver, fqn, 'super_ref' AS ref_field, super_ref AS ref FROM latest
             UNION ALL SELECT lib, ver, fqn, 'interface_refs', unnest(interface_refs) FROM latest
             UNION ALL SELECT lib, ver, fqn, 'enclosing', enclosing FROM latest),
refs AS (SELECT DISTINCT lib, ver, fqn, ref_field, target FROM (
           SELECT *, replace(regexp_replace(split_part(ref, '<', 1), '^\s+|\s+$', '', 'g'), '/', '.') AS target FROM raw_refs)
         WHERE target <> ''),
keys AS (SELECT DISTINCT lib, ver, fqn FROM latest)"""

_MEMBERS = """
members AS (
  SELECT lib, ver, owner, concat_ws('|', 'm', coalesce(name, '~'), coalesce(exec_kind, '~'), coalesce(visibility, '~'),
         CAST(list_sort(list_distinct(coalesce(modifiers, []))) AS VARCHAR), coalesce(return_ref, '~'),
         CAST(list_transform(coalesce(params, []), lambda p: [p.ref, CAST(p.varargs AS VARCHAR)]) AS VARCHAR),
         CAST(list_transform(coalesce(tps, []), lambda p: [p.name, CAST(coalesce(p.bounds, []) AS VARCHAR)]) AS VARCHAR),
         CAST(list_sort(list_distinct(coalesce(thrown, []))) AS VARCHAR), coalesce(CAST(has_default AS VARCHAR), '~')) AS x
  FROM exec_decl WHERE exec_kind IS NULL OR exec_kind <> 'CONSTRUCTOR'
  UNION ALL
  SELECT lib, ver, owner, concat_ws('|', 'f', coalesce(name, '~'), coalesce(visibility, '~'),
         CAST(list_sort(list_distinct(coalesce(modifiers, []))) AS VARCHAR), coalesce(type_ref, '~'),
         coalesce(CAST(is_const AS VARCHAR), '~'))
  FROM field_decl),"""

ORACLE = {
    "p2_found": f"""
WITH {_SNAPS},
{_MEMBERS}
sets AS (SELECT lib, ver, owner, string_agg(DISTINCT x, chr(10) ORDER BY x) AS v FROM members GROUP BY ALL),
cur AS (SELECT DISTINCT t.lib, t.ver, t.fqn, o.seq, coalesce(sets.v, '') AS v
        FROM type_decl t JOIN o ON t.lib = o.lib AND t.ver = o.ver
        LEFT JOIN sets ON sets.lib = t.lib AND sets.ver = t.ver AND sets.owner = t.fqn WHERE t.fqn IS NOT NULL)
SELECT n.lib, n.ver, n.fqn, CASE WHEN p.fqn IS NULL THEN 'added' ELSE 'changed' END AS change
FROM cur n LEFT JOIN cur p ON p.lib = n.lib AND p.fqn = n.fqn AND p.seq = n.seq - 1
WHERE n.seq > 1 AND (p.fqn IS NULL OR p.v <> n.v)
UNION ALL
SELECT p.lib, o.ver, p.fqn, 'removed'
FROM cur p JOIN o ON o.lib = p.lib AND o.seq = p.seq + 1
LEFT JOIN cur n ON n.lib = p.lib AND n.fqn = p.fqn AND n.seq = p.seq + 1
WHERE n.fqn IS NULL""",
    "p3_found": f"""
WITH {_SNAPS}, {_REFS},
gone AS (SELECT r.* FROM refs r ANTI JOIN keys k ON k.lib = r.lib AND k.ver = r.ver AND k.fqn = r.target
         WHERE r.target NOT IN (SELECT fqn FROM known_type WHERE fqn IS NOT NULL)),
spans AS (SELECT k.lib, k.fqn, min(s.t) AS first_at, max(s.t) AS last_at
          FROM keys k JOIN s ON s.lib = k.lib AND s.ver = k.ver GROUP BY k.lib, k.fqn)
SELECT g.lib, g.ver, g.fqn, g.ref_field, g.target,
       CASE WHEN x.first_at < s.t THEN 'deleted' WHEN x.last_at > s.t THEN 'later' ELSE 'missing' END AS reason
FROM gone g LEFT JOIN s ON s.lib = g.lib AND s.ver = g.ver LEFT JOIN spans x ON x.lib = g.lib AND x.fqn = g.target""",
    "p4_found": f"""
WITH RECURSIVE {_REFS.lstrip()},
n_keys AS (SELECT lib, ver, count(*) AS n FROM keys GROUP BY ALL),
edges AS (SELECT r.lib, r.ver, r.ref_field AS link, r.fqn AS c, r.target AS p
          FROM refs r SEMI JOIN keys k ON k.lib = r.lib AND k.ver = r.ver AND k.fqn = r.target),
walk AS (
  SELECT lib, ver, link, p AS ancestor, c AS descendant, 1 AS depth FROM edges
  UNION
  SELECT w.lib, w.ver, w.link, e.p, w.descendant, w.depth + 1
  FROM walk w JOIN edges e ON e.lib = w.lib AND e.ver = w.ver AND e.link = w.link AND e.c = w.ancestor
  JOIN n_keys z ON z.lib = w.lib AND z.ver = w.ver WHERE w.depth < z.n)
SELECT lib, ver, link, ancestor, descendant, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY ALL""",
}

# an orphan of level n refers to one of level n - 1 and to none before
ORACLE["p3_report"] = f"""
WITH RECURSIVE {_SNAPS.lstrip()}, {_REFS},
n_keys AS (SELECT lib, ver, count(*) AS n FROM keys GROUP BY ALL),
direct AS (SELECT lib, ver, fqn, ref_field, target, reason FROM ({ORACLE["p3_found"]})),
inner_refs AS (SELECT r.* FROM refs r SEMI JOIN keys k ON k.lib = r.lib AND k.ver = r.ver AND k.fqn = r.target),
lv AS (SELECT DISTINCT lib, ver, fqn, 0 AS level FROM direct
       UNION SELECT r.lib, r.ver, r.fqn, l.level + 1 FROM inner_refs r JOIN lv l ON l.lib = r.lib AND l.ver = r.ver AND l.fqn = r.target
       JOIN n_keys z ON z.lib = r.lib AND z.ver = r.ver WHERE l.level < z.n),
ml AS (SELECT lib, ver, fqn, min(level) AS level FROM lv GROUP BY ALL),
every AS (SELECT lib, ver, fqn, ref_field, reason, 0 AS level FROM direct
          UNION ALL SELECT r.lib, r.ver, r.fqn, r.ref_field, 'inherited', c.level FROM inner_refs r JOIN ml p ON p.lib = r.lib AND p.ver = r.ver AND p.fqn = r.target
          JOIN ml c ON c.lib = r.lib AND c.ver = r.ver AND c.fqn = r.fqn WHERE c.level = p.level + 1)
SELECT e.ref_field, strftime(s.t, '%Y-%m') AS period, e.reason, CAST(e.level AS INTEGER) AS level, count(*) AS n_refs, count(DISTINCT [e.lib, e.ver, e.fqn]) AS n_types
FROM every e LEFT JOIN s ON s.lib = e.lib AND s.ver = e.ver GROUP BY ALL"""

# old and new members of changed types, those left out that both sides have
ORACLE["p2_values"] = f"""
WITH {_SNAPS},{_MEMBERS}
named AS (SELECT DISTINCT lib, ver, owner, x, split_part(x, '|', 1) || ':' || split_part(x, '|', 2) AS member FROM members),
c AS (SELECT c.lib, c.ver, c.fqn, p.ver AS old_ver FROM ({ORACLE["p2_found"]}) c JOIN o ON o.lib = c.lib AND o.ver = c.ver JOIN o p ON p.lib = o.lib AND p.seq = o.seq - 1 WHERE c.change = 'changed')
SELECT c.lib, c.ver, c.fqn, 'new' AS side, n.member FROM c JOIN named n ON n.lib = c.lib AND n.ver = c.ver AND n.owner = c.fqn
WHERE NOT EXISTS (SELECT 1 FROM named w WHERE w.lib = c.lib AND w.ver = c.old_ver AND w.owner = c.fqn AND w.x = n.x)
UNION ALL SELECT c.lib, c.ver, c.fqn, 'old', n.member FROM c JOIN named n ON n.lib = c.lib AND n.ver = c.old_ver AND n.owner = c.fqn
WHERE NOT EXISTS (SELECT 1 FROM named w WHERE w.lib = c.lib AND w.ver = c.ver AND w.owner = c.fqn AND w.x = n.x)"""

ORACLE["p4_loops"] = f"SELECT lib, ver, link, ancestor AS fqn, depth AS length FROM ({ORACLE['p4_found']}) WHERE ancestor = descendant"

# JSON: strings are read through; a list may be written as its bare element; null elements keep their place
_ITEMS = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN {0} IS NULL THEN [] ELSE [{0}] END END"


def _each(frm: str, items: str, cols: str) -> str:
    """Elements of a list that are objects, with their places."""
    return f"SELECT {cols}, x, i - 1 AS i FROM (SELECT {cols}, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT {cols}, {items} AS l FROM {frm})) WHERE json_type(x) = 'OBJECT'"


_JSON = f"""
raw AS (SELECT rec_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY written_at DESC NULLS LAST, payload DESC NULLS LAST) AS rn FROM api_json) WHERE rn = 1 AND json_valid(payload)),
unwrap AS (SELECT rec_id, CAST(payload AS JSON) AS x FROM raw
           UNION ALL SELECT rec_id, CAST(x->>'$' AS JSON) FROM (SELECT * FROM unwrap WHERE json_type(x) = 'VARCHAR') WHERE json_valid(x->>'$')),
snap AS (SELECT rec_id, x FROM unwrap WHERE json_type(x) = 'OBJECT'),
ty AS (SELECT rec_id, CAST(i AS VARCHAR) AS path, '' AS parent, x FROM ({_each("(SELECT rec_id, x->'allTypes' AS l0 FROM snap)", _ITEMS.format("l0"), "rec_id")})
       UNION ALL SELECT rec_id, path || '.' || i, path, x FROM ({_each("(SELECT rec_id, path, x->'nestedTypes' AS l0 FROM ty)", _ITEMS.format("l0"), "rec_id, path")})),
me AS ({_each("(SELECT rec_id, path, x->>'typeKind' AS kind, x->'methods' AS l0 FROM ty)", _ITEMS.format("l0"), "rec_id, path, kind")}),
holder AS (SELECT rec_id, path, x->>'typeKind' AS kind, -1 AS method_no, x->'formalTypeParameters' AS l0 FROM ty UNION ALL SELECT rec_id, path, kind, i, x->'formalTypeParameters' FROM me),
tp AS ({_each("holder", _ITEMS.format("l0"), "rec_id, path, kind, method_no")})"""
ORACLE["p5_types"] = f"WITH RECURSIVE {_JSON} SELECT rec_id, path AS type_path, parent AS parent_path, coalesce(x->>'typeKind', '') AS type_kind, x->>'qualifiedName' AS qualified_name FROM ty"
ORACLE["p5_parameters"] = (
    f"WITH RECURSIVE {_JSON} SELECT rec_id, path AS type_path, coalesce(kind, '') AS type_kind, CAST(method_no AS INTEGER) AS method_no, CAST(i AS INTEGER) AS tp_no, x->>'name' AS name FROM tp"
)
# a bound is an object or a plain string
ORACLE["p5_found"] = (
    f"WITH RECURSIVE {_JSON} SELECT rec_id, path AS type_path, coalesce(kind, '') AS type_kind, CAST(method_no AS INTEGER) AS method_no, CAST(tp_no AS INTEGER) AS tp_no, CAST(j - 1 AS INTEGER) AS bound_no, "
    "CASE json_type(b) WHEN 'VARCHAR' THEN split_part(b->>'$', '<', 1) ELSE b->>'qualifiedName' END AS bound FROM (SELECT rec_id, path, kind, method_no, tp_no, unnest(l) AS b, generate_subscripts(l, 1) AS j FROM "
    f"(SELECT rec_id, path, kind, method_no, i AS tp_no, {_ITEMS.format('l0')} AS l FROM (SELECT *, x->'bounds' AS l0 FROM tp))) WHERE json_type(b) IN ('OBJECT', 'VARCHAR')"
)
