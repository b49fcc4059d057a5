"""Hierarchies of the types of each snapshot, along superclasses, interfaces and enclosing types.

Snapshots of ordinary size are numbered within the task that holds them (:mod:`forest`), larger ones by the distributed
rounds of :mod:`hierarchy`; both by the same nested sets, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolvent.operators.declarations import REF_FIELDS, references
from evolvent.operators.forest import NestedSets, closure, rooted
from evolvent.operators.hierarchy import G, hierarchy
from evolvent.operators.snapshot_diff import fingerprint
from evolvent.operators.snapshot_graph import GROUP_ROWS, Chunk, by_chunk, split_large
from evolvent.session import Stages


def _graph(types: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names ``g, node, lib, ver, fqn``; edges ``g, link, node, parent``; nodes ``g, link, node``), written once."""
    stages = Stages(types.sparkSession, "graph")
    g, node = fingerprint(F.col("lib"), F.col("ver")), lambda c: fingerprint(F.col(c))
    ok = types.where("lib IS NOT NULL AND ver IS NOT NULL AND fqn IS NOT NULL")
    names = stages.put(ok.select(g.alias("g"), node("fqn").alias("node"), "lib", "ver", "fqn").distinct(), "names")
    refs = references(types).select(g.alias("g"), F.col("ref_field").alias("link"), node("fqn").alias("node"), node("target").alias("parent"))
    inside = names.select("g", F.col("node").alias("parent"))
    edges = stages.put(refs.join(inside, ["g", "parent"], "left_semi").select("g", "link", "node", "parent").distinct(), "edges")
    nodes = edges.select("g", "link", "node").unionByName(edges.select("g", "link", F.col("parent").alias("node"))).distinct()
    return names, edges, nodes


#: Squares of group sizes that one array closure takes together, which bounds its pairs.
CLOSURE_PAIRS = 16_000_000


def _forests(c: Chunk, link: int) -> tuple[NestedSets, np.ndarray, np.ndarray]:
    """(numbers of the nodes of groups in which no node has two parents, edges left to close: child and parent)."""
    n = len(c.group)
    e = (c.field == link) & (c.parent >= 0)
    child, parent = c.child[e], c.parent[e]
    several = np.zeros(int(c.group.max()) + 1 if n else 0, dtype=bool)
    several[c.group[np.flatnonzero(np.bincount(child, minlength=n) > 1)]] = True
    one = ~several[c.group[child]]
    up = np.full(n, -1, dtype=np.int64)
    up[child[one]] = parent[one]
    sets = NestedSets(up)
    rest = ~one | ~sets.ranged[child]
    return sets, child[rest], parent[rest]


def _parts(c: Chunk, child: np.ndarray, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, edges by place among them) of so many groups together as keep the number of pairs of a closure in bounds."""
    g = c.group[child]
    groups, count = np.unique(g, return_counts=True)
    part = np.cumsum(np.minimum(4 * count, np.bincount(c.group)[groups]) ** 2) // CLOSURE_PAIRS
    for p in np.unique(part):
        e = np.isin(g, groups[part == p])
        nodes, at = np.unique(np.concatenate([child[e], parent[e]]), return_inverse=True)
        yield nodes, at[: e.sum()], at[e.sum() :]


def _closures(c: Chunk, child: np.ndarray, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for nodes, below, above in _parts(c, child, parent):
        for a, d, k in closure(len(nodes), below, above):
            yield nodes[a], nodes[d], k


def _ancestor_task(chunks: Iterator[Chunk], links: tuple[str, ...] = REF_FIELDS) -> Iterator[pa.RecordBatch]:
    for c in chunks:
        for i, link in enumerate(REF_FIELDS):
            if link not in links:
                continue
            sets, child, parent = _forests(c, i)
            for pairs in (sets.pairs(), _closures(c, child, parent)):
                for a, d, depth in pairs:
                    at = pa.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [c.lib.take(at), c.ver.take(at), pa.array([link] * len(d), pa.string()), c.fqn.take(pa.array(a)), c.fqn.take(at), pa.array(depth, pa.int32())],
                        names=["lib", "ver", "link", "ancestor", "descendant", "depth"],
                    )


def _tree_task(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
    names = ["lib", "ver", "link", "fqn", "root", "depth", "lo", "size", "n_descendants", "path"]
    for c in chunks:
        fqn = c.fqn.to_pylist()
        for i, link in enumerate(REF_FIELDS):
            sets, child, _ = _forests(c, i)
            used = np.zeros(len(fqn), dtype=bool)
            e = (c.field == i) & (c.parent >= 0)
            used[c.child[e]] = used[c.parent[e]] = True
            looping = np.zeros(len(fqn), dtype=bool)
            several = np.zeros(len(fqn), dtype=bool)
            looping[~sets.ranged] = True
            counts = np.bincount(c.child[e], minlength=len(fqn))
            several[np.isin(c.group, c.group[counts > 1])] = True
            show = used & ~looping & ~several
            path = list(fqn)
            for level in sets.levels[1:]:
                for x in level.tolist():
                    path[x] = f"{path[sets.parent[x]]}/{fqn[x]}"
            x = np.flatnonzero(show)
            at = pa.array(x)
            yield pa.RecordBatch.from_arrays(
                [
                    c.lib.take(at), c.ver.take(at), pa.array([link] * len(x), pa.string()), c.fqn.take(at), c.fqn.take(pa.array(sets.root[x])),
                    pa.array(sets.depth[x], pa.int32()), pa.array(sets.lo[x] - sets.lo[sets.root[x]], pa.int64()), pa.array(sets.size[x], pa.int64()),
                    pa.array(sets.size[x] - 1, pa.int64()), pa.array([path[j] for j in x.tolist()], pa.string()),
                ],
                names=names,
            )


def _place_task(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
    names = ["lib", "ver", "link", "fqn", "root", "depth", "n_descendants", "path", "loop"]
    for c in chunks:
        for b in _tree_task(iter([c])):
            kept = [b.column(b.schema.get_field_index(x)) for x in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([""] * b.num_rows, pa.string())], names=names)
        rank = np.empty(len(c.fqn), dtype=np.int64)
        rank[pc.sort_indices(c.fqn).to_numpy()] = np.arange(len(c.fqn))
        for i, link in enumerate(REF_FIELDS):
            _, child, parent = _forests(c, i)
            for nodes, below, above in _parts(c, child, parent):
                on, hangs, n_below, levels = rooted(len(nodes), below, above, rank[nodes])
                fqn, path = c.fqn.take(pa.array(nodes)).to_pylist(), []
                loop = np.where(on, "on", np.where(hangs, "below", ""))
                for depth, (x, root, up) in enumerate(levels):
                    path = [f"{path[u]}/{fqn[j]}" for u, j in zip(up.tolist(), x.tolist())] if depth else [fqn[j] for j in x.tolist()]
                    at = pa.array(nodes[x])
                    yield pa.RecordBatch.from_arrays(
                        [
                            c.lib.take(at), c.ver.take(at), pa.array([link] * len(x), pa.string()), c.fqn.take(at), c.fqn.take(pa.array(nodes[root])),
                            pa.array([depth] * len(x), pa.int32()), pa.array(n_below[x], pa.int64()), pa.array(path, pa.string()), pa.array(loop[x].tolist(), pa.string()),
                        ],
                        names=names,
                    )


def type_ancestors(types: DataFrame, group_rows: int = GROUP_ROWS, links: tuple[str, ...] = REF_FIELDS) -> DataFrame:
    """``lib, ver, link, ancestor, descendant, depth``: each type and each type it reaches by one or more links.

    ``link`` is super_ref, interface_refs or enclosing, each followed by itself, within a snapshot; ``depth`` is the
    least number of links. A type that reaches itself is its own ancestor. Only the latest state of a type counts;
    blank references and references out of the snapshot are no links; empty tables give no rows. Snapshots of more than
    ``group_rows`` rows take the distributed rounds. ``links`` chooses among the links.
    """
    small, large = split_large(types, group_rows)
    schema = "lib string, ver string, link string, ancestor string, descendant string, depth int"
    out = by_chunk(small, lambda it: _ancestor_task(it, links), schema)
    return out if large is None else out.unionByName(_distributed_ancestors(large).where(F.col("link").isin(*links)))


def type_trees(types: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``lib, ver, link, fqn, root, depth, lo, size, n_descendants, path`` of every node of an acyclic single-parent tree.

    ``path`` runs from the root to the node, ``/`` between names; ``lo`` and ``size`` are the node's place in its tree's
    preorder and the length of its range. Nodes on loops, hanging on loops, or of a snapshot whose links give a type
    several parents have no row here; :func:`type_places` covers them.
    """
    small, large = split_large(types, group_rows)
    schema = "lib string, ver string, link string, fqn string, root string, depth int, lo bigint, size bigint, n_descendants bigint, path string"
    out = by_chunk(small, _tree_task, schema)
    return out if large is None else out.unionByName(_distributed_trees(large))


def type_places(types: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``lib, ver, link, fqn, root, depth, n_descendants, path, loop`` of every type that has or is a parent along a link.

    One row for each root above the type (its own, for a root). A root is a type without parents; of a loop that no link
    leaves, the member of least name stands as its root. ``depth`` is the least number of links to the root and ``path``
    runs from there, ``/`` between names, along as many links; where several parents are as near, along the one of
    least name. ``n_descendants`` counts the types that reach this one, itself included if it is on a loop, as in
    :func:`type_ancestors`. ``loop`` is ``on`` for a type that reaches itself, ``below`` for one that reaches such a
    type, else empty.
    """
    small, large = split_large(types, group_rows)
    schema = "lib string, ver string, link string, fqn string, root string, depth int, n_descendants bigint, path string, loop string"
    out = by_chunk(small, _place_task, schema)
    return out if large is None else out.unionByName(_distributed_places(large))


def _distributed_ancestors(types: DataFrame) -> DataFrame:
    names, edges, nodes = _graph(types)
    pairs, _ = hierarchy(edges, nodes)
    a = names.select("g", F.col("node").alias("ancestor"), F.col("fqn").alias("a_fqn"))
    d = names.select("g", F.col("node").alias("descendant"), "lib", "ver", F.col("fqn").alias("d_fqn"))
    return (
        pairs.join(a, ["g", "ancestor"])
        .join(d, ["g", "descendant"])
        .select("lib", "ver", "link", F.col("a_fqn").alias("ancestor"), F.col("d_fqn").alias("descendant"), "depth")
    )


def _distributed_trees(types: DataFrame) -> DataFrame:
    names, edges, nodes = _graph(types)
    return _tree_rows(names, *hierarchy(edges, nodes))


def _tree_rows(names: DataFrame, pairs: DataFrame, ranged: DataFrame) -> DataFrame:
    n = names.select("g", "node", "lib", "ver", "fqn")
    r = names.select("g", F.col("node").alias("root"), F.col("fqn").alias("root_fqn"))
    a = names.select("g", F.col("node").alias("ancestor"), F.col("fqn").alias("a_fqn"))
    above = (
        pairs.join(ranged.select("g", "link", F.col("node").alias("descendant")), ["g", "link", "descendant"], "left_semi")
        .join(a, ["g", "ancestor"])
        .groupBy("g", "link", F.col("descendant").alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "a_fqn"))).alias("up"))
    )
    path = F.array_join(F.concat(F.coalesce(F.transform("up", lambda x: x["a_fqn"]), F.array().cast("array<string>")), F.array("fqn")), "/")
    return (
        ranged.join(n, ["g", "node"])
        .join(r, ["g", "root"])
        .join(above, ["g", "link", "node"], "left")
        .select("lib", "ver", "link", "fqn", F.col("root_fqn").alias("root"), "depth", "lo", "size", (F.col("size") - 1).alias("n_descendants"), path.alias("path"))
    )


def _distributed_places(types: DataFrame) -> DataFrame:
    names, edges, nodes = _graph(types)
    pairs, ranged = hierarchy(edges, nodes)
    stages = Stages(types.sparkSession, "places")
    node, numbered = [*G, "node"], ranged.select(*G, "node")
    trees = _tree_rows(names, pairs, ranged).withColumn("loop", F.lit("")).drop("lo", "size")
    # What the ranges do not cover: groups with several parents, loops and what hangs on them.
    closed = stages.put(pairs.join(numbered.withColumnRenamed("node", "descendant"), [*G, "descendant"], "left_anti"), "closed")
    above = closed.groupBy(*G, F.col("descendant").alias("node")).agg(F.count("*").alias("n_above"), F.bool_or(F.col("ancestor") == F.col("descendant")).alias("on"))
    below = closed.groupBy(*G, F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    own = nodes.join(numbered, node, "left_anti").join(names, ["g", "node"]).join(above, node, "left").join(below, node, "left")
    own = stages.put(own.fillna({"n_above": 0, "on": False, "n_descendants": 0}), "own")
    up = own.select(*G, F.col("node").alias("ancestor"), F.col("n_above").alias("a_above"), F.col("on").alias("a_on"), F.col("fqn").alias("a_fqn"))
    near = (
        closed.join(up, [*G, "ancestor"])
        .groupBy(*G, F.col("descendant").alias("node"))
        .agg(F.min("a_above").alias("least"), F.min("a_fqn").alias("first"), F.bool_or("a_on").alias("hangs"))
    )
    # The ancestors of a loop that no link leaves are its members, who all have the same ones.
    top = F.col("on") & (F.col("least") == F.col("n_above")) & (F.col("first") == F.col("fqn"))
    loop = F.when(F.col("on"), "on").when(F.col("hangs"), "below").otherwise("")
    own = own.join(near, node, "left").withColumns({"is_root": (F.col("n_above") == 0) | F.coalesce(top, F.lit(False)), "loop": loop})
    own = stages.put(own.drop("least", "first", "hangs"), "own")
    roots = own.where("is_root").select(*G, "node", F.col("node").alias("root"), "fqn")
    reached = closed.where("ancestor <> descendant").withColumnRenamed("ancestor", "root").join(roots.select(*G, "root"), [*G, "root"])
    reached = stages.put(reached.select(*G, F.col("descendant").alias("node"), "root", "depth"), "reached")
    at = reached.unionByName(roots.select(*node, "root", F.lit(0).alias("depth")))
    at = at.select(*G, F.col("node").alias("parent"), "root", (F.col("depth") + 1).alias("depth"))
    p = names.select("g", F.col("node").alias("parent"), F.col("fqn").alias("p_fqn"))
    via = reached.join(edges, node).join(at, [*G, "parent", "root", "depth"]).join(p, ["g", "parent"])
    via = stages.put(via.groupBy(*node, "root", "depth").agg(F.min(F.struct("p_fqn", "parent")).alias("p")).select(*node, "root", "depth", "p.parent"), "via")
    via = via.join(own.select(*node, "fqn"), node)
    level, found, depth = stages.put(roots.select(*node, "root", F.lit(0).alias("depth"), F.col("fqn").alias("path")), "paths"), [], 0
    while not level.isEmpty():
        found.append(level)
        depth += 1
        over = level.select(*G, F.col("node").alias("parent"), "root", F.col("path").alias("p_path"))
        path = F.concat_ws("/", "p_path", "fqn").alias("path")
        level = stages.put(via.where(F.col("depth") == depth).join(over, [*G, "parent", "root"]).select(*node, "root", "depth", path), "paths")
    r = names.select("g", F.col("node").alias("root"), F.col("fqn").alias("root_fqn"))
    for f in found:
        rows = f.join(own, node).join(r, ["g", "root"])
        trees = trees.unionByName(rows.select("lib", "ver", "link", "fqn", F.col("root_fqn").alias("root"), "depth", "n_descendants", "path", "loop"))
    return trees
