"""Parent-child links to full hierarchies, by nested sets.

Where every node of a group has at most one parent the group is a forest: subtree sizes are added up from the leaves,
preorder ranges are handed down by prefix sums over siblings, and node a is an ancestor of d exactly if d's number lies
within a's range. The ranges are cut into chunks of ``CHUNK`` numbers, so that finding all pairs is an equi-join of
each node's number with the ranges over its chunk, never a product within a tree. Nodes that the sums never complete
lie on loops. Loops, what hangs on them, and groups whose nodes have several parents (no single preorder exists there)
are closed by a breadth-first frontier instead, which also yields the least number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolvent.session import Stages

#: Preorder numbers in a chunk of the interval join.
CHUNK = 32
#: Bits of the sibling salt: siblings under one parent are numbered in 2**SALT_BITS slices.
SALT_BITS = 6

G = ["g", "link"]


def _slices(col: str):
    return F.shiftrightunsigned(F.col(col), 64 - SALT_BITS)


def _subtree_sizes(stages: Stages, nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(``g, link, node, parent, size`` of every node that is on no loop, the nodes that are).

    Kahn's order from the leaves: a node is done once all its children are; what is pending shrinks each round.
    """
    kids = nodes.where("parent IS NOT NULL").groupBy(*G, F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    pending = stages.put(
        nodes.join(kids, [*G, "node"], "left").select(
            *G, "node", "parent", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("got"), F.lit(1).cast("long").alias("size")
        ),
        "pending",
    )
    done = []
    while True:
        ready = pending.where("got = n")
        if ready.isEmpty():
            return (_union(done) if done else None), pending.select(*G, "node", "parent")
        fin = stages.put(ready.select(*G, "node", "parent", "size"), "sized")
        done.append(fin)
        up = fin.where("parent IS NOT NULL").select(
            *G,
            F.col("parent").alias("node"),
            F.lit(None).cast("long").alias("parent"),
            F.lit(None).cast("long").alias("n"),
            F.lit(1).cast("long").alias("got"),
            "size",
        )
        merged = (
            pending.where("got < n")
            .unionByName(up)
            .groupBy(*G, "node")
            .agg(F.max("parent").alias("parent"), F.max("n").alias("n"), F.sum("got").alias("got"), F.sum("size").alias("size"))
        )
        nxt = stages.put(merged, "pending")
        stages.drop(pending)
        pending = nxt


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _preorder(stages: Stages, sized: DataFrame) -> DataFrame:
    """``g, link, node, parent, root, lo, size, depth``: number and range of each node below a root.

    The offset of a node within its parent's range is the sum of the sizes of the siblings before it: a prefix sum over
    the slices of a parent plus one within the slice, so that no task holds all children of one parent.
    """
    s = sized.where("parent IS NOT NULL").withColumn("slice", _slices("node"))
    per = s.groupBy(*G, "parent", "slice").agg(F.sum("size").alias("z"))
    before = Window.partitionBy(*G, "parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*G, "parent", "slice", F.coalesce(F.sum("z").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*G, "parent", "slice").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("off", F.coalesce(F.sum("size").over(within), F.lit(0)))
    below = stages.put(
        s.join(per, [*G, "parent", "slice"]).select(*G, "node", "parent", "size", (F.col("off") + F.col("base")).alias("off")), "off"
    )
    level = stages.put(
        sized.where("parent IS NULL").select(
            *G,
            "node",
            F.lit(None).cast("long").alias("parent"),
            F.col("node").alias("root"),
            F.lit(0).cast("long").alias("lo"),
            "size",
            F.lit(0).alias("depth"),
        ),
        "ranged",
    )
    levels = []
    while not level.isEmpty():
        levels.append(level)
        up = level.where("size > 1").select(*G, F.col("node").alias("parent"), "root", F.col("lo").alias("plo"), F.col("depth").alias("pd"))
        level = stages.put(
            below.join(up, [*G, "parent"]).select(
                *G, "node", "parent", "root", (F.col("plo") + 1 + F.col("off")).alias("lo"), "size", (F.col("pd") + 1).alias("depth")
            ),
            "ranged",
        )
    return _union(levels or [level])


def _contained(ranged: DataFrame) -> DataFrame:
    """``g, link, ancestor, descendant, depth`` of every node within another's range."""
    d = ranged.where("depth > 0").select(
        *G, "root", F.floor(F.col("lo") / CHUNK).alias("chunk"), F.col("node").alias("descendant"), F.col("lo").alias("d_lo"), F.col("depth").alias("d_depth")
    )
    first, last = F.floor((F.col("lo") + 1) / CHUNK), F.floor((F.col("lo") + F.col("size") - 1) / CHUNK)
    a = ranged.where("size > 1").select(
        *G, "root", F.explode(F.sequence(first, last)).alias("chunk"), F.col("node").alias("ancestor"), "lo", "size", "depth"
    )
    j = d.join(a, [*G, "root", "chunk"]).where("d_lo > lo AND d_lo < lo + size")
    return j.select(*G, "ancestor", "descendant", (F.col("d_depth") - F.col("depth")).alias("depth"))


def _frontier_closure(stages: Stages, edges: DataFrame) -> DataFrame | None:
    """Every (ancestor, descendant) over edges ``node -> parent`` with the least number of links, breadth first."""
    step = edges.select(*G, F.col("node").alias("ancestor"), F.col("parent").alias("up"))
    front = stages.put(
        edges.select(*G, F.col("parent").alias("ancestor"), F.col("node").alias("descendant")).distinct(), "front"
    )
    seen, path, depth = None, None, 1
    while not front.isEmpty():
        # What is reached is one growing table, whatever the number of rounds.
        seen, path = stages.grow(front.withColumn("depth", F.lit(depth)), path)
        depth += 1
        nxt = front.join(step, [*G, "ancestor"]).select(*G, F.col("up").alias("ancestor"), "descendant").distinct()
        new = stages.put(nxt.join(seen, [*G, "ancestor", "descendant"], "left_anti"), "front")
        stages.drop(front)
        front = new
    return seen


def hierarchy(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closure and node numbers of parent links.

    ``edges`` are distinct ``g, link, node, parent`` (longs but for ``link``), ``nodes`` all distinct ``g, link, node``
    that occur in them. Returns (pairs ``g, link, ancestor, descendant, depth``; numbers ``g, link, node, parent, root,
    lo, size, depth`` of the nodes of forests that hang on no loop). A node on a loop is its own ancestor.
    """
    spark = edges.sparkSession
    stages = Stages(spark, "hierarchy")
    parents = edges.groupBy(*G, "node").agg(F.count("*").alias("n"), F.max("parent").alias("parent"))
    many = stages.put(parents.where("n > 1").select(*G).distinct(), "many")
    forest_nodes = nodes.join(many, G, "left_anti")
    forest = stages.put(
        forest_nodes.join(parents.select(*G, "node", "parent"), [*G, "node"], "left").select(*G, "node", "parent"), "forest"
    )
    sized, looped = _subtree_sizes(stages, forest)
    closed = [edges.join(many, G, "left_semi")]
    ranged = None
    if sized is not None:
        ranged = stages.put(_preorder(stages, sized), "numbers")
        # Loops, and trees that hang on them: no root reached these.
        hanging = sized.where("parent IS NOT NULL").join(ranged.select(*G, "node"), [*G, "node"], "left_anti")
        closed.append(hanging.select(*G, "node", "parent"))
    closed.append(looped.select(*G, "node", "parent"))
    rest = stages.put(_union(closed), "closed")
    by_front = _frontier_closure(stages, rest)
    pairs = [x for x in (ranged is not None and _contained(ranged) or None, by_front) if x is not None]
    if not pairs:
        none = edges.limit(0)
        pairs = [none.select(*G, F.col("parent").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).alias("depth"))]
    if ranged is None:
        ranged = edges.limit(0).select(
            *G, "node", "parent", F.col("node").alias("root"), F.col("node").alias("lo"), F.col("node").alias("size"), F.lit(0).alias("depth")
        )
    return _union(pairs), ranged
