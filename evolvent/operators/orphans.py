"""References to records that do not exist, and what hangs on them.

Direct orphans are references whose target is neither a type of the same snapshot nor a known outside type. A fixpoint
then cascades down the foreign-key graph: a type that refers, inside its snapshot, to an orphaned type is an inherited
orphan of the next level. Each round semi-joins the internal edges with the last frontier and anti-joins what was
reached before; the rounds end when a frontier is empty, so loops among types end too. Snapshots of ordinary size go
through these rounds within the task that holds them, as array operations; larger ones by rounds of distributed joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolvent.operators.declarations import REF_FIELDS, references
from evolvent.operators.snapshot_diff import BROADCAST_SNAPSHOTS, fingerprint
from evolvent.operators.snapshot_graph import GROUP_ROWS, Chunk, by_chunk, split_large
from evolvent.session import Stages, small_enough

#: Known outside types up to which they are broadcast.
BROADCAST_KNOWN = 200_000
#: Frontier types up to which a round broadcasts them.
BROADCAST_FRONTIER = 500_000


def _orphan_task(chunks: Iterator[Chunk], known: pa.Array) -> Iterator[pa.RecordBatch]:
    names = ["lib", "ver", "fqn", "ref_field", "target", "level"]
    fields = pa.array(REF_FIELDS)

    def rows(c: Chunk, refs: np.ndarray, level: int) -> pa.RecordBatch:
        at = pa.array(c.child[refs])
        field = fields.take(pa.array(c.field[refs]))
        cols = [c.lib.take(at), c.ver.take(at), c.fqn.take(at), field, c.target.take(pa.array(refs)), pa.array(np.full(len(refs), level), pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for c in chunks:
        outside = pc.is_in(c.target, value_set=known).to_numpy(zero_copy_only=False)
        refs, level = np.flatnonzero((c.parent < 0) & ~outside), 0
        inner = np.flatnonzero(c.parent >= 0)
        reached = np.zeros(len(c.group), dtype=bool)
        while len(refs):
            yield rows(c, refs, level)
            front = np.zeros(len(c.group), dtype=bool)
            front[c.child[refs]] = True
            reached |= front
            refs = inner[front[c.parent[inner]] & ~reached[c.child[inner]]]
            level += 1


def _distributed_rounds(types: DataFrame, known: DataFrame) -> DataFrame:
    """What :func:`_orphan_task` yields, by rounds of joins over edges of hashed names."""
    stages = Stages(types.sparkSession, "orphans")
    sid, node = fingerprint(F.col("lib"), F.col("ver")), lambda c: fingerprint(F.col(c))
    nodes = types.where("lib IS NOT NULL AND ver IS NOT NULL AND fqn IS NOT NULL").select(sid.alias("s"), node("fqn").alias("p"))
    inside = nodes.distinct().withColumn("inside", F.lit(True))
    refs = references(types).select(
        sid.alias("s"), node("fqn").alias("c"), node("target").alias("p"), "lib", "ver", "fqn", "ref_field", "target"
    )
    refs = stages.put(refs.join(inside, ["s", "p"], "left"), "refs")
    edges = refs.where("inside")
    direct = stages.put(refs.where("inside IS NULL").join(known, "target", "left_anti").select(refs.columns), "direct")
    cols = ["lib", "ver", "fqn", "ref_field", "target"]
    out = direct.select(*cols, F.lit(0).alias("level"))
    reached = frontier = stages.put(direct.select("s", F.col("c").alias("p")).distinct(), "frontier")
    level = 0
    while True:
        level += 1
        small = F.broadcast(frontier) if small_enough(frontier, BROADCAST_FRONTIER) else frontier
        hit = edges.join(small, ["s", "p"], "left_semi")
        hits = stages.put(hit.join(reached.select("s", F.col("p").alias("c")), ["s", "c"], "left_anti"), f"level{level}")
        if hits.isEmpty():
            return out
        out = out.unionByName(hits.select(*cols, F.lit(level).alias("level")))
        frontier = stages.put(hits.select("s", F.col("c").alias("p")).distinct(), "frontier")
        reached = stages.put(reached.unionByName(frontier), "reached")


def orphan_references(types: DataFrame, known: DataFrame, snapshots: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Direct and inherited orphans: ``lib, ver, fqn, ref_field, target, reason, level``.

    Level 0 are direct orphans, one row for each reference whose target is neither a type of its snapshot nor in
    ``known``. ``reason`` is deleted if a snapshot of the library taken earlier has the target, else later if one taken
    later has it, else missing. Level n > 0 are references inside a snapshot to a type that became an orphan at level
    n-1 (``reason`` is inherited); a type has the rows of the first level that reaches it.

    Repeated rows count once; blank references, null list elements and rows with a null key are no references; a
    snapshot that ``snapshots`` lacks is neither earlier nor later than another; empty tables give no rows. Snapshots of
    more than ``group_rows`` rows, and all of them where ``known`` is too large to send, take the distributed rounds.
    """
    sc = types.sparkSession.sparkContext
    k = known.where("fqn IS NOT NULL").select(F.col("fqn").alias("target")).distinct()
    if small_enough(k, BROADCAST_KNOWN):
        sent = sc.broadcast(k.toArrow()["target"].combine_chunks())
        small, large = split_large(types, group_rows)
        schema = "lib string, ver string, fqn string, ref_field string, target string, level int"
        found = by_chunk(small, lambda chunks: _orphan_task(chunks, sent.value), schema)
        if large is not None:
            found = found.unionByName(_distributed_rounds(large, k))
    else:
        found = _distributed_rounds(types, k)
    taken = (
        snapshots.where("state = 'DELIVERED' AND lib IS NOT NULL AND ver IS NOT NULL AND taken_at IS NOT NULL")
        .groupBy("lib", "ver")
        .agg(F.min("taken_at").alias("taken_at"))
    )
    taken = F.broadcast(taken) if small_enough(taken, BROADCAST_SNAPSHOTS) else taken
    spans = (
        types.where("fqn IS NOT NULL")
        .select("lib", "ver", F.col("fqn").alias("target"))
        .join(taken, ["lib", "ver"])
        .groupBy("lib", "target")
        .agg(F.min("taken_at").alias("first_at"), F.max("taken_at").alias("last_at"))
    )
    reason = (
        F.when(F.col("level") > 0, "inherited")
        .when(F.col("first_at") < F.col("taken_at"), "deleted")
        .when(F.col("last_at") > F.col("taken_at"), "later")
        .otherwise("missing")
    )
    return (
        found.join(taken, ["lib", "ver"], "left")
        .join(spans, ["lib", "target"], "left")
        .select("lib", "ver", "fqn", "ref_field", "target", reason.alias("reason"), "level")
    )


def orphan_report(orphans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Orphans by field and month of the snapshot: ``ref_field, period, reason, level, n_refs, n_types``."""
    taken = snapshots.where("state = 'DELIVERED'").groupBy("lib", "ver").agg(F.min("taken_at").alias("taken_at"))
    return (
        orphans.join(taken, ["lib", "ver"], "left")
        .groupBy("ref_field", F.date_format("taken_at", "yyyy-MM").alias("period"), "reason", "level")
        .agg(F.count("*").alias("n_refs"), F.countDistinct("lib", "ver", "fqn").alias("n_types"))
    )
