"""The reference graphs of many snapshots at once, in one task.

Declarations are exchanged once, by snapshot, and reach Python as Arrow batches in which the rows of a snapshot stand
together. Whole snapshots are gathered to chunks of some 50 000 rows whose names become dense numbers, so that graph
algorithms run as array operations over all snapshots of a chunk in step. A snapshot of more than ``GROUP_ROWS`` rows
is not gathered in a task: :func:`split_large` hands it to the distributed form of an operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolvent.operators.declarations import REF_FIELDS, references

#: Raw rows of one snapshot up to which it is processed in a task.
GROUP_ROWS = 5_000
#: Rows at which a chunk of whole snapshots is processed.
CHUNK_ROWS = 50_000


def split_large(types: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of snapshots of at most ``limit`` rows, rows of all others or None if there are none)."""
    large = types.groupBy("lib", "ver").count().where(F.col("count") > limit).select("lib", "ver")
    if large.isEmpty():
        return types, None
    return types.join(large, ["lib", "ver"], "left_anti"), types.join(large, ["lib", "ver"], "left_semi")


@dataclass
class Chunk:
    """Snapshots of a chunk: ``node``-indexed ``lib, ver, fqn`` and reference arrays ``child, field, parent, target``.

    ``parent`` is the node that a reference names in its own snapshot, or -1; ``field`` is an index into the names of the
    reference fields. ``of_node`` and ``of_ref`` hold further columns by node and by reference.
    """

    lib: pa.Array
    ver: pa.Array
    fqn: pa.Array
    group: np.ndarray
    child: np.ndarray
    field: np.ndarray
    parent: np.ndarray
    target: pa.Array
    of_node: dict[str, pa.Array] = attribute(default_factory=dict)
    of_ref: dict[str, pa.Array] = attribute(default_factory=dict)


def _chunk(t: pa.Table, fields: tuple[str, ...], node_cols: tuple[str, ...], ref_cols: tuple[str, ...]) -> Chunk:
    def col(name: str) -> pa.Array:
        c = t[name].combine_chunks()
        return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c

    lib, ver, fqn = col("lib"), col("ver"), col("fqn")
    n = len(lib)
    new = np.ones(n, dtype=bool)
    if n > 1:
        same = pc.and_(pc.equal(lib[1:], lib[:-1]), pc.equal(ver[1:], ver[:-1]))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    gid = np.cumsum(new) - 1
    g = pa.array(gid).cast(pa.string())
    keys = pc.binary_join_element_wise(g, fqn, "\x00").dictionary_encode()
    child = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.unique(child, return_index=True)[1]
    at = pa.array(first)
    ref_field = col("ref_field")
    has = pc.is_valid(ref_field)
    target = col("target").filter(has)
    where = pc.index_in(pc.binary_join_element_wise(g.filter(has), target, "\x00"), value_set=keys.dictionary)
    parent = pc.fill_null(where, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    field = pc.index_in(ref_field.filter(has), value_set=pa.array(fields)).to_numpy(zero_copy_only=False)
    own = {c: col(c).take(at) for c in node_cols}
    held = {c: col(c).filter(has) for c in ref_cols}
    child = child[has.to_numpy(zero_copy_only=False)]
    return Chunk(lib.take(at), ver.take(at), fqn.take(at), gid[first], child, field, parent, target, own, held)


def chunks(
    batches: Iterator[pa.RecordBatch], fields: tuple[str, ...] = REF_FIELDS, node_cols: tuple[str, ...] = (), ref_cols: tuple[str, ...] = ()
) -> Iterator[Chunk]:
    """Chunks of whole snapshots from batches sorted by (lib, ver)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < CHUNK_ROWS or not b.num_rows:
            continue
        t = pa.Table.from_batches(held)
        lib, ver = t["lib"], t["ver"]
        last = pc.and_(pc.equal(lib, lib[n - 1]), pc.equal(ver, ver[n - 1])).to_numpy()
        cut = int(np.argmax(last))  # where the last snapshot, which may go on, begins
        if cut:
            yield _chunk(t.slice(0, cut), fields, node_cols, ref_cols)
            held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield _chunk(pa.Table.from_batches(held), fields, node_cols, ref_cols)


def by_chunk(types: DataFrame, task: Callable[[Iterator[Chunk]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``task`` over the reference graphs of all snapshots of ``types``, after one exchange by snapshot."""
    placed = types.repartition("lib", "ver")
    rows = references(placed, keep_empty=True).sortWithinPartitions("lib", "ver")
    return rows.mapInArrow(lambda batches: task(chunks(batches)), schema)
