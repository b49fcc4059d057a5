"""What changed between full snapshots.

An index maps every key of a snapshot to a fingerprint of its values; the index of the last snapshot is probed with the
keys of the next one, and the newer index takes its place. Over a history of snapshots the same is done in one pass:
the entries of all snapshots are bucketed by key, with one exchange of 24-byte entries, and the task that holds a bucket
keeps its index of the last snapshot, probes it with the next snapshot's entries and swaps, snapshot by snapshot.
:class:`SnapshotIndex` is the durable form for snapshots that arrive one at a time, and :func:`changed_values` fetches
old and new values, for changed keys only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evolvent.session import ship_package, small_enough

#: Entries of one hash bucket beyond which the bucket is pre-aggregated before the exchange by key.
HOT_BUCKET_ROWS = 2_000_000
#: Hash buckets of the histogram that finds hot ones; it bounds what reaches the driver.
BUCKETS = 4096
#: Snapshots up to which the snapshot list is broadcast; beyond that it is joined by exchange.
BROADCAST_SNAPSHOTS = 100_000


def set_key(col: str) -> Column:
    """A list read as a set: sorted, without repeats or null elements; null counts as empty."""
    return F.array_join(F.sort_array(F.array_distinct(F.coalesce(F.col(col), F.array().cast("array<string>")))), "\x01")


def list_key(col: str, item) -> Column:
    """A list in its order, each element through ``item``; null counts as empty."""
    return F.coalesce(F.array_join(F.transform(col, item), "\x01"), F.lit(""))


def tps_key(col: str) -> Column:
    """Formal type parameters in their order; null counts as empty for the list and for its bounds."""
    return list_key(
        col,
        lambda t: F.concat(
            F.coalesce(t["name"], F.lit("\x04")),
            F.lit("\x03"),
            F.coalesce(F.array_join(t["bounds"], "\x02", "\x04"), F.lit("")),
        ),
    )


def fingerprint(*cols: Column) -> Column:
    """64-bit hash of values in their places: a number between two values keeps nulls and shifted values apart."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        parts += [F.lit(i), c]
    return F.xxhash64(*parts)


def method_fingerprint() -> Column:
    """A method by all that counts: not its line and not the names of its parameters."""
    return fingerprint(
        F.lit("method"),
        F.col("name"),
        F.col("exec_kind"),
        F.col("visibility"),
        set_key("modifiers"),
        F.col("return_ref"),
        list_key(
            "params",
            lambda p: F.concat(
                F.coalesce(p["ref"], F.lit("\x04")), F.lit("\x03"), F.coalesce(p["varargs"].cast("string"), F.lit(""))
            ),
        ),
        tps_key("tps"),
        set_key("thrown"),
        F.col("has_default"),
    )


def field_fingerprint() -> Column:
    """A field by all that counts: not its file and line."""
    return fingerprint(
        F.lit("field"), F.col("name"), F.col("visibility"), set_key("modifiers"), F.col("type_ref"), F.col("is_const")
    )


def key_hash(*names: str) -> Column:
    return fingerprint(*[F.col(n) for n in names])


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """``lib, ver, seq, next_ver`` of the delivered snapshots, ``seq`` from 1 by ``taken_at`` within a library.

    Repeated rows count once (the earliest ``taken_at``); rows without lib, ver or taken_at are no snapshots; equal
    times are ordered by ``ver``.
    """
    s = (
        snapshots.where("state = 'DELIVERED' AND lib IS NOT NULL AND ver IS NOT NULL AND taken_at IS NOT NULL")
        .groupBy("lib", "ver")
        .agg(F.min("taken_at").alias("taken_at"))
    )
    w = Window.partitionBy("lib").orderBy("taken_at", "ver")
    return s.select("lib", "ver", F.row_number().over(w).alias("seq"), F.lead("ver").over(w).alias("next_ver"))


def hot_buckets(frames: Sequence[DataFrame], max_rows: int) -> list[int]:
    """Hash buckets of column ``k`` with more than ``max_rows`` rows over all frames (at most ``BUCKETS`` counts)."""
    total: dict[int, int] = {}
    for f in frames:
        for r in f.groupBy(F.pmod("k", F.lit(BUCKETS)).alias("b")).count().collect():
            total[r["b"]] = total.get(r["b"], 0) + r["count"]
    return sorted(b for b, n in total.items() if n > max_rows)


def snapshot_index(
    snapshots: DataFrame,
    types: DataFrame,
    members: Sequence[tuple[DataFrame, str, Column]],
    hot_rows: int = HOT_BUCKET_ROWS,
) -> DataFrame:
    """The key-to-fingerprint index of every delivered snapshot, bucketed by ``k``.

    Columns ``k, lib, fqn, ver, next_ver, seq`` and one fingerprint ``h0, h1, ...`` for each member table: the XOR of
    the fingerprints of its distinct rows, 0 for none. ``members`` are (frame, owner column, row fingerprint).

    Keys are matched by 128 bits (library+key, library+version) and sets compared by 64. A bucket that holds more than
    ``hot_rows`` rows is made distinct and summed up on its own, evenly spread exchange before it joins the rest.
    """
    n = len(members)
    ship_package(types.sparkSession)
    order = snapshot_order(snapshots)
    t = types.where("fqn IS NOT NULL AND lib IS NOT NULL AND ver IS NOT NULL").select("lib", "ver", "fqn")
    order = F.broadcast(order) if small_enough(order, BROADCAST_SNAPSHOTS) else order
    t = t.join(order, ["lib", "ver"]).select(
        key_hash("lib", "fqn").alias("k"), key_hash("lib", "ver").alias("sid"), "lib", "fqn", "ver", "next_ver", "seq"
    )
    zero = F.lit(0).cast("long")
    rows = []
    for i, (df, owner, h) in enumerate(members):
        keyed = df.where(F.col(owner).isNotNull() & F.col("lib").isNotNull() & F.col("ver").isNotNull())
        rows.append(
            keyed.select(
                key_hash("lib", owner).alias("k"),
                key_hash("lib", "ver").alias("sid"),
                *[(h if j == i else zero).alias(f"h{j}") for j in range(n)],
            )
        )
    hs = [f"h{i}" for i in range(n)]
    hot = hot_buckets([t.select("k"), *(r.select("k") for r in rows)], hot_rows)
    parts = []
    is_hot = F.pmod("k", F.lit(BUCKETS)).isin(hot)
    for r in rows:
        if hot:
            parts.append(r.where(~is_hot))
            spread = r.where(is_hot).distinct()
            parts.append(spread.groupBy("k", "sid").agg(*[F.bit_xor(h).alias(h) for h in hs]))
        else:
            parts.append(r)
    parts.append(t.where(~is_hot) if hot else t)
    if hot:
        parts.append(t.where(is_hot).distinct())
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    u = u.withColumns({h: F.coalesce(h, zero) for h in hs})
    # One exchange by k; distinct, the XOR by snapshot and the probing window all keep it.
    u = u.repartition("k").groupBy("k", "sid", "lib", "fqn", "ver", "next_ver", "seq", *hs).agg(F.lit(1).alias("one"))
    whole = u.groupBy("k", "sid").agg(
        *[F.max(c).alias(c) for c in ("lib", "fqn", "ver", "next_ver", "seq")], *[F.bit_xor(h).alias(h) for h in hs]
    )
    return whole.where("fqn IS NOT NULL").drop("sid")


#: Entries at which a chunk of the index entries of whole libraries is probed.
CHUNK_ROWS = 100_000


def _probe_chunk(t: pa.Table, hashes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Changes within a chunk of entries of whole libraries, one step for each snapshot, all libraries in step.

    ``last`` is the index: for each key the place of its entry of the last snapshot, -1 if it had none. A step probes it
    with the keys of the next snapshots and puts their entries in the place of the old ones.
    """
    t = t.combine_chunks()
    n = t.num_rows
    key = pc.binary_join_element_wise(t["lib"], t["fqn"], "\x00").combine_chunks().dictionary_encode()
    ids = key.indices.to_numpy(zero_copy_only=False)
    seq = t["seq"].to_numpy()
    values = [t[h].to_numpy() for h in hashes]
    order = np.argsort(seq, kind="stable")
    cuts = np.flatnonzero(np.diff(seq[order])) + 1
    last = np.full(len(key.dictionary), -1, dtype=np.int64)
    added, changed, kept = [], [], np.zeros(n, dtype=bool)
    before = np.full(n, -1, dtype=np.int64)
    for rows in np.split(order, cuts):
        s = seq[rows[0]] if len(rows) else 1
        old = last[ids[rows]]
        # An entry counts only if it is of the snapshot just before: a library may have had none of its keys there.
        hit = (old >= 0) & (seq[np.where(old >= 0, old, 0)] == s - 1)
        kept[old[hit]] = True
        before[rows[hit]] = old[hit]
        if s > 1:
            added.append(rows[~hit])
        changed.append(rows[hit])
        last[ids[rows]] = rows
    none = np.empty(0, dtype=np.int64)
    new = np.concatenate([none, *added])
    both = np.concatenate([none, *changed])
    differ = [v[both] != v[before[both]] for v in values]
    what = np.array([""] * len(both), dtype=object)
    for h, d in zip(hashes, differ):
        what[d] = what[d] + np.where(what[d] == "", h, "," + h) if d.any() else what[d]
    some = np.logical_or.reduce(differ) if differ else np.zeros(len(both), dtype=bool)
    gone = np.flatnonzero(~kept & pc.is_valid(t["next_ver"]).to_numpy())
    for rows, ver, change, told, shift in ((new, "ver", "added", None, 1), (both[some], "ver", "changed", what[some], 1), (gone, "next_ver", "removed", None, 0)):
        at = pa.array(rows)
        told = pa.array([""] * len(rows) if told is None else told.tolist(), pa.string())
        cols = [t["lib"].take(at), t[ver].take(at), t["fqn"].take(at), pa.array([change] * len(rows), pa.string()), told, pa.array((seq[rows] - shift).astype(np.int32))]
        yield from pa.table(cols, names=["lib", "ver", "fqn", "change", "what", "old_seq"]).to_batches()


def _probe_task(batches: Iterator[pa.RecordBatch], hashes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """:func:`_probe_chunk` over chunks of whole libraries, from entries sorted by library."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < CHUNK_ROWS or not b.num_rows:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.argmax(pc.equal(t["lib"], t["lib"][n - 1]).to_numpy()))  # where the last library, which may go on, begins
        if cut:
            yield from _probe_chunk(t.slice(0, cut), hashes)
            held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield from _probe_chunk(pa.Table.from_batches(held), hashes)


def probe(index: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """Changes between each snapshot in the index and the next: ``lib, ver, fqn, change, what, old_seq``.

    ``change`` is added, removed or changed; ``ver`` is the newer snapshot, ``old_seq`` the place of the older one.
    ``what`` names the fingerprints that differ. The entries stay in the bucket of their key: a task holds the index of
    the last snapshot for its buckets, probes it with the next snapshot's entries and swaps, snapshot by snapshot.
    """
    hashes = tuple(hashes)
    rows = index.select("lib", "fqn", "ver", "next_ver", "seq", *hashes).sortWithinPartitions("lib")
    return rows.mapInArrow(lambda it: _probe_task(it, hashes), "lib string, ver string, fqn string, change string, what string, old_seq int")


def snapshot_changes(
    snapshots: DataFrame, types: DataFrame, execs: DataFrame, fields: DataFrame, hot_rows: int = HOT_BUCKET_ROWS
) -> DataFrame:
    """Types added, removed or changed between consecutive delivered snapshots of each library.

    A type changed if the set of its methods (``h0``; constructors left out) or of its fields (``h1``) differs; see
    :func:`method_fingerprint` and :func:`field_fingerprint` for what counts. Repeated rows count once; types and
    members without key columns are skipped; empty tables give no rows; further columns are ignored.
    """
    methods = execs.where("exec_kind IS NULL OR exec_kind <> 'CONSTRUCTOR'")
    index = snapshot_index(
        snapshots, types, [(methods, "owner", method_fingerprint()), (fields, "owner", field_fingerprint())], hot_rows
    )
    return probe(index, ["h0", "h1"])


def changed_values(
    changes: DataFrame, snapshots: DataFrame, members: DataFrame, owner: str, h: Column, show: Column
) -> DataFrame:
    """Old and new member values of the changed keys only: ``lib, ver, fqn, side, value``.

    ``side`` is old or new; a value that both sides have is left out. Nothing but the rows of changed keys is moved
    beyond the semi-join.
    """
    order = snapshot_order(snapshots)
    names = order.select("lib", F.col("seq").alias("old_seq"), F.col("ver").alias("old_ver"))
    c = changes.where("change = 'changed'").join(names, ["lib", "old_seq"]).select("lib", "ver", "old_ver", "fqn")
    sides = c.select(
        "lib",
        "fqn",
        "ver",
        F.explode(
            F.array(
                F.struct(F.lit("old").alias("side"), F.col("old_ver").alias("at")),
                F.struct(F.lit("new").alias("side"), F.col("ver").alias("at")),
            )
        ).alias("s"),
    ).select("lib", "fqn", "ver", "s.side", "s.at")
    m = members.select("lib", F.col("ver").alias("at"), F.col(owner).alias("fqn"), h.alias("h"), show.alias("value"))
    rows = sides.join(m, ["lib", "at", "fqn"]).groupBy("lib", "ver", "fqn", "side", "h").agg(F.min("value").alias("value"))
    both = rows.groupBy("lib", "ver", "fqn", "h").agg(
        F.count("*").alias("n"), F.min("side").alias("side"), F.min("value").alias("value")
    )
    return both.where("n = 1").select("lib", "ver", "fqn", "side", "value")


class SnapshotIndex:
    """The index of the last snapshot, kept as a table bucketed by key, for snapshots that arrive one by one.

    ``advance`` writes the next snapshot's index beside the old one, probes the old one with it bucket by bucket (both are
    bucketed by key, so neither moves), writes the changes, and only then swaps: one rename puts the new pointer in the
    place of the old one. A run that is lost before the swap leaves the old index in force and is repeated with the same
    ``step``: it writes the same changes over what it left. A step that is already in force is not done again.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> dict | None:
        """``index, step, schema`` of the index in force."""
        p, fs = self._path("CURRENT")
        if not fs.exists(p):
            return None
        s = fs.open(p)
        try:
            return json.loads(s.readUTF())
        finally:
            s.close()

    def _table(self, name: str, schema: str) -> DataFrame:
        """An index as a table that knows its buckets."""
        t = f"`{name.replace('-', '_')}`"
        clustered = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {t} ({schema}) USING parquet CLUSTERED BY ({clustered}) SORTED BY ({clustered}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'"
        )
        return self.spark.table(t)

    def current(self) -> DataFrame | None:
        at = self.pointer()
        return None if at is None else self._table(at["index"], at["schema"])

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{name.replace('-', '_')}`")
        p, fs = self._path(name)
        fs.delete(p, True)

    def write(self, rows: DataFrame, h: Column) -> tuple[str, str]:
        """(name, schema) of a new index of ``rows``: a key's fingerprint is the XOR over its distinct rows."""
        ok = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        new = ok.select(*self.keys, h.alias("h")).distinct().groupBy(*self.keys).agg(F.bit_xor("h").alias("h"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        name = f"index-{uuid.uuid4().hex[:12]}"
        placed = new.repartition(self.buckets, *self.keys)
        placed.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name.replace("-", "_"))
        return name, schema

    def changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The keys that differ, with ``change``, ``old_h`` and ``new_h``."""
        j = old.withColumnRenamed("h", "old_h").join(new.withColumnRenamed("h", "new_h"), self.keys, "full_outer")
        change = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").otherwise("changed")
        return j.where(~F.col("old_h").eqNullSafe(F.col("new_h"))).select(*self.keys, change.alias("change"), "old_h", "new_h")

    def swap(self, name: str, schema: str, step: str) -> None:
        """Put an index in force, by one rename over the pointer; the index before it is removed."""
        was = self.pointer()
        jvm = self.spark.sparkContext._jvm
        tmp, fs = self._path(f"CURRENT-{name}")
        s = fs.create(tmp, True)
        s.writeUTF(json.dumps({"index": name, "step": step, "schema": schema}))
        s.close()
        over = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(over, 1)
        jvm.java.lang.reflect.Array.set(options, 0, over.getEnumConstants()[1])
        to, _ = self._path("CURRENT")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, to, options)
        if was is not None and was["index"] != name:
            self._drop(was["index"])

    def advance(self, rows: DataFrame, h: Column, out: str, step: str, extra: dict[str, Column] | None = None) -> DataFrame:
        """Changes of ``rows`` against the last snapshot, written to ``out/step=<step>`` before the indexes are swapped.

        Returns them as read back: the keys, ``change``, ``old_h`` and ``new_h``, and the ``extra`` columns. The first
        snapshot gives no changes. Rows with a null key are skipped.
        """
        path = f"{out.rstrip('/')}/step={step}"
        at = self.pointer()
        if at is None or at["step"] != step:
            name, schema = self.write(rows, h)
            fresh = self._table(name, schema)
            last = self.current()
            found = self.changes(fresh if last is None else last, fresh).withColumns(extra or {})
            found.write.mode("overwrite").parquet(path)
            self.swap(name, schema, step)
        return self.spark.read.parquet(path)
