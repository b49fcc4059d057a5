"""Incremental rebuilding: which files changed, and a snapshot from the one before plus what changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evolvent.operators.declarations import latest_types
from evolvent.operators.snapshot_diff import field_fingerprint, fingerprint, list_key, method_fingerprint, set_key, snapshot_order, tps_key
from evolvent.session import Stages

#: What a type says of itself, with its file.
TYPE_VALUES = ("kind", "visibility", "modifiers", "super_ref", "interface_refs", "tps", "enclosing", "permitted", "annotations", "targets", "file")

FILE_VALUES = ("kind", "visibility", "super_ref", "line", "file")


def scan_files(spark: SparkSession, path: str, pattern: str = "*.java") -> DataFrame:
    """``path, hash, modified`` of the files below a folder; a file that cannot be read has a null hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    relative = relative_path(spark, path)
    return files.where(~F.col("path").endswith("/package-info.java")).select(relative.alias("path"), F.xxhash64("content").alias("hash"), F.col("modificationTime").alias("modified"))


def relative_path(spark: SparkSession, root: str) -> Column:
    """A file's ``path`` below ``root``: the qualified root is cut off by its length, whatever characters it holds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.makeQualified(p).toString().rstrip("/") + "/"
    # Listings write a local root with one slash or three.
    bare = F.regexp_replace("path", "^file:/+", "file:/")
    cut = re.sub("^file:/+", "file:/", whole)
    return F.when(F.startswith(bare, F.lit(cut)), F.substring(bare, len(cut) + 1, 1 << 30)).otherwise(F.col("path"))


def changed_files(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, status`` of files that are deleted, created or updated; a missing hash on either side counts as updated."""
    o, n = old.select(*keys, F.col("hash").alias("h1"), F.lit(True).alias("in_old")), new.select(*keys, F.col("hash").alias("h2"), F.lit(True).alias("in_new"))
    j = o.join(n, keys, "full_outer")
    same = F.coalesce(F.col("h1") == F.col("h2"), F.lit(False))
    status = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "created").when(~same, "updated")
    return j.select(*keys, status.alias("status")).where("status IS NOT NULL")


def changed_since(old: DataFrame, new: DataFrame, keys: list[str], since) -> DataFrame:
    """The same by modification time: a file in both listings is updated if it was modified after ``since``."""
    o, n = old.select(*keys, F.lit(True).alias("in_old")), new.select(*keys, "modified", F.lit(True).alias("in_new"))
    j = o.join(n, keys, "full_outer")
    status = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "created").when(F.col("modified") > since, "updated")
    return j.select(*keys, status.alias("status")).where("status IS NOT NULL")


def incremental_build(previous: DataFrame, parsed: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the previous snapshot whose file neither went nor changed, and the rows of new and changed files."""
    dropped = changes.where("status IN ('deleted', 'updated')").select(*keys)
    fresh = changes.where("status IN ('updated', 'created')").select(*keys)
    return previous.join(dropped, keys, "left_anti").unionByName(parsed.join(fresh, keys, "left_semi"))


def _values(types: DataFrame, change) -> DataFrame:
    """``types`` with the values of each annotation through ``change``."""
    return types.withColumn("annotations", F.transform("annotations", lambda a: F.struct(a["fqn"].alias("fqn"), change(a["values"]).alias("values"))))


def _declared_types(types: DataFrame) -> DataFrame:
    """The latest state of types that have a file; maps, which have no order, as sorted entries."""
    return latest_types(_values(types, lambda m: F.array_sort(F.map_entries(m))), *TYPE_VALUES).where("file IS NOT NULL")


def type_fingerprint():
    """A type by all that it says: not its file, line, origin and time of loading."""
    lists = [list_key(c, lambda r: F.coalesce(r, F.lit("\x04"))) for c in ("interface_refs", "permitted")]
    entries = lambda a: F.array_join(F.transform(a["values"], lambda e: F.concat(e["key"], F.lit("\x03"), F.coalesce(e["value"], F.lit("\x04")))), "\x02")
    annotations = list_key("annotations", lambda a: F.concat(F.coalesce(a["fqn"], F.lit("\x04")), F.lit("\x05"), F.coalesce(entries(a), F.lit(""))))
    own = [F.col(c) for c in ("fqn", "kind", "visibility", "super_ref", "enclosing")]
    return fingerprint(F.lit("type"), *own, set_key("modifiers"), *lists, tps_key("tps"), annotations, set_key("targets"))


def snapshot_files(types: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of each snapshot as the older, as the newer side of a pair): ``lib, ver, file, hash``, ver the newer.

    A file's hash is the XOR of the hashes of the declarations that name it, by name, kind, visibility and superclass
    alone, as the SQL of the query ``changed_files`` has it; :func:`declaration_files` hashes all that is declared.
    """
    t = latest_types(types, *FILE_VALUES).where("file IS NOT NULL")
    line = F.concat_ws("|", "fqn", F.coalesce("kind", F.lit("~")), F.coalesce("visibility", F.lit("~")), F.coalesce("super_ref", F.lit("~")))
    files = t.groupBy("lib", "ver", "file").agg(F.bit_xor(F.xxhash64(line)).alias("hash"))
    order = snapshot_order(snapshots)
    f = files.join(order, ["lib", "ver"])
    old = f.where("next_ver IS NOT NULL").select("lib", F.col("next_ver").alias("ver"), "file", "hash")
    return old, f.where("seq > 1").select("lib", "ver", "file", "hash")


def declaration_files(types: DataFrame, execs: DataFrame, fields: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as :func:`snapshot_files`, a file's hash being of all that its types and their members say.

    Lines, ``origin`` and ``loaded_at`` do not count, nor do the names of parameters; lists that are sets are compared
    as such, null and empty lists are equal. Repeated members count once.
    """
    t = _declared_types(types).select("lib", "ver", "fqn", "file", type_fingerprint().alias("h"))
    members = [
        d.where(F.col("owner").isNotNull()).select("lib", "ver", F.col("owner").alias("fqn"), h.alias("m"))
        for d, h in ((execs, method_fingerprint()), (fields, field_fingerprint()))
    ]
    held = members[0].unionByName(members[1]).distinct().groupBy("lib", "ver", "fqn").agg(F.bit_xor("m").alias("m"))
    whole = t.join(held, ["lib", "ver", "fqn"], "left").select("lib", "ver", "file", fingerprint(F.col("h"), F.coalesce("m", F.lit(0).cast("long"))).alias("h"))
    f = whole.groupBy("lib", "ver", "file").agg(F.bit_xor("h").alias("hash")).join(snapshot_order(snapshots), ["lib", "ver"])
    old = f.where("next_ver IS NOT NULL").select("lib", F.col("next_ver").alias("ver"), "file", "hash")
    return old, f.where("seq > 1").select("lib", "ver", "file", "hash")


def _rebuilt(rows: DataFrame, changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``rows`` (with ``lib, ver, file``) of each newer snapshot, from the older one's and those of changed files."""
    r = rows.join(snapshot_order(snapshots), ["lib", "ver"])
    cols = [c for c in rows.columns if c not in ("lib", "ver")]
    previous = r.where("next_ver IS NOT NULL").select("lib", F.col("next_ver").alias("ver"), *cols)
    return incremental_build(previous, r.where("seq > 1").select("lib", "ver", *cols), changes, ["lib", "ver", "file"])


def rebuilt_types(types: DataFrame, execs: DataFrame, fields: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each newer snapshot's types with all their columns, built from the older snapshot and the changed files."""
    changes = changed_files(*declaration_files(types, execs, fields, snapshots), ["lib", "ver", "file"])
    return _values(_rebuilt(_declared_types(types), changes, snapshots), F.map_from_entries)


def rebuilt_members(types: DataFrame, execs: DataFrame, fields: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(methods, fields) of each newer snapshot's types, built in the same way, distinct.

    A member goes with the file of its owner. Lines and a field's own ``file`` are left out, as they do not count.
    """
    changes = changed_files(*declaration_files(types, execs, fields, snapshots), ["lib", "ver", "file"])
    of = latest_types(types, "file").where("file IS NOT NULL").withColumnRenamed("fqn", "owner")
    rows = (d.drop("line", "file", "org").join(of, ["lib", "ver", "owner"]) for d in (execs, fields))
    methods, members = (_rebuilt(r, changes, snapshots).drop("file").distinct() for r in rows)
    return methods, members


def incremental_sources(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decoded types of ``old``, those of ``new``, changed files): of the newer tree only new and changed files are decoded.

    What the other files declare is taken over from the older tree. Both results have the schema of ``scan_sources``.
    """
    from evolvent.sources.javasource import scan_sources

    changes = changed_files(scan_files(spark, old), scan_files(spark, new), ["path"])
    stages = Stages(spark, "incremental")
    changes = stages.put(changes, "changes")
    before = stages.put(scan_sources(spark, old).withColumn("at", relative_path(spark, old)), "old")
    dropped = changes.where("status IN ('deleted', 'updated')").select(F.col("path").alias("at"))
    kept = before.join(dropped, "at", "left_anti")
    fresh = changes.where("status IN ('created', 'updated')").select("path")
    parsed = scan_sources(spark, new, only=fresh, more=kept.where("type IS NOT NULL").select("type.fqn"))
    return before.drop("at"), kept.drop("at").unionByName(parsed), changes
