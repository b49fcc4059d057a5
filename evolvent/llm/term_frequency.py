"""How often every distinct term occurs, and in how many groups of records.

Terms are counted by recursive radix partitioning. The first level is Spark's exchange, by hash bits of term and group
together, so that a term which makes up a third of all rows still spreads evenly; map-side combination has then
already made one row of each (term, group). Within a task the rows are spilled to files by hash bits of the term; a
file that is still too large is split by the next bits, and one that bits can no longer split (a single hot term) is
aggregated in bounded blocks. DuckDB aggregates each file out of core. Partial counts of a term add up, because no
(term, group) is in two tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolvent.session import shared_dir

#: Hash bits used up by each level of spilling.
RADIX_BITS = 4
#: Rows that one DuckDB aggregation takes at most; a spill file with more is split further.
SPILL_ROWS = 2_000_000
#: Rows a task holds before it spills.
HOLD_ROWS = 500_000
DUCKDB_MEMORY = "256MB"


def terms_of(value: Column, separators: str = "[;|,]") -> Column:
    """The terms of a cell: its pieces in upper case, runs of other characters than A-Z and 0-9 made one ``_``, no outer
    ``_``, empty pieces left out."""
    pieces = F.transform(
        F.split(value, separators), lambda p: F.btrim(F.regexp_replace(F.upper(p), "[^A-Z0-9]+", "_"), F.lit("_"))
    )
    return F.filter(pieces, lambda p: p != "")


#: Hadoop's names of object stores by those of Arrow. Fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def shared_filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of the shared folder as a task sees them, whichever of its names the store is called by."""
    scheme, colon, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}" if colon else uri)


class _Spill:
    """Files of one level, one for each value of the next hash bits, in the shared folder."""

    def __init__(self, fs: pyarrow.fs.FileSystem, root: str, shift: int):
        self.fs, self.root, self.shift = fs, root, shift
        self.writers: dict[int, pq.ParquetWriter] = {}
        self.rows: dict[int, int] = {}
        fs.create_dir(root, recursive=True)

    def add(self, t: pa.Table) -> None:
        mask = (1 << RADIX_BITS) - 1
        bits = pc.bit_wise_and(pc.shift_right(t["th"].cast(pa.uint64(), safe=False), pa.scalar(self.shift, pa.uint64())), pa.scalar(mask, pa.uint64()))
        for b in pc.unique(bits).to_pylist():
            part = t.filter(pc.equal(bits, pa.scalar(b, pa.uint64())))
            if b not in self.writers:
                self.writers[b] = pq.ParquetWriter(f"{self.root}/{b}.parquet", t.schema, filesystem=self.fs)
                self.rows[b] = 0
            self.writers[b].write_table(part)
            self.rows[b] += part.num_rows

    def close(self) -> None:
        for w in self.writers.values():
            w.close()

    def read(self, b: int) -> Iterator[pa.Table]:
        with self.fs.open_input_file(f"{self.root}/{b}.parquet") as f:
            for batch in pq.ParquetFile(f).iter_batches(HOLD_ROWS):
                yield pa.Table.from_batches([batch])


def _duckdb_sums(t: pa.Table, scratch: str | None) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY} | ({"temp_directory": scratch} if scratch else {}))
    try:
        con.register("t", t)
        out = con.sql(
            "SELECT th, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS g FROM t GROUP BY th, term"
        ).to_arrow_table()
    finally:
        con.close()
    return out


def _aggregate(tables: Iterator[pa.Table], rows: int, fs, root: str, shift: int, scratch: str | None, limit: int) -> Iterator[pa.Table]:
    """Sums of ``n`` and ``g`` by term, over tables of ``rows`` rows in all, spilled by the bits at ``shift`` if too many."""
    if rows <= limit:
        held = list(tables)
        if held:
            yield _duckdb_sums(pa.concat_tables(held), scratch)
        return
    if shift < 0:  # all hash bits used: one term, or next to; blocks give partial sums of it
        for t in tables:
            yield _duckdb_sums(t, scratch)
        return
    level = _Spill(fs, f"{root}/{shift}-{uuid.uuid4().hex[:8]}", shift)
    try:
        for t in tables:
            level.add(_duckdb_sums(t, scratch))  # a term has one row of a block, so one hot term does not fill its file
        level.close()
        for b, n in sorted(level.rows.items()):
            yield from _aggregate(level.read(b), n, fs, f"{root}/{b}", shift - RADIX_BITS, scratch, limit)
    finally:
        fs.delete_dir(level.root)


def _task(batches: Iterator[pa.RecordBatch], uri: str, limit: int, hold: int) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows by term. The shared folder is opened only by a task that holds more than ``hold`` rows."""
    held: list[pa.RecordBatch] = []
    n, spill, fs, root, scratch = 0, None, None, "", None
    top = 64 - RADIX_BITS
    try:
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > hold:
                if spill is None:
                    fs, base = shared_filesystem(uri)
                    root = f"{base}/terms-{uuid.uuid4().hex}"
                    # Elsewhere DuckDB keeps to memory: what it sums at once is at most a file of ``limit`` rows.
                    scratch = f"{root}/duckdb" if isinstance(fs, pyarrow.fs.LocalFileSystem) else None
                    spill = _Spill(fs, f"{root}/top", top)
                spill.add(_duckdb_sums(pa.Table.from_batches(held), scratch))
                held, n = [], 0
        if spill is None:
            outs = iter([_duckdb_sums(pa.Table.from_batches(held), scratch)] if held else [])
        else:
            if held:
                spill.add(_duckdb_sums(pa.Table.from_batches(held), scratch))
            spill.close()
            outs = (
                o
                for b, rows in sorted(spill.rows.items())
                for o in _aggregate(spill.read(b), rows, fs, f"{root}/{b}", top - RADIX_BITS, scratch, limit)
            )
        for o in outs:
            yield from o.select(["term", "n", "g"]).cast(pa.schema([("term", pa.string()), ("n", pa.int64()), ("g", pa.int64())])).to_batches()
    finally:
        if fs is not None and fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(root)


def term_frequency(
    records: DataFrame,
    id_col: str,
    group_col: str,
    value_col: str,
    version_col: str | None = None,
    rare_groups: int = 2,
    common_share: float = 0.5,
    spill_rows: int = SPILL_ROWS,
    hold_rows: int = HOLD_ROWS,
) -> DataFrame:
    """``term, n_occurrences, n_groups, mark`` of every term of ``value_col``.

    Rows of one id count once (the one with the greatest ``version_col``, then group and value); rows without an id are
    told apart by their values. ``mark`` is rare if the term is in at most ``rare_groups`` groups, else common if in
    more than ``common_share`` of all distinct groups of the table, else null. A null group is none; null, empty and
    blank values have no terms; an empty table gives no rows; further columns are ignored.
    """
    spark = records.sparkSession
    version = [version_col] if version_col else []
    best = F.max(F.struct(*version, F.col(group_col).alias("g"), F.col(value_col).alias("v"))).alias("m")
    unnamed = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(0), group_col, F.lit(1), value_col))
    one = records.groupBy(F.col(id_col).alias("id"), unnamed.alias("u")).agg(best).select("m.g", "m.v")
    pairs = (
        one.select("g", F.explode(terms_of(F.col("v"))).alias("term"))
        .groupBy("term", "g")
        .agg(F.count("*").alias("n"))
        .select(F.xxhash64("term").alias("th"), "term", "n", F.col("g").isNotNull().cast("long").alias("g"))
    )
    uri = shared_dir(spark)
    partial = pairs.mapInArrow(lambda it: _task(it, uri, spill_rows, hold_rows), "term string, n bigint, g bigint")
    sums = partial.groupBy("term").agg(F.sum("n").alias("n_occurrences"), F.sum("g").alias("n_groups"))
    groups = records.select(group_col).where(F.col(group_col).isNotNull()).distinct().count()
    mark = F.when(F.col("n_groups") <= rare_groups, "rare").when(F.col("n_groups") > common_share * groups, "common")
    return sums.withColumn("mark", mark)
