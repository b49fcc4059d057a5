"""Snapshots that arrive as files: a stream over a folder that advances the snapshot index snapshot by snapshot.

An extension: the batch operators have no notion of time. The rows of a snapshot may arrive in any number of files and
micro-batches: they wait in ``pending`` until a later snapshot has begun, and are then taken whole, in the order of
``seq_col``. Every step can be repeated: a micro-batch writes its rows under its own number, and the index is swapped
only after its changes are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evolvent.operators.snapshot_diff import SnapshotIndex


class SnapshotStream:
    """Changes of each snapshot that appears below ``source`` (Parquet), written below ``out_dir`` with its ``seq_col``.

    A snapshot is complete once a later one has begun; :meth:`close` says that the last one is complete too. Rows of a
    snapshot that is already in force come too late and stay in ``pending``.
    """

    def __init__(
        self, spark: SparkSession, source: str, schema: StructType | str, index_dir: str, out_dir: str, checkpoint: str, keys: Sequence[str], h: Column, seq_col: str
    ):
        self.spark, self.source, self.schema, self.out, self.checkpoint, self.h, self.seq = spark, source, schema, out_dir.rstrip("/"), checkpoint, h, seq_col
        self.index = SnapshotIndex(spark, index_dir, keys)
        self.pending_dir = f"{index_dir.rstrip('/')}/pending"

    def _pending(self) -> DataFrame:
        return self.spark.read.option("basePath", self.pending_dir).parquet(f"{self.pending_dir}/batch=*")

    def _take(self, all_of_them: bool) -> None:
        """Advance the index by every pending snapshot that is complete."""
        at = self.index.pointer()
        rows = self._pending()
        done = F.lit(True) if at is None else F.col(self.seq) > F.lit(at["step"]).cast(rows.schema[self.seq].dataType)
        waiting = sorted(r[0] for r in rows.where(done).select(self.seq).distinct().collect())  # snapshots not yet taken: a handful
        for n in waiting if all_of_them else waiting[:-1]:
            self.index.advance(rows.where(F.col(self.seq) == n).drop("batch"), self.h, self.out, str(n), {self.seq: F.lit(n)})

    def _batch(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.pending_dir}/batch={number}")
        if not df.isEmpty():
            self._take(False)

    def start(self) -> StreamingQuery:
        """Take all files that are present; the last snapshot waits for a later one or for :meth:`close`."""
        files = self.spark.readStream.schema(self.schema).parquet(self.source)
        return files.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def close(self) -> None:
        self._take(True)

    def changes(self) -> DataFrame:
        return self.spark.read.option("basePath", self.out).parquet(f"{self.out}/step=*").drop("step")


def windowed_findings(spark: SparkSession, source: str, schema: StructType | str, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """Findings per week and library as they arrive, late ones up to ``late``: an event-time aggregate for a sink."""
    f = spark.readStream.schema(schema).parquet(source).withColumn("found_at", F.col("found_at").cast("timestamp"))
    w = F.window("found_at", window)
    return f.withWatermark("found_at", late).groupBy(w.alias("w"), "lib").agg(F.count("*").alias("n")).select("w.start", "w.end", "lib", "n")
