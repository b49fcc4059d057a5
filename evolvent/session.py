"""Session, shared folder and stage tables.

Iterative operators cut their lineage by writing a stage as Parquet in the folder that all executors share
(``spark.checkpoint.dir``), so that a lost executor costs a re-read and never a restart of the loop.
"""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "evolvent", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, so that they need not find it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_evolvent_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="evolvent-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(name)
    sc._evolvent_shipped = True
    atexit.register(lambda: os.path.exists(name) and os.remove(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that setting is absent and the master is local.

    A cluster without the setting is an error: its executors share no folder of this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_before = getattr(sc, "_evolvent_dir", None)
    if not set_before:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_before = "file://" + tempfile.mkdtemp(prefix="evolvent-")
        sc._evolvent_dir = set_before
        atexit.register(_delete, spark, set_before)
    return set_before


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway is gone at interpreter exit
        pass


class Stages:
    """Stage tables of one operator run, in one subfolder of the shared folder.

    ``put`` writes a frame and returns it as read back; ``drop`` removes tables that no live plan reads any more.
    What is left is removed when the process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.n = itertools.count(1)
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame, name: str = "s") -> DataFrame:
        path = f"{self.root}/{next(self.n):04d}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._evolvent_path = path
        return back

    def grow(self, df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
        """Append a frame to a stage table of its own, a new one without ``path``: (the whole table as read back, its path)."""
        path = path or f"{self.root}/{next(self.n):04d}-grown"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if path := getattr(f, "_evolvent_path", None):
                _delete(self.spark, path)


class once:
    """A property that is worked out when first asked for, by one thread while others that ask wait for it."""

    def __init__(self, f: Callable[[Any], Any]):
        self.f, self.name, self.__doc__ = f, f.__name__, f.__doc__

    def __get__(self, obj: Any, cls: type | None = None) -> Any:
        if obj is None:
            return self
        with obj.__dict__.setdefault(f"_lock_{self.name}", threading.RLock()):
            if self.name not in obj.__dict__:
                obj.__dict__[self.name] = self.f(obj)
        return obj.__dict__[self.name]


def together(*wanted: tuple[Any, str]) -> None:
    """Work out properties (object, name of a :class:`once`) side by side: stages that do not need each other share the cores."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(len(wanted)) as pool:
        for f in [pool.submit(inheritable_thread_target(spark)(getattr), obj, name) for obj, name in wanted]:
            f.result()


#: Bytes that a side may have to be broadcast.
BROADCAST_BYTES = 8_000_000


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most ``max_rows`` rows and ``max_bytes`` bytes: the check behind every broadcast of a side that can grow."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(16))
    n, held = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and held <= max_bytes
