"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Nothing removes it; clear that folder when a job is done.

    Only where that setting is absent and Spark runs in one process (tests, a laptop) a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _own_roots[app]
    return f"{root.rstrip('/')}/citewell-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with a copy that survives executors, and gives Spark the table's true size, so that a later join
    broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold`` and else shuffles both sides, where AQE can split
    a skewed key. The write's shuffle files are of no use afterwards and go at once.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let this session hand texts to Python in batches of at most so many rows, unless it has a lower bound.

    Spark's default of 10,000 rows is tens of MB of whole texts, several times over in the JVM and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def release_memory() -> None:
    """Give back what a reused worker still holds of tasks before: their garbage and the allocators' free pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise combined hashes so that their order is as good as random."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of k entries."""
    m = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        m = m * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return mix(m)
