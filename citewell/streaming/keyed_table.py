"""A keyed table that streams update: key buckets, a version per change and a commit log, all of them Parquet.

    data/version=n/bucket=b   the rows of the buckets that version n changed
    commits/version=n         one row per bucket of the table: where its rows are (one file, so it is there or not)

A batch reads the buckets that hold its keys, writes these anew and then its commit. Readers take the last commit. A
batch that is repeated after a failure writes the same version again, from the version before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Key buckets, and committed versions that are kept for readers that began before.
BUCKETS, KEPT = 64, 3
COMMIT = "bucket int, at long"


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """All committed versions that are still listed."""
    system, where = _files(spark, f"{path}/commits")
    if not system.exists(where):
        return []
    done = [s.getPath() for s in system.listStatus(where) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def places(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """bucket -> the version that wrote it last; at most BUCKETS entries."""
    return {r["bucket"]: r["at"] for r in spark.read.schema(COMMIT).parquet(f"{path}/commits/version={version}").collect()}


def _read(spark: SparkSession, path: str, schema, where: dict[int, int]) -> DataFrame:
    if not where:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/version={at}/bucket={bucket}" for bucket, at in sorted(where.items())))


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The table after its last commit, or at a version that is still kept."""
    known = versions(spark, path)
    return _read(spark, path, schema, places(spark, path, known[-1] if version is None else version) if known else {})


def read_buckets(spark: SparkSession, path: str, schema, version: int, keys: DataFrame, key: str) -> DataFrame:
    """The buckets of a version that the keys in ``keys`` fall into."""
    touched = {r[0] for r in keys.select(_bucket(key)).distinct().collect()}  # at most BUCKETS
    return _read(spark, path, schema, {b: at for b, at in places(spark, path, version).items() if b in touched})


def _write(rows: DataFrame, path: str, key: str, version: int, before: dict[int, int]) -> None:
    """Write whole buckets as a version and commit it; ``rows`` that are left of a bucket may be none."""
    spark = rows.sparkSession
    rows.withColumn("bucket", _bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    system, where = _files(spark, f"{path}/data/version={version}")
    written = [int(s.getPath().getName().partition("=")[2]) for s in system.listStatus(where) if s.isDirectory()]
    spark.createDataFrame(sorted({**before, **dict.fromkeys(written, version)}.items()), COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")


def create(rows: DataFrame, path: str, key: str) -> None:
    """Version 0, unless the table is there."""
    if not versions(rows.sparkSession, path):
        _write(rows, path, key, 0, {})


def update(path: str, key: str, changes: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame], schema) -> None:
    """Commit ``version`` from the one before: ``merge(rows of the touched buckets, changes)`` replaces these buckets.

    ``merge`` keeps each row's key. Old versions that no kept commit needs are removed afterwards.
    """
    spark = changes.sparkSession
    old = read_buckets(spark, path, schema, version - 1, changes, key)
    _write(merge(old, changes).select(*(f.name for f in schema)), path, key, version, places(spark, path, version - 1))
    clean(spark, path)


def clean(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Remove commits but for the last ``kept``, and the buckets that none of these names."""
    known = versions(spark, path)
    needed = {(b, at) for v in known[-kept:] for b, at in places(spark, path, v).items()}
    for v in known[:-kept]:
        system, where = _files(spark, f"{path}/commits/version={v}")
        system.delete(where, True)
    system, where = _files(spark, f"{path}/data")
    for s in system.listStatus(where):
        at = int(s.getPath().getName().partition("=")[2])
        if at < known[-1]:
            inside = [x.getPath() for x in system.listStatus(s.getPath()) if x.isDirectory()]
            unneeded = [p for p in inside if (int(p.getName().partition("=")[2]), at) not in needed]
            for p in [s.getPath()] if len(unneeded) == len(inside) else unneeded:
                system.delete(p, True)


def replace(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge where a changed row takes the place of the one with its key."""
    return lambda old, new: old.join(new.select(key), key, "left_anti").unionByName(new)


