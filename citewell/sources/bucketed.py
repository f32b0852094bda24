"""Tables bucketed by their key: new rows come to the buckets, the rows that are there are never shuffled again.

A table is created once, in a folder that all executors share. Every write sends only the
new rows over the network, dealt by the key into the table's own buckets, and adds files; no file is rewritten. One
writer at a time, as for any table of plain files: a write's files are there only once it has committed, and repeating a
failed ``insert_absent`` or ``append_versions`` adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64


def create(rows: DataFrame, name: str, key: list[str], buckets: int = BUCKETS, path: str | None = None) -> None:
    """A new table of ``rows``, bucketed by ``key``, in the warehouse or at ``path``; an error if it exists."""
    dealt = rows.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).mode("errorifexists").format("parquet")
    (dealt.option("path", path) if path else dealt).saveAsTable(name)


def _append(rows: DataFrame, name: str, key: list[str], buckets: int) -> None:
    rows.write.bucketBy(buckets, *key).sortBy(*key).mode("append").format("parquet").saveAsTable(name)


def buckets_of(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """A table's bucket columns, in order, and how many buckets it has."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] in ("Bucket Columns", "Num Buckets")}
    return [c.strip().strip("`") for c in told["Bucket Columns"].strip("[]").split(",")], int(told["Num Buckets"])


def absent(spark: SparkSession, name: str, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose key the table lacks: of each key the one that is least by its other columns in order.

    The table is read bucket by bucket and meets ``new`` without an exchange of its own rows. A key with a null in it
    equals none, so such rows always count as absent, once each.
    """
    key, buckets = buckets_of(spark, name)
    columns = spark.table(name).columns
    rest = [c for c in columns if c not in key]
    dealt = new.select(*columns).repartition(buckets, *key)
    one = dealt.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest)) if rest else dealt.distinct()
    return one.join(spark.table(name).select(*key).hint("merge"), key, "left_anti").select(*columns)


def insert_absent(spark: SparkSession, name: str, new: DataFrame) -> None:
    """Add what ``absent`` finds; of repeated calls with the same rows the first adds them."""
    key, buckets = buckets_of(spark, name)
    _append(absent(spark, name, new), name, key, buckets)


def joined(spark: SparkSession, left: str, right: str, how: str = "left") -> DataFrame:
    """Two tables with the same buckets by their key, joined bucket by bucket without an exchange."""
    key, _ = buckets_of(spark, left)
    if buckets_of(spark, right) != buckets_of(spark, left):
        raise ValueError(f"{left} and {right} are bucketed differently")
    return spark.table(left).join(spark.table(right).hint("merge"), key, how)


def latest(spark: SparkSession, name: str, version: str = "version") -> DataFrame:
    """Of each key of a table the row with the highest version, worked out bucket by bucket."""
    key, _ = buckets_of(spark, name)
    rows = spark.table(name)
    rest = [c for c in rows.columns if c not in (*key, version)]
    return rows.groupBy(*key).agg(F.max_by(F.struct(version, *rest), version).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def append_versions(spark: SparkSession, name: str, after: DataFrame, version: str = "version") -> None:
    """Rows of ``after(key, after, ...)`` as version ``after + 1`` of their key, if ``after`` is the key's latest one.

    Naming the version that the writer saw keeps a repeated or late write from adding another. A key that the table lacks
    has version 0. Columns that ``after`` lacks are taken from the latest version. Repeated keys in ``after`` count once.
    """
    key, buckets = buckets_of(spark, name)
    columns = spark.table(name).columns
    given = [c for c in columns if c in after.columns and c not in key]
    one = after.repartition(buckets, *key).groupBy(*key).agg(F.min(F.struct("after", *given)).alias("_new"))
    seen = latest(spark, name, version).hint("merge")
    rows = one.join(seen, key, "left").filter(F.coalesce(version, F.lit(0)) == F.col("_new.after"))
    changed = {c: F.col(f"_new.{c}") for c in given} | {version: (F.col("_new.after") + 1).cast(spark.table(name).schema[version].dataType)}
    _append(rows.withColumns(changed).select(*columns), name, key, buckets)
