"""Substring search by an index of short character sequences: postings for grams of a few lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of indexed grams. Each is at most one and a half times (from 4 on) the one before, so that two of them
#: cover a needle; one longer than twice the last is looked up by its ends.
SIZES = (1, 2, 3, 4, 6, 8)


def _grams(text: Column, n: int) -> Column:
    """Distinct sequences of n characters."""
    size = F.char_length(text) - n + 1
    every = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def gram_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``gram, key``: all grams of SIZES characters of the lower-cased text; a null text has none."""
    low = rows.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    return low.select(F.explode(F.concat(*(_grams(F.col("_low"), n) for n in SIZES))).alias("gram"), key)


def write_index(index: DataFrame, path: str) -> None:
    """Postings in order of gram, so that a search skips the row groups of other grams."""
    index.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search(index: DataFrame, rows: DataFrame, key: str, text: str, needles: DataFrame) -> DataFrame:
    """``needle, key``: rows whose lower-cased text contains the lower-cased, stripped needle; ``needles(needle)``.

    A needle of an indexed length is a gram itself, whose postings are the answer. Any other is looked up by the longest
    indexed grams that begin and end it; a row is a candidate if it has both, and its text is compared. Longer needles
    have longer grams, whose lists are short, so that many needles don't meet as many rows each. An empty or null needle
    finds nothing, as it asks for nothing; a null text is empty. ``key`` names one row each; needles that are repeated
    are answered once. No text is read but candidates'.
    """
    asked = needles.filter("needle IS NOT NULL").select("needle", F.lower(F.trim("needle")).alias("_low")).distinct().filter("_low <> ''")
    length = F.char_length("_low")
    short = asked.filter(length.isin(*SIZES)).select("needle", F.col("_low").alias("gram")).join(index, "gram").select("needle", key)
    size = F.element_at(F.filter(F.array(*(F.lit(n) for n in SIZES)), lambda n: n <= length), -1)
    wanted = asked.filter(~length.isin(*SIZES)).withColumn("_grams", F.array_distinct(F.array(F.left("_low", size), F.right("_low", size))))
    wanted = wanted.select("needle", "_low", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    found = wanted.join(index, "gram").groupBy("needle", "_low", "_n", key).agg(F.count("*").alias("_has")).filter("_has = _n")
    texts = rows.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    long = found.join(texts, key).filter(F.contains("_text", F.col("_low"))).select("needle", key)
    return short.unionByName(long)
