"""Ranking, filters, top-k, reports, searches and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .requirements import latest_version


def _order() -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col("created_at").desc(), F.col("evaluation_id").asc()]


def rank_evaluations(evaluations: DataFrame) -> DataFrame:
    """``place`` within each job: best score first, none last, then the newest, then by id."""
    return evaluations.withColumn("place", F.row_number().over(W.partitionBy("job_id").orderBy(*_order())))


def rank_all(evaluations: DataFrame, path: str) -> DataFrame:
    """``rank_evaluations`` for jobs that may hold a large share of all rows: no task sorts or counts a whole job.

    Rows are dealt by ranges of job and order and written to ``path`` with their places in the range, which fixes both.
    A place within the job is then the rows of the job in the ranges before, a sum over at most as many counts as there
    are ranges, and the place within its own range.
    """
    spark = evaluations.sparkSession
    order = [F.col("job_id").asc_nulls_first(), *_order()]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = evaluations.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"_range": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy("_range", F.col("job_id").alias("_job")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_job").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumnRenamed("_range", "_of").drop("_n")
    ranked = rows.join(counts, (F.col("_range") == F.col("_of")) & F.col("job_id").eqNullSafe(F.col("_job")))
    place = (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("place")
    return ranked.select(*evaluations.columns, place)


def filter_evaluations(evaluations: DataFrame, eligibility: list[str] | None = None, min_score: int | None = None) -> DataFrame:
    """A minimum score also drops rows without one."""
    if eligibility:
        evaluations = evaluations.filter(F.col("eligibility").isin(*eligibility))
    return evaluations if min_score is None else evaluations.filter(F.col("score") >= min_score)


def top_k(evaluations: DataFrame, k: int = 100) -> DataFrame:
    """The best ``k`` (1 to 500) of each job; Spark keeps k rows a job and task before the shuffle."""
    if not 1 <= k <= 500:
        raise ValueError("k has to be between 1 and 500")
    return rank_evaluations(evaluations).filter(F.col("place") <= k)


def evaluation_report(ranked: DataFrame, assessments: DataFrame) -> DataFrame:
    """Ranked rows with their assessments nested, by requirement."""
    item = F.struct("requirement_id", "outcome", "confidence", "reasoning")
    nested = assessments.groupBy("evaluation_id").agg(F.sort_array(F.collect_list(item)).alias("assessments"))
    return ranked.join(nested, "evaluation_id", "left").withColumn("assessments", F.coalesce("assessments", F.array().cast(nested.schema["assessments"].dataType)))


def search_candidates(candidates: DataFrame, needle: str) -> DataFrame:
    return candidates.filter(F.contains(F.lower(F.concat_ws(" ", "name", "email")), F.lit(needle.strip().lower())))


def search_jobs(jobs: DataFrame, needle: str) -> DataFrame:
    return jobs.filter(F.contains(F.lower("title"), F.lit(needle.strip().lower())))


def job_summary(evaluations: DataFrame) -> DataFrame:
    """Counts and top score per job, per organisation (null job) and overall (both null)."""
    return evaluations.rollup("org_id", "job_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("eligibility") == "eligible").alias("eligible"),
        F.count_if(F.col("eligibility") == "needs_review").alias("needs_review"),
        F.max("score").alias("top_score"),
    )


def list_jobs(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Jobs with latest version and whether it is confirmed, newest first within an organisation."""
    latest = latest_version(versions).select("job_id", "version", F.col("confirmed_at").isNotNull().alias("confirmed"))
    out = jobs.join(latest, "job_id", "left")
    return out.withColumn("place", F.row_number().over(W.partitionBy("org_id").orderBy(F.desc("created_at"), "job_id")))


def report_history(reports: DataFrame, user_id: int) -> DataFrame:
    return reports.filter(F.col("user_id") == user_id).select("report_id", "status", "score", "created_at").orderBy(F.desc("created_at"), "report_id")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the table's value of their key; rows without a key stay where they are, as a join would gather them all in one task."""
    found = rows.filter(F.col(key).isNotNull()).join(table.select(key, value), key, "left")
    return found.unionByName(rows.filter(F.col(key).isNull()).withColumn(value, F.lit(None).cast(table.schema[value].dataType)))


def job_status(processing: DataFrame, reports: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each processing record with its owner: a report's user, else its submission's organisation."""
    out = _looked_up(_looked_up(processing, reports, "report_id", "user_id"), submissions, "submission_id", "org_id")
    return out.withColumn("owner", F.coalesce(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("org:"), F.col("org_id").cast("string"))))


def clamp_score_filter(value: Column) -> Column:
    """Rounded half up and held in 0..100."""
    return F.least(F.greatest(F.floor(value + 0.5), F.lit(0)), F.lit(100)).cast("int")
