"""Structured Streaming forms: ingest, de-duplication, fan-out, upsert, job state and admission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.admission import application_open, invitation_reason
from . import keyed_table


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand all that is there to ``each`` batch by batch and stop; a restart goes on after the last finished batch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_facts(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Apply a batch operator to each micro-batch; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(stream, write, checkpoint)


def stream_dedupe(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """One record per key; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def stream_once(stream: DataFrame, keys: list[str], order: list[str], target: str) -> DataFrame:
    """The first record of each key for all time; all of them so far, also after a restart.

    Within a batch the smallest ``order`` wins, between batches the earlier one. The keys seen are a table in key
    buckets, of which a batch reads those that its own keys fall into; nothing is held in memory or forgotten.
    """
    spark, schema = stream.sparkSession, StructType.fromDDL("key string")
    out = f"{target}/records"
    keyed_table.create(spark.createDataFrame([], schema), f"{target}/seen", "key")

    def write(batch: DataFrame, number: int) -> None:
        key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        first = batch.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_first"))
        before = keyed_table.read_buckets(spark, f"{target}/seen", schema, number, first.select(F.col("_key").alias("key")), "key")
        new = first.join(before, first["_key"] == before["key"], "left_anti")
        new.select("_key", "_first.*").write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen = spark.read.parquet(f"{out}/batch={number}").select(F.col("_key").alias("key"))
        keyed_table.update(f"{target}/seen", "key", seen, number + 1, lambda old, x: old.unionByName(x), schema)

    run_available(stream, write, f"{target}/state")
    if keyed_table.versions(spark, f"{target}/seen") == [0]:  # no batch yet
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(StructType([StructField("_key", StringType()), *stream.schema.fields])).parquet(out).drop("_key")


def stream_fanout(finished: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Each finished document with each of its evaluations (a static table)."""
    return finished.join(evaluations, "doc_id")


def upsert_contacts(current: DataFrame, found: DataFrame) -> DataFrame:
    """Fill only null contact fields of ``current`` from ``found``; one row per candidate."""
    fields = ("name", "email", "location")
    new = found.groupBy("candidate_id").agg(*(F.min(c).alias(f"new_{c}") for c in fields))
    joined = current.join(new, "candidate_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"new_{c}")) for c in fields}).drop(*(f"new_{c}" for c in fields))


def stream_upsert(stream: DataFrame, found: Callable[[DataFrame], DataFrame], current: DataFrame, target: str) -> DataFrame:
    """Fill null contact fields batch by batch; the table after the last one, also after a restart without new rows.

    The table is kept in key buckets with a commit per batch (see ``keyed_table``): batch n makes version n + 1 from
    version n and rewrites only the buckets that hold its candidates. Candidates that ``current`` doesn't have are no rows.
    """
    spark, schema = stream.sparkSession, current.schema
    keyed_table.create(current, f"{target}/table", "candidate_id")

    def write(batch: DataFrame, number: int) -> None:
        keyed_table.update(f"{target}/table", "candidate_id", found(batch), number + 1, upsert_contacts, schema)

    run_available(stream, write, f"{target}/state")
    return keyed_table.read(spark, f"{target}/table", schema)


def stream_states(events: DataFrame, target: str, max_attempts: int = 3) -> DataFrame:
    """``job_state`` of a stream; the states after the last batch, also after a restart without new rows.

    Spark keeps the sums per job; each batch hands over the jobs it changed (update mode), which replace their rows in
    a table in key buckets.
    """
    spark = events.sparkSession
    states = job_state(events, max_attempts)
    keyed_table.create(spark.createDataFrame([], states.schema), f"{target}/table", "job_id")

    def write(batch: DataFrame, number: int) -> None:
        keyed_table.update(f"{target}/table", "job_id", batch, number + 1, keyed_table.replace("job_id"), states.schema)

    run_available(states, write, f"{target}/state", "update")
    return keyed_table.read(spark, f"{target}/table", states.schema)


def job_state(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """``job_id, state, attempts, last_error, ready_at``: the state after each job's last event; failures count as attempts.

    A failed job is ready again while it has attempts left, from ``ready_at`` on (see ``retry_plan``), else dead. Works
    on batches and on streams (update mode); a table of the states needs no timer, as who asks compares ``ready_at``.
    """
    last = F.max(F.struct("ts", "event_id", "status", "error"))
    failed = F.col("status") == "failed"
    sums = events.groupBy("job_id").agg(last.alias("last"), F.sum(F.when(failed, 1).otherwise(0)).alias("attempts"), F.max(F.when(failed, F.struct("ts", "event_id", "error"))).alias("failure"))
    status = F.col("last.status")
    again = (status == "failed") & (F.col("attempts") < max_attempts)
    state = F.when(again, "ready").when(status == "failed", "dead").otherwise(status)
    ready_at = F.when(again, F.col("failure.ts").cast("timestamp") + retry_wait(F.col("attempts")))
    return sums.select("job_id", state.alias("state"), "attempts", F.col("failure.error").alias("last_error"), ready_at.alias("ready_at"))


def retry_wait(attempt: Column) -> Column:
    """Two to the power of the attempt seconds, five minutes at most."""
    seconds = F.least(F.lit(300), F.pow(F.lit(2.0), F.least(attempt, F.lit(9))).cast("int"))
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def retry_plan(failures: DataFrame, max_attempts: int = 3) -> DataFrame:
    """``job_id, attempt, failed_at, retryable`` -> ``ready_at`` (null: dead) after a wait that doubles with each attempt."""
    again = F.col("retryable") & (F.col("attempt") < max_attempts)
    return failures.withColumns({"next_state": F.when(again, "ready").otherwise("dead"), "ready_at": F.when(again, F.col("failed_at") + retry_wait(F.col("attempt")))})


def stream_admission(submissions: DataFrame, windows: DataFrame) -> DataFrame:
    """Submissions (a stream) whose job's window (a static table) is open at their time."""
    return submissions.join(windows, "job_id").filter(application_open(F.col("opens"), F.col("closes"), F.col("at")))


REDEEMED = "invitation_id long, redeemer long, submission_id long, used_at timestamp"


def gate_submissions(submissions: DataFrame, invitations: DataFrame, redeemed: DataFrame) -> DataFrame:
    """``submission_id, invitation_id, user_id, at, reason``: why a submission is refused, null if it is admitted.

    ``submissions(submission_id, invitation_id, user_id, at)`` meet ``invitations(invitation_id, opens, closes, revoked_at,
    expires_at, holder)`` and ``redeemed``, the invitations used before. Of those that pass all else the first one in
    event time (ties: smallest submission_id) uses an invitation; a holder, where one is named, must be the user. Later
    ones are told that it is used, or by whom: the same user gets "invitation is used", others "... by another user".
    """
    used = redeemed.select("invitation_id", F.col("redeemer").alias("_by"), F.col("submission_id").alias("_with"))
    rows = submissions.select("submission_id", "invitation_id", "user_id", "at").join(invitations, "invitation_id", "left").join(used, "invitation_id", "left")
    none = F.lit(None)
    still = invitation_reason(F.col("opens"), F.col("closes"), F.col("revoked_at"), F.col("expires_at"), none, F.col("holder"), F.col("user_id"), F.col("at"))
    rows = rows.withColumn("_open", F.when(F.col("opens").isNull() & F.col("expires_at").isNull(), "invitation is unknown").otherwise(still))
    fits = rows.filter(F.col("_open").isNull() & F.col("_with").isNull())
    first = fits.groupBy("invitation_id").agg(F.min(F.struct("at", "submission_id", "user_id")).alias("_first"))
    rows = rows.join(first, "invitation_id", "left")
    who, which = F.coalesce("_by", "_first.user_id"), F.coalesce("_with", "_first.submission_id")
    taken = F.when(F.col("submission_id") == which, none).when(F.col("user_id") == who, "invitation is used").otherwise("invitation is redeemed by another user")
    return rows.select("submission_id", "invitation_id", "user_id", "at", F.coalesce("_open", taken).alias("reason"))


def stream_invited(stream: DataFrame, submissions: Callable[[DataFrame], DataFrame], invitations: DataFrame, target: str) -> DataFrame:
    """``gate_submissions`` of a stream: all decisions so far, also after a restart.

    Who has redeemed what is kept in key buckets with a commit per batch, so that a repeated batch decides as before
    and a later batch can't redeem again. Within a batch event time decides, between batches who came first.
    """
    spark = stream.sparkSession
    decided, schema = f"{target}/decisions", StructType.fromDDL(REDEEMED)
    keyed_table.create(spark.createDataFrame([], schema), f"{target}/redeemed", "invitation_id")

    def write(batch: DataFrame, number: int) -> None:
        rows = submissions(batch)
        before = keyed_table.read_buckets(spark, f"{target}/redeemed", schema, number, rows, "invitation_id")
        gate_submissions(rows, invitations, before).write.mode("overwrite").parquet(f"{decided}/batch={number}")
        admitted = spark.read.parquet(f"{decided}/batch={number}").filter("reason IS NULL AND invitation_id IS NOT NULL")
        new = admitted.select("invitation_id", F.col("user_id").alias("redeemer"), "submission_id", F.col("at").alias("used_at"))
        new = new.join(before.select("invitation_id"), "invitation_id", "left_anti")
        keyed_table.update(f"{target}/redeemed", "invitation_id", new, number + 1, lambda old, x: old.unionByName(x), schema)

    run_available(stream, write, f"{target}/state")
    return spark.read.parquet(decided).drop("batch")


def failed_reports(reports: DataFrame, states: DataFrame, message: str = "The report could not be completed.") -> DataFrame:
    """Reports of dead jobs get the status failed and a message that tells nothing private."""
    dead = states.filter("state = 'dead'").select("job_id", F.lit(True).alias("dead"))
    out = reports.join(dead, "job_id", "left")
    gone = F.coalesce("dead", F.lit(False))
    return out.withColumns({"status": F.when(gone, "failed").otherwise(F.col("status")), "error": F.when(gone, message)}).drop("dead")
