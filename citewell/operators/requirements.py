"""Requirements: drafts from job texts and append-only job versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import collapse, fold, lines

MAX_DRAFTS = 20


def draft_requirements(jobs: DataFrame) -> DataFrame:
    """``job_id, description`` -> ``job_id, draft_no, stable_id, normalized_text``.

    Lines lose one leading dash and then one star, blanks collapse, short ones go, the first of each folded text stays,
    and of these the first twenty. The id is a hash of the text as written.
    """
    bare = lambda x: collapse(F.regexp_replace(F.regexp_replace(x, "^-", ""), r"^\*", ""))
    rows = jobs.select("job_id", F.posexplode(F.transform(lines(F.col("description")), bare)).alias("line_no", "text"))
    rows = rows.filter(F.char_length("text") >= 3)
    first = rows.groupBy("job_id", fold(F.col("text")).alias("key")).agg(F.min(F.struct("line_no", "text")).alias("x"))
    kept = first.groupBy("job_id").agg(F.slice(F.sort_array(F.collect_list("x")), 1, MAX_DRAFTS).alias("drafts"))
    out = kept.select("job_id", F.posexplode("drafts").alias("i", "d"))
    stable = F.concat(F.lit("draft-"), F.substring(F.sha2("d.text", 256), 1, 12))
    return out.select("job_id", (F.col("i") + 1).alias("draft_no"), stable.alias("stable_id"), F.col("d.text").alias("normalized_text"))


def default_confirmation(drafts: DataFrame) -> DataFrame:
    return drafts.withColumns({"kind": F.lit("required"), "weight": F.lit(2)})


def latest_version(versions: DataFrame) -> DataFrame:
    """All columns of each job's row with the highest version."""
    rest = [c for c in versions.columns if c not in ("job_id", "version")]
    best = versions.groupBy("job_id").agg(F.max_by(F.struct("version", *rest), "version").alias("x"))
    return best.select("job_id", "x.*")


def next_version(versions: DataFrame, requirements: DataFrame, confirmed: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Append a confirmed copy of the latest version of each job in ``confirmed``, with its new requirement rows.

    ``confirmed(job_id, stable_id, normalized_text, kind, weight)``. Returns all versions and all requirements.
    """
    chosen = confirmed.select("job_id").distinct()
    new = latest_version(versions).join(chosen, "job_id", "left_semi").withColumn("version", F.col("version") + 1).withColumn("confirmed_at", F.lit(now).cast("timestamp"))
    rows = confirmed.join(new.select("job_id", "version"), "job_id")
    return versions.unionByName(new.select(*versions.columns)), requirements.unionByName(rows.select(*requirements.columns))


def job_detail(jobs: DataFrame, versions: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each job with its latest version and that version's requirements, sorted by id; without any an empty list."""
    latest = latest_version(versions).select("job_id", "version", "confirmed_at")
    item = F.struct("stable_id", "normalized_text", "kind", "weight")
    nested = requirements.groupBy("job_id", "version").agg(F.sort_array(F.collect_list(item)).alias("requirements"))
    out = jobs.join(latest, "job_id", "left").join(nested, ["job_id", "version"], "left")
    none = F.array().cast(nested.schema["requirements"].dataType)
    return out.withColumn("requirements", F.coalesce("requirements", none))
