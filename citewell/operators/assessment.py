"""Assessment of requirements against cited facts, and the summary of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Parts of the dictionary of names; each is numbered by a task of its own.
PARTS = 16
EVIDENCE = "array<struct<blockId:string,quote:string>>"


def eval_pairs(evaluations: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each evaluation with each requirement of its job: ``evaluation_id, doc_id, job_id`` and the requirement's columns."""
    return evaluations.select("evaluation_id", "doc_id", "job_id").join(requirements, "job_id")


def assess_requirements(pairs: DataFrame, required: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome, confidence, reasoning and evidence of every pair.

    ``required(requirement_id, canonical)``: what each requirement names; ``evidence(doc_id, canonical, evidence)``: the
    cited blocks of each document. Evidence is sorted by name and then by block order.
    """
    named = pairs.join(required, "requirement_id", "left").join(evidence, ["doc_id", "canonical"], "left")
    matched = F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0
    cited = F.struct("canonical", F.transform("evidence", lambda b: F.struct(b.alias("blockId"), F.col("canonical").alias("quote"))).alias("quotes"))
    keys = [c for c in pairs.columns]
    found = named.groupBy(*keys).agg(
        F.count("canonical").alias("n_required"),
        F.count_if(matched).alias("n_matched"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(matched, cited))), lambda x: x["quotes"])).alias("evidence"),
    )
    none, some = F.col("n_required") == 0, F.col("n_matched") > 0
    every = F.col("n_matched") == F.col("n_required")
    return found.withColumns(
        {
            "outcome": F.when(none, "unknown").when(every, "met").when(some, "partial").otherwise("not_met"),
            "confidence": F.when(none, 0.0).otherwise(1.0),
            "reasoning": F.when(none, "No deterministic criterion match.")
            .when(every, "All explicit skill evidence found.")
            .when(some, "Some explicit skill evidence found.")
            .otherwise("Explicit required skill is not documented."),
        }
    ).drop("n_required", "n_matched")


def summarise(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, score, evidence_coverage, eligibility``; ratios round half to even, an empty sum gives no score."""
    outcome, gate = F.col("outcome"), F.col("kind") == "hard_gate"
    scored = ~F.col("kind").isin("ignored", "hard_gate")
    known = scored & (outcome != "unknown")
    worth = F.when(outcome == "met", 2).when(outcome == "partial", 1).otherwise(0)  # in halves
    sums = assessments.groupBy(*keys).agg(
        F.sum(F.when(known, F.col("weight") * worth).otherwise(0)).alias("points"),
        F.sum(F.when(known, F.col("weight")).otherwise(0)).alias("weights"),
        F.count_if(known).alias("n_known"),
        F.count_if(scored).alias("n_scored"),
        F.coalesce(F.bool_or(gate & (outcome == "not_met")), F.lit(False)).alias("failed"),
        F.coalesce(F.bool_or(gate & outcome.isin("partial", "unknown")), F.lit(False)).alias("open"),
    )
    return sums.select(*keys, *_results())


def _results() -> list[Column]:
    """Score, coverage and eligibility from the sums of an evaluation."""
    return [
        F.when(F.col("weights") > 0, F.bround(50 * F.col("points") / F.col("weights"))).cast("int").alias("score"),
        F.when(F.col("n_scored") == 0, 100).otherwise(F.bround(100 * F.col("n_known") / F.nullif("n_scored", F.lit(0)))).cast("int").alias("evidence_coverage"),
        F.when(F.col("failed"), "not_eligible").when(F.col("open"), "needs_review").otherwise("eligible").alias("eligibility"),
    ]


def evaluate(evaluations: DataFrame, requirements: DataFrame, required: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assessments and the summary of every evaluation; one without requirements is eligible without a score.

    Pairs are grouped by their ids alone; what the requirement says joins them afterwards.
    """
    ids = ["job_id", "requirement_id"]
    pairs = eval_pairs(evaluations, requirements.select(*ids))
    assessments = assess_requirements(pairs, required, evidence).join(requirements, ids)
    summary = evaluations.select("evaluation_id", "doc_id", "job_id").join(summarise(assessments, ["evaluation_id"]), "evaluation_id", "left")
    return assessments, summary.fillna({"evidence_coverage": 100, "eligibility": "eligible"})


def number_names(required: DataFrame) -> DataFrame:
    """``canonical, word, bit`` of every name that some requirement asks for, 64 names a word.

    Names are dealt to parts by hash and numbered within their part, so that no task numbers all; words are keyed by
    part and by their place in it.
    """
    part = F.pmod(F.xxhash64("canonical"), F.lit(PARTS))
    names = required.select("canonical").filter("canonical IS NOT NULL").distinct().withColumn("part", part)
    at = F.row_number().over(W.partitionBy("part").orderBy("canonical")) - 1
    return names.withColumn("at", at).select("canonical", (F.col("part") + PARTS * F.floor(F.col("at") / 64)).alias("word"), (F.col("at") % 64).cast("int").alias("bit"))


def bitmaps(named: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """``key, bits``: of the numbered names in ``named(key, canonical)`` a map word -> bits. Repeated names count once.

    Only words with a bit are held, so that a bitmap grows with the key's own names, not with the dictionary.
    """
    own = named.select(key, "canonical").join(numbers, "canonical").groupBy(key).agg(F.collect_set(F.struct("word", "bit")).alias("at"))
    words = F.array_distinct(F.transform("at", lambda x: x["word"]))
    one = lambda w: F.aggregate(F.filter("at", lambda x: x["word"] == w), F.lit(0).cast("long"), lambda b, x: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])))
    return own.select(key, F.map_from_arrays(words, F.transform(words, one)).alias("bits"))


def evaluate_bitmaps(evaluations: DataFrame, requirements: DataFrame, required: DataFrame, found: DataFrame) -> DataFrame:
    """``evaluate``'s summary and ``outcomes``, the outcome of each requirement, without a row per pair or name.

    ``found(doc_id, canonical)``: what each document names. A requirement is met if its bits are all among the
    document's. An evaluation stays one row: it meets its document's bitmap and its job's list of requirements, and
    score, coverage and eligibility are sums over that list. So the rows that are shuffled are evaluations, however many
    requirements a job has and names a requirement. Evaluations without a document's names, requirements or job count as
    in ``evaluate``; null names are none.
    """
    numbers = number_names(required)
    needs = bitmaps(required, "requirement_id", numbers).select("requirement_id", F.map_entries("bits").alias("needs"))
    item = F.struct("requirement_id", "kind", "weight", F.coalesce("needs", F.array().cast("array<struct<key:bigint,value:bigint>>")).alias("needs"))
    jobs = requirements.select("job_id", "requirement_id", "kind", "weight").join(needs, "requirement_id", "left").groupBy("job_id").agg(F.sort_array(F.collect_list(item)).alias("asked"))
    documents = bitmaps(found, "doc_id", numbers)
    rows = evaluations.select("evaluation_id", "doc_id", "job_id").join(documents, "doc_id", "left").join(jobs, "job_id", "left")
    has = lambda x: F.bit_count(x["value"].bitwiseAND(F.coalesce(F.try_element_at("bits", x["key"]), F.lit(0).cast("long"))))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + x)

    def outcome(asked: Column) -> Column:
        n, met = total(F.transform(asked["needs"], lambda x: F.bit_count(x["value"]))), total(F.transform(asked["needs"], has))
        said = F.when(n == 0, "unknown").when(met == n, "met").when(met > 0, "partial").otherwise("not_met")
        return F.struct(asked["requirement_id"].alias("requirement_id"), asked["kind"].alias("kind"), asked["weight"].alias("weight"), said.alias("outcome"))

    none = F.array().cast(rows.schema["asked"].dataType)
    rows = rows.withColumn("outcomes", F.transform(F.coalesce("asked", none), outcome)).drop("bits", "asked")
    gate = lambda x: x["kind"] == "hard_gate"
    scored = F.filter("outcomes", lambda x: ~x["kind"].isin("ignored", "hard_gate"))
    known = F.filter(scored, lambda x: x["outcome"] != "unknown")
    worth = lambda x: F.when(x["outcome"] == "met", 2).when(x["outcome"] == "partial", 1).otherwise(0)
    sums = {
        "points": total(F.transform(known, lambda x: x["weight"] * worth(x))),
        "weights": total(F.transform(known, lambda x: x["weight"])),
        "n_known": F.size(known),
        "n_scored": F.size(scored),
        "failed": F.exists("outcomes", lambda x: gate(x) & (x["outcome"] == "not_met")),
        "open": F.exists("outcomes", lambda x: gate(x) & x["outcome"].isin("partial", "unknown")),
    }
    return rows.withColumns(sums).select("evaluation_id", "doc_id", "job_id", *_results(), "outcomes")


def meeting_documents(required: DataFrame, found: DataFrame) -> DataFrame:
    """``requirement_id, doc_id`` of all documents that name everything that a requirement names, for any number of both.

    Not every document meets every requirement here: of an inverted index name -> documents a requirement reads the list
    of its rarest name alone, and the document's bitmap, which the list carries, tells whether the other names are there
    too. A requirement that names nothing, or something that no document names, is met by none.
    """
    numbers = number_names(required)
    needs = bitmaps(required, "requirement_id", numbers).select("requirement_id", F.map_entries("bits").alias("needs"))
    asked = required.select("requirement_id", "canonical").filter("canonical IS NOT NULL").distinct()
    named = found.select("doc_id", "canonical").join(numbers.select("canonical"), "canonical", "left_semi").distinct()
    common = named.groupBy("canonical").agg(F.count("*").alias("n"))
    rarest = asked.join(common, "canonical", "left").groupBy("requirement_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "canonical")).alias("r"))
    rarest = rarest.filter("r.n > 0").select("requirement_id", F.col("r.canonical").alias("canonical")).join(needs, "requirement_id")
    lists = named.join(bitmaps(named, "doc_id", numbers), "doc_id")
    whole = F.forall("needs", lambda x: x["value"].bitwiseAND(F.coalesce(F.try_element_at("bits", x["key"]), F.lit(0).cast("long"))) == x["value"])
    return rarest.join(lists, "canonical").filter(whole).select("requirement_id", "doc_id")


def refine_assessments(deterministic: DataFrame, model: DataFrame) -> DataFrame:
    """Take the model's outcome, but never below what is proven.

    ``model(evaluation_id, requirement_id, position, outcome, confidence, reasoning, evidence)``; of repeated entries the
    last counts. A proven ``met`` becomes ``partial`` at a model's ``not_met`` and stays at any other outcome; empty
    reasoning and evidence fall back; confidence is held in [0, 1].
    """
    given = F.struct(*(F.col(c).alias(c) for c in ("outcome", "confidence", "reasoning", "evidence")))
    last = model.groupBy("evaluation_id", "requirement_id").agg(F.max_by(given, "position").alias("m"))
    joined = deterministic.join(last, ["evaluation_id", "requirement_id"], "left")
    has, said = F.col("m").isNotNull(), F.coalesce("m.outcome", F.lit("unknown"))
    proven = (F.col("outcome") == "met") & (said != "met")
    return joined.withColumns(
        {
            "outcome": F.when(~has, F.col("outcome")).when(proven, F.when(said == "not_met", "partial").otherwise("met")).otherwise(said),
            "confidence": F.when(has, F.greatest(F.lit(0.0), F.least(F.coalesce("m.confidence", F.lit(0.0)), F.lit(1.0)))).otherwise(F.col("confidence")),
            "reasoning": F.coalesce(F.nullif("m.reasoning", F.lit("")), "reasoning"),
            "evidence": F.when(F.size(F.coalesce("m.evidence", F.array().cast(EVIDENCE))) > 0, F.col("m.evidence")).otherwise(F.col("evidence")),
        }
    ).drop("m")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks: of each key the one that is least by its columns in order."""
    rest = [c for c in existing.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)) if rest else new.select(*keys).distinct()
    return existing.unionByName(one.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def complete_evaluations(evaluations: DataFrame, summary: DataFrame) -> DataFrame:
    """Evaluations with status and results of the summary, the rest unchanged."""
    results = ("score", "evidence_coverage", "eligibility")
    done = summary.select("evaluation_id", F.struct(*results).alias("done"))
    joined = evaluations.join(done, "evaluation_id", "left")
    changed = {c: F.when(F.col("done").isNotNull(), F.col(f"done.{c}")).otherwise(F.col(c)) for c in results}
    return joined.withColumns(changed | {"status": F.when(F.col("done").isNotNull(), "completed").otherwise(F.col("status"))}).drop("done")
