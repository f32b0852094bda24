"""Queries: admission, requirements and versions, assessment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import admission, assessment, matching, ranking, requirements
from ..sources import bucketed
from ..sources.documents import scratch
from . import fixtures as fx
from .registry import query


def pick(values, at):
    """The value at a position from 0."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


UPLOADS_SQL = """uploads AS (SELECT page_id, ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/plain', 'image/png'][page_id % 4 + 1] AS media_type,
  'cv' || page_id || ['.pdf', '.DOCX', '.txt', '', '.tar.txt'][page_id % 5 + 1] AS filename, CASE page_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 30000000 ELSE strlen(html) END AS size,
  CASE WHEN page_id % 3 = 0 THEN '%PDF-1.7' ELSE 'plain' END AS head, CASE WHEN page_id % 7 = 0 THEN 'Macro-enabled Office documents are not supported' END AS docx_reason FROM pages)"""


def _uploads(spark, sf):
    i = F.col("page_id")
    rows = fx.table(spark, sf, "pages")
    return rows.select(
        i,
        pick([*admission.SUFFIXES, "image/png"], i % 4).alias("media_type"),
        F.concat(F.lit("cv"), i, pick([".pdf", ".DOCX", ".txt", "", ".tar.txt"], i % 5)).alias("filename"),
        F.when(i % 11 == 0, 0).when(i % 11 == 1, 30000000).otherwise(F.octet_length("html")).alias("size"),
        F.when(i % 3 == 0, "%PDF-1.7").otherwise("plain").cast("binary").alias("head"),
        F.when(i % 7 == 0, "Macro-enabled Office documents are not supported").alias("docx_reason"),
    )


SUFFIX_SQL = "lower(regexp_extract(filename, '(\\.[^.]+)$', 1))"
REASON_SQL = f"""CASE WHEN size NOT BETWEEN 1 AND 20971520 THEN 'Resume must be between 1 byte and 20 MB' WHEN media_type = 'image/png' THEN 'Resume must be a PDF, DOCX, or TXT file'
  WHEN {SUFFIX_SQL} <> CASE WHEN media_type = 'text/plain' THEN '.txt' WHEN media_type = 'application/pdf' THEN '.pdf' ELSE '.docx' END THEN 'Resume filename does not match its media type'
  WHEN media_type = 'application/pdf' AND NOT starts_with(head, '%PDF-') THEN 'Resume content is not a PDF' WHEN media_type LIKE '%wordprocessingml.document' THEN docx_reason END"""


@query(f"WITH {UPLOADS_SQL} SELECT page_id, {REASON_SQL} AS reason FROM uploads")
def a1_admit_document(spark, sf):
    reason = admission.admit_document(*(F.col(c) for c in ("media_type", "filename", "size", "head", "docx_reason")))
    return _uploads(spark, sf).select("page_id", reason.alias("reason"))


ENTRIES_SQL = """entries AS (SELECT CAST(page_id // 10 AS BIGINT) AS archive_id, page_id, CASE page_id % 9 WHEN 0 THEN '[Content_Types].xml' WHEN 1 THEN 'word/document.xml' WHEN 2 THEN 'a/../cv.txt'
   WHEN 3 THEN '/etc/cv.txt' WHEN 4 THEN 'inner.ZIP' WHEN 5 THEN 'word/vbaProject.bin' ELSE url || '.txt' END AS entry_name, CASE WHEN page_id % 13 = 0 THEN 2717843456 ELSE 2175008768 END AS external_attr,
   CASE WHEN page_id % 6 = 0 THEN strlen(html) // 200 ELSE strlen(html) // 3 END AS compress_size, CASE WHEN page_id % 50 = 7 THEN 900000000 ELSE strlen(html) END AS file_size, page_id % 100 <> 99 AS has_magic FROM pages)"""


def _entries(spark, sf):
    i = F.col("page_id")
    rows = fx.table(spark, sf, "pages")
    name = F.when(i % 9 < 6, pick(["[Content_Types].xml", "word/document.xml", "a/../cv.txt", "/etc/cv.txt", "inner.ZIP", "word/vbaProject.bin"], F.least(i % 9, F.lit(5)))).otherwise(F.concat("url", F.lit(".txt")))
    n = F.octet_length("html").cast("long")
    return rows.select(
        F.floor(i / 10).cast("long").alias("archive_id"),
        i,
        name.alias("entry_name"),
        F.when(i % 13 == 0, F.lit(2717843456)).otherwise(F.lit(2175008768)).alias("external_attr"),
        F.when(i % 6 == 0, F.floor(n / 200)).otherwise(F.floor(n / 3)).alias("compress_size"),
        F.when(i % 50 == 7, F.lit(900000000)).otherwise(n).alias("file_size"),
        (i % 100 != 99).alias("has_magic"),
    )


@query(f"""WITH {ENTRIES_SQL} SELECT archive_id, CASE WHEN NOT bool_and(has_magic) OR NOT bool_or(entry_name = '[Content_Types].xml') OR NOT bool_or(entry_name = 'word/document.xml') THEN 'Resume content is not a DOCX file'
  WHEN bool_or(lower(entry_name) LIKE '%vbaproject.bin') THEN 'Macro-enabled Office documents are not supported' END AS reason FROM entries GROUP BY archive_id""")
def a2_docx_structure(spark, sf):
    return admission.docx_structure(_entries(spark, sf))


ENTRY_REASON_SQL = """CASE WHEN starts_with(entry_name, '/') OR list_contains(string_split(entry_name, '/'), '..') THEN 'ZIP entry has an unsafe path' WHEN (external_attr >> 16) & 61440 = 40960 THEN 'ZIP entry is a symlink'
  WHEN lower(entry_name) LIKE '%.zip' THEN 'Nested ZIP archives are not supported' WHEN compress_size > 0 AND file_size > 100 * compress_size THEN 'ZIP entry has a suspicious compression ratio' END"""


def _judged(spark, sf):
    rows = _entries(spark, sf)
    return rows.withColumn("reason", admission.zip_entry_reason(*(F.col(c) for c in ("entry_name", "external_attr", "compress_size", "file_size"))))


@query(f"WITH {ENTRIES_SQL} SELECT page_id, {ENTRY_REASON_SQL} AS reason FROM entries")
def a3_zip_entry_reason(spark, sf):
    return _judged(spark, sf).select("page_id", "reason")


@query(f"WITH {ENTRIES_SQL} SELECT archive_id, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total, CASE WHEN count(*) > 500 THEN 'Resume ZIP exceeds 500 files' WHEN sum(file_size) > 524288000 THEN 'Resume ZIP exceeds 500 MB uncompressed' END AS reason FROM entries GROUP BY archive_id")
def a4_batch_caps(spark, sf):
    return admission.batch_caps(_entries(spark, sf))


@query(f"WITH {ENTRIES_SQL}, j AS (SELECT *, {ENTRY_REASON_SQL} AS reason FROM entries) SELECT archive_id, entry_name, coalesce(reason, 'accepted') AS result FROM j")
def a5_batch_split(spark, sf):
    accepted, rejected = admission.batch_split(_judged(spark, sf))
    return accepted.select("archive_id", "entry_name", F.lit("accepted").alias("result")).unionByName(rejected.withColumnRenamed("reason", "result"))


@query(f"WITH {UPLOADS_SQL} SELECT filename, CASE {SUFFIX_SQL} WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.txt' THEN 'text/plain' END AS media_type FROM uploads")
def a6_media_type_for_name(spark, sf):
    return _uploads(spark, sf).select("filename", admission.media_type_for_name(F.col("filename")).alias("media_type"))


@query("SELECT doc_id, sha256(text) AS checksum, CAST(strlen(text) AS BIGINT) AS byte_size, make_timestamp((1704067200 + doc_id) * 1000000) + INTERVAL 90 DAY AS retain_until FROM documents")
def a7_stamp_document(spark, sf):
    now = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    return fx.table(spark, sf, "documents").select("doc_id", *admission.stamp_document(F.col("text").cast("binary"), now))


WINDOWS_SQL = "windows AS (SELECT o_orderkey AS window_id, CAST(o_orderdate AS TIMESTAMP) AS opens, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 14 DAY AS closes, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 20 AS INT)) AS \"at\" FROM orders)"


def _windows(spark, sf):
    opens = F.col("o_orderdate").cast("timestamp")
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("window_id"), opens.alias("opens"), (opens + F.expr("INTERVAL 14 DAYS")).alias("closes"), (opens + F.make_dt_interval(days=(F.col("o_orderkey") % 20).cast("int"))).alias("at"))


@query(f"WITH {WINDOWS_SQL} SELECT window_id, CASE WHEN c IS NULL THEN 'window needs both ends' WHEN c <= opens THEN 'window closes before it opens' END AS reason FROM (SELECT *, CASE window_id % 3 WHEN 0 THEN closes WHEN 1 THEN opens END AS c FROM windows)")
def a8_validate_window(spark, sf):
    closes = F.when(F.col("window_id") % 3 == 0, F.col("closes")).when(F.col("window_id") % 3 == 1, F.col("opens"))
    return _windows(spark, sf).select("window_id", admission.validate_window(F.col("opens"), closes).alias("reason"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 1000 END BETWEEN 1 AND 720, false) AS valid FROM part")
def a9_validate_invite_expiry(spark, sf):
    hours = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 1000)
    return fx.table(spark, sf, "part").select("p_partkey", admission.validate_invite_expiry(hours).alias("valid"))


@query("WITH t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN repeat(text, 60) ELSE ' ' || text || chr(10) END AS x FROM documents), c AS (SELECT doc_id, nullif(regexp_replace(x, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'), '') AS c FROM t) SELECT doc_id, md5(c) AS clean_md5, coalesce(length(c) <= 100000, true) AS valid FROM c")
def a10_validate_job_text(spark, sf):
    i = F.col("doc_id")
    text = F.when(i % 9 == 0, "  ").when(i % 9 == 1, F.repeat("text", F.lit(60))).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    clean, valid = admission.validate_job_text(F.col("x"))
    return fx.table(spark, sf, "documents").select("doc_id", text.alias("x")).select("doc_id", F.md5(clean).alias("clean_md5"), valid.alias("valid"))


@query("WITH r AS (SELECT p_partkey, ['required', 'preferred', 'ignored', 'hard_gate', 'maybe'][p_partkey % 5 + 1] AS kind, p_size - 3 AS weight FROM part) SELECT p_partkey, kind <> 'maybe' AND weight > 0 AS valid FROM r")
def a11_validate_requirement(spark, sf):
    kind = pick(["required", "preferred", "ignored", "hard_gate", "maybe"], F.col("p_partkey") % 5)
    return fx.table(spark, sf, "part").select("p_partkey", admission.validate_requirement(kind, F.col("p_size") - 3).alias("valid"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN 3 * p_size - 6 BETWEEN 1 AND 100 THEN 3 * p_size - 6 END WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS weight FROM part")
def a12_default_weight(spark, sf):
    kind, weight = F.when(F.col("p_partkey") % 3 == 0, "required").otherwise("preferred"), F.when(F.col("p_partkey") % 2 == 0, 3 * F.col("p_size") - 6)
    return fx.table(spark, sf, "part").select("p_partkey", admission.default_weight(kind, weight).alias("weight"))


@query(f"WITH {WINDOWS_SQL} SELECT window_id, opens <= \"at\" AND \"at\" < closes AS open FROM windows")
def a13_application_open(spark, sf):
    return _windows(spark, sf).select("window_id", admission.application_open(F.col("opens"), F.col("closes"), F.col("at")).alias("open"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS opens, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 700 AS INT)) AS closes, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 50000 AS INT)) AS "at" FROM orders)
SELECT e.o_orderkey AS submission_id, w.o_orderkey AS window_id FROM s e JOIN s w ON e.o_custkey = w.o_custkey AND w.opens <= e."at" AND e."at" < w.closes""")
def a13_interval_join(spark, sf):
    """Several overlapping windows a job: which of them are open at a submission's time."""
    opens, i = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    orders = fx.table(spark, sf, "orders")
    windows = orders.select(i.alias("window_id"), F.col("o_custkey").alias("job_id"), opens.alias("opens"), (opens + F.make_dt_interval(days=(i % 700).cast("int"))).alias("closes"))
    events = orders.select(i.alias("submission_id"), F.col("o_custkey").alias("job_id"), (opens + F.make_dt_interval(mins=(i % 50000).cast("int"))).alias("at"))
    return admission.interval_join(events, windows, "job_id").select("submission_id", "window_id")


@query(f"""WITH {WINDOWS_SQL} SELECT window_id, CASE WHEN NOT (opens <= "at" AND "at" < closes) THEN 'applications are closed' WHEN window_id % 11 = 0 THEN 'invitation is revoked'
  WHEN opens + to_days(CAST(window_id % 14 AS INT)) <= "at" THEN 'invitation is expired' WHEN window_id % 5 = 0 THEN 'invitation is used' WHEN window_id % 3 = 0 AND window_id % 4 <> window_id % 7 THEN 'invitation is redeemed by another user' END AS reason FROM windows""")
def a14_invitation_available(spark, sf):
    i = F.col("window_id")
    expires = F.col("opens") + F.make_dt_interval(days=(i % 14).cast("int"))
    reason = admission.invitation_reason(F.col("opens"), F.col("closes"), F.when(i % 11 == 0, F.col("at")), expires, F.when(i % 5 == 0, F.col("at")), F.when(i % 3 == 0, i % 4), i % 7, F.col("at"))
    return _windows(spark, sf).select("window_id", reason.alias("reason"))


VERSIONS_SQL = "versions AS (SELECT o_custkey AS job_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version, o_orderpriority AS title, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS confirmed_at FROM orders)"
LATEST_SQL = "latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY version DESC) = 1)"


def _versions(spark, sf):
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), number.alias("version"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("timestamp")).alias("confirmed_at"))


@query(f"WITH {VERSIONS_SQL}, {LATEST_SQL} SELECT d.doc_id, l.version FROM documents d JOIN latest l ON l.job_id = d.doc_id WHERE l.confirmed_at IS NOT NULL")
def a15_require_confirmed_version(spark, sf):
    asked = fx.table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("job_id"))
    return admission.require_confirmed_version(asked, requirements.latest_version(_versions(spark, sf))).select("doc_id", "version")


@query("SELECT c_custkey, lower(replace(c_name, '#', '@')) || '.example' AS email FROM customer")
def a16_normalise_email(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", admission.normalise_email(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("@")), F.lit(".EXAMPLE\t"))).alias("email"))


JOB_TEXTS_SQL = "texts AS (SELECT item_id AS job_id, '- ' || replace(text, chr(10), chr(10) || '- ') || chr(10) || '* ' || upper(string_split(text, chr(10))[1]) AS description FROM benchmark)"


def _job_texts(spark, sf):
    first = F.upper(F.get(F.split("text", "\n"), F.lit(0)))
    return fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("job_id"), F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit("\n* "), first).alias("description"))


DRAFTS_SQL = f"""{JOB_TEXTS_SQL}, ls AS (SELECT job_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT job_id, string_split(description, chr(10)) AS x FROM texts)),
cl AS (SELECT job_id, i, trim(regexp_replace(regexp_replace(regexp_replace(x[i], '^-', ''), '^\\*', ''), '\\s+', ' ', 'g')) AS text FROM ls),
first AS (SELECT * FROM cl WHERE length(text) >= 3 QUALIFY row_number() OVER (PARTITION BY job_id, {fx.fold_sql('text')} ORDER BY i) = 1),
drafts AS (SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY i) AS INT) AS draft_no, 'draft-' || substr(sha256(text), 1, 12) AS stable_id, text AS normalized_text FROM first QUALIFY draft_no <= 20)"""


@query(f"WITH {DRAFTS_SQL} SELECT * FROM drafts")
def r1_draft_requirements(spark, sf):
    return requirements.draft_requirements(_job_texts(spark, sf))


@query(f"WITH {DRAFTS_SQL} SELECT *, 'required' AS kind, 2 AS weight FROM drafts")
def r2_default_confirmation(spark, sf):
    return requirements.default_confirmation(requirements.draft_requirements(_job_texts(spark, sf)))


@query(f"WITH {VERSIONS_SQL}, {LATEST_SQL} SELECT job_id, version, title, confirmed_at FROM latest")
def r3_latest_version(spark, sf):
    return requirements.latest_version(_versions(spark, sf))


def _confirmed(spark, sf):
    return requirements.default_confirmation(requirements.draft_requirements(_job_texts(spark, sf))).select("job_id", "stable_id", "normalized_text", "kind", "weight")


@query(f"WITH {VERSIONS_SQL}, {LATEST_SQL}, {DRAFTS_SQL} SELECT job_id, version, title, confirmed_at FROM versions UNION ALL SELECT job_id, version + 1, title, TIMESTAMP '2024-05-01 00:00:00' FROM latest WHERE job_id IN (SELECT job_id FROM drafts)")
def r4_next_version(spark, sf):
    none = spark.createDataFrame([], "job_id long, version int, stable_id string, normalized_text string, kind string, weight int")
    return requirements.next_version(_versions(spark, sf), none, _confirmed(spark, sf), "2024-05-01 00:00:00")[0]


def _table(spark, rows, key):
    """A new bucketed table with ``rows``; its name."""
    name = f"citewell_{uuid.uuid4().hex}"
    bucketed.create(rows, name, key, path=scratch(spark, "bucketed"))
    return name


@query(f"WITH {VERSIONS_SQL}, {LATEST_SQL} SELECT job_id, version, title, confirmed_at FROM versions UNION ALL SELECT job_id, version + 1, title || '!', confirmed_at FROM latest WHERE job_id % 3 = 0")
def r4_bucketed_versions(spark, sf):
    """Every third job gets a version after its latest one, asked for twice; the rest ask after a version that is not the latest."""
    versions = _versions(spark, sf)
    name = _table(spark, versions, ["job_id"])
    seen = requirements.latest_version(versions)
    after = seen.select("job_id", (F.col("version") - F.when(F.col("job_id") % 3 == 0, 0).otherwise(1)).alias("after"), F.concat("title", F.lit("!")).alias("title"))
    for _ in range(2):
        bucketed.append_versions(spark, name, after)
    return spark.table(name)


@query(f"""WITH {VERSIONS_SQL}, {LATEST_SQL}, {DRAFTS_SQL}, n AS (SELECT job_id, list({{'stable_id': stable_id, 'normalized_text': normalized_text, 'kind': 'required', 'weight': 2}} ORDER BY stable_id) AS requirements FROM drafts GROUP BY job_id)
SELECT c_custkey AS job_id, c_name AS title, CASE WHEN n.job_id IS NOT NULL AND l.version IS NOT NULL THEN l.version + 1 ELSE l.version END AS version,
  CASE WHEN n.job_id IS NOT NULL AND l.version IS NOT NULL THEN TIMESTAMP '2024-05-01 00:00:00' ELSE l.confirmed_at END AS confirmed_at, CASE WHEN l.version IS NULL THEN [] ELSE coalesce(n.requirements, []) END AS requirements
FROM customer LEFT JOIN latest l ON l.job_id = c_custkey LEFT JOIN n ON n.job_id = c_custkey""")
def r5_job_detail(spark, sf):
    jobs = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("title"))
    none = spark.createDataFrame([], "job_id long, version int, stable_id string, normalized_text string, kind string, weight int")
    versions, rows = requirements.next_version(_versions(spark, sf), none, _confirmed(spark, sf), "2024-05-01 00:00:00")
    return requirements.job_detail(jobs, versions, rows)


@query(f"WITH RECURSIVE {fx.VOCABULARY_SQL}, {JOB_TEXTS_SQL}, rt AS (SELECT job_id, description AS text FROM texts), {fx.spans_sql('rt', 'job_id', 's')}, m AS (SELECT DISTINCT job_id, canonical FROM s) SELECT job_id, list(canonical ORDER BY canonical) AS names, CAST(count(*) AS INT) AS n_required FROM m GROUP BY job_id")
def r6_requirement_skills(spark, sf):
    texts = _job_texts(spark, sf).select("job_id", F.col("description").alias("text"))
    names = matching.mentioned_set(matching.leftmost_longest(texts, ["job_id"], fx.phrases(spark)), ["job_id"])
    return names.groupBy("job_id").agg(F.sort_array(F.collect_set("canonical")).alias("names")).withColumn("n_required", F.size("names"))


@query(f"WITH {fx.REQUIREMENTS_SQL}, {fx.SUBMISSIONS_SQL} SELECT evaluation_id, doc_id, job_id, requirement_id, kind, weight, normalized_text FROM submissions JOIN requirements USING (job_id)")
def e1_eval_pairs(spark, sf):
    return assessment.eval_pairs(fx.submissions(spark, sf), fx.requirements(spark, sf))


REASONING_SQL = "CASE outcome WHEN 'unknown' THEN 'No deterministic criterion match.' WHEN 'met' THEN 'All explicit skill evidence found.' WHEN 'partial' THEN 'Some explicit skill evidence found.' ELSE 'Explicit required skill is not documented.' END"


@query(f"{fx.ASSESSED_SQL} SELECT evaluation_id, requirement_id, outcome, confidence, {REASONING_SQL} AS reasoning FROM assessed")
def e2_assess_requirement(spark, sf):
    return fx.evaluated(spark, sf)[0].select("evaluation_id", "requirement_id", "outcome", "confidence", "reasoning")


@query(f"{fx.ASSESSED_SQL} SELECT evaluation_id, requirement_id, outcome FROM assessed")
def e2_bitmap_outcomes(spark, sf):
    return fx.scored(spark, sf).select("evaluation_id", F.explode("outcomes").alias("o")).select("evaluation_id", "o.requirement_id", "o.outcome")


@query(f"""{fx.ASSESSED_SQL}, need AS (SELECT requirement_id, count(*) AS n FROM required GROUP BY ALL)
SELECT requirement_id, doc_id FROM required JOIN evidence USING (canonical) JOIN need USING (requirement_id) GROUP BY requirement_id, doc_id, n HAVING count(*) = n""")
def e2_meeting_documents(spark, sf):
    """Every requirement against every document, whichever job a document was sent to."""
    return assessment.meeting_documents(fx.required_names(spark, sf), fx.spans(spark, sf).select("doc_id", "canonical"))


@query(f"""{fx.ASSESSED_SQL}, c AS (SELECT evaluation_id, requirement_id, canonical, evidence FROM pairs JOIN required USING (requirement_id) JOIN evidence USING (doc_id, canonical)),
x AS (SELECT evaluation_id, requirement_id, canonical, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM c)
SELECT p.evaluation_id, p.requirement_id, coalesce(list({{'blockId': evidence[i], 'quote': canonical}} ORDER BY canonical, i) FILTER (canonical IS NOT NULL), []) AS evidence FROM pairs p LEFT JOIN x USING (evaluation_id, requirement_id) GROUP BY ALL""")
def e3_assessment_evidence(spark, sf):
    return fx.evaluated(spark, sf)[0].select("evaluation_id", "requirement_id", "evidence")


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, score FROM evaluations")
def e4_weighted_score(spark, sf):
    return fx.scored(spark, sf).select("evaluation_id", "score")


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, evidence_coverage FROM evaluations")
def e5_evidence_coverage(spark, sf):
    return fx.scored(spark, sf).select("evaluation_id", "evidence_coverage")


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, eligibility FROM evaluations")
def e6_gate_eligibility(spark, sf):
    return fx.scored(spark, sf).select("evaluation_id", "eligibility")


MODEL_SQL = """model AS (SELECT evaluation_id, requirement_id, position, ['met', 'partial', 'not_met', 'unknown'][(evaluation_id + requirement_id + position) % 4 + 1] AS outcome, CAST((evaluation_id % 5) * 0.3 - 0.1 AS DOUBLE) AS confidence,
  CASE WHEN evaluation_id % 3 = 0 THEN '' ELSE 'model ' || position END AS reasoning, CASE WHEN evaluation_id % 2 = 0 THEN [{'blockId': 'p1-b1', 'quote': 'm' || position}] ELSE [] END AS evidence FROM pairs, range(2) r(position) WHERE (evaluation_id + requirement_id) % 7 > 1)"""


def _model(pairs):
    e, r, p = F.col("evaluation_id"), F.col("requirement_id"), F.col("position")
    rows = pairs.select(e, r, F.explode(F.sequence(F.lit(0), F.lit(1))).alias("position")).filter((e + r) % 7 > 1)
    quoted = F.array(F.struct(F.lit("p1-b1").alias("blockId"), F.concat(F.lit("m"), p).alias("quote")))
    return rows.select(e, r, p, pick(["met", "partial", "not_met", "unknown"], (e + r + p) % 4).alias("outcome"), ((e % 5) * F.expr("0.3BD") - F.expr("0.1BD")).cast("double").alias("confidence"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("model "), p)).alias("reasoning"), F.when(e % 2 == 0, quoted).otherwise(F.array().cast(assessment.EVIDENCE)).alias("evidence"))


REFINED_SQL = f"""{fx.ASSESSED_SQL}, {MODEL_SQL}, last AS (SELECT * FROM model WHERE position = 1),
refined AS (SELECT a.evaluation_id, a.doc_id, a.job_id, a.requirement_id, a.kind, a.weight, CASE WHEN m.outcome IS NULL THEN a.outcome WHEN a.outcome = 'met' AND m.outcome = 'not_met' THEN 'partial' WHEN a.outcome = 'met' THEN 'met' ELSE m.outcome END AS outcome,
  CASE WHEN m.outcome IS NULL THEN a.confidence ELSE greatest(0, least(m.confidence, 1)) END AS confidence, coalesce(nullif(m.reasoning, ''), {REASONING_SQL.replace('CASE outcome', 'CASE a.outcome')}) AS reasoning FROM assessed a LEFT JOIN last m USING (evaluation_id, requirement_id))"""


def _refined(spark, sf):
    found = fx.evaluated(spark, sf)[0]
    return assessment.refine_assessments(found, _model(assessment.eval_pairs(fx.submissions(spark, sf), fx.requirements(spark, sf))))


@query(f"{REFINED_SQL} SELECT evaluation_id, requirement_id, outcome, confidence, reasoning FROM refined")
def e7_refine_assessments(spark, sf):
    return _refined(spark, sf).select("evaluation_id", "requirement_id", "outcome", "confidence", "reasoning")


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, doc_id, job_id, score, evidence_coverage, eligibility FROM evaluations")
def e8_evaluate(spark, sf):
    return fx.evaluated(spark, sf)[1]


@query(f"{REFINED_SQL} {fx.summary_sql('refined')}".replace("any_value(doc_id) AS doc_id, any_value(job_id) AS job_id,", ""))
def e9_evaluate_refined(spark, sf):
    return assessment.summarise(_refined(spark, sf), ["evaluation_id"])


@query(f"{fx.ASSESSED_SQL} SELECT evaluation_id, requirement_id, CASE WHEN evaluation_id % 2 = 0 THEN 'kept' ELSE outcome END AS outcome FROM assessed")
def e10_insert_if_absent(spark, sf):
    new = fx.evaluated(spark, sf)[0].select("evaluation_id", "requirement_id", "outcome")
    pairs = assessment.eval_pairs(fx.submissions(spark, sf), fx.requirements(spark, sf))
    existing = pairs.filter("evaluation_id % 2 = 0").select("evaluation_id", "requirement_id", F.lit("kept").alias("outcome"))
    return assessment.insert_if_absent(existing, new, ["evaluation_id", "requirement_id"])


@query(f"{fx.ASSESSED_SQL} SELECT evaluation_id, requirement_id, CASE WHEN evaluation_id % 2 = 0 THEN 'kept' ELSE outcome END AS outcome FROM assessed")
def e10_bucketed_insert(spark, sf):
    """Outcomes into a table that holds half of the pairs already, inserted twice."""
    new = e2_bitmap_outcomes(spark, sf)
    pairs = assessment.eval_pairs(fx.submissions(spark, sf), fx.requirements(spark, sf))
    name = _table(spark, pairs.filter("evaluation_id % 2 = 0").select("evaluation_id", "requirement_id", F.lit("kept").alias("outcome")), ["evaluation_id", "requirement_id"])
    for _ in range(2):
        bucketed.insert_absent(spark, name, new)
    return spark.table(name)


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, CASE WHEN evaluation_id % 3 > 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN evaluation_id % 3 > 0 THEN score END AS score, CASE WHEN evaluation_id % 3 > 0 THEN eligibility END AS eligibility FROM evaluations")
def e11_bucketed_results(spark, sf):
    """Evaluations and their results in tables of the same buckets; a result is written once and none is rewritten."""
    sent = _table(spark, fx.submissions(spark, sf).select("evaluation_id"), ["evaluation_id"])
    done = fx.scored(spark, sf).filter("evaluation_id % 3 > 0").select("evaluation_id", "score", "eligibility")
    results = _table(spark, done.filter("false"), ["evaluation_id"])
    bucketed.insert_absent(spark, results, done)
    both = bucketed.joined(spark, sent, results)
    return both.select("evaluation_id", F.when(F.col("eligibility").isNotNull(), "completed").otherwise("processing").alias("status"), "score", "eligibility")


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, CASE WHEN evaluation_id % 3 > 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN evaluation_id % 3 > 0 THEN score END AS score, CASE WHEN evaluation_id % 3 > 0 THEN evidence_coverage END AS evidence_coverage, CASE WHEN evaluation_id % 3 > 0 THEN eligibility END AS eligibility FROM evaluations")
def e11_complete_evaluations(spark, sf):
    rows = fx.submissions(spark, sf).selectExpr("evaluation_id", "'processing' AS status", "CAST(NULL AS INT) AS score", "CAST(NULL AS INT) AS evidence_coverage", "CAST(NULL AS STRING) AS eligibility")
    return assessment.complete_evaluations(rows, fx.evaluated(spark, sf)[1].filter("evaluation_id % 3 > 0"))


def evaluations(spark, sf):
    return fx.scored(spark, sf).drop("outcomes").join(fx.submissions(spark, sf).select("evaluation_id", "created_at"), "evaluation_id")


RANKED_SQL = f"{fx.EVALUATED_SQL}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY score DESC NULLS LAST, created_at DESC, evaluation_id) AS INT) AS place FROM evaluations)"


@query(f"{RANKED_SQL} SELECT evaluation_id, doc_id, job_id, score, evidence_coverage, eligibility, created_at, place FROM ranked")
def flagship_ranked_evaluations(spark, sf):
    return ranking.rank_evaluations(evaluations(spark, sf))
