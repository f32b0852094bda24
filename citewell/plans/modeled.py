"""Queries: model outputs, merges, readiness reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, modelio, readiness
from ..sources.documents import settled
from . import fixtures as fx
from .registry import query
from .screening import JOB_TEXTS_SQL, _job_texts, pick

#: Raw model documents by doc_id % 7; {i} is the id. Both engines build the same strings.
GOOD = '{"contact": {"name": "Ann {i}", "phone": ""}, "skills": [{"canonicalName": "THE", "sourceText": "s", "evidence": [{"blockId": "p1-b1", "quote": "q"}]}, {"canonicalName": " Kafka {i}", "sourceText": "s", "evidence": [{"blockId": "p9999-b1", "quote": "q"}, {"blockId": "p1-b1", "quote": "q"}]}, {"canonicalName": "Gone", "sourceText": "s", "evidence": [{"blockId": "x", "quote": "q"}]}], "employment": [{"employer": "Org", "title": "Dev", "startDate": "2022-03", "isCurrent": true}], "education": [], "certifications": [{"name": "Cert"}], "suggestions": [{"title": "Add a clear name", "detail": "again"}, {"title": "More {i}", "detail": "d"}], "warnings": ["w"]}'
DOCUMENTS = (
    (GOOD, None),
    (GOOD.replace('"contact": {', '"extra": 1, "contact": {'), "unknown field"),
    (GOOD.replace('"Org"', "42"), "not a text"),
    (GOOD.replace('"2022-03"', '"March"'), "not allowed"),
    (GOOD.replace('"canonicalName": "THE", ', '"canonical_name": "The", '), None),
    ("{not json", "not JSON"),
    (GOOD.replace(', "education": []', ""), "missing education"),
)
SENT = '{"assessments": [{"requirementId": "{r}", "outcome": "met", "confidence": 1, "reasoning": "r", "evidence": [{"blockId": "p1-b1", "quote": "q"}]}, {"requirementId": "none", "outcome": "met", "confidence": 1, "reasoning": "r"}, {"requirementId": "{r}", "outcome": "not_met", "confidence": 0.9, "reasoning": "r", "evidence": [{"blockId": "x", "quote": "q"}]}]}'
ASSESSED = ((SENT, None), (SENT.replace('"met", "confidence": 1', '"maybe", "confidence": 1', 1), "not allowed"), (SENT.replace("0.9", '"0.9"'), "not a number"), (SENT.replace("0.9", "1.5"), "range"))


def _sql_list(rows, k):
    return "[" + ", ".join("NULL" if r[k] is None else "'" + r[k].replace("'", "''") + "'" for r in rows) + "]"


RAW_SQL = f"raws AS (SELECT doc_id, replace({_sql_list(DOCUMENTS, 0)}[doc_id % 7 + 1], '{{i}}', CAST(doc_id AS VARCHAR)) AS raw, {_sql_list(DOCUMENTS, 1)}[doc_id % 7 + 1] AS error FROM documents)"
VALID_SQL = f"{RAW_SQL}, valid AS (SELECT doc_id, CAST(replace(raw, 'canonical_name', 'canonicalName') AS JSON) AS f FROM raws WHERE error IS NULL)"


def _facts(spark, sf):
    i = F.col("doc_id")
    raw = F.replace(pick([d for d, _ in DOCUMENTS], i % 7), F.lit("{i}"), i.cast("string"))
    return modelio.strict_facts(fx.table(spark, sf, "documents").select(i, raw.alias("raw")))


@query(f"WITH {RAW_SQL} SELECT doc_id, error IS NULL AS valid, error FROM raws")
def j1_strict_facts(spark, sf):
    return _facts(spark, sf).select("doc_id", F.col("facts").isNotNull().alias("valid"), "error")


def _assessed(spark, sf):
    i = F.col("doc_id")
    raw = F.replace(pick([d for d, _ in ASSESSED], i % 4), F.lit("{r}"), (i % 25 * 4).cast("string"))
    return modelio.strict_assessments(fx.table(spark, sf, "documents").select(i, raw.alias("raw")))


@query(f"SELECT doc_id, {_sql_list(ASSESSED, 1)}[doc_id % 4 + 1] AS error, CASE WHEN doc_id % 4 = 0 THEN 3 END AS n FROM documents")
def j2_strict_assessments(spark, sf):
    return _assessed(spark, sf).select("doc_id", "error", F.when(F.col("assessments").isNotNull(), F.size("assessments")).alias("n"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'confirmed outcome without evidence' END AS error FROM documents")
def j3_strict_cited(spark, sf):
    i = F.col("doc_id")
    body = '{"requirementId": "r", "outcome": "%s", "confidence": 0.5, "reasoning": "r"%s}'
    raw = pick([body % ("met", ', "evidence": [{"blockId": "b", "quote": "q"}]'), body % ("met", ""), body % ("unknown", "")], i % 3)
    return modelio.strict_cited(fx.table(spark, sf, "documents").select(i, raw.alias("raw"))).select("doc_id", "error")


WHOLE = '{"skills": [{"canonicalName": "A", "sourceText": "a", "evidence": [{"blockId": "p1-b1", "quote": "q"}]}], "employment": [], "projects": [], "education": [], "certifications": [], "warnings": []}'
#: Whole documents and what is wrong with them, one of each kind.
CITED = (
    (WHOLE, None),
    (WHOLE.replace('"warnings"', '"identity": {"fullName": "N"}, "contact": {"links": ["l"], "email": null}, "warnings"'), None),
    (WHOLE.replace('[{"blockId": "p1-b1", "quote": "q"}]', "[]"), "length"),
    (WHOLE.replace(', "evidence": [{"blockId": "p1-b1", "quote": "q"}]', ""), "missing evidence"),
    (WHOLE.replace('"warnings"', '"extra": 1, "warnings"'), "unknown field"),
    (WHOLE.replace('"projects": [], ', ""), "missing projects"),
    (WHOLE.replace('"employment": []', '"employment": [{"evidence": [{"blockId": "b", "quote": "q"}]}]'), "missing isCurrent"),
    (WHOLE.replace('"certifications": []', '"certifications": [{"name": "c", "issuedDate": "5 May", "evidence": [{"blockId": "b", "quote": "q"}]}]'), "not allowed"),
    (WHOLE.replace('"education": []', '"education": {}'), "not a list"),
    (WHOLE.replace('"warnings"', '"contact": {"phone": 42}, "warnings"'), "not a text"),
    ("{", "not JSON"),
)


@query(f"SELECT doc_id, {_sql_list(CITED, 1)}[doc_id % {len(CITED)} + 1] AS error, CASE WHEN doc_id % {len(CITED)} < 2 THEN '1' END AS version, CASE WHEN doc_id % {len(CITED)} < 2 THEN 1 END AS n_skills FROM documents")
def j3_strict_document(spark, sf):
    i = F.col("doc_id")
    rows = fx.table(spark, sf, "documents").select(i, pick([d for d, _ in CITED], i % len(CITED)).alias("raw"))
    found = modelio.strict_document(rows)
    return found.select("doc_id", "error", F.col("facts.schemaVersion").alias("version"), F.when(F.col("facts").isNotNull(), F.size("facts.skills")).alias("n_skills"))


def _ids(spark, sf):
    return fx.nested_blocks(spark, sf).select("doc_id", F.transform("blocks", lambda b: b["id"]).alias("ids"))


CITED_SQL = f"""{VALID_SQL}, {fx.BLOCKS_SQL}, sk AS (SELECT doc_id, s.i AS position, f->'skills'->CAST(s.i AS INT) AS s FROM valid, range(3) s(i)),
ev AS (SELECT doc_id, position, s->>'canonicalName' AS name, e.i AS e, (s->'evidence'->CAST(e.i AS INT))->>'blockId' AS block_id FROM sk, range(2) e(i) WHERE e.i < json_array_length(s->'evidence')),
ok AS (SELECT ev.*, block_pos FROM ev JOIN blocks USING (doc_id, block_id)),
pruned AS (SELECT doc_id, position, name, list(block_id ORDER BY e) AS block_ids FROM ok GROUP BY ALL)"""


def _facts_once(spark, sf):
    """The validated facts, written: several parts of a merge read them."""
    return settled(_facts(spark, sf).select("doc_id", "facts"))


def _pruned(spark, sf, facts=None):
    rows = (_facts(spark, sf) if facts is None else facts).filter("facts IS NOT NULL").join(_ids(spark, sf), "doc_id")
    return rows.withColumn("kept", modelio.prune_evidence(F.col("facts.skills"), F.col("ids")))


@query(f"WITH {CITED_SQL} SELECT v.doc_id, coalesce(list(name ORDER BY position) FILTER (name IS NOT NULL), []) AS names, coalesce(list(block_ids ORDER BY position) FILTER (name IS NOT NULL), []) AS block_ids FROM valid v LEFT JOIN pruned USING (doc_id) GROUP BY v.doc_id")
def j4_prune_evidence(spark, sf):
    return _pruned(spark, sf).select("doc_id", F.transform("kept", lambda s: s["canonicalName"]).alias("names"), F.transform("kept", lambda s: F.transform(s["evidence"], lambda e: e["blockId"])).alias("block_ids"))


@query(f"WITH {CITED_SQL} SELECT v.doc_id, CASE WHEN count(name) < 3 THEN ['w', (3 - count(name)) || ' skills lacked valid evidence'] ELSE ['w'] END AS warnings FROM valid v LEFT JOIN pruned USING (doc_id) GROUP BY v.doc_id")
def j5_prune_warning(spark, sf):
    return _pruned(spark, sf).select("doc_id", modelio.prune_warning(F.col("facts.warnings"), F.col("facts.skills"), F.col("kept")).alias("warnings"))


@query(f"WITH {fx.REQUIREMENTS_SQL}, {fx.BLOCKS_SQL}, d AS (SELECT doc_id, doc_id % 25 * 4 AS requirement_id FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, requirement_id, 0 AS position, 'met' AS outcome, CAST(1.0 AS DOUBLE) AS confidence, 1 AS n_evidence FROM d UNION ALL SELECT doc_id, requirement_id, 2, 'unknown', CAST(0.5 AS DOUBLE), 0 FROM d")
def j6_degrade_unsupported(spark, sf):
    rows = _assessed(spark, sf).filter("assessments IS NOT NULL").select("doc_id", F.posexplode("assessments").alias("position", "a"))
    rows = rows.select("doc_id", "position", F.col("a.requirementId").alias("requirement_id"), "a.outcome", "a.confidence", "a.evidence")
    known = fx.requirements(spark, sf).select(F.col("requirement_id").cast("string").alias("requirement_id"))
    out = modelio.degrade_unsupported(rows, known, fx.blocks(spark, sf))
    return out.select("doc_id", F.col("requirement_id").cast("long").alias("requirement_id"), "position", "outcome", "confidence", F.size("evidence").alias("n_evidence"))


def _own(spark, sf):
    evidence = matching.skill_evidence(fx.spans(spark, sf))
    return evidence.join(fx.categories(spark).select(F.col("name").alias("canonical"), "category"), "canonical", "left").select("doc_id", "canonical", "category", "evidence")


def _extracted(spark, sf, facts=None):
    rows = _pruned(spark, sf, facts).select("doc_id", F.posexplode("kept").alias("position", "s"))
    return rows.select("doc_id", "position", F.col("s.canonicalName").alias("name"), F.transform("s.evidence", lambda e: e["blockId"]).alias("evidence"))


def _merged(spark, sf, facts=None):
    return modelio.merge_skills(settled(_own(spark, sf)), _extracted(spark, sf, facts), fx.aliases(spark), fx.categories(spark))


MERGED_SQL = f"""WITH RECURSIVE {fx.VOCABULARY_SQL}, {CITED_SQL}, {fx.spans_sql('blocks', 'doc_id, block_pos, block_id', 'spans')}, {fx.EVIDENCE_SQL}, {fx.CATEGORIES_SQL},
own AS (SELECT doc_id, canonical, evidence FROM evidence),
new AS (SELECT p.doc_id, position, coalesce(v.canonical, trim(name)) AS canonical, list_distinct(block_ids) AS evidence FROM pruned p LEFT JOIN vocab v ON v.phrase = lower(trim(name)) AND v.canonical IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = p.doc_id AND lower(o.canonical) = lower(trim(name)))),
both_ AS (SELECT doc_id, canonical, evidence, 0 AS rank, 0 AS position FROM own UNION ALL SELECT doc_id, canonical, evidence, 1, position FROM new),
merged AS (SELECT b.doc_id, b.canonical, category, evidence FROM both_ b LEFT JOIN categories ON name = b.canonical QUALIFY row_number() OVER (PARTITION BY b.doc_id, lower(b.canonical) ORDER BY rank, position) = 1)"""


@query(f"{MERGED_SQL} SELECT doc_id, canonical, category, evidence FROM merged")
def j7_merge_skills(spark, sf):
    return _merged(spark, sf)


CONTACT_SQL = "contacts AS (SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN 'Own' ELSE '' END, ''), CASE WHEN doc_id % 7 IN (0, 4) THEN 'Ann ' || doc_id END) AS name, CASE WHEN doc_id % 3 = 0 THEN 'a@b.cd' END AS email FROM documents)"


def _contact(spark, sf):
    i = F.col("doc_id")
    own = F.struct(F.when(i % 2 == 0, "Own").otherwise("").alias("name"), F.when(i % 3 == 0, "a@b.cd").alias("email"), F.lit(None).cast("string").alias("location"))
    return fx.table(spark, sf, "documents").select(i, own.alias("contact"))


@query(f"WITH {CONTACT_SQL} SELECT doc_id, name, email, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS location FROM contacts")
def j8_merge_contact(spark, sf):
    both = _contact(spark, sf).join(_facts(spark, sf).select("doc_id", "facts"), "doc_id", "left")
    return both.select("doc_id", modelio.merge_contact(F.col("contact"), F.col("facts")["contact"]).alias("c")).select("doc_id", "c.*")


def _merged_facts(spark, sf, facts=None, merged=None):
    facts = _facts_once(spark, sf) if facts is None else facts
    return modelio.merge_facts(_contact(spark, sf), facts, _merged(spark, sf, facts) if merged is None else merged)


SKILL_LIST_SQL = "skill_lists AS (SELECT doc_id, list(canonical ORDER BY lower(canonical)) AS names FROM merged GROUP BY doc_id)"


@query(f"{MERGED_SQL}, {CONTACT_SQL}, {SKILL_LIST_SQL} SELECT doc_id, name, coalesce(names, []) AS names, CASE WHEN doc_id % 7 IN (0, 4) THEN 1 ELSE 0 END AS jobs, CASE WHEN doc_id % 7 IN (0, 4) THEN ['w'] ELSE [] END AS warnings FROM contacts LEFT JOIN skill_lists USING (doc_id)")
def j9_merge_facts(spark, sf):
    return _merged_facts(spark, sf).select("doc_id", "contact.name", F.transform("skills", lambda s: s["canonical"]).alias("names"), F.size("employment").alias("jobs"), "warnings")


def _suggestions(spark, sf, facts, merged_facts):
    """Deterministic ones (rank 0) and those of the model (rank 1)."""
    named = merged_facts.withColumn("skills", F.transform("skills", lambda s: F.struct(s["canonical"].alias("canonicalName"))))
    own = readiness.readiness_report(named, F.lit(None).cast("array<string>")).select("doc_id", F.lit(0).alias("rank"), F.posexplode("suggestions").alias("position", "s"))
    model = facts.filter("facts IS NOT NULL").select("doc_id", F.lit(1).alias("rank"), F.posexplode("facts.suggestions").alias("position", "s"))
    return own.unionByName(model).select("doc_id", "rank", "position", "s.title", "s.detail")


REPORT_SQL = f"""{MERGED_SQL}, {CONTACT_SQL}, {SKILL_LIST_SQL},
rep AS (SELECT doc_id, name, email, coalesce(names, []) AS names, doc_id % 7 IN (0, 4) AS has FROM contacts LEFT JOIN skill_lists USING (doc_id)),
adv AS (SELECT doc_id, 0 AS rank, 0 AS position, 'Add a clear name' AS title, 'Start the resume with your name.' AS detail FROM rep WHERE name IS NULL
  UNION ALL SELECT doc_id, 0, 1, 'Add contact details', 'Include a professional email address.' FROM rep WHERE email IS NULL
  UNION ALL SELECT doc_id, 0, 2, 'Make skills easier to verify', 'Name the tools and technologies you used in your experience.' FROM rep WHERE len(names) = 0
  UNION ALL SELECT doc_id, 0, 3, 'Document your experience', 'List each role with the employer, title, and dates so your experience can be verified.' FROM rep WHERE NOT has
  UNION ALL SELECT doc_id, 0, 4, 'Add education or certifications', 'Include degrees or credentials with their issuing institutions and dates.' FROM rep WHERE NOT has)"""
ALL_ADVICE_SQL = f"""{REPORT_SQL}, every AS (SELECT * FROM adv UNION ALL SELECT doc_id, 1, 0, 'Add a clear name', 'again' FROM rep WHERE has UNION ALL SELECT doc_id, 1, 1, 'More ' || doc_id, 'd' FROM rep WHERE has),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY rank, position) = 1),
placed AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, position) AS INT) AS place, title, detail FROM once)"""


@query(f"{ALL_ADVICE_SQL} SELECT * FROM placed WHERE place <= 10")
def j10_merge_suggestions(spark, sf):
    facts = _facts_once(spark, sf)
    return modelio.merge_suggestions(_suggestions(spark, sf, facts, _merged_facts(spark, sf, facts)))


RESPONSES = (
    (200, '{"choices": [{"finish_reason": "stop", "message": {"content": "{\\"a\\": 1}"}}]}', "ok", None),
    (429, '{"error": {"message": "slow down"}}', "retryable", "slow down"),
    (402, '{"error": {"message": "pay"}}', "fatal", "Model credits are exhausted"),
    (401, "{}", "fatal", "Model credentials were rejected"),
    (400, "{}", "fatal", "HTTP 400"),
    (200, '{"error": {"code": "provider_overloaded"}}', "retryable", "provider_overloaded"),
    (200, '{"error": {"code": "timeout", "metadata": {"file_annotations": [1]}}}', "fatal", "timeout"),
    (200, '{"choices": []}', "fatal", "Model response has no choices"),
    (200, '{"choices": [{"finish_reason": "length", "message": {"content": "{"}}]}', "retryable", "Model output was truncated"),
    (200, '{"choices": [{"finish_reason": "filter", "message": {"content": "{}"}}]}', "fatal", "Model stopped early: filter"),
    (200, '{"choices": [{"message": {"content": " ", "refusal": "no"}}]}', "fatal", "Model refused the extraction request"),
    (200, '{"choices": [{"message": {"content": ""}}]}', "fatal", "Model response is empty"),
    (200, '{"choices": [{"message": {"content": "{a"}}]}', "fatal", "Model response is not valid JSON"),
    (200, '{"choices": [{"message": {"content": "[1]"}}]}', "fatal", "Model response is not a JSON object"),
    (503, "oops", "retryable", "Model returned invalid JSON"),
    (200, "[1]", "fatal", "Model response is not an object"),
)


@query(f"SELECT event_id, {_sql_list(RESPONSES, 2)}[event_id % 16 + 1] AS outcome, {_sql_list(RESPONSES, 3)}[event_id % 16 + 1] AS reason FROM events")
def j11_completion_triage(spark, sf):
    at = F.col("event_id") % 16
    rows = fx.table(spark, sf, "events").select("event_id", pick([r[0] for r in RESPONSES], at).alias("http_status"), pick([r[1] for r in RESPONSES], at).alias("body"))
    return modelio.completion_triage(rows).select("event_id", "outcome", "reason")


@query(f"""WITH {fx.BLOCKS_SQL}, {fx.REQUIREMENTS_SQL}, {fx.SUBMISSIONS_SQL},
doc AS (SELECT d.doc_id, coalesce(string_agg('[' || block_id || ']' || chr(10) || b.text, chr(10) || chr(10) ORDER BY block_pos) FILTER (trim(b.text) <> ''), '') AS document FROM documents d LEFT JOIN blocks b USING (doc_id) GROUP BY d.doc_id),
ask AS (SELECT job_id, string_agg('- id: ' || requirement_id || ' | text: ' || normalized_text, chr(10) ORDER BY requirement_id) AS asked FROM requirements GROUP BY job_id)
SELECT evaluation_id, md5('<job_requirements>' || chr(10) || asked || chr(10) || '</job_requirements>') AS asked_md5, md5('<resume_document>' || chr(10) || document || chr(10) || '</resume_document>') AS document_md5
FROM submissions JOIN ask USING (job_id) JOIN doc USING (doc_id)""")
def j12_request_rows(spark, sf):
    docs = fx.nested_blocks(spark, sf).select("doc_id", matching.labelled_document(F.col("blocks")).alias("document"))
    rows = modelio.request_rows(fx.submissions(spark, sf), fx.requirements(spark, sf), docs)
    parsed = F.from_json("request", "content array<struct<type:string,text:string>>")["content"]
    return rows.select("evaluation_id", F.md5(parsed[0]["text"]).alias("asked_md5"), F.md5(parsed[1]["text"]).alias("document_md5"))


def _report_facts(spark, sf):
    return _merged_facts(spark, sf).withColumn("skills", F.transform("skills", lambda s: F.struct(s["canonical"].alias("canonicalName"))))


SCORE_SQL = "CAST(least(100, 20 + CASE WHEN name IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 15 ELSE 0 END + least(25, 5 * len(names)) + CASE WHEN has THEN 7 ELSE 0 END) AS INT)"


@query(f"{REPORT_SQL} SELECT doc_id, {SCORE_SQL} AS score FROM rep")
def p1_readiness_score(spark, sf):
    return readiness.readiness_report(_report_facts(spark, sf), F.lit(None).cast("array<string>")).select("doc_id", "score")


@query(f"{REPORT_SQL} SELECT doc_id, position AS rule, title, detail FROM adv".replace("position AS rule, ", ""))
def p2_readiness_suggestions(spark, sf):
    rows = readiness.readiness_report(_report_facts(spark, sf), F.lit(None).cast("array<string>"))
    return rows.select("doc_id", F.explode("suggestions").alias("s")).select("doc_id", "s.title", "s.detail")


GAP_SQL = f"""{REPORT_SQL}, {JOB_TEXTS_SQL}, rt AS (SELECT job_id, description || ' und the of the ai' AS text FROM texts), {fx.spans_sql('rt', 'job_id', 'js')}, mentioned AS (SELECT job_id, list(DISTINCT canonical) AS m FROM js GROUP BY job_id),
gaps AS (SELECT doc_id, list_sort(list_filter(m, lambda x: NOT list_contains(names, x))) AS gap FROM rep JOIN mentioned ON job_id = doc_id % 40),
gap AS (SELECT doc_id, CASE WHEN len(gap) = 0 THEN 'Connect experience to the role' ELSE 'Review role-specific evidence' END AS title,
  CASE WHEN len(gap) = 0 THEN 'Use specific outcomes to show how your documented skills apply to this role.' ELSE 'The job description mentions ' || array_to_string(gap[1:8], ', ') || '. Add them only when your resume already supports the claim.' END AS detail FROM gaps)"""


def _with_mentions(spark, sf):
    texts = _job_texts(spark, sf).select("job_id", F.concat("description", F.lit(" und the of the ai")).alias("text"))
    names = matching.mentioned_set(matching.leftmost_longest(texts, ["job_id"], fx.phrases(spark)), ["job_id"]).groupBy("job_id").agg(F.collect_set("canonical").alias("mentioned"))
    return _report_facts(spark, sf).join(names, F.col("doc_id") % 40 == F.col("job_id"))


@query(f"{GAP_SQL} SELECT doc_id, title, detail FROM gap")
def p3_role_gap(spark, sf):
    rows = _with_mentions(spark, sf)
    return rows.select("doc_id", readiness.role_gap(F.col("mentioned"), readiness.documented_names(F.col("skills"))).alias("s")).select("doc_id", "s.title", "s.detail")


@query(f"{REPORT_SQL} SELECT doc_id, list_sort(names) AS names FROM rep")
def p4_documented_names(spark, sf):
    return _report_facts(spark, sf).select("doc_id", readiness.documented_names(F.col("skills")).alias("names"))


@query(f"{GAP_SQL} SELECT r.doc_id, {SCORE_SQL} AS score, count(a.title) + 1 AS n_suggestions, any_value(g.title) AS last_title FROM rep r JOIN gap g USING (doc_id) LEFT JOIN adv a USING (doc_id) GROUP BY r.doc_id, name, email, names, has")
def p5_readiness_report(spark, sf):
    rows = readiness.readiness_report(_with_mentions(spark, sf), F.col("mentioned"))
    return rows.select("doc_id", "score", F.size("suggestions").cast("long").alias("n_suggestions"), F.element_at("suggestions", -1)["title"].alias("last_title"))


@query(f"{MERGED_SQL} SELECT doc_id, coalesce(category, 'Other') AS category, list(canonical ORDER BY lower(canonical)) AS names FROM merged GROUP BY ALL")
def p6_skills_by_category(spark, sf):
    return readiness.skills_by_category(_merged(spark, sf))


@query(f"""{ALL_ADVICE_SQL}, cats AS (SELECT doc_id, coalesce(category, 'Other') AS c, list(canonical ORDER BY lower(canonical)) AS n FROM merged GROUP BY ALL),
lines AS (SELECT doc_id, 0 AS section_no, 'Heading' AS section, coalesce(name, 'Resume') AS line FROM rep UNION ALL SELECT doc_id, 0, 'Heading', email FROM rep WHERE email IS NOT NULL
  UNION ALL SELECT doc_id, 1, 'Skills', c || ': ' || array_to_string(n, ', ') FROM cats UNION ALL SELECT doc_id, 2, 'Experience', 'Dev — Org (2022-03 to present)' FROM rep WHERE has
  UNION ALL SELECT doc_id, 4, 'Certifications', 'Cert' FROM rep WHERE has UNION ALL SELECT doc_id, 5, 'Improvement notes', title || ': ' || detail FROM placed WHERE place <= 10)
SELECT doc_id, section_no, section, line FROM lines""")
def p7_corrected_lines(spark, sf):
    facts = _facts_once(spark, sf)
    merged = settled(_merged(spark, sf, facts))
    whole = settled(_merged_facts(spark, sf, facts, merged))
    notes = modelio.merge_suggestions(_suggestions(spark, sf, facts, whole))
    return readiness.corrected_lines(whole, readiness.skills_by_category(merged), notes).select("doc_id", "section_no", "section", "line")
