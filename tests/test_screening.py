import io
import json
import random
import re
import zipfile

from pyspark.sql import functions as F

from citewell.operators import admission, assessment, integrity, modelio, ranking, readiness, requirements, search
from citewell.sources import documents as source
from citewell.streaming import jobs


def package(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'


def test_docx_and_text_blocks(spark):
    files = spark.createDataFrame([("a", package(**{"word__document.xml": BODY})), ("b", b"no zip"), ("c", package(**{"word__document.xml": "<w"}))], "doc_id string, content binary")
    assert sorted((r["doc_id"], r["text"], r["reason"]) for r in source.docx_blocks(files).collect()) == [("a", "One line\nTwo", None), ("b", None, "Resume DOCX could not be parsed"), ("c", None, "Resume DOCX could not be parsed")]
    texts = spark.createDataFrame([(1, "﻿hé".encode()), (2, b"\xff\xfe"), (3, b" \n")], "doc_id int, content binary")
    assert sorted((r["doc_id"], r["text"], r["reason"]) for r in source.decode_text_blocks(texts).collect()) == [(1, "hé", None), (2, None, "Resume text is not UTF-8"), (3, None, "Resume text contains no extractable text")]


def test_archive_entries_and_reasons(spark):
    archive = package(**{"letter.txt": "dear all", "..__above.txt": "up", "photo.png": "p", "inner.Zip": "z", "zeros.txt": "0" * 100_000})
    many = package(**{f"f{i}.txt": "" for i in range(501)})
    rows = source.archive_entries(spark.createDataFrame([("z", archive), ("bad", b"x"), ("many", many)], "archive_id string, content binary"))
    assert rows.filter("archive_id = 'many'").first()["reason"] == "Resume ZIP exceeds 500 files"
    rows = rows.filter("archive_id <> 'many'")
    reason = admission.zip_entry_reason(*(F.col(c) for c in ("entry_name", "external_attr", "compress_size", "file_size")))
    docx = F.lit(None).cast("string")
    own = admission.admit_document(admission.media_type_for_name(F.col("entry_name")), F.col("entry_name"), F.col("file_size"), F.col("content"), docx)
    found = {r["entry_name"]: r["x"] for r in rows.select("entry_name", F.coalesce("reason", reason, own).alias("x")).collect()}
    assert found == {None: "Resume ZIP file is malformed", "letter.txt": None, "../above.txt": "ZIP entry has an unsafe path", "photo.png": "Resume must be a PDF, DOCX, or TXT file", "inner.Zip": "Nested ZIP archives are not supported", "zeros.txt": "ZIP entry has a suspicious compression ratio"}


def test_a_bomb_is_not_inflated(monkeypatch):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb.txt", "0" * 30_000_000)
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *_: 1 / 0)
    assert source._entries("a", data.getvalue())[0][5:] == (None, "ZIP entry has a suspicious compression ratio")


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "tech.txt").write_text("Example\tCommodity Title\nGit\tVersion control\n")
    (tmp_path / "a.txt").write_text("Element Name\nWriting\nReading\n")
    (tmp_path / "b.txt").write_text("Element Name\nReading\n")
    (tmp_path / "titles.json").write_text('["T one",\n "T two"]')
    assert [tuple(r) for r in source.scan_vocab_tech(spark, str(tmp_path / "tech.txt")).collect()] == [("Git", "Version control")]
    assert [r["name"] for r in source.scan_vocab_elements(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()] == ["Reading", "Writing"]
    assert [tuple(r) for r in source.scan_vocab_titles(spark, str(tmp_path / "titles.json")).collect()] == [(0, "T one"), (1, "T two")]
    skills = spark.createDataFrame([("b", "B"), ("a", "A")], "key string, name string")
    source.write_vocabulary(skills, spark.createDataFrame([("x", "A")], "alias string, canonical string"), str(tmp_path / "v"))
    assert [r["key"] for r in spark.read.parquet(str(tmp_path / "v/skills")).collect()] == ["a", "b"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/x.txt").write_bytes(b"abc")
    assert source.scan_documents(spark, str(tmp_path / "docs"), "*.txt").first()["length"] == 3


def test_drafts(spark):
    text = "- Python experience\n* PostgreSQL experience\n- Python experience\n  - kept dash\nab\n" + "\n".join(f"line number {i}" for i in range(30))
    rows = requirements.draft_requirements(spark.createDataFrame([(1, text), (2, "")], "job_id int, description string")).orderBy("draft_no").collect()
    assert [r["normalized_text"] for r in rows][:4] == ["Python experience", "PostgreSQL experience", "- kept dash", "line number 0"]
    assert len(rows) == 20 and len({r["stable_id"] for r in rows}) == 20


def evaluate(spark, reqs, named, facts):
    evaluations = spark.createDataFrame([(1, 1, 1)], "evaluation_id int, doc_id int, job_id int")
    r = spark.createDataFrame([(1, *x) for x in reqs], "job_id int, requirement_id string, kind string, weight int, normalized_text string")
    n = spark.createDataFrame(named, "requirement_id string, canonical string")
    f = spark.createDataFrame([(1, *x) for x in facts], "doc_id int, canonical string, evidence array<string>")
    return assessment.evaluate(evaluations, r, n, f)


def test_gate_and_partial_scores(spark):
    _, summary = evaluate(spark, [("python", "required", 2, ""), ("k8s", "hard_gate", 1, "")], [("python", "Python"), ("k8s", "Kubernetes")], [("Python", ["p1-b1"])])
    assert summary.select("score", "evidence_coverage", "eligibility").first()[:] == (100, 100, "not_eligible")
    rows, summary = evaluate(spark, [("backend", "required", 2, "")], [("backend", "Python"), ("backend", "PostgreSQL")], [("Python", ["p1-b1"])])
    assert summary.first()["score"] == 50 and rows.first()["outcome"] == "partial"
    assert [tuple(x) for x in rows.first()["evidence"]] == [("p1-b1", "Python")]
    _, summary = evaluate(spark, [("x", "hard_gate", 1, "")], [], [])
    assert summary.select("score", "evidence_coverage", "eligibility").first()[:] == (None, 100, "needs_review")
    _, summary = evaluate(spark, [], [], [])
    assert summary.select("score", "evidence_coverage", "eligibility").first()[:] == (None, 100, "eligible")


def test_refinement_never_erases_proof(spark):
    quote = f"array<struct<blockId:string,quote:string>>"
    base = spark.createDataFrame([(1, r, o, 1.0, "d", [("p1-b1", "Python")]) for r, o in (("a", "met"), ("b", "met"), ("c", "met"), ("d", "partial"), ("e", "not_met"))], f"evaluation_id int, requirement_id string, outcome string, confidence double, reasoning string, evidence {quote}")
    model = spark.createDataFrame([(1, "a", 0, "met", 0.2, "m", []), (1, "a", 1, "not_met", 1.7, "", []), (1, "b", 0, "unknown", 0.3, "m", [("p2-b1", "q")]), (1, "c", 0, "partial", 0.4, "m", None), (1, "d", 0, "met", -1.0, "m", [])], f"evaluation_id int, requirement_id string, position int, outcome string, confidence double, reasoning string, evidence {quote}")
    found = {r["requirement_id"]: (r["outcome"], r["confidence"], r["reasoning"], r["evidence"][0]["blockId"]) for r in assessment.refine_assessments(base, model).collect()}
    assert found == {"a": ("partial", 1.0, "d", "p1-b1"), "b": ("met", 0.3, "m", "p2-b1"), "c": ("met", 0.4, "m", "p1-b1"), "d": ("met", 0.0, "m", "p1-b1"), "e": ("not_met", 1.0, "d", "p1-b1")}


def by_walking(value, rule):
    """What breaks a rule first, by walking the value; None if nothing does."""
    kinds = {"text": str, "bool": bool, "number": (int, float), "object": dict, "list": list}
    if value is None and rule.nullable:
        return None
    if not isinstance(value, kinds[rule.kind]) or (rule.kind == "number" and isinstance(value, bool)):
        return f"not a {rule.kind}"
    if rule.kind in ("text", "list") and not rule.shortest <= len(value) <= (rule.longest if rule.longest is not None else len(value)):
        return "length"
    if (rule.date and not re.fullmatch("[0-9]{4}(-[0-9]{2})?", value)) or (rule.choices and value not in rule.choices):
        return "not allowed"
    if rule.kind == "number" and not rule.low <= value <= rule.high:
        return "range"
    if rule.kind == "list":
        return next((e for e in (by_walking(x, rule.item) for x in value) if e), None)
    if rule.kind != "object":
        return None
    given = lambda n: value.get(n, value.get(modelio.snake(n), ...))
    if set(value) - {x for n in rule.fields for x in (n, modelio.snake(n))}:
        return "unknown field"
    if absent := [n for n, r in rule.fields.items() if r.required and given(n) is ...]:
        return f"missing {absent[0]}"
    return next((e for n, r in rule.fields.items() if given(n) is not ... and (e := by_walking(given(n), r))), None)


def broken(value, rng):
    """A copy of a JSON value with one place changed."""
    if isinstance(value, dict) and value and rng.random() < 0.85:
        key = rng.choice(sorted(value))
        return {k: broken(v, rng) if k == key else v for k, v in value.items()}
    if isinstance(value, list) and value and rng.random() < 0.85:
        at = rng.randrange(len(value))
        return [broken(v, rng) if i == at else v for i, v in enumerate(value)]
    odd = [None, True, 0, 1, -0.5, 7.25, 1e300, 10**40, "", "x", "2020-05", "2020-05\n", "met", "\U0001f600" * 64, "\U0001f600" * 65, "y" * 300, [], {}, [1], ["a"] * 21, {"a": 1}]
    if isinstance(value, dict):
        odd += [{**value, "extra": 1}, dict(list(value.items())[1:]), {modelio.snake(k): v for k, v in value.items()}]
    return rng.choice(odd + ([value * 12, value * 2] if isinstance(value, list) else []))


def test_contracts_agree_with_a_walk_over_the_value(spark):
    rng = random.Random(7)
    quote = {"blockId": "p1-b2", "quote": "q"}
    reached = {"name": "n", "email": None, "phone": "1", "location": "l"}
    job = {"employer": "e", "title": None, "startDate": "2020-05", "endDate": "2021", "isCurrent": False}
    facts = {"schemaVersion": "1", "contact": reached, "skills": [{"canonicalName": "a", "sourceText": "b", "evidence": [quote, quote]}] * 2, "employment": [job], "education": [{"degree": "d"}], "certifications": [{"name": "c"}], "suggestions": [{"title": "t", "detail": "d"}], "warnings": ["w"]}
    one = {"requirementId": "r", "outcome": "met", "confidence": 0.5, "reasoning": "x", "evidence": [quote]}
    whole = {"identity": {"fullName": "n"}, "contact": {"links": ["l"], "phone": None}, "skills": [{"canonicalName": "a", "sourceText": "b", "evidence": [quote]}], "employment": [{**job, "evidence": [quote]}], "projects": [{"name": "p", "evidence": [quote]}], "education": [], "certifications": [], "warnings": [{"code": "c", "message": "m", "evidence": [quote]}]}
    result = {"assessments": [one, {**one, "outcome": "unknown"}], "scoreComponents": {"deterministic": 1, "semantic": 0.25, "assessment": 0}}
    for rule, good in ((modelio.FACTS, facts), (modelio.ASSESSMENTS, {"assessments": [one]}), (modelio.CITED_FACTS, whole), (modelio.CITED_ASSESSMENTS, result)):
        values = [good] + [broken(good, rng) for _ in range(250)]
        want = [by_walking(v, rule) for v in values]
        assert want[0] is None and len(set(want)) > 5
        raw = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
        found = raw.select("i", modelio.strict("raw", rule).alias("x")).select("i", "x.error", F.col("x.value").isNull().alias("gone")).orderBy("i").collect()
        assert [r["error"] for r in found] == want and all(r["gone"] == (r["error"] is not None) for r in found)


def test_strict_values(spark):
    good = '{"requirement_id": "r", "outcome": "met", "confidence": 1, "reasoning": "x", "evidence": null}'.replace(', "evidence": null', "")
    texts = [good, f" {good}\n", None, "", "{", f"{good} x", f"{good}, {good}", f"{good}] [", f"{good}}} {{", good[:-1] + ', "outcome": "met"}', "[]", "null", good.replace("1,", '"0.9",'), good.replace("1,", "true,")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").select("i", modelio.strict("raw", modelio.ASSESSED).alias("x"))
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = [r["x"] for r in rows.orderBy("i").collect()]
    assert [x["error"] for x in found] == [None, None] + ["not JSON"] * 8 + ["not a object"] * 2 + ["not a number"] * 2
    assert found[0]["value"].asDict() == {"requirementId": "r", "outcome": "met", "confidence": 1.0, "reasoning": "x", "evidence": None}


def test_bitmaps_give_the_outcomes_of_pairs(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(1500)]
    required = [(r, rng.choice(names[:40] if r % 2 else names)) for r in range(400) for _ in range(rng.randrange(4))] + [(1, None), (2, "nobody")]
    found = [(d, rng.choice(names[:60])) for d in range(120) for _ in range(40)] + [(3, None), (4, "unasked")]
    needs = spark.createDataFrame([(r % 50, r, rng.choice(["required", "preferred", "hard_gate", "ignored"]), rng.randrange(1, 9)) for r in range(400)], "job_id int, requirement_id int, kind string, weight int")
    sent = spark.createDataFrame([(i, i % 130, i % 53) for i in range(600)], "evaluation_id int, doc_id int, job_id int")
    asked = spark.createDataFrame(required, "requirement_id int, canonical string").distinct().filter("canonical IS NOT NULL")
    known = spark.createDataFrame(found, "doc_id int, canonical string")
    evidence = known.distinct().filter("canonical IS NOT NULL").withColumn("evidence", F.array(F.lit("p1-b1")))
    pairs, summary = assessment.evaluate(sent, needs, asked, evidence)
    bits = assessment.evaluate_bitmaps(sent, needs, spark.createDataFrame(required + required, "requirement_id int, canonical string"), known)
    columns = ["evaluation_id", "doc_id", "job_id", "score", "evidence_coverage", "eligibility"]
    assert sorted(map(repr, summary.select(columns).collect())) == sorted(map(repr, bits.select(columns).collect()))
    rows = bits.select("evaluation_id", F.explode("outcomes").alias("o")).select("evaluation_id", "o.requirement_id", "o.outcome").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, pairs.select("evaluation_id", "requirement_id", "outcome").collect()))
    of = {}
    for d, n in found:
        of.setdefault(d, set()).add(n)
    want = {}
    for r, n in required:
        want.setdefault(r, set()).add(n)
    want = {r: n - {None} for r, n in want.items()}
    met = assessment.meeting_documents(spark.createDataFrame(required, "requirement_id int, canonical string"), known)
    assert sorted(map(tuple, met.collect())) == sorted((r, d) for r, n in want.items() for d in of if n and n <= of[d])
    empty = known.filter("false")
    assert assessment.meeting_documents(asked, empty).count() == 0 and assessment.evaluate_bitmaps(sent, needs, asked.filter("false"), empty).filter("score IS NOT NULL").count() == 0


def test_readiness(spark):
    quotes = "array<struct<canonicalName:string>>"
    schema = f"doc_id int, contact {modelio.CONTACT}, skills {quotes}, employment {modelio.EMPLOYMENT}, education {modelio.EDUCATION}, certifications {modelio.CERTIFICATIONS}"
    facts = spark.createDataFrame([(1, ("A B", "a@b.cd", None, None), [("Python",)], [], [], []), (2, ("A B", "a@b.cd", None, "X"), [("Python",), ("SQL",), ("SQL",)], [("E", "T", None, None, True)], [("I", None, None, None)], None), (3, (None, "", None, None), [], None, None, None)], schema)
    rows = {r["doc_id"]: r for r in readiness.readiness_report(facts, F.array(F.lit("SQL"), F.lit("Go"))).collect()}
    assert [rows[i]["score"] for i in (1, 2, 3)] == [55, 78, 20]
    assert rows[1]["suggestions"][-1]["detail"].startswith("The job description mentions Go, SQL.")
    assert [s["title"] for s in rows[3]["suggestions"]][:2] == ["Add a clear name", "Add contact details"]


def test_suggestions_keep_the_first_of_a_title(spark):
    rows = [(1, 0, 0, "Same", "a"), (1, 1, 0, " same ", "b"), *[(1, 1, i, f"T{i}", "x") for i in range(1, 21)], (1, 0, 1, " ", "x")]
    out = modelio.merge_suggestions(spark.createDataFrame(rows, "doc_id int, rank int, position int, title string, detail string")).orderBy("place").collect()
    assert len(out) == 10 and (out[0]["title"], out[0]["detail"]) == ("Same", "a")


def test_ranking_puts_missing_scores_last(spark):
    rows = spark.createDataFrame([(1, 1, None, 5), (2, 1, 50, 1), (3, 1, 50, 2), (4, 1, 90, 0)], "evaluation_id int, job_id int, score int, created_at int")
    assert [r["evaluation_id"] for r in ranking.rank_evaluations(rows).orderBy("place").collect()] == [4, 3, 2, 1]
    assert ranking.top_k(rows, 2).count() == 2


def test_invitation_and_violations(spark):
    inv = spark.createDataFrame([(1, "tok", "CODE")], "invitation_id int, t string, c string").select("invitation_id", F.sha2("t", 256).alias("token_hash"), F.sha2("c", 256).alias("passcode_hash"))
    asked = spark.createDataFrame([(1, "tok"), (2, "code"), (3, "no")], "ask_id int, code string")
    assert {r["ask_id"]: r["invitation_id"] for r in integrity.invitation_lookup(asked, inv).collect()} == {1: 1, 2: 1, 3: None}
    t = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert integrity.unique_violations([("k", t, ["k"])]).first()["n"] == 2
    assert integrity.fk_violations([("k", t, spark.createDataFrame([(2,)], "k int"), ["k"])]).count() == 1


def test_insert_if_absent_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    once = assessment.insert_if_absent(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, assessment.insert_if_absent(once, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (1, "x", "2024-01-01 00:01:00"), (2, "x", "2024-01-01 00:02:00")], "k int, v string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_dedupe(jobs.file_stream(spark, str(tmp_path / "in"), events.schema, 1), ["k"])
    jobs.stream_facts(stream, lambda b: b.select("k"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_job_state(spark):
    rows = [(1, "2024-01-01", 1, "failed", "e1"), (1, "2024-01-02", 2, "failed", "e2"), (1, "2024-01-03", 3, "failed", "e3"), (2, "2024-01-01", 4, "failed", "e"), (3, "2024-01-01", 5, "failed", "e"), (3, "2024-01-02", 6, "completed", None)]
    found = jobs.job_state(spark.createDataFrame(rows, "job_id int, ts string, event_id int, status string, error string")).collect()
    assert {r["job_id"]: (r["state"], r["attempts"], r["last_error"]) for r in found} == {1: ("dead", 3, "e3"), 2: ("ready", 1, "e"), 3: ("completed", 1, "e")}


def test_no_docx_ends_the_job(spark):
    """Encrypted, damaged, of an unknown method, too large, without a body, odd XML: a reason each."""
    good = package(**{"word__document.xml": BODY})
    at = good.index(b"PK\x01\x02")  # the archive's own directory
    encrypted, unknown, damaged = bytearray(good), bytearray(good), bytearray(good)
    encrypted[6] |= 1
    encrypted[at + 8] |= 1
    unknown[8] = unknown[at + 10] = 99
    start = 30 + len("word/document.xml")
    damaged[start : start + 40] = b"\xff" * 40
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", BODY)
    cut = bytearray(stored.getvalue())
    cut[start : start + 20] = b"\xff" * 20
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b" " * (source.MAX_BODY + 1))
    odd = [bytes(encrypted), bytes(unknown), bytes(damaged), bytes(cut), good[: len(good) // 2], package(**{"other.xml": BODY}), package(**{"word__document.xml": '<?xml version="1.0" encoding="none"?><w/>'}), b"", None]
    rows = [("good", good), ("big", big.getvalue()), *((f"odd{i}", x) for i, x in enumerate(odd))]
    found = {r["doc_id"]: (r["text"], r["reason"]) for r in source.docx_blocks(spark.createDataFrame(rows, "doc_id string, content binary")).collect()}
    assert found.pop("good") == ("One line\nTwo", None) and found.pop("big") == (None, "Resume DOCX body is too large")
    assert set(found.values()) == {(None, "Resume DOCX could not be parsed")} and len(found) == len(odd)


def test_documents_that_cite_evidence(spark):
    quote = {"blockId": "p1-b2", "quote": "Ran a bakery."}
    whole = {"skills": [{"canonicalName": "Baking", "sourceText": "bakery", "evidence": [quote]}], "employment": [], "projects": [], "education": [], "certifications": [], "warnings": []}
    job = {"isCurrent": True, "startDate": "2020-05", "evidence": [quote]}
    cases = [
        (whole, None),
        (whole | {"identity": None, "contact": {"links": ["x"] * 20}, "schemaVersion": "7"}, None),
        (whole | {"employment": [job | {"description": "d" * 8000}], "projects": [{"name": "p", "evidence": [quote] * 50}]}, None),
        (whole | {"warnings": [{"code": "c", "message": "m"}]}, None),
        (whole | {"employment": [job | {"description": "d" * 8001}]}, "length"),
        (whole | {"employment": [job | {"isCurrent": "yes"}]}, "not a bool"),
        (whole | {"projects": [{"name": "p", "evidence": [quote] * 51}]}, "length"),
        (whole | {"contact": {"links": ["x"] * 21}}, "length"),
        (whole | {"identity": {"fullName": "n", "evidence": [quote] * 11}}, "length"),
        (whole | {"warnings": [{"code": "", "message": "m"}]}, "length"),
        (whole | {"skills": [{"canonicalName": "Baking", "sourceText": "b", "evidence": [quote | {"page": 1}]}]}, "unknown field"),
        (whole | {"skills": None}, "not a list"),
        ([], "not a object"),
    ]
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, raw string")
    rows = modelio.strict_document(raw).orderBy("i").collect()
    assert [r["error"] for r in rows] == [e for _, e in cases] and all((r["facts"] is None) == (r["error"] is not None) for r in rows)
    assert rows[0]["facts"]["schemaVersion"] == "1" and rows[1]["facts"]["schemaVersion"] == "7" and rows[1]["facts"]["contact"]["evidence"] == []
    assert rows[0]["facts"]["skills"][0]["evidence"][0]["blockId"] == "p1-b2" and rows[3]["facts"]["warnings"][0]["evidence"] == []
    one = {"requirementId": "r", "outcome": "met", "confidence": 0.5, "reasoning": "r", "evidence": [quote]}
    results = [({"assessments": [one], "scoreComponents": {"deterministic": 1, "semantic": 0, "assessment": 0.5}}, None), ({"assessments": [one | {"evidence": []}]}, "confirmed outcome without evidence"), ({"assessments": [one | {"outcome": "unknown", "evidence": []}]}, None), ({"assessments": [], "scoreComponents": {"deterministic": 2, "semantic": 0, "assessment": 0}}, "range")]
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(results)], "i int, raw string")
    assert [r["error"] for r in modelio.strict_assessment_result(raw).orderBy("i").collect()] == [e for _, e in results]


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(12)
    hour = 3600
    times = lambda: rng.choice([rng.randrange(-40 * hour, 400 * hour), rng.randrange(100) * hour, rng.randrange(10**9)])
    windows = [(i, rng.randrange(3), (a := times()), a + rng.choice([0, 1, -5, hour, 16 * hour, 300 * hour, rng.randrange(10**8), 10**9])) for i in range(80)] + [(80, 1, None, 5), (81, 1, 5, None)]
    events = [(i, rng.choice([0, 1, 2, None]), rng.choice([times(), rng.choice(windows[:80])[2], rng.choice(windows[:80])[3], None])) for i in range(300)]
    w = spark.createDataFrame(windows, "window_id int, job_id int, o long, c long").selectExpr("window_id", "job_id", "timestamp_seconds(o) AS opens", "timestamp_seconds(c) AS closes")
    e = spark.createDataFrame(events, "event_id int, job_id int, s long").selectExpr("event_id", "job_id", "timestamp_seconds(s) AS at")
    got = sorted((r.event_id, r.window_id) for r in admission.interval_join(e, w, "job_id").select("event_id", "window_id").collect())
    assert got == sorted((i, k) for i, j, s in events for k, job, o, c in windows if j is not None and j == job and None not in (s, o, c) and o <= s < c)
    assert len(got) > 500


def test_search_index_equals_contains(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, rng.choice([None, ""]) if i % 17 == 0 else "".join(rng.choice("abAB é@.") for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    rows = spark.createDataFrame(texts, "k int, text string")
    search.write_index(search.gram_index(rows, "k", "text"), str(tmp_path / "index"))
    index = search.read_index(spark, str(tmp_path / "index"))
    needles = [rng.choice(["", " ", "a", "B", "ab", "é", "zz", None, *("".join(rng.choice("abAB é@.") for _ in range(n)) for n in (2, 3, 4, 5, 7))]) for _ in range(60)] + ["aaa", "aaaa", " Ab "]
    got = sorted((r.needle, r.k) for r in search.search(index, rows, "k", "text", spark.createDataFrame([(n,) for n in needles], "needle string")).collect())
    want = sorted((n, k) for n in {x for x in needles if x and x.strip(" ")} for k, t in texts if n.strip(" ").lower() in (t or "").lower())
    assert got == want and len(got) > 300
    plan = search.search(index, rows, "k", "text", spark.createDataFrame([("abcd",)], "needle string"))
    assert plan.count() == 0 and search.search(index.limit(0), rows, "k", "text", spark.createDataFrame([("a",)], "needle string")).count() == 0


def test_a_hot_job_is_ranked_by_many_tasks(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, 1, 2, 3]), rng.randrange(5), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "job_id int, score int, created_at int, evaluation_id int").repartition(5)
    got = ranking.rank_all(frame, str(tmp_path / "ranked"))
    assert sorted(map(str, got.collect())) == sorted(map(str, ranking.rank_evaluations(frame).select(*got.columns).collect()))
    held = spark.read.parquet(str(tmp_path / "ranked")).filter("job_id = 1").groupBy("_range").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 1500
    assert ranking.rank_all(frame.limit(0), str(tmp_path / "none")).count() == 0
