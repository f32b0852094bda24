"""Model outputs: strict validation of raw JSON, evidence pruning, and first-wins merges into facts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fold, missing, strip

#: Partial dates, and the codes after which a request is tried again.
DATE = r"\A[0-9]{4}(-[0-9]{2})?\z"
RETRYABLE_STATUS = (408, 409, 429, 500, 502, 503, 504, 529)
RETRYABLE_CODES = ("rate_limit_exceeded", "provider_overloaded", "provider_unavailable", "timeout")


#: What ``schema_of_variant`` calls the values of each plain kind, and the type that they are read as.
KINDS = {"text": (("STRING",), "string"), "bool": (("BOOLEAN",), "boolean"), "number": (("BIGINT", "DOUBLE", "DECIMAL"), "double")}


#: Names of lambda arguments.
_names = count()


def bound(value: str, use: Callable[[str], str]) -> str:
    """SQL of ``use(value)`` with the value worked out once, however often it is named."""
    x = f"x{next(_names)}"
    return f"transform(array({value}), {x} -> {use(x)})[0]"


def members(value: str) -> str:
    """An object's fields, null for any other variant."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def entries(value: str) -> str:
    """A list's items, null for any other variant."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def case(*steps: tuple[str, str], otherwise: str = "NULL") -> str:
    return f"CASE {' '.join(f'WHEN {test} THEN {what}' for test, what in steps)} ELSE {otherwise} END"


@dataclass(frozen=True)
class Rule:
    """What a JSON value has to be: kind text, bool, number, object or list. Rules become SQL expressions on variants."""

    kind: str
    required: bool = True
    nullable: bool = False
    shortest: int = 0
    longest: int | None = None
    date: bool = False
    choices: tuple[str, ...] = ()
    low: float = float("-inf")
    high: float = float("inf")
    fields: dict[str, Rule] = field(default_factory=dict)
    item: Rule | None = None

    def problem(self, value: str) -> str:
        """What is wrong first, in the contract's order of fields; null if the variant fits. Nothing is converted."""
        if self.kind == "object":
            found = bound(members(value), self._of_members)
        elif self.kind == "list":
            found = bound(entries(value), self._of_entries)
        else:
            found = self._of_plain(value)
        return case((f"NOT is_variant_null({value})", found)) if self.nullable else found

    def _of_plain(self, value: str) -> str:
        names, as_type = KINDS[self.kind]
        x = f"try_variant_get({value}, '$', '{as_type}')"
        steps = [(f"substring_index(schema_of_variant({value}), '(', 1) NOT IN ({', '.join(map(repr, names))})", f"'not a {self.kind}'")]
        if self.kind == "text":
            steps += self._length(f"char_length({x})")
        if self.date:
            steps.append((f"NOT rlike({x}, r'{DATE}')", "'not allowed'"))
        if self.choices:
            steps.append((f"{x} NOT IN ({', '.join(map(repr, self.choices))})", "'not allowed'"))
        if self.kind == "number" and self.low > float("-inf"):
            steps.append((f"NOT ({x} BETWEEN {self.low} AND {self.high})", "'range'"))
        return case(*steps)

    def _length(self, n: str) -> list[tuple[str, str]]:
        least = [(f"{n} < {self.shortest}", "'length'")] if self.shortest else []
        return least + ([(f"{n} > {self.longest}", "'length'")] if self.longest is not None else [])

    def _of_entries(self, items: str) -> str:
        x = f"x{next(_names)}"
        first = f"get(filter(transform({items}, {x} -> {self.item.problem(x)}), e -> e IS NOT NULL), 0)"
        return case((f"{items} IS NULL", "'not a list'"), *self._length(f"size({items})"), otherwise=first)

    def _of_members(self, found: str) -> str:
        names = ", ".join(repr(n) for k in self.fields for n in dict.fromkeys((k, snake(k))))
        steps = [(f"{found} IS NULL", "'not a object'"), (f"size(array_except(map_keys({found}), array({names}))) > 0", "'unknown field'")]
        steps += [(f"{given(found, n)} IS NULL", f"'missing {n}'") for n, r in self.fields.items() if r.required]
        inner = [bound(given(found, n), lambda x, r=r: case((f"{x} IS NOT NULL", r.problem(x)))) for n, r in self.fields.items()]
        return case(*steps, otherwise=f"coalesce({', '.join(inner)})")

    def typed(self, value: str) -> str:
        """A variant that fits as a struct, array, text, boolean or double; null where it is absent or null."""
        if self.kind == "object":
            row = lambda m: ", ".join(f"'{n}', {r.typed(given(m, n))}" for n, r in self.fields.items())
            return bound(members(value), lambda m: case((f"{m} IS NOT NULL", f"named_struct({row(m)})")))
        if self.kind == "list":
            x = f"x{next(_names)}"
            return f"transform({entries(value)}, {x} -> {self.item.typed(x)})"
        return f"try_variant_get({value}, '$', '{KINDS[self.kind][1]}')"


def given(found: str, name: str) -> str:
    """A field under its contract name, else in snake case."""
    places = [f"try_element_at({found}, {n!r})" for n in dict.fromkeys((name, snake(name)))]
    return f"coalesce({', '.join(places)})"


def snake(name: str) -> str:
    return re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name)


def text(longest=None, shortest=1, **more) -> Rule:
    return Rule("text", shortest=shortest, longest=longest, **more)


def maybe(longest=None, **more) -> Rule:
    return Rule("text", required=False, nullable=True, longest=longest, **more)


def record(**fields) -> Rule:
    return Rule("object", fields=fields)


def many(item: Rule, longest: int, required=True, shortest=0) -> Rule:
    return Rule("list", item=item, longest=longest, required=required, shortest=shortest)


QUOTE = record(blockId=text(128), quote=text(2000))
OUTCOMES = ("met", "partial", "not_met", "unknown")
#: The contracts of extracted facts and of assessments.
FACTS = record(
    schemaVersion=Rule("text", required=False),
    contact=record(name=maybe(256), email=maybe(320), phone=maybe(64), location=maybe(256)),
    skills=many(record(canonicalName=text(128), sourceText=text(1000), evidence=many(QUOTE, 20, shortest=1)), 200),
    employment=many(record(employer=maybe(256), title=maybe(256), startDate=maybe(date=True), endDate=maybe(date=True), isCurrent=Rule("bool")), 100),
    education=many(record(institution=maybe(256), degree=maybe(256), fieldOfStudy=maybe(256), graduationDate=maybe(date=True)), 50),
    certifications=many(record(name=text(256), issuer=maybe(256)), 100),
    suggestions=many(record(title=text(200), detail=text(1000)), 10, required=False),
    warnings=many(Rule("text"), 50, required=False),
)
ASSESSED = record(requirementId=text(128), outcome=Rule("text", choices=OUTCOMES), confidence=Rule("number", low=0, high=1), reasoning=text(2000), evidence=many(QUOTE, 20, required=False))
ASSESSMENTS = record(assessments=many(ASSESSED, 200))


def cited(longest: int, needed: bool = True, **fields) -> Rule:
    """A record with its evidence: at least one reference where that is needed."""
    return record(**fields, evidence=many(QUOTE, longest, required=needed, shortest=int(needed)))


#: The contract of whole documents, where each fact cites its evidence.
WARNING = cited(20, needed=False, code=text(64), message=text(1000))
IDENTITY = cited(10, needed=False, fullName=maybe(256))
REACHED = cited(20, needed=False, email=maybe(320), phone=maybe(64), location=maybe(256), links=many(Rule("text"), 20, required=False))
CITED_FACTS = record(
    schemaVersion=Rule("text", required=False),
    identity=replace(IDENTITY, required=False, nullable=True),
    contact=replace(REACHED, required=False, nullable=True),
    skills=many(cited(20, canonicalName=text(128), sourceText=text(1000)), 200),
    employment=many(cited(50, employer=maybe(256), title=maybe(256), startDate=maybe(date=True), endDate=maybe(date=True), isCurrent=Rule("bool"), description=maybe(8000)), 100),
    projects=many(cited(50, name=text(256), description=maybe(8000)), 100),
    education=many(cited(20, institution=maybe(256), degree=maybe(256), fieldOfStudy=maybe(256), graduationDate=maybe(date=True)), 50),
    certifications=many(cited(20, name=text(256), issuer=maybe(256), issuedDate=maybe(date=True), expiresDate=maybe(date=True)), 100),
    warnings=many(WARNING, 100),
)
CITED_ASSESSED = record(**ASSESSED.fields, warnings=many(WARNING, 20, required=False))
CITED_ASSESSMENTS = record(
    schemaVersion=Rule("text", required=False), scoringPolicyVersion=Rule("text", required=False), assessments=many(CITED_ASSESSED, 200),
    scoreComponents=Rule("object", required=False, nullable=True, fields={n: Rule("number", low=0, high=1) for n in ("deterministic", "semantic", "assessment")}),
)
#: Facts as a struct.
CONTACT = "struct<name:string,email:string,phone:string,location:string>"
QUOTES = "array<struct<blockId:string,quote:string>>"
EMPLOYMENT = "array<struct<employer:string,title:string,startDate:string,endDate:string,isCurrent:boolean>>"
EDUCATION = "array<struct<institution:string,degree:string,fieldOfStudy:string,graduationDate:string>>"
CERTIFICATIONS = "array<struct<name:string,issuer:string>>"
SUGGESTIONS = "array<struct<title:string,detail:string>>"


def strict(raw: str, rule: Rule) -> Column:
    """Of the JSON text in column ``raw``: ``value`` (typed, under its contract names; null if anything in it breaks the
    contract) and ``error``.

    The text is parsed as a variant, which keeps each value's own type: 42 is no text. A parser that stops after the
    first value would take ``{} x``: inside a list and inside an object, only text that is one value parses to one. Null
    and empty texts are not JSON, nor is an object that names a field twice.
    """

    def judge(value: str) -> str:
        error = case((f"{value} IS NULL", "'not JSON'"), otherwise=rule.problem(value))
        return bound(error, lambda e: f"named_struct('value', {case((f'{e} IS NULL', rule.typed(value)))}, 'error', {e})")

    one = entries(f"try_parse_json(concat('[', {raw}, ']'))")
    alone = "try_parse_json(concat('{\"value\":', " + raw + ", '}')) IS NOT NULL"
    return F.expr(bound(bound(one, lambda x: case((f"size({x}) = 1 AND {alone}", f"get({x}, 0)"))), judge))


def _checked(documents: DataFrame, rule: Rule) -> DataFrame:
    """``checked``: as a generated column, below which no filter is pushed that would judge each document again."""
    return documents.select("*", F.explode(F.array(strict("raw", rule))).alias("checked"))


def strict_facts(documents: DataFrame) -> DataFrame:
    """``raw`` -> ``facts`` (typed, null if invalid) and ``error``."""
    return _checked(documents, FACTS).withColumns({"facts": F.col("checked.value"), "error": F.col("checked.error")}).drop("checked")


def strict_assessments(documents: DataFrame) -> DataFrame:
    return _checked(documents, ASSESSMENTS).withColumns({"assessments": F.col("checked.value.assessments"), "error": F.col("checked.error")}).drop("checked")


def strict_cited(documents: DataFrame) -> DataFrame:
    """The stricter contract for single assessments: also a confirmed outcome needs evidence."""
    checked, one = _checked(documents, ASSESSED), F.col("checked.value")
    bare = (one["outcome"] != "unknown") & (F.size(F.coalesce(one["evidence"], F.array().cast(QUOTES))) == 0)
    checked = checked.withColumn("error", F.when(bare, "confirmed outcome without evidence").otherwise(F.col("checked.error")))
    return checked.withColumn("assessment", F.when(F.col("error").isNull(), one)).drop("checked")


def strict_document(documents: DataFrame) -> DataFrame:
    """``raw`` -> ``facts`` (typed, null if invalid) and ``error``, by the contract where every fact cites evidence.

    ``facts.schemaVersion`` is 1 where it isn't given, lists that may be absent are empty.
    """
    checked, facts = _checked(documents, CITED_FACTS), F.col("checked.value")
    none, links = F.array().cast(QUOTES), F.array().cast("array<string>")
    whole = facts.withField("schemaVersion", F.coalesce(facts["schemaVersion"], F.lit("1")))
    whole = whole.withField("identity", F.when(facts["identity"].isNotNull(), facts["identity"].withField("evidence", F.coalesce(facts["identity"]["evidence"], none))))
    reached = facts["contact"].withField("evidence", F.coalesce(facts["contact"]["evidence"], none)).withField("links", F.coalesce(facts["contact"]["links"], links))
    whole = whole.withField("contact", F.when(facts["contact"].isNotNull(), reached))
    whole = whole.withField("warnings", F.transform(facts["warnings"], lambda w: w.withField("evidence", F.coalesce(w["evidence"], none))))
    return checked.withColumns({"facts": F.when(facts.isNotNull(), whole), "error": F.col("checked.error")}).drop("checked")


def strict_assessment_result(documents: DataFrame) -> DataFrame:
    """``raw`` -> ``result`` (typed, null if invalid) and ``error``: assessments of a document, confirmed ones with evidence."""
    checked, found = _checked(documents, CITED_ASSESSMENTS), F.col("checked.value")
    bare = F.exists(found["assessments"], lambda a: (a["outcome"] != "unknown") & (F.size(F.coalesce(a["evidence"], F.array().cast(QUOTES))) == 0))
    checked = checked.withColumn("error", F.when(bare, "confirmed outcome without evidence").otherwise(F.col("checked.error")))
    return checked.withColumn("result", F.when(F.col("error").isNull(), found)).drop("checked")


def prune_evidence(skills: Column, block_ids: Column) -> Column:
    """Skills with only evidence from known blocks; those left without any go."""
    cited = F.transform(skills, lambda s: s.withField("evidence", F.filter(s["evidence"], lambda e: F.array_contains(block_ids, e["blockId"]))))
    return F.filter(cited, lambda s: F.size(s["evidence"]) > 0)


def prune_warning(warnings: Column, before: Column, after: Column) -> Column:
    dropped = F.size(before) - F.size(after)
    kept = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.when(dropped > 0, F.concat(kept, F.array(F.concat(dropped.cast("string"), F.lit(" skills lacked valid evidence"))))).otherwise(kept)


def degrade_unsupported(entries: DataFrame, requirements: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, requirement_id, outcome, confidence, evidence`` and more: unknown requirements go, foreign evidence goes,
    and an outcome left without evidence becomes unknown with at most half confidence."""
    ids = blocks.groupBy("doc_id").agg(F.collect_set("block_id").alias("ids"))
    own = entries.join(requirements.select("requirement_id").distinct(), "requirement_id", "left_semi").join(ids, "doc_id", "left")
    known = F.coalesce("ids", F.array().cast("array<string>"))
    own = own.withColumn("evidence", F.filter(F.coalesce("evidence", F.array().cast(QUOTES)), lambda e: F.array_contains(known, e["blockId"])))
    bare = (F.col("outcome") != "unknown") & (F.size("evidence") == 0)
    return own.withColumns({"confidence": F.when(bare, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")), "outcome": F.when(bare, "unknown").otherwise(F.col("outcome"))}).drop("ids")


def merge_skills(deterministic: DataFrame, extracted: DataFrame, aliases: DataFrame, categories: DataFrame) -> DataFrame:
    """``doc_id, canonical, category, evidence``: own skills first, then extracted ones under names not yet taken.

    ``deterministic(doc_id, canonical, category, evidence)``; ``extracted(doc_id, position, name, evidence)`` with block
    ids in block order. An extracted name that is taken as written, or whose canonical name is, adds nothing.
    """
    own = deterministic.withColumn("key", fold(F.col("canonical")))
    new = extracted.withColumn("name", strip(F.col("name"))).filter("name <> ''").withColumn("alias", fold(F.col("name")))
    taken = own.select("doc_id", F.col("key").alias("alias"))
    new = new.join(taken, ["doc_id", "alias"], "left_anti").join(aliases.select("alias", F.col("canonical").alias("known")), "alias", "left")
    new = new.withColumn("canonical", F.coalesce("known", "name")).withColumn("key", fold(F.col("canonical")))
    new = new.join(categories.select("key", "category"), "key", "left").select("doc_id", "key", F.lit(1).alias("rank"), "position", F.struct("canonical", "category", F.array_distinct("evidence").alias("evidence")).alias("x"))
    own = own.select("doc_id", "key", F.lit(0).alias("rank"), F.lit(0).alias("position"), F.struct("canonical", "category", "evidence").alias("x"))
    first = own.unionByName(new).groupBy("doc_id", "key").agg(F.min_by("x", F.struct("rank", "position")).alias("x"))
    return first.select("doc_id", "x.canonical", "x.category", "x.evidence")


def merge_contact(own: Column, extracted: Column) -> Column:
    """Per field the own value, else the extracted one; empty counts as missing."""
    return F.struct(*(F.coalesce(missing(own[k]) if k != "phone" else F.lit(None).cast("string"), missing(extracted[k])).alias(k) for k in ("name", "email", "phone", "location")))


def merge_facts(own: DataFrame, extracted: DataFrame, skills: DataFrame) -> DataFrame:
    """``doc_id, contact, skills, employment, education, certifications, warnings`` from both sides.

    ``own(doc_id, contact)``, ``extracted(doc_id, facts)``, ``skills`` from ``merge_skills``.
    """
    item = F.struct(fold(F.col("canonical")).alias("key"), F.struct("canonical", "category", "evidence").alias("x"))
    order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    nested = skills.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item), order), lambda x: x["x"]).alias("skills"))
    joined = own.select("doc_id", F.col("contact").alias("own")).join(extracted.select("doc_id", "facts"), "doc_id", "left").join(nested, "doc_id", "left")
    rest = {k: F.coalesce(F.col(f"facts.{k}"), F.array().cast(t)) for k, t in (("employment", EMPLOYMENT), ("education", EDUCATION), ("certifications", CERTIFICATIONS), ("warnings", "array<string>"))}
    return joined.select("doc_id", merge_contact(F.col("own"), F.col("facts")["contact"]).alias("contact"), F.coalesce("skills", F.array().cast(nested.schema["skills"].dataType)).alias("skills"), *(c.alias(k) for k, c in rest.items()))


def merge_suggestions(suggestions: DataFrame, limit: int = 10) -> DataFrame:
    """``doc_id, rank, position, title, detail`` -> the first of each folded title, in order, up to ``limit`` a document."""
    rows = suggestions.withColumn("title", strip(F.col("title"))).filter("title <> ''")
    first = rows.groupBy("doc_id", fold(F.col("title")).alias("key")).agg(F.min(F.struct("rank", "position", "title", "detail")).alias("x"))
    kept = first.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("x")), 1, limit).alias("x"))
    return kept.select("doc_id", F.posexplode("x").alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("place"), "x.title", "x.detail")


def completion_triage(responses: DataFrame) -> DataFrame:
    """``http_status, body`` -> ``outcome`` (ok, retryable, fatal), ``reason`` and ``content``."""
    get = lambda path: F.get_json_object("body", path)
    is_json = F.try_parse_json("body").isNotNull()
    is_object = F.startswith(F.ltrim("body"), F.lit("{"))
    by_status = F.when(F.col("http_status").isin(*RETRYABLE_STATUS), "retryable").otherwise("fatal")
    said = F.when(F.col("http_status").isin(*RETRYABLE_STATUS), F.lit(None)).when(F.col("http_status") == 402, "Model credits are exhausted").when(F.col("http_status").isin(401, 403), "Model credentials were rejected")
    error, message = get("$.error"), F.coalesce(missing(get("$.error.message")), get("$.error.code"), F.lit(""))
    has_error = F.startswith(F.ltrim(error), F.lit("{"))
    annotated = ~F.coalesce(get("$.error.metadata.file_annotations"), F.lit("[]")).isin("[]", "{}", "", "false", "0", "null")
    finish, content, refusal = get("$.choices[0].finish_reason"), F.coalesce(get("$.choices[0].message.content"), F.lit("")), F.coalesce(get("$.choices[0].message.refusal"), F.lit(""))
    choice = get("$.choices[0]")
    steps = [
        (~F.coalesce(is_json, F.lit(False)), by_status, F.coalesce(said, F.lit("Model returned invalid JSON"))),
        (~is_object, by_status, F.coalesce(said, F.lit("Model response is not an object"))),
        (F.col("http_status") != 200, by_status, F.coalesce(said, missing(get("$.error.message")), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))),
        (has_error, F.when(~annotated & get("$.error.code").isin(*RETRYABLE_CODES), "retryable").otherwise("fatal"), message),
        (choice.isNull(), F.lit("fatal"), F.lit("Model response has no choices")),
        (~F.startswith(F.ltrim(choice), F.lit("{")), F.lit("fatal"), F.lit("Model response choice is malformed")),
        (finish == "length", F.lit("retryable"), F.lit("Model output was truncated")),
        (finish.isNotNull() & (finish != "stop"), F.lit("fatal"), F.concat(F.lit("Model stopped early: "), finish)),
        ((strip(content) == "") & (refusal != ""), F.lit("fatal"), F.lit("Model refused the extraction request")),
        (strip(content) == "", F.lit("fatal"), F.lit("Model response is empty")),
        (F.try_parse_json(content).isNull(), F.lit("fatal"), F.lit("Model response is not valid JSON")),
        (~F.startswith(F.ltrim(content), F.lit("{")), F.lit("fatal"), F.lit("Model response is not a JSON object")),
    ]
    outcome, reason = F, F
    for test, what, why in steps:
        test = F.coalesce(test, F.lit(False))
        outcome, reason = outcome.when(test, what), reason.when(test, why)
    out = responses.withColumns({"outcome": outcome.otherwise("ok"), "reason": reason})
    return out.withColumn("content", F.when(F.col("outcome") == "ok", content))


def request_rows(evaluations: DataFrame, requirements: DataFrame, documents: DataFrame) -> DataFrame:
    """``evaluation_id, request``: the batch-inference record of each evaluation, as JSON.

    ``requirements(job_id, requirement_id, normalized_text)``; ``documents(doc_id, document)`` labelled texts.
    """
    line = F.concat(F.lit("- id: "), F.col("requirement_id").cast("string"), F.lit(" | text: "), F.coalesce("normalized_text", F.lit("")))
    asked = requirements.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("requirement_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("asked"))
    part = lambda tag, c: F.struct(F.lit("text").alias("type"), F.concat(F.lit(f"<{tag}>\n"), c, F.lit(f"\n</{tag}>")).alias("text"))
    joined = evaluations.join(asked, "job_id").join(documents, "doc_id")
    return joined.select("evaluation_id", F.to_json(F.struct(F.array(part("job_requirements", F.col("asked")), part("resume_document", F.col("document"))).alias("content"))).alias("request"))
