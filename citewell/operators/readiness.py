"""Private readiness report: score, suggestions, gap to a role, and the lines of a corrected document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fold, missing, strip

#: Points of a report, names that a gap lists at most, and the titles and texts of its advice.
BASE, NAME, EMAIL, LOCATION, SKILL, MOST_SKILLS, EMPLOYED, EDUCATED, CERTIFIED, MOST = 20, 15, 15, 10, 5, 25, 5, 3, 2, 100
MAX_LISTED_GAPS = 8
NO_NAME = ("Add a clear name", "Start the resume with your name.")
NO_EMAIL = ("Add contact details", "Include a professional email address.")
NO_SKILLS = ("Make skills easier to verify", "Name the tools and technologies you used in your experience.")
NO_EMPLOYMENT = ("Document your experience", "List each role with the employer, title, and dates so your experience can be verified.")
NO_EDUCATION = ("Add education or certifications", "Include degrees or credentials with their issuing institutions and dates.")
NO_GAP = ("Connect experience to the role", "Use specific outcomes to show how your documented skills apply to this role.")
GAP = ("Review role-specific evidence", "The job description mentions ", ". Add them only when your resume already supports the claim.")


def _any(entries: Column) -> Column:
    return F.coalesce(F.size(entries) > 0, F.lit(False))


def _filled(value: Column) -> Column:
    return missing(value).isNotNull()


def documented_names(skills: Column) -> Column:
    """Distinct canonical names that aren't empty, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(skills, lambda s: s["canonicalName"]), lambda n: n.isNotNull() & (n != ""))))


def readiness_score(contact: Column, names: Column, employment: Column, education: Column, certifications: Column) -> Column:
    points = lambda test, n: F.when(test, n).otherwise(0)
    total = (
        F.lit(BASE)
        + points(_filled(contact["name"]), NAME)
        + points(_filled(contact["email"]), EMAIL)
        + points(_filled(contact["location"]), LOCATION)
        + F.least(F.lit(MOST_SKILLS), SKILL * F.size(names))
        + points(_any(employment), EMPLOYED)
        + points(_any(education), EDUCATED)
        + points(_any(certifications), CERTIFIED)
    )
    return F.least(F.lit(MOST), total).cast("int")


def _advice(test: Column, title: str, detail) -> Column:
    return F.when(test, F.struct(F.lit(title).alias("title"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))


def readiness_suggestions(contact: Column, names: Column, employment: Column, education: Column, certifications: Column) -> Column:
    advice = F.array(
        _advice(~_filled(contact["name"]), *NO_NAME),
        _advice(~_filled(contact["email"]), *NO_EMAIL),
        _advice(F.size(names) == 0, *NO_SKILLS),
        _advice(~_any(employment), *NO_EMPLOYMENT),
        _advice(~_any(education) & ~_any(certifications), *NO_EDUCATION),
    )
    return F.filter(advice, lambda a: a.isNotNull())


def role_gap(mentioned: Column, names: Column) -> Column:
    """One suggestion: the first missing names of the role in order, or how to connect what is documented."""
    gap = F.array_sort(F.array_except(mentioned, names))
    listed = F.concat(F.lit(GAP[1]), F.array_join(F.slice(gap, 1, MAX_LISTED_GAPS), ", "), F.lit(GAP[2]))
    none = _advice(F.lit(True), *NO_GAP)
    return F.when(F.size(gap) == 0, none).otherwise(_advice(F.lit(True), GAP[0], listed))


def readiness_report(facts: DataFrame, mentioned: Column) -> DataFrame:
    """``doc_id, score, suggestions`` of ``facts(doc_id, contact, skills, employment, education, certifications)``.

    ``mentioned``: the names that the job text has, null if none is given.
    """
    rows = facts.withColumn("names", documented_names(F.col("skills")))
    parts = [F.col(c) for c in ("contact", "names", "employment", "education", "certifications")]
    base = readiness_suggestions(*parts)
    return rows.select("doc_id", readiness_score(*parts).alias("score"), F.when(mentioned.isNull(), base).otherwise(F.concat(base, F.array(role_gap(mentioned, F.col("names"))))).alias("suggestions"))


def skills_by_category(skills: DataFrame) -> DataFrame:
    """``doc_id, category, canonical`` -> ``doc_id, category, names``; without a category "Other"; names by folded order."""
    rows = skills.filter(F.regexp_like(F.coalesce("canonical", F.lit("")), F.lit(r"\S"))).withColumn("category", F.when(strip(F.coalesce("category", F.lit(""))) == "", "Other").otherwise(F.col("category")))
    item = F.struct(fold(F.col("canonical")).alias("key"), "canonical")
    return rows.groupBy("doc_id", "category").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["canonical"]).alias("names"))


def _shown(value: Column) -> Column:
    """The text, null if it has nothing visible."""
    return F.when(strip(value) != "", value)


def _joined(sep: str, *parts: Column) -> Column:
    return missing(F.concat_ws(sep, *(_shown(p) for p in parts)))


def corrected_lines(facts: DataFrame, by_category: DataFrame, suggestions: DataFrame) -> DataFrame:
    """``doc_id, section_no, section, line_no, line``: the corrected document as ordered lines."""
    base = facts.select("doc_id", "contact", "employment", "education", "certifications")
    head = base.select("doc_id", F.lit(0).alias("section_no"), F.lit("Heading").alias("section"), F.posexplode(F.array(F.coalesce(_shown(F.col("contact.name")), F.lit("Resume")), _joined(" · ", F.col("contact.email"), F.col("contact.phone"), F.col("contact.location")))).alias("line_no", "line"))
    skills = by_category.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("category", "names"))), lambda x: F.concat(x["category"], F.lit(": "), F.array_join(x["names"], ", "))).alias("x"))

    def role(r):
        title = _joined(" — ", r["title"], r["employer"])
        start, end = _shown(r["startDate"]), _shown(r["endDate"])
        dates = F.when(r["isCurrent"] & start.isNotNull(), F.concat(start, F.lit(" to present"))).when(start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" to "), end)).otherwise(F.coalesce(start, end))
        return F.coalesce(F.concat(title, F.lit(" ("), dates, F.lit(")")), title, dates, F.lit("Role"))

    def section(rows: DataFrame, no: int, name: str, lines: Column) -> DataFrame:
        return rows.select("doc_id", F.lit(no).alias("section_no"), F.lit(name).alias("section"), F.posexplode(lines).alias("line_no", "line"))

    notes = suggestions.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "title", "detail"))), lambda s: _joined(": ", s["title"], s["detail"])).alias("x"))
    parts = [
        head,
        section(skills, 1, "Skills", F.col("x")),
        section(base, 2, "Experience", F.transform("employment", role)),
        section(base, 3, "Education", F.transform("education", lambda e: _joined(", ", e["degree"], e["fieldOfStudy"], e["institution"]))),
        section(base, 4, "Certifications", F.transform("certifications", lambda c: _joined(" — ", c["name"], c["issuer"]))),
        section(notes, 5, "Improvement notes", F.col("x")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("line IS NOT NULL")
