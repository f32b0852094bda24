"""Admission of documents, archives, windows, invitations and requirements; each rule gives a reason or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip, suffix

MAX_BYTES, MAX_FILES, MAX_TOTAL, MAX_RATIO = 20 << 20, 500, 500 << 20, 100
PDF, DOCX, TEXT = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain"
#: Media types and their suffixes.
SUFFIXES = {PDF: ".pdf", DOCX: ".docx", TEXT: ".txt"}
LINK_MODE, MODE_MASK = 0o120000, 0o170000


def admit_document(media_type: Column, filename: Column, size: Column, head: Column, docx_reason: Column) -> Column:
    """The first failing rule's reason. ``head``: the content's first bytes; ``docx_reason``: from ``docx_structure``."""
    wanted = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[media_type]
    return (
        F.when(F.coalesce(~size.between(1, MAX_BYTES), F.lit(True)), "Resume must be between 1 byte and 20 MB")
        .when(F.coalesce(~media_type.isin(*SUFFIXES), F.lit(True)), "Resume must be a PDF, DOCX, or TXT file")
        .when(F.coalesce(suffix(filename) != wanted, F.lit(True)), "Resume filename does not match its media type")
        .when((media_type == PDF) & ~F.startswith(head, F.lit(b"%PDF-")), "Resume content is not a PDF")
        .when(media_type == DOCX, docx_reason)
    )


def docx_structure(entries: DataFrame) -> DataFrame:
    """``archive_id, entry_name, has_magic`` -> ``archive_id, reason``."""
    name = F.col("entry_name")
    found = entries.groupBy("archive_id").agg(
        F.bool_and("has_magic").alias("magic"),
        F.bool_or(name == "[Content_Types].xml").alias("types"),
        F.bool_or(name == "word/document.xml").alias("body"),
        F.bool_or(F.endswith(F.lower(name), F.lit("vbaproject.bin"))).alias("macro"),
    )
    reason = F.when(~F.col("magic") | ~F.coalesce("types", F.lit(False)) | ~F.coalesce("body", F.lit(False)), "Resume content is not a DOCX file").when(F.col("macro"), "Macro-enabled Office documents are not supported")
    return found.select("archive_id", reason.alias("reason"))


def zip_entry_reason(name: Column, external_attr: Column, compressed: Column, size: Column) -> Column:
    unsafe = F.startswith(name, F.lit("/")) | F.array_contains(F.split(name, "/"), "..")
    link = F.shiftright(external_attr, 16).bitwiseAND(F.lit(MODE_MASK)) == LINK_MODE
    return (
        F.when(unsafe, "ZIP entry has an unsafe path")
        .when(link, "ZIP entry is a symlink")
        .when(F.endswith(F.lower(name), F.lit(".zip")), "Nested ZIP archives are not supported")
        .when((compressed > 0) & (size > MAX_RATIO * compressed), "ZIP entry has a suspicious compression ratio")
    )


def entry_reason(name: str, external_attr: int, compressed: int, size: int) -> str | None:
    """``zip_entry_reason`` for one entry of an archive that is being read."""
    if name.startswith("/") or ".." in name.split("/"):
        return "ZIP entry has an unsafe path"
    if external_attr >> 16 & MODE_MASK == LINK_MODE:
        return "ZIP entry is a symlink"
    if name.lower().endswith(".zip"):
        return "Nested ZIP archives are not supported"
    return "ZIP entry has a suspicious compression ratio" if compressed > 0 and size > MAX_RATIO * compressed else None


def batch_caps(entries: DataFrame) -> DataFrame:
    """``archive_id, files, total, reason``."""
    sums = entries.groupBy("archive_id").agg(F.count("*").alias("files"), F.sum("file_size").alias("total"))
    return sums.withColumn("reason", F.when(F.col("files") > MAX_FILES, "Resume ZIP exceeds 500 files").when(F.col("total") > MAX_TOTAL, "Resume ZIP exceeds 500 MB uncompressed"))


def batch_split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ``archive_id, entry_name, reason``."""
    return entries.filter("reason IS NULL").drop("reason"), entries.filter("reason IS NOT NULL").select("archive_id", "entry_name", "reason")


def media_type_for_name(name: Column) -> Column:
    ending = suffix(name)
    out = None
    for media, s in SUFFIXES.items():
        out = F.when(ending == s, media) if out is None else out.when(ending == s, media)
    return out


def stamp_document(content: Column, now: Column) -> list[Column]:
    """Checksum, size, and the date up to which a document is kept."""
    return [F.sha2(content, 256).alias("checksum"), F.octet_length(content).cast("long").alias("byte_size"), (now + F.expr("INTERVAL 90 DAYS")).alias("retain_until")]


def validate_window(opens: Column, closes: Column) -> Column:
    return F.when(opens.isNull() | closes.isNull(), "window needs both ends").when(closes <= opens, "window closes before it opens")


def validate_invite_expiry(hours: Column) -> Column:
    return F.coalesce(hours.between(1, 720), F.lit(False))


def validate_job_text(text: Column) -> tuple[Column, Column]:
    """The stripped text (null if empty) and whether its length is allowed."""
    clean = F.nullif(strip(text), F.lit(""))
    return clean, F.coalesce(F.char_length(clean) <= 100_000, F.lit(True))


def validate_requirement(kind: Column, weight: Column) -> Column:
    return F.coalesce(kind.isin("required", "preferred", "ignored", "hard_gate") & (weight > 0), F.lit(False))


def default_weight(kind: Column, weight: Column) -> Column:
    """The given weight, or 2 for a required and 1 for any other kind; null where the given one is not in (0, 100]."""
    return F.when(F.coalesce((weight > 0) & (weight <= 100), F.lit(True)), F.coalesce(weight, F.when(kind == "required", 2).otherwise(1)))


def application_open(opens: Column, closes: Column, now: Column) -> Column:
    return F.coalesce((opens <= now) & (now < closes), F.lit(False))


def invitation_reason(opens: Column, closes: Column, revoked: Column, expires: Column, used: Column, redeemer: Column, user: Column, now: Column) -> Column:
    """Why an invitation can't be used now, null if it can."""
    return (
        F.when(~application_open(opens, closes, now), "applications are closed")
        .when(revoked.isNotNull(), "invitation is revoked")
        .when(F.coalesce(expires <= now, F.lit(True)), "invitation is expired")
        .when(used.isNotNull(), "invitation is used")
        .when(redeemer.isNotNull() & (redeemer != user), "invitation is redeemed by another user")
    )


def require_confirmed_version(submissions: DataFrame, latest: DataFrame) -> DataFrame:
    """Submissions whose job's latest version is confirmed, with that version."""
    confirmed = latest.filter("confirmed_at IS NOT NULL").select("job_id", "version")
    return submissions.join(confirmed, "job_id")


def normalise_email(email: Column) -> Column:
    return F.lower(strip(email))


def admitted_submissions(submissions: DataFrame, windows: DataFrame) -> DataFrame:
    """Range join of submissions ``(window_id, at)`` with windows ``(window_id, opens, closes)``."""
    return submissions.join(windows, "window_id").filter(application_open(F.col("opens"), F.col("closes"), F.col("at")))


#: Finest time bin in seconds; a bin of the next level is four times as long (SHIFT bits of the hour's number); levels: an
#: hour up to over four hundred years.
BIN, SHIFT, LEVELS = 3600, 2, 12


def interval_join(events: DataFrame, windows: DataFrame, on: str, at: str = "at", opens: str = "opens", closes: str = "closes") -> DataFrame:
    """Each pair of an event and a window of the same ``on`` with ``opens <= at < closes``, once.

    Windows may overlap and be of any length. A window is put on the level whose bins are as long as itself or up to four
    times longer, so that two bins cover it at most (but above the last level); an event is put into its bin of each
    level that any window is on, and both meet by equal bins. A hot ``on`` with many windows thus makes no product: an
    event meets only windows that are near it for their length. The exact times are compared afterwards. A null time is
    never open, an empty or reversed window holds nothing.
    """
    hour = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(BIN * 1e6)
    bin_of = lambda h: F.call_function("shiftright", h, SHIFT * F.col("_level"))
    first, last = F.floor(hour(opens)).cast("long"), F.ceil(hour(closes)).cast("long") - 1
    level = F.aggregate(F.array(*(F.lit(n) for n in range(LEVELS - 1))), F.lit(0), lambda n, m: n + F.when(last - first + 1 > F.call_function("shiftleft", F.lit(1).cast("long"), SHIFT * m), 1).otherwise(0))
    cover = windows.filter(F.col(opens) < F.col(closes)).withColumn("_level", level)
    levels = cover.select("_level").distinct()
    cover = cover.withColumn("_bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    points = events.filter(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_bin", bin_of(F.floor(hour(at)).cast("long")))
    return points.join(cover, [on, "_level", "_bin"]).filter(application_open(F.col(opens), F.col(closes), F.col(at))).drop("_level", "_bin")


def counts_by_reason(entries: DataFrame) -> DataFrame:
    return entries.groupBy("reason").agg(F.count("*").alias("n"))

