"""Document sources: stored bytes to text blocks, with a reason where that fails."""

from __future__ import annotations

import io
import lzma
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import BLANK
from ..operators.admission import MAX_BYTES, MAX_FILES, MAX_TOTAL, entry_reason

MAX_PAGES = 100
#: Bytes of a DOCX body, inflated.
MAX_BODY = 50 * 2**20
#: Files that a task reads at once, and bytes of entries that make a batch of its result.
PART_FILES, PART_BYTES = 64, 4 * 2**20
#: What reading an entry raises if it is encrypted, of an unknown method or damaged.
DAMAGED = (RuntimeError, NotImplementedError, zlib.error, lzma.LZMAError, OSError)
#: The namespace of a DOCX body; reasons are those of the contract.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def store_documents(rows: DataFrame, path: str) -> None:
    """``path, content`` -> a store of many documents a file, with the columns of scanned files; null content stays null.

    A file per document costs a name, a listing entry and a read each, whatever its size: millions of small documents
    are kept in as many files as tasks write, each under its own path as a key.
    """
    now = F.current_timestamp().alias("modificationTime")
    rows.select("path", now, F.octet_length("content").cast("long").alias("length"), "content").write.parquet(path)


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents as ``path, modificationTime, length, content``, like scanned files."""
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").parquet(path)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a folder of this machine only where Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: worked out once however often it is used, and of known size to Spark."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores where the input has splits for less than half of them; a larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def block_id(page: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-b1"))


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "") == ""


def decode_text_blocks(files: DataFrame) -> DataFrame:
    """``doc_id, content`` -> one block per document; ``reason`` is set and the text null where it is not UTF-8 or blank."""
    raw = F.col("content").cast("string")
    good = F.is_valid_utf8(raw)
    text = F.when(good, F.regexp_replace(raw, "^﻿", ""))
    reason = F.when(~good, "Resume text is not UTF-8").when(is_blank(text), "Resume text contains no extractable text")
    return files.select("doc_id", block_id(F.lit(1)).alias("block_id"), F.lit(1).alias("page"), F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))


def _paragraphs(content: bytes | None) -> tuple[str | None, str | None]:
    """Text or reason of one DOCX file; the body is inflated up to MAX_BODY only."""
    bad = None, "Resume DOCX could not be parsed"
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive, archive.open("word/document.xml") as body:
            data = body.read(MAX_BODY + 1)
        if len(data) > MAX_BODY:
            return None, "Resume DOCX body is too large"
        root = ElementTree.fromstring(data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, ValueError, LookupError, *DAMAGED):
        return bad
    texts = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))
    shown = [t for t in texts if t.strip()]
    return ("\n".join(shown), None) if shown else (None, "Resume DOCX contains no extractable text")


def few_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few files at a time, so that a task never holds the Python objects of a whole batch."""
    for batch in batches:
        for at in range(0, len(batch), PART_FILES):
            yield batch.slice(at, PART_FILES)


def docx_blocks(files: DataFrame) -> DataFrame:
    """``doc_id, content`` of DOCX files -> one block each, paragraphs joined by line feeds, or a reason.

    A file that is no archive, damaged, encrypted, of an unknown method, without a body or with one that is no XML gets
    a reason like any other; no file ends the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_files(batches):
            found = [_paragraphs(c) for c in part.column("content").to_pylist()]
            texts, reasons = (pa.array([x[i] for x in found], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(["p1-b1"] * len(found)), pa.array([1] * len(found), pa.int32()), texts, reasons], names=["doc_id", "block_id", "page", "text", "reason"])

    return files.select("doc_id", "content").mapInArrow(read, files.select("doc_id").schema.simpleString()[7:-1] + ", block_id string, page int, text string, reason string")


def page_blocks(pages: DataFrame) -> DataFrame:
    """``doc_id, page, text`` -> blocks with ids; documents of too many pages or of blank ones only get a reason."""
    own = W.partitionBy("doc_id")
    text = F.coalesce("text", F.lit(""))
    n, shown = F.count("*").over(own), F.max((~is_blank(text)).cast("int")).over(own)
    reason = F.when(n > MAX_PAGES, "Resume PDF exceeds 100 pages").when(shown == 0, "Scanned or image-only resume PDFs are not supported")
    return pages.select("doc_id", block_id(F.col("page")).alias("block_id"), "page", text.alias("text"), reason.alias("reason"))


def _entries(archive_id: str, content: bytes) -> list[tuple]:
    whole = lambda reason: [(archive_id, None, None, None, None, None, reason)]
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        return whole("Resume ZIP file is malformed")
    with archive:
        listed = [e for e in archive.infolist() if not e.is_dir()]
        if len(listed) > MAX_FILES:
            return whole("Resume ZIP exceeds 500 files")
        if sum(e.file_size for e in listed) > MAX_TOTAL:
            return whole("Resume ZIP exceeds 500 MB uncompressed")
        rows = []
        for e in listed:
            data, reason = None, entry_reason(e.filename, e.external_attr, e.compress_size, e.file_size)
            if reason is None and e.file_size <= MAX_BYTES:
                try:
                    data = archive.read(e)
                except (zipfile.BadZipFile, EOFError, *DAMAGED):
                    reason = "Resume ZIP file is malformed"
            rows.append((archive_id, e.filename, e.compress_size, e.file_size, e.external_attr, data, reason))
    return rows


def archive_entries(archives: DataFrame) -> DataFrame:
    """``archive_id, content`` of ZIP files -> one row per entry that is no folder; a bad archive is one row with a reason.

    What the archive's own directory tells is judged before anything is inflated: an archive of too many or too large
    entries is one row with a reason, and an entry that is refused by name, kind or ratio, is encrypted or damaged, or
    is larger than a document may be, comes without content.
    """
    schema = "archive_id string, entry_name string, compress_size long, file_size long, external_attr long, content binary, reason string"
    kinds = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        for part in few_files(batches):
            for archive_id, content in zip(part.column("archive_id").to_pylist(), part.column("content"), strict=True):
                for row in _entries(archive_id, content.as_py()):
                    rows.append(row)
                    held += 100 + len(row[5] or b"")
                    if held >= PART_BYTES:
                        yield whole()
                        rows, held = [], 0
        if rows:
            yield whole()

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), "content").mapInArrow(read, schema)


def scan_vocab_tech(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated technology list -> ``name, category``."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col("Example").alias("name"), F.col("Commodity Title").alias("category"))


def scan_vocab_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct element names over several tab-separated files, sorted."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(paths)
    return rows.select(F.col("Element Name").alias("name")).distinct().orderBy("name")


def scan_vocab_titles(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of titles -> ``row_idx, name``."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("row_idx", "name"))


def write_vocabulary(skills: DataFrame, aliases: DataFrame, path: str) -> None:
    """Both tables in key order."""
    skills.orderBy("key").write.parquet(f"{path}/skills")
    aliases.orderBy("alias").write.parquet(f"{path}/aliases")


def write_nested_json(rows: DataFrame, column: str, path: str) -> None:
    """One JSON document per line; nulls inside are written, so that what is read back is the same."""
    rows.select(F.to_json(column, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_nested_json(rows: DataFrame, column: str, schema: str, into: str) -> DataFrame:
    """``rows`` with the JSON text of ``column`` as ``into``; text that isn't such a document gives null."""
    return rows.withColumn(into, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


#: The columns of the exported list.
EXPORTED = ("candidate_name", "status", "score", "eligibility", "evidence_coverage")


def write_csv(ranked: DataFrame, path: str) -> None:
    """The export of all jobs as CSV files with a header, in the order of job and place over all files."""
    rows = ranked.orderBy("job_id", "place")
    export_csv(rows).write.option("header", True).option("emptyValue", "").csv(path)


def export_csv(ranked: DataFrame) -> DataFrame:
    """The ranked list as text columns, null as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ranked.select(*(text(c).alias(c) for c in EXPORTED))
