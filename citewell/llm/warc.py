"""WARC archives, index first.

Writing returns an index table (file, offset, length, URL, digest per record); reading takes index rows, sorts them by
place, joins neighbouring byte ranges into one read each, and parses only the selected records.
"""

from __future__ import annotations

import gzip
import hashlib
import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import materialize, scratch

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, uri string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "record_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, intact boolean, payload binary"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Bare upper-case base32 of the SHA-1, from built-in functions: five hex digits are four of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def plan_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Decide response or revisit: of equal payloads of at least ``min_bytes`` the largest id is the response.

    A null text is an empty payload. A null id loses against any id; if all ids of a payload are null, and where the
    largest id is repeated, each such row is a response. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = rows.groupBy("payload_digest").agg(F.max("record_id").alias("first_id"), F.count("*").alias("copies"), F.max("payload_bytes").alias("size"))
    repeated = materialize(repeated.filter((F.col("copies") > 1) & (F.col("size") >= min_bytes)).select("payload_digest", "first_id"))
    is_revisit = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return rows.join(repeated, "payload_digest", "left").select(
        "record_id",
        "uri",
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(is_revisit, F.col("first_id")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~is_revisit, F.col("payload")).alias("payload"),
    )


def _urn(record_id: int | None) -> str:
    """The id inside the UUID; a null id has its own first digit."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 124) if record_id is None else record_id % (1 << 64))}>"


def _id(urn: str) -> int | None:
    n = uuid.UUID(urn[10:-1]).int
    return None if n >> 124 else n - (1 << 64) if n >> 63 else n


def _record(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['record_id'])}", f"WARC-Date: {DATE}"]
    if row["uri"] is not None:
        head.append("WARC-Target-URI: " + row["uri"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, roll_bytes: int = 1 << 30, level: int = 3) -> DataFrame:
    """Write each task's records as gzip members of its own archive files; return the written index.

    The files lie in the shared folder, under names that no other attempt of a task uses; only files that the index
    names count, so a lost or repeated task leaves at most an unused file.
    """
    spark = records.sparkSession
    folder = scratch(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stem, out, name, at, n = uuid.uuid4().hex, None, "", 0, 0
        for batch in batches:
            found: dict[str, list] = {k.split()[0]: [] for k in INDEX.split(", ")}
            for row in batch.to_pylist():
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at, n = f"{stem}-{n:05d}.warc.gz", 0, n + 1
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), level, mtime=0)
                    at += out.write(info)
                data = gzip.compress(_record(row), level, mtime=0)
                out.write(data)
                for k, v in (row | {"file": f"{folder}/{name}", "offset": at, "length": len(data)}).items():
                    if k in found:
                        found[k].append(v)
                at += len(data)
            yield pa.RecordBatch.from_pydict(found, schema=_arrow(INDEX))
        if out is not None:
            out.close()

    return materialize(records.mapInArrow(write, INDEX))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(k, kinds[t]) for k, t in (x.split() for x in ddl.split(", "))])


def parse_record(data: bytes) -> dict:
    """One uncompressed record as a row of RECORD."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    digest = said if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "record_id": _id(fields["WARC-Record-ID"]),
        "uri": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _id(fields["WARC-Refers-To"]) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": size if revisit else len(payload),
        "intact": revisit or (digest == said and len(payload) == size),
        "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, with_payload: bool = True, gap_bytes: int = 1 << 16, span_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Read the records that ``index`` selects.

    Rows are dealt out by file and by ``span_bytes`` of offset, sorted by place, and ranges that lie at most
    ``gap_bytes`` apart become one read. The selected records' bytes, not the small index rows, set the number of
    tasks: one per ``task_bytes``, and up to one per core while spans last. An empty index gives no rows.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes), min(-(-total // span_bytes), spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at = None, None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            rows, i = [], 0
            while i < len(places):
                file, start, length = places[i]
                end, j = start + length, i + 1
                while j < len(places) and places[j][0] == file and places[j][1] - end <= gap_bytes and places[j][1] - start < span_bytes:
                    end, j = max(end, places[j][1] + places[j][2]), j + 1
                if at != file:
                    if opened is not None:
                        opened.close()
                    store, path = fs.FileSystem.from_uri(file)
                    opened, at = store.open_input_file(path), file
                data = opened.read_at(end - start, start)
                for _, o, n in places[i:j]:
                    row = parse_record(gzip.decompress(data[o - start : o - start + n]))
                    rows.append(row if with_payload else row | {"payload": None})
                i = j
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(RECORD))
        if opened is not None:
            opened.close()

    placed = index.select("file", "offset", "length", F.floor(F.col("offset") / span_bytes).alias("span"))
    return placed.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)
