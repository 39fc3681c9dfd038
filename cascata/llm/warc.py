"""WARC archives with resolved revisits (operator 6).

Headers (id, payload digest) are shuffled by digest; of the records with equal payloads of at least
``min_bytes`` bytes the one with the smallest id is the response and the others become revisit records
that refer to it.  Payloads never meet by digest: the resolved headers join them by id, evenly however many
copies a payload has.  Archives are then written with fresh headers, one gzip member per record, into the
folder that all machines share, and read back from there; a revisit's size and digest come from the
response that it refers to.

Every task attempt writes files of its own name, and the manifest names those of the attempt that counted,
so a task that runs again after a lost executor, even with its rows in another order, leaves right offsets;
files of other attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_folder, same

#: Archives are closed when they hold this many bytes.
ARCHIVE_BYTES = 256 << 20
MANIFEST = "path string, offset long, size long, page_id long"
RECORDS = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(column):
    """Upper-case base32 of the SHA-1 of a binary column, from built-in functions: 5 hex digits are 4 base32 digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digest = F.sha1(column)
    digits = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(alphabet, F.shiftright(value, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*digits)


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every page.

    A null html is empty.  Repeated rows of the smallest page_id are all responses; a null page_id is
    never referred to unless it is the only one.  Only ids and digests are shuffled by digest (with partial
    sums before); the join of the headers may split a hot digest's partition.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        (F.col("url").cast("string") if "url" in pages.columns else F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    headers = cut(rows.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest", "url"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "url"))
    first = headers.groupBy("payload_digest").agg(least.alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND NOT v.nameless")
    first = first.select("payload_digest", F.col("v.page_id").alias("first"), F.col("v.url").alias("first_url"))
    revisits = headers.select("page_id", "payload_digest").join(first, "payload_digest").filter(~same(F.col("page_id"), F.col("first"))).distinct()
    revisits = revisits.toDF("r_digest", "r_id", "first", "first_url")
    joined = rows.join(revisits, same(rows["page_id"], revisits["r_id"]) & (rows["payload_digest"] == revisits["r_digest"]), "left")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= min_bytes)
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def warcinfo(date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: cascata\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, refers_to_url, date: str) -> bytes:
    """One record; a revisit's block has the HTTP header alone.  Rows that repeat a page_id share a record id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Refers-To-Target-URI: {_one_line(refers_to_url)}", f"WARC-Refers-To-Date: {date}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _folder(path: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_archives(resolved: DataFrame, folder: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all records below ``folder`` (a URI every machine can reach), as of ``date`` (else now); one manifest row per record."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, where = _folder(folder)
        files.create_dir(where, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, at, number, rows = None, 0, 0, []

        def name(k: int) -> str:
            return f"part-{part:06d}-{attempt}-{k:04d}.warc.gz"

        def packed(data: bytes) -> bytes:
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            return packer.compress(data) + packer.flush()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "refers_to_url")]
            for page_id, *fields in zip(*columns):
                if out is None:
                    out, info = files.open_output_stream(f"{where}/{name(number)}", compression=None), packed(warcinfo(date))
                    out.write(info)
                    at = len(info)
                member = packed(record(page_id, *fields, date))
                out.write(member)
                rows.append((f"{folder}/{name(number)}", at, len(member), page_id))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out, number = None, number + 1
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "offset", "size", "page_id"])

    return resolved.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "refers_to_url").mapInArrow(run, MANIFEST)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: int(uri[10:-1]) if uri and uri[10:-1] else None
    kind = fields["WARC-Type"]
    return (
        number(fields["WARC-Record-ID"]), kind, fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        int(_fields(http)["Content-Length"]), number(fields.get("WARC-Refers-To")), None if kind == "revisit" else payload,
    )


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives that the manifest names, from its byte range."""

    def run(batches):
        for batch in batches:
            rows, open_path, stream, size = [], None, None, 0
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if path != open_path:
                    files, where = _folder(path)
                    open_path, stream = path, files.open_input_file(where)
                stream.seek(offset)
                rows.append(parse_record(zlib.decompress(stream.read(length), 31)))
                size += length
                if size > 8 << 20:
                    yield _records(rows)
                    rows, size = [], 0
            yield _records(rows)

    def _records(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "payload"])

    return manifest.select("path", "offset", "size").mapInArrow(run, RECORDS)


def verify_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    Responses' digests and sizes are taken anew from the payloads that were read, and a revisit's are those
    of the response that it refers to; a revisit without such a response has neither.
    """

    def run(batches):
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            # a revisit's own header says which digest its response must have
            digest = [d if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p, d in zip(payloads, batch.column("payload_digest").to_pylist())]
            size = [None if p is None else len(p) for p in payloads]
            yield pa.record_batch([batch.column("page_id"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), batch.column("record_type"), batch.column("refers_to")], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = cut(records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    responses = read.filter("record_type = 'response'").select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes")).distinct()
    revisits = read.filter("record_type = 'revisit'")
    found = revisits.join(responses, (revisits["refers_to"] == responses["r_id"]) & (revisits["payload_digest"] == responses["r_digest"]), "left")
    found = found.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"), "record_type", "refers_to")
    return read.filter("record_type <> 'revisit'").union(found)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Resolve, write and list; the manifest is materialised in the shared folder, so archives are written once."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    manifest = write_archives(resolve(pages, min_bytes), folder.rstrip("/"))
    table = f"{folder.rstrip('/')}-manifest"
    manifest.write.parquet(table)
    return spark.read.parquet(table)


def local_files(folder: str) -> list[str]:
    files, where = _folder(folder)
    from pyarrow import fs

    return sorted(os.path.basename(f.path) for f in files.get_file_info(fs.FileSelector(where)))
