"""WARC archives: write one gzip member per record, read them back sequentially.

The reader holds one record at a time: it feeds chunks of the file to an
incremental zlib decompressor until the member ends, frames the record by its
Content-Length and compares both digests with what was read.

Defined cases: null html is an empty payload; a null url leaves the target URI
out; a page without page_id is always a response, has no page number in its
record id and can't be referred to; rows that share the largest page_id of
their payload are all responses; an empty table makes no archive and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, ship_package, written
from .arrow_text import record_batch, slices

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISITED = 1000
#: Parts that the rows of one payload are dealt to.
SALTS = 16
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"

RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
_RECORDS_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PACKED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("member", pa.binary())])
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


class WarcError(ValueError):
    """An archive that isn't framed as it says, or whose digests differ."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _record_id(page_id: int | None) -> str:
    return f"<{_URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def pack(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, payload_digest: str | None = None,
    payload_bytes: int | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6
) -> bytes:
    """A record as a gzip member. With ``refers_to``, a revisit: the HTTP head without the payload."""
    n = len(payload) if payload_bytes is None else payload_bytes
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: {payload_digest or _digest(payload)}", f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"
    ]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def members(stream: io.RawIOBase, chunk: int = CHUNK) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other."""
    rest = b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise WarcError("the file ends within a gzip member")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as bad:
                raise WarcError(f"not a gzip member: {bad}") from bad
            data = b"" if inflate.eof else stream.read(chunk)
        rest = inflate.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    """A record's fields, framed by Content-Length and verified by its digests."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no record header")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length and the member's end differ")
    if _digest(block) != fields["warc-block-digest"]:
        raise WarcError(f"block digest differs in {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response" and _digest(payload) != fields["warc-payload-digest"]:
        raise WarcError(f"payload digest differs in {fields['warc-record-id']}")
    size = int(http.decode().partition("Content-Length: ")[2].split("\r\n")[0])
    if kind == "response" and size != len(payload):
        raise WarcError(f"payload length differs in {fields['warc-record-id']}")
    number = lambda x: int(x[len(_URN) + 1 : -1]) if x and x.startswith(f"<{_URN}") else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": _hex(fields["warc-payload-digest"]), "record_type": kind, "refers_to": number(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None
    }


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); return the archives' paths.

    ``folder`` is a URI that every executor can write. Records are compressed
    where the pages are read, so that the shuffle which finds equal payloads
    carries compressed members. Rows of one payload are dealt to ``SALTS``
    parts, and those too small for a revisit, which nothing is looked up for, to
    any. A file belongs to one task attempt, and only those that successful
    attempts report are in the returned manifest.
    """
    ship_package(pages.sparkSession)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                ids, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                payloads = [(x or "").encode() for x in part.column(2).to_pylist()]
                yield record_batch(_PACKED, [ids, urls, [len(x) for x in payloads], [hashlib.sha1(x).hexdigest() for x in payloads], [
                    pack(i, u, x, date=date, level=level) for i, u, x in zip(ids, urls, payloads)
                ]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = size = 0
        where, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    where.create_dir(top, recursive=True)
                    path, records, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(path)
                member = row["member"]
                if row["refers_to"] is not None:
                    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
                    member = pack(row["page_id"], row["url"], b"", row["refers_to"], digest, row["payload_bytes"], date, level)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield record_batch(_FILES, [[path], [records], [size]])
                    out = None
        if out is not None:
            out.close()
            yield record_batch(_FILES, [[path], [records], [size]])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    packed = rows.mapInArrow(compress, "page_id long, url string, payload_bytes long, payload_digest string, member binary")
    payload = F.coalesce("html", F.lit(""))
    firsts = (
        rows.where(F.octet_length(payload) >= LEAST_REVISITED)
        .groupBy(F.sha1(payload.cast("binary")).alias("payload_digest"))
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("first"))
        .where("copies > 1")
        .drop("copies")
    )
    own = F.xxhash64("page_id", "url")
    is_large = F.col("payload_bytes") >= LEAST_REVISITED
    dealt = packed.withColumns({"meets": F.when(is_large, F.col("payload_digest")).otherwise(F.hex(own)), "salt": F.pmod(own, F.lit(SALTS)).cast("int")})
    salted = firsts.select(F.col("payload_digest").alias("meets"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    refers = F.when(is_large & (F.col("page_id") != F.col("first")), F.col("first"))
    joined = dealt.join(salted, ["meets", "salt"], "left").withColumn("refers_to", refers).drop("first", "meets", "salt")
    slim = joined.withColumn("member", F.when(F.col("refers_to").isNull(), F.col("member")))
    return slim.mapInArrow(write, "path string, records long, bytes long")


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``files`` (path), each archive read by one task from its start to its end.

    There are as many tasks as archives, up to a multiple of the cores that the
    session has, and then a sixteenth of the archives at least. The number is
    given, as Spark would see some hundred bytes of paths and take one task.
    """
    spark = files.sparkSession
    ship_package(spark)
    n = files.count()
    tasks = max(1, min(n, max(8 * spark.sparkContext.defaultParallelism, -(-n // 16))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with where.open_input_stream(path) as stream:
                    for member in members(stream):
                        record = parse(member)
                        if not payloads:
                            record["payload"] = None
                        held.append(record)
                        size += len(record["payload"] or b"") + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, RECORDS)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, RECORDS)

    return files.select("path").repartition(tasks).mapInArrow(read, _RECORDS_DDL)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write ``pages`` as archives under ``folder`` (by default one in the shared folder) and read them back."""
    folder = folder or fresh_dir(spark, "warc")
    return read_archives(written(write_archives(pages, folder), "warc-manifest"), folder, payloads)
