"""WARC archives: written by Spark's text writer, read in byte ranges.

Writing. Every page is one record in one gzip member. The members leave through
the text sink, so the committer keeps retried tasks from writing twice and any
store that Spark writes to will do. That sink ends each row with a separator;
the last byte of a member is the top byte of its size, zero below 16 MB, so the
member is written without it and the zero separator puts it back. (A larger
member is followed by a zero byte, which gzip readers skip as padding.)

Of records with equal payloads of ``least`` bytes or more the one with the
largest page_id is the response and the others are revisits of it.

Reading. Files are cut into byte ranges, one task each. A task looks for the
gzip magic, takes a candidate for a member if it decodes to a WARC header, and
owns the records that start in its range, reading past its end to finish the
last one. After a member it goes on at the member's end.

Defined cases: a null payload is empty; payloads shorter than ``least`` are
always responses; rows that repeat the largest page_id are each responses; a
null page_id is written as ``null``, read as null, and never refers or is
referred to; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .files import opened

MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
STEP = 1 << 18
#: Bytes in which a record's header must end.
HEADER = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to`` that holds no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='%/:?#[]@!$&()*+,;=~-._')}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write(pages: DataFrame, path: str, least: int = 1000, level: int = 6) -> None:
    """Write ``pages`` (page_id, url, html) as archives in the folder ``path``."""
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    keys = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    last = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = scratch.keep(keys.join(last, "sha1").where("page_id < refers_to").distinct(), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, data, sha1, refers in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                own = member(record(page, url, data, sha1, refers), level)
                out.append(own[:-1] if own[-1] == 0 else own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    made = rows.join(revisits, ["page_id", "sha1"], "left").mapInArrow(run, "member binary")
    made.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


class Source:
    """Reads a file in steps from any place on."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def get(self, start: int, size: int) -> bytes:
        """``size`` bytes from ``start`` on, fewer at the end of the file."""
        if not self.at <= start <= start + size <= self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(size, STEP))
        return self.data[start - self.at : start - self.at + size]


def decoded(source: Source, start: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at ``start`` and the member's end; None if
    no record begins there."""
    gz, out, at, size = zlib.decompressobj(31), [], start, 0
    try:
        while not gz.eof:
            if not (data := source.get(at, STEP)):
                return None
            out.append(gz.decompress(data))
            at += len(data)
            size += len(out[-1])
            if len(out) == 1 or size < HEADER:
                head = b"".join(out)
                if not (head.startswith(b"WARC/") or b"WARC/".startswith(head[:5])) or (b"\r\n\r\n" not in head and size > HEADER):
                    return None
    except zlib.error:
        return None
    return b"".join(out), at - len(gz.unused_data)


def records(source: Source, start: int, end: int) -> Iterator[bytes]:
    """The records whose members begin in [start, end)."""
    at = start
    while at < end:
        data = source.get(at, min(STEP, end - at + len(MAGIC) - 1))
        i = data.find(MAGIC)
        if i < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            if len(data) < len(MAGIC):
                return
        elif at + i < end and (found := decoded(source, at + i)):
            yield found[0]
            at = found[1]
        else:
            at += i + 1


def page_of(value: str) -> int | None:
    page = value.strip("<>").removeprefix("urn:page:")
    return None if page == "null" else int(page)


def parsed(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    given = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page, refers = page_of(fields["WARC-Record-ID"]), fields.get("WARC-Refers-To")
    if fields["WARC-Type"] == "response":
        sha1 = hashlib.sha1(payload)
        if b32encode(sha1.digest()).decode() != given:
            raise ValueError(f"page {page}: the payload does not match its digest")
        return page, len(payload), sha1.hexdigest(), "response", None, fields["WARC-Target-URI"], payload
    from base64 import b32decode

    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    return page, size, b32decode(given).hex(), "revisit", page_of(refers), fields["WARC-Target-URI"], None


def read(spark: SparkSession, path: str, split: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url
    [, payload]) of all records in the archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {split}L)")).alias("start"))
    tasks = max(1, files.agg(F.coalesce(F.sum(F.expr(f"length div {split} + 1")), F.lit(0))).first()[0])
    n = 7 if with_payload else 6
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][:n]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                out: list[list] = [[] for _ in names]
                size = 0
                with opened(at) as file:
                    for data in records(Source(file), start, start + split):
                        row = parsed(data)
                        for col, v in zip(out, row, strict=False):
                            col.append(v)
                        size += len(row[6] or b"") * with_payload
                        if size > 64 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                            out, size = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return ranges.repartition(int(tasks)).mapInArrow(run, schema)
