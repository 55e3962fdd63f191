"""WARC archives: a writer on Spark's text sink and a salvage reader for damaged files.

Writing. Each record is one row of text; the sink ends rows with the two line ends that close a
record, so the part files are plain WARC/1.1 files with one record after the other. Records with
equal payloads (SHA-1 and length) are one response, that of the smallest id, and revisits of it.
The larger a record, the fewer share its file (``FILES``): no file passes 64 MiB but by one record.
A record of more than 1 GiB (``MOST_RECORD``) is more than the reader takes; writing one is an error.

Reading. A file is one row of a task; its records stream out. Bytes are consumed from good record to
good record. Where a version line, a header, a length, the closing line ends or the payload digest
is wrong, the reader searches for the next version line or gzip member after the bad start, goes on
there, and logs the bytes between as a quarantined gap (file, offset, length, reason). It reads
plain files, files of one gzip member per record, and mixtures.

A null payload is empty, a null url an empty target. Rows with a null or repeated id are written
like others; equal payloads without any id are all responses. An empty table gives no records. A
file that is no WARC at all is one gap. Columns other than id, url and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanveil.llm.common import hold, join_checked, new_folder

VERSION, MEMBER, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
MOST_RECORD = 1 << 30
FILES = ((1 << 14, 4000), (1 << 18, 256), (1 << 22, 16), (None, 1))  # records of at most so many bytes: so many a file
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:spanveil:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIELDS = ("record_id", "record_type", "target", "refers_to", "payload_digest")
RECORDS = ("file string, offset long, length long, record_id string, record_type string, target string, "
           "refers_to string, payload_digest string, payload_bytes long, reason string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four letters."""
    digest, out = F.sha1(payload), []
    for part in range(8):
        bits = F.conv(F.substring(digest, part * 5 + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.lit(1) + F.shiftright(bits, shift).bitwiseAND(F.lit(31)), F.lit(1))
                for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
               least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 4000) -> None:
    """Write a record per row. Equal payloads of at least ``least_bytes`` are revisits of the first."""
    rows = pages.select(
        F.col(key).alias("id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    repeated = hold(rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "repeated")
    rows = join_checked(rows, repeated, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    rows = rows.withColumn("block", F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload")))
    fields = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("WARC-Payload-Length: "), "bytes"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block"))]
    fits = F.octet_length("block") <= MOST_RECORD
    block = F.when(fits, F.col("block")).otherwise(F.raise_error(F.lit("a record of more than 1 GiB")))
    records = rows.withColumn("block", block).select(F.concat_ws("\r\n", *fields, F.concat(F.lit("\r\n"), "block")).alias("value"))
    size, least = F.octet_length("value"), -1
    for most, together in FILES:
        some = records.where((size > least) if most is None else (size > least) & (size <= most))
        some.write.mode("append").option("lineSep", "\r\n\r\n").option(
            "maxRecordsPerFile", min(together, records_per_file)).text(path)
        least = most


USED = ("warc-type", "content-length", "content-type", "warc-payload-digest", "warc-payload-length", "warc-record-id",
        "warc-target-uri", "warc-refers-to")


class Header:
    """The lines up to the next header end, read once for all starts that may stand among them."""

    def __init__(self, data: bytes, since: int, before: Header | None):
        self.since, self.bad, self.fields = since, None, {}
        if before and before.end >= since - 2:
            self.end = before.end
        else:  # the version line's end may be part of it
            found = data.find(END, since - 2)
            self.end = len(data) if found < 0 else found
        to = since
        if self.end == len(data):
            self.bad = self.end
            return
        while to < self.end:  # line by line: a header may be of any length
            line = data[to:data.find(b"\r\n", to)]
            field, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                self.bad = to
                break
            if (name := field.strip().lower()) in USED:
                self.fields[name] = to, value.strip()
            to += len(line) + 2

    def serves(self, to: int) -> bool:
        return self.since <= to <= self.end + 2 and (self.bad is None or to <= self.bad)


def _plain(data: bytes, at: int, check: bool, seen: dict[str, Header]):
    """The record at a version line: (record, end), or (None, reason)."""
    version = data[at:at + len(VERSIONS[0])]
    if version not in VERSIONS:
        return None, "no end of header" if any(v.startswith(version) for v in VERSIONS) else "version line"
    to = at + len(version)
    if "header" not in seen or not seen["header"].serves(to):
        seen["header"] = Header(data, to, seen.get("header"))
    header = seen["header"]
    if header.bad is not None:
        return None, "header line" if header.bad < len(data) else "no end of header"
    head = {name: value for name, (place, value) in header.fields.items() if place >= to}
    to = header.end + len(END)
    if not re.fullmatch(r"[0-9]{1,12}", head.get("content-length", "")) or "warc-type" not in head:
        return None, "missing field"
    start, size = to, int(head["content-length"])
    if size > MOST_RECORD or start + size > len(data):
        return None, "truncated"
    if data[start + size:start + size + 4] != END:
        return None, "length"
    payload = data[start:start + size]
    if head.get("content-type", "").startswith("application/http"):
        payload = payload.partition(END)[2]
    digest, kind = head.get("warc-payload-digest", "").removeprefix("sha1:"), head["warc-type"]
    length = len(payload)
    if kind == "revisit":
        length = int(head["warc-payload-length"]) if head.get("warc-payload-length", "").isdigit() else None
    else:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if check and digest and digest.upper() != found:
            return None, "digest"
        digest = found
    name = lambda f: head.get(f, "").strip("<>").removeprefix(URN) or None
    return {"record_id": name("warc-record-id"), "record_type": kind, "target": head.get("warc-target-uri"),
            "refers_to": name("warc-refers-to"), "payload_digest": digest, "payload_bytes": length,
            "payload": payload}, start + size + 4


def _member(data: bytes, at: int, check: bool):
    """The records of a gzip member: ([records], end), or (None, reason)."""
    unpack = zlib.decompressobj(31)
    try:
        plain = unpack.decompress(memoryview(data)[at:], MOST_RECORD)
    except zlib.error:
        return None, "member"
    if not unpack.eof:
        return None, "truncated member"
    records, inner, seen = [], 0, {}
    while inner < len(plain):
        record, end = _plain(plain, inner, check, seen)
        if record is None:
            return None, f"{end} in member"
        records.append(record)
        inner = end
    return records, len(data) - len(unpack.unused_data)


def salvage(data: bytes, check: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive, in order. Gaps have record_type 'gap' and a reason."""
    at, n, gap, reason, seen = 0, len(data), None, "", {}
    while at < n:
        if data.startswith(VERSION, at):
            found, end = _plain(data, at, check, seen)
            found = None if found is None else [found]
        elif data.startswith(MEMBER, at):
            found, end = _member(data, at, check)
        elif data.startswith(b"\r\n", at) and gap is None:
            at += 2
            continue
        else:
            found, end = None, "no record"
        if found is not None:
            if gap is not None:
                yield {"offset": gap, "length": at - gap, "record_type": "gap", "reason": reason}
                gap = None
            for record in found:
                yield record | {"offset": at, "length": end - at}
            at = end
            continue
        if gap is None:
            gap, reason = at, end
        start = START.search(data, at + 1)
        at = start.start() if start else n
    if gap is not None:
        yield {"offset": gap, "length": n - gap, "record_type": "gap", "reason": reason}


def read_warc(spark: SparkSession, path: str, check: bool = True, with_payload: bool = True,
              gaps: bool = True) -> DataFrame:
    """Records and gaps of all files of a folder; see ``RECORDS``. Without ``gaps`` one is an error."""
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in names], names)

        for files in batches:
            for path_, content in zip(files.column("path").to_pylist(), files.column("content")):
                rows, size = [], 0
                for record in salvage(content.as_py(), check):
                    if not gaps and record["record_type"] == "gap":
                        raise ValueError(f"{path_}: gap of {record['length']} bytes at {record['offset']}: {record['reason']}")
                    rows.append(record | {"file": path_})
                    size += record["length"]
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write pages to a fresh folder of archives and read them back; what cannot be read is an error."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(pages, folder, key, least_bytes=least_bytes)
    return read_warc(spark, folder, with_payload=with_payload, gaps=False)
