"""Legacy archive converter: ARC (version 1 and 2) to WARC/1.1.

read_arc() parses the version block, then each record's header line by the fields of its version, and takes as
many payload bytes as the line declares. to_warc() synthesises what ARC lacks: record ids, ISO timestamps,
record types and SHA-256 digests. Records travel as Spark rows, are written as WARC archives by Spark's own text
writer (each record ends in CRLF CRLF, which is the writer's line separator, so commits and retries are Spark's),
and are read back by declared lengths.

Defined results: a null html is an empty payload; a null url is "unknown:"; a null page_id takes no part in the
choice of the response, and a group whose ids are all null stays response. Rows repeated under the page_id that
responds are responses too and share its record id. An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, table, with_join_key

#: The header fields of either version.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EPOCH = datetime.datetime(1996, 1, 1)
ARCHIVE_BYTES = 32 << 20


class ArcError(ValueError):
    pass


def write_arc(records: Iterable[dict], version: int, name: str) -> bytes:
    """An ARC archive of records (url, ip, date, type, body; version 2 also status and checksum)."""
    intro = f"{version} 0 recordloom\n{ARC_TITLES[version]}\n\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(intro)}\n".encode(), intro, b"\n"]
    at = sum(map(len, out))
    for r in records:
        head = [r["url"].replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "unknown:", r["ip"], r["date"], r["type"]]
        if version == 2:
            head += [str(r.get("status", 200)), r.get("checksum", "-"), "-", str(at), name]
        line = " ".join([*head, str(len(r["body"]))]).encode() + b"\n"
        out += [line, r["body"], b"\n"]
        at += len(line) + len(r["body"]) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Each record's header fields and body. The version block comes first, with scheme filedesc."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"header line at byte {at} has no end")
        words = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if not version:
            if not words[0].startswith("filedesc://"):
                raise ArcError("the archive has no version block")
            body = data[end + 1 : end + 1 + int(words[-1])]
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ArcError(f"unknown version {version}")
        fields = ARC_FIELDS[version]
        if len(words) != len(fields):
            raise ArcError(f"header line at byte {at} has {len(words)} fields and not {len(fields)}")
        record = dict(zip(fields, words, strict=True))
        size = int(record["length"])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ArcError(f"record at byte {at} declares {size} bytes and has {len(body)}")
        yield record | {"body": body, "version": version, "at": at}
        at = end + 1 + size


def to_warc(record: dict) -> dict:
    """What WARC needs of an ARC record: type, id, date, target, content type, HTTP head, payload, digests. The version
    block is the record at the archive's start, whatever the urls of others say."""
    body, head, kind, mime = record["body"], b"", "resource", record["type"]
    if record["at"] == 0:
        kind, mime = "warcinfo", "application/warc-fields"
    elif body.startswith(b"HTTP/"):
        cut = body.find(b"\r\n\r\n")
        head, body = (body[: cut + 4], body[cut + 4 :]) if cut >= 0 else (body, b"")
        kind, mime = "response", "application/http; msgtype=response"
    date = (record["date"] + "00000101000000"[len(record["date"]) :])[:14]
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    digest = hashlib.sha256(body).hexdigest()
    name = f"{record['url']} {date} {digest} {hashlib.sha256(head).hexdigest()}"
    return {"kind": kind, "id": record_id(name), "date": iso, "url": record["url"], "ip": record["ip"], "mime": mime, "head": head, "payload": body, "digest": digest}


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(w: dict, refers_to: str | None = None) -> bytes:
    """The record's bytes without the CRLF CRLF that ends it. refers_to: its payload is that of another record."""
    block = w["head"] if refers_to else w["head"] + w["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else w['kind']}", f"WARC-Record-ID: {w['id']}", f"WARC-Date: {w['date']}"]
    if w["kind"] != "warcinfo":
        lines += [f"WARC-Target-URI: {w['url']}", f"WARC-IP-Address: {w['ip']}", f"WARC-Payload-Digest: sha256:{w['digest']}", f"X-Payload-Length: {len(w['payload'])}"]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id('page ' + refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {w['mime']}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't as long as declared")
        yield fields | {"version": lines[0]}, block
        at = end + 8 + size


def page_as_arc(page_id: int | None, url: str | None, html: str | None) -> dict:
    body = (html or "").encode("utf-8", "surrogatepass")
    date = (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 900_000_000)).strftime("%Y%m%d%H%M%S")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    return {"url": url or "unknown:", "ip": "192.0.2.1", "date": date, "type": "text/html", "status": 200, "body": head.encode() + body}


def mark_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, refers_to. refers_to: the smallest page_id of an equal payload of min_bytes at least."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    long = rows.where(F.octet_length("html") >= min_bytes)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    first = materialize(first.select("digest", "first"), "payloads")
    both = with_join_key(rows, "j", "digest").join(with_join_key(first, "j", "digest"), ["j", "digest"], "left")
    return both.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def convert(pages: DataFrame, path: str) -> DataFrame:
    """Lay pages out as ARC archives of either version, convert them, write WARC archives under path. pages: as of mark_revisits()."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, archive, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                names, out = [], []
                info = None
                arc = write_arc([page_as_arc(r["page_id"], r["url"], r["html"]) for r in rows], 1 + (part + k // 64) % 2, f"{part}.arc")
                for n, record in enumerate(read_arc(arc)):
                    w = to_warc(record)
                    if not n:
                        info = warc_record(w)
                        continue
                    if not size:  # each archive begins with the version block's record
                        out.append(info)
                        names.append(f"{part:06d}-{archive:05d}")
                        size = len(info)
                    row = rows[n - 1]
                    w["id"] = record_id(f"page {row['page_id']}") if row["page_id"] is not None else w["id"]
                    out.append(warc_record(w, None if row["refers_to"] is None else str(row["refers_to"])))
                    names.append(f"{part:06d}-{archive:05d}")
                    size += len(out[-1])
                    if size >= ARCHIVE_BYTES:
                        archive, size = archive + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["archive", "record"])

    made = pages.select("page_id", "url", "html", "refers_to").mapInArrow(records, "archive string, record binary")
    made.select("archive", F.col("record").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)
    return read_archives(pages.sparkSession, path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record under path."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in read_warc(content.as_buffer().to_pybytes()):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    page = next(x for x in head.decode("utf-8", "replace").split("\r\n") if x.startswith("X-Page-Id:"))[10:].strip()
                    digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
                    if f["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"the payload of page {page} isn't as declared")
                    refers = f.get("x-refers-to-page")
                    rows.append((int(page) if page else None, size, digest, f["warc-type"], int(refers) if refers else None, f["warc-record-id"], f["warc-date"], f["warc-target-uri"]))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, warc_date string, target_uri string")


def op3_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    rows = convert(mark_revisits(table(spark, sf_dir, "pages")), path)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""
