"""WARC archives, and a converter of legacy ARC archives into WARC records.

An ARC file is a version block and then records: one header line, whose fields
depend on the version that the block declares, and as many bytes as that line's
last field says. The converter walks by these lengths alone and synthesises what
WARC has and ARC lacks: a record id (a UUID from the header line and the
payload's digest, so a retried task makes the same one), an ISO timestamp from
ARC's digits, a record type from scheme and content type, and digests.

Records are written by Spark's text sink with the WARC record end as separator,
so any file system that Spark writes can hold the archives; they are read back
as whole files and walked by their declared lengths. Equal payloads are found by
digest in a narrow table; a payload moves once, to the file it is written to.

Defined results: null content is empty; null urls become ``unknown:``; a null
page id is taken as larger than all others; rows with an equal page id are equal
records with equal ids, and all of them are responses if one is; an archive that
breaks off, or a line that is no header, gives one record of type metadata with
the bytes that remain; an empty table gives an archive without records; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, mapped, scratch_path, stored

#: Bytes of an ARC segment; payloads of at least so many bytes are written once.
ARC_BYTES, LEAST_BYTES = 1 << 21, 100
#: Header fields of an ARC record by version: fixed values.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"],
}
END = b"\r\n\r\n"
RECORD = "record_id string, type string, uri string, date string, ip string, content_type string, payload_digest string, payload_bytes long, head binary, payload binary"
COLUMNS = [x.split()[0] for x in RECORD.split(", ")]
LIMIT = 1 << 23
#: Bytes of records in a WARC file, before compression.
FILE_BYTES = 256 << 20


# --- ARC ---


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that an archive begins with."""
    names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}
    body = f"{version} 0 tessera\n{' '.join(names[x] for x in ARC_FIELDS[version])}\n".encode()
    given = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "file": name, "length": str(len(body))}
    return " ".join(given[x] for x in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, content_type: str, body: bytes, ip: str = "0.0.0.0", name: str = "-", offset: int = 0) -> bytes:
    given = {"url": url, "ip": ip, "date": date, "type": content_type, "result": "200", "checksum": "-", "location": "-", "offset": str(offset), "file": name, "length": str(len(body))}
    return " ".join(given[x] for x in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def header_url(url: str | None) -> str:
    """A url as a header line can hold it: white space and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: quote(m[0]), url or "") or "unknown:"


def walk_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, header line, content) of each record; fields are empty for bytes that are no record."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)]
        names = ARC_FIELDS[version]
        if line.startswith(b"filedesc:"):  # its own line tells the number of fields; the block's first line confirms it
            names = ARC_FIELDS[2] if line.count(b" ") >= 9 else ARC_FIELDS[1]
        parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if stop < 0 or len(parts) < len(names) or not parts[-1].isascii() or not parts[-1].isdigit() or stop + 1 + int(parts[-1]) > len(data):
            yield {}, b"", data[at:]
            return
        content = data[stop + 1 : stop + 1 + int(parts[-1])]
        if line.startswith(b"filedesc:") and content[:1] in (b"1", b"2"):
            version = int(content[:1])
        yield dict(zip(names, parts)), line, content
        at = stop + 1 + int(parts[-1])


# --- synthesis ---


def iso_date(digits: str) -> str:
    """ARC's 14 digits (or 12, 8) as WARC-Date; what is no date is the epoch."""
    d = (digits + "00000000000000")[:14] if digits.isascii() and digits.isdigit() and len(digits) in (8, 12, 14) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def synthesise(fields: dict[str, str], line: bytes, content: bytes) -> tuple:
    """One converted record, as :data:`RECORD`."""
    uri, head, payload = fields.get("url", "unknown:"), b"", content
    if not fields:
        kind, content_type = "metadata", "application/octet-stream"
    elif uri.startswith("filedesc:"):
        kind, content_type = "warcinfo", "application/warc-fields"
    elif content.startswith(b"HTTP/"):
        kind, content_type = "response", "application/http; msgtype=response"
        cut = content.find(END)
        cut = len(content) if cut < 0 else cut + 4
        head, payload = content[:cut], content[cut:]
    else:
        kind, content_type = "resource", fields["type"]
    digest = hashlib.sha256(payload).hexdigest()
    made = uuid.UUID(bytes=hashlib.sha256(line + b"\n" + head + digest.encode()).digest()[:16], version=5)
    return f"urn:uuid:{made}", kind, uri, iso_date(fields.get("date", "")), fields.get("ip", "0.0.0.0"), content_type, digest, len(payload), head, payload


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some megabytes each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > LIMIT:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)


TYPES = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.binary()]


def convert(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """WARC records from ARC archives, one archive (plain or gzip) a row; ``payloads=False`` leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for data in batch.column(batch.schema.get_field_index(content)):
                    data = data.as_py() or b""
                    if data[:2] == b"\x1f\x8b":
                        data = b"".join(_inflated(data))
                    for record in walk_arc(data):
                        made = synthesise(*record)
                        yield made if payloads else (*made[:9], None)

        yield from _batches(rows(), COLUMNS, TYPES)

    return mapped(archives.select(content), run, RECORD)


def to_arc(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", version: int = 1, date: str = "20240101000000") -> DataFrame:
    """(content): ARC archives of about two megabytes with the pages as HTTP responses; the key is the header X-Page-Id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(batch.schema.get_field_index(c)) for c in (url, html, key)}
            held, size = [arc_header(version, "pages.arc", date)], 0
            for i in range(batch.num_rows):
                payload = (get[html][i].as_py() or "").encode()
                k = get[key][i].as_py()
                mark = "" if k is None else f"X-Page-Id: {k}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}\r\n".encode() + payload
                held.append(arc_record(version, header_url(get[url][i].as_py()), date, "text/html", body))
                size += len(held[-1])
                if size > ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [arc_header(version, "pages.arc", date)], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    return mapped(pages.select(*map(col, (url, html, key))), run, "content binary")


# --- WARC ---


def with_revisits(records: DataFrame, narrow: DataFrame, key: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``records`` with refers_to, refers_uri and refers_date: set where an equal payload has a smaller key.

    ``narrow`` has the same records without payloads, stored; ``key`` is a column of it.
    """
    n = narrow.filter((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes)).select(
        F.coalesce(key, F.lit((1 << 63) - 1)).alias("key"), "record_id", "uri", "date", "payload_digest", "payload_bytes",
    )
    first = n.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("key", "record_id", "uri", "date")).alias("first"), F.max("key").alias("last")).filter(F.col("last") > F.col("first.key"))
    again = n.select("key", "record_id", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"]).filter(F.col("key") > F.col("first.key"))
    again = again.select("record_id", F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date")).dropDuplicates(["record_id"])
    return records.join(again, "record_id", "left")


def per_file(narrow: DataFrame, size: int = FILE_BYTES) -> int:
    """So many records of these payload_bytes make a file of about ``size`` bytes."""
    mean = narrow.agg(F.avg("payload_bytes")).first()[0] or 0.0  # one number
    return max(1, int(size / (mean + 1000)))


def write_warc(records: DataFrame, path: str, most: int = 0) -> None:
    """Write :data:`RECORD` rows as gzip-compressed WARC files; rows with ``refers_to`` as revisits.

    A partition is a file, or several of at most ``most`` records: a file is
    read as a whole by one task, and none may be larger than two gigabytes.
    """
    for c in ("refers_to", "refers_uri", "refers_date"):
        records = records if c in records.columns else records.withColumn(c, F.lit(None).cast("string"))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise(F.col("type"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("uri"))), line("WARC-IP-Address", F.when(F.col("ip") != "0.0.0.0", F.col("ip"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))), line("WARC-Refers-To-Target-URI", F.col("refers_uri")), line("WARC-Refers-To-Date", F.col("refers_date")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    # The sink ends each row with lineSep, which is how a WARC record ends; the bytes of a row pass as they are.
    records.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members."""
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        piece = member.decompress(rest, LIMIT)
        while piece or not member.eof:
            yield piece
            if member.eof or not (member.unconsumed_tail or piece):
                break
            piece = member.decompress(member.unconsumed_tail, LIMIT)
        rest = member.unused_data


class _Stream(io.RawIOBase):
    """The pieces as a file to read from, so that one piece is held at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = piece
        n = min(len(b), len(self.left))
        b[:n], self.left = self.left[:n], self.left[n:]
        return n


def walk_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of each record."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {}, line + file.read()
            return
        headers = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, file.read(int(headers.get("content-length", 0)))


READ = "record_id string, type string, uri string, date string, refers_to string, declared_digest string, payload_digest string, payload_bytes long, head binary, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files (gzip or plain). Digest and bytes are those of the payload that was read; null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for data in batch.column(0):
                    data = data.as_py()
                    source = _Stream(_inflated(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                    for h, block in walk_warc(io.BufferedReader(source, 1 << 20)):
                        cut = block.find(END) + 4 if h.get("content-type", "").startswith("application/http") else 0
                        head, payload, kind = block[:cut], block[cut:], h.get("warc-type", "unparsed")
                        had = kind != "revisit"
                        yield (
                            h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-target-uri"), h.get("warc-date"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
                            h.get("warc-payload-digest", "").removeprefix("sha256:"), hashlib.sha256(payload).hexdigest() if had else None, len(payload) if had else None, head, payload if payloads else None,
                        )

        yield from _batches(rows(), [x.split()[0] for x in READ.split(", ")], TYPES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return mapped(files, run, READ)


def page_key(head: str = "head") -> Column:
    """The page id in an HTTP head."""
    found = F.regexp_extract(F.col(head).cast("string"), r"\r\nX-Page-Id: (-?\d+)\r\n", 1)
    return F.when(found != "", found.cast("long"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: page_id, payload_bytes, payload_digest, record_type, refers_to for each page.

    Pages become ARC archives, these are converted, written as WARC, and read.
    """
    arcs = to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    narrow = stored(convert(arcs, payloads=False).drop("payload").withColumn("key", page_key()).drop("head"), "warc-narrow")
    path = scratch_path(spark, "warc")
    write_warc(with_revisits(convert(arcs), narrow, F.col("key")), path, per_file(narrow))
    found = stored(read_warc(spark, path, payloads=False).drop("payload").withColumn("page_id", page_key()).drop("head"), "warc-read")
    found = found.filter(F.col("type").isin("response", "revisit"))
    first = found.filter(F.col("type") == "response").select(F.col("record_id").alias("id"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    responses = found.filter(F.col("type") == "response").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = found.filter(F.col("type") == "revisit").join(first.dropDuplicates(["id"]), F.col("refers_to") == F.col("id"))
    return responses.unionByName(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first").alias("refers_to")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
