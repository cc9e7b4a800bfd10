"""Legacy archive converter: ARC versions 1 and 2 to WARC 1.1, and a reader of what it writes.

An ARC file is a ``filedesc`` record, whose body names the version, and records of one header line
and as many bytes as it declares. Version 1 lines are ``URL IP date type length``, version 2 lines
``URL IP date type code checksum location offset filename length``. Each record becomes a WARC
record with a synthesised id (a UUID of its place and URL), ISO date, type and SHA-1 digests:

* ``filedesc`` -> warcinfo;
* an HTTP response -> response, or revisit if an equal payload is kept by an earlier record; a
  revisit holds the HTTP headers and refers to that record;
* anything else -> resource.

Which record keeps a payload is settled over light rows (digest, length, order) with a partially
aggregated minimum; payloads move once, to be written in place by Spark's text writer, which
reaches any file system that Spark does: a line is a run of whole records that ends in CR LF CR, and
the line feed is the writer's.

Defined results: a header line that doesn't parse, or a declared length beyond the end of the
archive, ends the archive; what is left of such a body is kept and marked WARC-Truncated; empty
archives give nothing; records without a payload have the digest of no bytes and take part in
revisits from ``min_bytes`` 0 on. Of pages: a null html is empty, a null url ``urn:unknown``, any
signed 64-bit page_id is kept and a null one never is a keeper where another is there; repeated
rows are records of their own, of which the earliest in the archives is the keeper; long texts are
one record; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.skew import join_unique
from termloom.llm.staging import new_path, stage

V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    declared: int
    offset: int
    version: int
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)

    @property
    def truncated(self) -> bool:
        return len(self.body) < self.declared

    @property
    def http(self) -> tuple[bytes, bytes] | None:
        """HTTP headers with their empty line, and the payload."""
        if not self.body.startswith(b"HTTP/"):
            return None
        ends = [(self.body.find(mark), len(mark)) for mark in (b"\r\n\r\n", b"\n\n")]
        at, size = min(((a, s) for a, s in ends if a >= 0), default=(len(self.body), 0))
        return self.body[: at + size], self.body[at + size :]

    @property
    def payload(self) -> bytes:
        http = self.http
        return http[1] if http else self.body


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def inflated(data: bytes) -> bytes:
    """The bytes of an archive that may be gzipped, in one member or one for each record."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, step = [], 0, 1 << 16
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while at < len(data) and not z.eof:  # by steps, as what is behind a member's end is copied
            out.append(z.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(z.unused_data)
        while data[at : at + 1] == b"\0":
            at += 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an archive, by their header lines and declared lengths."""
    data, at, version = inflated(data), 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        is_head = parts[0].startswith("filedesc:")
        if len(parts) not in ((5, 10) if is_head else ((5,) if version == 1 else (10,))) or end < 0 or not parts[-1].isdigit():
            return
        declared = int(parts[-1])
        body = data[end + 1 : end + 1 + declared]
        if is_head:
            first = body.split(b"\n", 1)[0].split(b" ")[0]
            version = 2 if first == b"2" else 1
        names = ("code", "checksum", "location", "offset", "filename")
        extra = dict(zip(names, parts[4:9], strict=True)) if len(parts) == 10 else {}
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], declared, at, version, body, extra)
        at = end + 1 + declared


def arc_file(name: str, version: int, date: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, mime, body) records."""
    about = f"{version} 0 termloom\n".encode() + (V1 if version == 1 else V2) + b"\n"
    out, at = [], 0

    def add(url: str, ip: str, mime: str, body: bytes) -> None:
        nonlocal at
        middle = "" if version == 1 else f" {200 if body.startswith(b'HTTP/') else '-'} - - {at} {name}"
        record = f"{url} {ip} {date} {mime}{middle} {len(body)}\n".encode() + body + b"\n"
        out.append(record)
        at += len(record)

    add(f"filedesc://{name}", "0.0.0.0", "text/plain", about)
    for r in records:
        add(*r)
    return b"".join(out)


def warc_date(date: str) -> str:
    """An ARC date of up to 14 digits as ISO 8601."""
    d = (re.sub(r"\D", "", date) + "00010101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int, url: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE_ID, f'{archive}#{offset} {url}')}"


def to_warc(archive: str, r: ArcRecord, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers`` is (id, url, ISO date) of the payload's keeper."""
    http = r.http
    block, kind, mime = r.body, "resource", r.mime
    if r.url.startswith("filedesc:"):
        kind, mime = "warcinfo", "text/plain"
    elif http:
        kind, mime = ("revisit" if refers else "response"), "application/http; msgtype=response"
        block = http[0] if refers else r.body
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(archive, r.offset, r.url)}>", f"WARC-Date: {warc_date(r.date)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}",
    ]
    if kind == "warcinfo":
        head.append(f"WARC-Filename: {archive}.warc")
    else:
        head += [f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha1:{payload_digest(r.payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers[0]}>", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {refers[2]}", f"WARC-Profile: {PROFILE}"]
    if r.truncated:
        head.append("WARC-Truncated: length")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record."""
    data, at = inflated(data), 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if end < 0 or not lines[0].startswith("WARC/") or not head.get("content-length", "").isdigit():
            return
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def http_header(block: bytes, name: str) -> str | None:
    head = re.split(rb"\r?\n\r?\n", block, maxsplit=1)[0].decode("utf-8", "replace")
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", head)
    return m[1] if m else None


def _number(text: str | None) -> int | None:
    """A signed 64-bit number in decimal digits."""
    n = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


#: Payload bytes that are put into one archive; bytes of a chunk of records, and chunks of a file.
ARCHIVE_BYTES = 4 << 20
CHUNK_BYTES, FILE_CHUNKS = 2 << 20, 32
_NOT_IN_URL = re.compile(r"\s")


def pages_to_arcs(pages: DataFrame, id_header: str = "X-Page-Id", date: str = "20200101000000") -> DataFrame:
    """(archive, content): ARC files of pages (page_id, url, html), of both versions in turn.

    A page is an HTTP response whose headers carry its page_id; a null html is an empty payload, a
    null url ``urn:unknown``.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, records, held = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:06d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(name, 1 + number % 2, date, records)], pa.binary())], ["archive", "content"])

        for batch in batches:
            htmls = batch.column("html").cast(pa.binary())
            for k, page, url in zip(range(len(batch)), batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                payload = htmls[k].as_py() or b""
                own = "" if page is None else f"{id_header}: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                records.append((_NOT_IN_URL.sub("%20", url or "urn:unknown"), "0.0.0.0", "text/html", head.encode() + payload))
                held += len(payload) + 256
                if held > ARCHIVE_BYTES:
                    yield archive()
                    number, records, held = number + 1, [], 0
        if records:
            yield archive()

    return pages.select("page_id", "url", "html").mapInArrow(run, "archive string, content binary")


def keepers(arcs: DataFrame, min_bytes: int = 0, order_header: str = "X-Page-Id") -> DataFrame:
    """(archive, offset, keeper) of records that revisit the equal payload of ``keeper``.

    The keeper is the first by the number in ``order_header`` (records without one come last),
    then by date, archive and offset.
    """
    schema = "archive string, offset long, digest string, bytes long, unranked boolean, rank long, date string, url string"

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in parse_arc(content.as_py()):
                    http = r.http
                    if http and len(http[1]) >= min_bytes:
                        rank = _number(http_header(http[0], order_header))
                        rows.append((name, r.offset, payload_digest(http[1]), len(http[1]), rank is None, rank or 0, r.date, r.url))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    light = stage(arcs.mapInArrow(run, schema), "payloads")
    first = light.groupBy("digest", "bytes").agg(F.min(F.struct("unranked", "rank", "date", "archive", "offset", "url")).alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    return join_unique(light, first, ["digest", "bytes"], "n", light.count()).filter("archive <> keeper.archive OR offset <> keeper.offset").select("archive", "offset", "keeper")


def convert(arcs: DataFrame, path: str, min_bytes: int = 0, order_header: str = "X-Page-Id") -> None:
    """Write the WARC files of ``arcs`` (archive, content) to ``path``, gzipped.

    Records go to the writer in chunks of ``CHUNK_BYTES``, or of one record that is longer, and a
    file takes ``FILE_CHUNKS`` of them: its size follows from bytes, not from a number of records.
    """

    def split(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                records = list(parse_arc(content.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(records), pa.string()), pa.array([r.offset for r in records], pa.int64()),
                        pa.array([f"{r.url} {r.ip} {r.date} {r.mime} {r.declared} {r.version}" for r in records], pa.string()), pa.array([r.body for r in records], pa.binary()),
                    ],
                    ["archive", "offset", "head", "body"],
                )

    def join(batches):
        out, held = [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["record"])

        for batch in batches:
            for k in range(len(batch)):
                name, offset, head, body, keeper = (c[k].as_py() for c in batch.columns)
                url, ip, date, mime, declared, version = head.rsplit(" ", 5)
                refers = keeper and (record_id(keeper["archive"], keeper["offset"], keeper["url"]), keeper["url"], warc_date(keeper["date"]))
                record = to_warc(name, ArcRecord(url, ip, date, mime, int(declared), offset, int(version), body), refers)
                if out and held + len(record) > CHUNK_BYTES:
                    yield chunk()
                    out, held = [], 0
                out.append(record)
                held += len(record)
        if out:
            yield chunk()

    records = arcs.mapInArrow(split, "archive string, offset long, head string, body binary")
    joined = records.join(keepers(arcs, min_bytes, order_header), ["archive", "offset"], "left").select("archive", "offset", "head", "body", "keeper")
    lines = joined.mapInArrow(join, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def read_warc(spark: SparkSession, path: str, id_header: str = "X-Page-Id") -> DataFrame:
    """Every record of the archives in ``path`` that has a payload, by its headers and digest.

    payload_bytes and payload_digest are of the full payload: a revisit's are those it declares.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string, target string, date string, intact boolean"

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in parse_warc(content.as_py()):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    http = block if kind == "resource" else re.split(rb"\r?\n\r?\n", block, maxsplit=1)
                    payload = block if kind == "resource" else (http[1] if len(http) > 1 else b"")
                    digest = said if kind == "revisit" else payload_digest(payload)
                    size = _number(http_header(block, "Content-Length")) if kind == "revisit" else len(payload)
                    page = None if kind == "resource" else _number(http_header(block, id_header))
                    rows.append((page, size, digest, kind, head.get("warc-record-id", "")[1:-1], head.get("warc-refers-to", "")[1:-1] or None, head.get("warc-target-uri"), head.get("warc-date"), digest == said))
                if rows:
                    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6, pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC by way of ARC, and read the archives back.

    Columns as of ``read_warc``, with refers_to: the page_id of the record that a revisit refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    convert(pages_to_arcs(pages), path, min_bytes)
    read = stage(read_warc(spark, path), "read")
    light = read.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    revisits = read.filter("refers_id IS NOT NULL")
    wanted = stage(revisits.groupBy("refers_id").agg(F.count("*").alias("n")).join(light, "refers_id"), "wanted")
    found = join_unique(revisits, wanted, ["refers_id"], "n", revisits.count(), "left")
    return found.unionByName(read.filter("refers_id IS NULL").withColumn("refers_to", F.lit(None).cast("long")))
