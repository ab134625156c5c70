"""WARC: legacy ARC records are converted, written as archives and read back.

ARC: a version block names the version; each record is one header line, whose fields
depend on the version (1: URL, IP address, date, type, length; 2: URL, IP address,
date, type, result code, checksum, location, offset, file name, length), then as many
bytes as the line declares, then a line feed. A file is plain or has gzip members, and is
read as a stream. The converter parses the lines and lengths and makes up what WARC wants
besides: a record id, an ISO timestamp, the record type and SHA-1 digests. What a server
sent (a status line, headers, an empty line, the payload) becomes a response, whose
payload digest is that of the bytes after the headers and whose block digest covers all;
anything else becomes a resource, the version block a warcinfo record.

Archives: files of WARC/1.1 records, a gzip member each, in the folder given or a scratch
folder, written by Spark's text writer: a row is a run of members of about `chunk` bytes,
a file holds `per_file` rows, and what the writer puts after each row is an empty member.
Readers get files from Spark's binary source, so any store that Spark reads will do, and
unpack them member by member and piece by piece. Reading goes by declared lengths, and
each response's digest is checked against its bytes.

Record ids are name-based UUIDs. That of a response that others refer to is named by its
page_id and digest, so a revisit knows it (WARC-Refers-To); any other is named by
its place in the run besides, so repeated rows and URLs have ids of their own.

Copies: of the records with equal payloads of at least `least` bytes the one with the
largest page_id is the response, the others revisit it; all smaller ones are
responses. The choice is a partial maximum per digest. Rows meet it by digest and one of
`salts` parts, rows without a digest by parts of their own, so a digest that a third of
the rows share is dealt out.

Defined results: null html is an empty payload; a null url becomes urn:page:<id>;
white space and control characters in URLs are percent-encoded. Rows with the largest
page_id of their copies are all responses when that id is repeated; a null page_id is
smaller than any other, and where a group has only null ids all are responses. A revisit
of a repeated response names its page, URL and date but no record. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, forget_at_exit, scratch_path

V1 = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
V2 = ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    payload: bytes


def arc_url(url: str) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") or "urn:none"


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc", date: str = "20200101000000") -> bytes:
    """An ARC file of one version; version 2 carries checksums, offsets and the name."""
    about = f"{version} 0 tidelog\n{' '.join(V1 if version == 1 else V2)}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    line += f" {len(about)}\n" if version == 1 else f" 200 - - 0 {name} {len(about)}\n"
    out = [line.encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        line = f"{r.url} {r.ip} {r.date} {r.content_type}"
        line += f" {len(r.payload)}\n" if version == 1 else f" 200 {hashlib.md5(r.payload).hexdigest()} - {at} {name} {len(r.payload)}\n"
        part = line.encode() + r.payload + b"\n"
        at += len(part)
        out.append(part)
    return b"".join(out)


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records after the version block, of a plain file or gzip members; ValueError
    where lines or lengths don't fit."""
    packed = raw[:2] == b"\x1f\x8b"
    stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if packed else io.BytesIO(raw)
    first = stream.readline().decode().rstrip("\n").split(" ")
    if not first[0].startswith("filedesc://"):
        raise ValueError("an ARC file begins with filedesc://")
    version = int(stream.read(int(first[-1])).split(b" ", 1)[0])
    if version not in (1, 2):
        raise ValueError(f"ARC version {version}")
    names = V1 if version == 1 else V2
    while line := stream.readline():
        if line == b"\n":
            continue
        got = line.decode().rstrip("\n").split(" ")
        if len(got) > len(names):  # a content type may hold spaces
            wide = len(got) - len(names) + 1
            got[3 : 3 + wide] = [" ".join(got[3 : 3 + wide])]
        if len(got) != len(names):
            raise ValueError(f"{len(got)} fields in an ARC {version} line")
        f = dict(zip(names, got, strict=True))
        size = int(f["Archive-length"])
        payload = stream.read(size)
        if len(payload) != size:
            raise ValueError("the archive ends inside a record")
        if f.get("Checksum", "-") != "-" and f["Checksum"] != hashlib.md5(payload).hexdigest():
            raise ValueError("a checksum doesn't fit its payload")
        yield ArcRecord(f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], payload)


HEADED = re.compile(rb"HTTP/\d[^\r\n]*\r?\n(?:[^\r\n]+\r?\n)*\r?\n")


def _label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, name)))}>"


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(head: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_record(r: ArcRecord, id_: str | None = None, refers_to: dict[str, object] | None = None, **extra: object) -> bytes:
    """The WARC equivalent of an ARC record: a response, a resource, or with `refers_to`
    (the headers that name the record it repeats) a revisit, which keeps only the
    headers that the server sent."""
    got = HEADED.match(r.payload)
    at = got.end() if got else 0
    label = _label(r.payload[at:])
    block = r.payload if refers_to is None else r.payload[:at]
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if got else "resource",
        "WARC-Record-ID": id_ or record_id(r.url, r.date, label),
        "WARC-Date": warc_date(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": label,
        "WARC-Block-Digest": _label(block),
        "X-Payload-Length": len(r.payload) - at,
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **refers_to}
    head |= {k.replace("_", "-"): v for k, v in extra.items()}
    return _record(head | {"Content-Type": "application/http; msgtype=response" if got else r.content_type}, block)


def member(record: bytes) -> bytes:
    """A record as a gzip member; equal records are equal bytes."""
    return gzip.compress(record, 6, mtime=0)


#: What the text writer puts after each row: an empty gzip member.
EMPTY_MEMBER = gzip.compress(b"", 6, mtime=0)


def arc_to_warc(raw: bytes, name: str) -> Iterator[bytes]:
    """The records of an ARC file in WARC, behind a warcinfo record that names it."""
    about = f"converted-from: {name}\r\n".encode()
    first = record_id("warcinfo", name, hashlib.sha1(raw).hexdigest())
    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": first, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    yield _record(info, about)
    for i, r in enumerate(read_arc(raw)):
        yield warc_record(r, record_id(first, i), WARC_Warcinfo_ID=first)


def _head(text: bytes, at: int) -> dict[str, str]:
    lines = text.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"no WARC record at byte {at}")
    return dict(x.split(": ", 1) for x in lines[1:])


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an unpacked archive, by declared length."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = _head(raw[at:end], at)
        size = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a declared length doesn't fit")
        at = end + 8 + size
        yield head, block


def _pieces(raw: memoryview, at: int, piece: int, feed: int = 1 << 14) -> Iterator[tuple[bytes, int]]:
    """Unpacked pieces of the member that begins at `at`, and at last where the next begins."""
    gz, fed = zlib.decompressobj(31), at
    while not gz.eof:
        data = gz.unconsumed_tail
        if not data:
            data = bytes(raw[fed : fed + feed])
            fed += len(data)
        out = gz.decompress(data, piece)
        if not (data or out or gz.eof):
            raise ValueError("the archive ends inside a member")
        if out:
            yield out, at
    yield b"", fed - len(gz.unused_data)


def read_members(raw: bytes, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes, str, str]]:
    """Of each record in an archive with a member a record: headers, the first bytes of its
    block (up to `piece`), and the SHA-1 of its block and of its payload (the block after
    what a server sent before it). No more than two pieces are unpacked at a time."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        head, start, held, left, block, payload = None, b"", b"", 0, hashlib.sha1(), hashlib.sha1()
        begun, began = False, at
        for out, at in _pieces(view, at, piece):  # noqa: B020
            if head is None:
                held += out
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    continue
                head = _head(held[:end], began)
                left, out = int(head["Content-Length"]), held[end + 4 :]
                held = b""
            part, tail = out[:left], out[left:]
            left, held = left - len(part), held + tail
            block.update(part)
            if begun:
                payload.update(part)
                continue
            start += part
            if left == 0 or len(start) >= piece:
                got = HEADED.match(start) if head.get("Content-Type", "").startswith("application/http") else None
                payload.update(start[got.end() if got else 0 :])
                begun = True
        if head is None and not held:
            continue  # an empty member
        if head is None or left or held != b"\r\n\r\n":
            raise ValueError("a declared length doesn't fit")
        yield head, start, block.hexdigest(), payload.hexdigest()


ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, warc_date string, target_uri string"


def _read_rows(raw: bytes) -> Iterator[tuple]:
    for head, _, block, payload in read_members(raw):
        hexed = lambda k: base64.b32decode(head[k].removeprefix("sha1:")).hex()  # noqa: E731, B023
        if "WARC-Payload-Digest" not in head:
            continue  # a warcinfo record
        if hexed("WARC-Block-Digest") != block or head["WARC-Type"] != "revisit" and hexed("WARC-Payload-Digest") != payload:
            raise ValueError(f"{head['WARC-Record-ID']}: the bytes differ from their digest")
        number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
        yield number("X-Page-Id"), number("X-Payload-Length"), hexed("WARC-Payload-Digest"), head["WARC-Type"], number("X-Refers-To-Page"), head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Date"], head["WARC-Target-URI"]


def write_archives(records: DataFrame, path: str, per_file: int = 32) -> None:
    """Rows of gzip members (column `value`, text of any bytes) as archives in a folder."""
    writer = records.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder, warcinfo records apart."""
    names = [x.split(" ")[0] for x in ROW.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in ROW.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows: list[tuple] = []
                for row in _read_rows(raw.as_py()):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_map(files, read, ROW)


def _chunks(members: Iterator[bytes], chunk: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for m in members:
        held.append(m)
        size += len(m)
        if size >= chunk:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["record"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["record"])


def convert_archives(spark: SparkSession, source: str, target: str, chunk: int = 1 << 20, per_file: int = 32) -> DataFrame:
    """Legacy ARC files under `source` as WARC archives under `target`; a row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            for b in batches:
                for path, raw in zip(*b.columns):
                    yield from map(member, arc_to_warc(raw.as_py(), path.as_py().rpartition("/")[2]))

        yield from _chunks(members(), chunk)

    files = spark.read.format("binaryFile").load(source).select("path", "content")
    write_archives(arrow_map(files, run, "record binary").select(F.col("record").cast("string").alias("value")), target, per_file)
    return read_archives(spark, target)


def warc_archive(pages: DataFrame, path: str | None = None, least: int = 1000, crawl_date: str = "20200101000000", ip: str = "0.0.0.0", chunk: int = 1 << 20, per_file: int = 32, salts: int = 16) -> DataFrame:
    """One row per page, as read back from the archives that are written here; they stay
    in `path`, if one is given."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    src = src.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    each = src.where("digest is not null").groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    copies = each.groupBy("digest").agg(F.max(F.struct("page_id", (F.col("n") == 1).alias("single"), "url")).alias("to"), F.sum("n").alias("n")).where("n > 1 and to.page_id is not null")
    copies = copies.select(F.col("digest").alias("d"), "to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = F.xxhash64("page_id", "url")
    own = F.coalesce("digest", F.concat(F.lit("-"), F.pmod(spread, F.lit(1 << 16)).cast("string")))  # no copy has such a digest
    src = src.withColumn("own", own).withColumn("part", F.pmod(spread, F.lit(salts)))
    src = src.join(copies, (F.col("own") == F.col("d")) & (F.col("part") == F.col("salt")), "left").select("page_id", "url", "payload", F.col("to.page_id").alias("to"), "to.single", F.col("to.url").alias("to_url"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, at = context.partitionId() if context else 0, 0
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

        def members() -> Iterator[bytes]:
            nonlocal at
            for b in batches:
                for page, url, payload, to, single, to_url in zip(*b.columns):
                    page, to, at = page.as_py(), to.as_py(), at + 1
                    named = arc_url(url.as_py() if url.is_valid else f"urn:page:{page}")
                    arc = write_arc([ArcRecord(named, ip, crawl_date, "text/html", head + (payload.as_py() or b""))], 1 + (page or 0) % 2)  # both kinds
                    (r,) = read_arc(arc)
                    digest = hashlib.sha1(memoryview(r.payload)[len(head) :]).hexdigest()
                    refers = None
                    if to is not None and to != page:
                        target = arc_url(to_url.as_py() if to_url.is_valid else f"urn:page:{to}")
                        refers = {"WARC-Refers-To": record_id("response", to, digest) if single.as_py() else None, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": warc_date(crawl_date), "X-Refers-To-Page": to}
                    answered = to is not None and to == page and single.as_py()
                    id_ = record_id("response", page, digest) if answered else record_id(page, digest, task, at)
                    yield member(warc_record(r, id_, refers, X_Page_Id=page))

        yield from _chunks(members(), chunk)

    target = path or scratch_path(spark, "warc")
    write_archives(arrow_map(src, convert, "record binary").select(F.col("record").cast("string").alias("value")), target, per_file)
    if path is None:
        forget_at_exit(spark, target)
    return read_archives(spark, target)
