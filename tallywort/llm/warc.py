"""WARC: conversion of legacy ARC archives, and archives written and read back on the cluster.

An ARC file begins with a version block, ``filedesc://name ip date text/plain length``, whose body states
the version, the origin and the names of the fields; version 1 record headers then have five fields (URL,
IP address, date of 14 digits, content type, length) and version 2 headers ten (with result code, checksum,
location, offset, file name before the length). Each record's body follows for its declared length, then a
line break. Fields are counted from the right, so that a URL with spaces in it stays whole.

Conversion gives each ARC record an equivalent WARC record: a UUID derived from URL, date and digest, so that
reruns agree; the date in ISO form; type ``warcinfo`` for the version block, ``response`` for HTTP bodies
and ``resource`` for others; ``revisit`` on demand; and SHA-1 digests of block and payload in base 32.

Files are written by the executors below the shared folder under names of their own and listed in a
manifest, which is written like any table; only listed files are read, so lost or repeated tasks do no harm.
Null payloads are empty. Repeated page ids are written as they come.
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
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The header line of each ARC version's records.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
MIN_REVISIT_BYTES = 1000
#: Bytes of an archive file before the next one begins.
FILE_BYTES = 64 * 2**20
#: Compressed bytes that are read at once.
PIECE = 2**14
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    version: int


def arc_header(url: str, ip: str, date: str, content_type: str, length: int, version: int, name: str = "-", code: str = "200") -> bytes:
    """A record's header line in its version's form."""
    middle = [] if version == 1 else [code, "-", "-", "0", name]
    return " ".join([url, ip, date, content_type, *middle, str(length)]).encode() + b"\n"


def arc_start(name: str, date: str, version: int) -> bytes:
    """The version block that begins an ARC file."""
    body = f"{version} 0 tallywort\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), version, name) + body + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block first. A header that doesn't fit its version, and a body
    shorter than declared, end the file with an error."""
    version = None
    while line := stream.readline():
        if not line.strip():
            continue
        fields = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if version is None:
            if not fields[0].startswith("filedesc:") or not fields[-1].isdigit():
                raise ValueError("an ARC file begins with its version block")
            body = stream.read(int(fields[-1]))
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            head = [fields[0], *fields[1:4]]
        else:
            tail = 4 if version == 1 else 9
            if len(fields) <= tail or not fields[-1].isdigit() or not re.fullmatch(r"\d{14}", fields[-tail + 1]):
                raise ValueError(f"not an ARC {version} header: {line[:100]!r}")
            head = [" ".join(fields[:-tail]), *fields[-tail : -tail + 3]]
            body = stream.read(int(fields[-1]))
        if len(body) < int(fields[-1]):
            raise ValueError("an ARC record ends before its declared length")
        yield ArcRecord(*head, body, version)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP response; all is payload if there is no header."""
    if body[:5] == b"HTTP/":
        for gap in (b"\r\n\r\n", b"\n\n"):
            at = body.find(gap)
            if at >= 0:
                return body[: at + len(gap)], body[at + len(gap) :]
    return b"", body


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(url: str, date: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest}')}>"


def to_warc(r: ArcRecord, refers_to: tuple[str, str, str] | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The equivalent WARC record. refers_to: id, URL and date of the record whose payload this one repeats."""
    if r.url.startswith("filedesc:"):
        kind, block, payload, mime = "warcinfo", b"format: WARC File Format 1.1\r\nsoftware: tallywort\r\n", None, "application/warc-fields"
    else:
        header, payload = split_http(r.body)
        block, kind, mime = r.body, "response" if header else "resource", "application/http; msgtype=response" if header else r.content_type
        if refers_to is not None:
            kind, block = "revisit", header
    digest = sha1_label(payload if payload is not None else block)
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(r.url, r.date, digest), "WARC-Date": iso_date(r.date)}
    if kind == "warcinfo":
        head["WARC-Filename"] = r.url.removeprefix("filedesc://")
    else:
        head |= {"WARC-Target-URI": r.url, "WARC-IP-Address": r.ip, "WARC-Payload-Digest": digest}
    if refers_to is not None:
        head |= {"WARC-Refers-To": refers_to[0], "WARC-Refers-To-Target-URI": refers_to[1], "WARC-Refers-To-Date": refers_to[2], "WARC-Profile": REVISIT_PROFILE}
    head |= {"WARC-Block-Digest": sha1_label(block), "Content-Type": mime, **(extra or {}), "Content-Length": str(len(block))}
    clean = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + clean.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(stream, revisits=lambda r: None, extra=lambda r: None) -> Iterator[tuple[ArcRecord, bytes]]:
    """Each record of an ARC file with its WARC form."""
    for r in read_arc(stream):
        yield r, to_warc(r, revisits(r), extra(r))


def gunzip_members(data: bytes) -> Iterator[bytes]:
    """The members of a compressed archive, one record each. Bytes go in by pieces, since what is left over after a
    member is copied."""
    at = 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("a compressed record is cut off")
            out.append(d.decompress(data[at : at + PIECE]))
            at += PIECE
        at = min(at, len(data)) - len(d.unused_data)
        yield b"".join(out)


def read_warc_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    stream = io.BytesIO(data)
    if not stream.readline().startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
        head[name] = value
    block = stream.read(int(head["Content-Length"]))
    if len(block) != int(head["Content-Length"]) or stream.read() != b"\r\n\r\n" or sha1_label(block) != head["WARC-Block-Digest"]:
        raise ValueError("a WARC record doesn't have its declared length or digest")
    return head, block


def _date_of(page_id: int) -> str:
    """The tables have no capture times, so a page's is counted in seconds from a fixed day."""
    day, second = divmod(page_id % (28 * 86_400), 86_400)
    return f"202401{day + 1:02d}{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"


def page_as_arc(page_id: int | None, url: str, payload: bytes, version: int) -> bytes:
    """A page as a record of a legacy archive; its id, unless null, travels in the HTTP header."""
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    body = head.encode() + payload
    return arc_header(re.sub(r"[\r\n]+", "%0A", url) or "unknown:", "192.0.2.1", _date_of(page_id or 0), "text/html", len(body), version) + body + b"\n"


def originals(pages: DataFrame) -> DataFrame:
    """(id, again): for page ids with a payload of at least MIN_REVISIT_BYTES that recurs under a larger one, a map from
    the payload's digest to the largest page_id with it and its url. Only digests shuffle, one row a digest and task."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keys = pages.where("page_id is not null").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha1(payload).alias("digest"), F.length(payload).alias("size")).where(F.col("size") >= MIN_REVISIT_BYTES).drop("size")
    keys = common.materialize(keys, "warc-digests")
    # a table, so that the join shuffles both sides and a common payload's rows can be split among tasks
    last = common.materialize(
        keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"), F.max_by("url", F.struct("page_id", "url")).alias("refers_url"))
        .where("first < refers_to").drop("first"),
        "warc-last",
    )
    found = keys.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", F.struct("refers_to", "refers_url").alias("to")).distinct()
    return found.groupBy(F.col("page_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("digest", "to"))).alias("again"))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def written(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each page into compressed archives below the folder; returns the manifest (file, records)."""
    again = common.materialize(originals(pages.select("page_id", "url", "html")), "warc-revisits")
    slim = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    both = common.join_by_id(slim, again, F.col("page_id") == F.col("id"), "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, size, records, files = None, "", 0, 0, []
        version = 1
        for batch in batches:
            for page_id, url, html, again in zip(*batch.columns, strict=True):
                if out is None:
                    name, size, records, version = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 3 - version
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    first = to_warc(next(read_arc(io.BytesIO(arc_start(name, _date_of(0), version)))))
                    out.write(gzip.compress(first, 1))
                page_id, payload = page_id.as_py(), html.as_py()
                arc = arc_start(name, _date_of(0), version) + page_as_arc(page_id, url.as_py(), payload, version)
                refers, extra = None, {}
                to = dict(again.as_py()).get(digest := hashlib.sha1(payload).hexdigest()) if again.is_valid else None
                if to is not None:
                    label = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                    target = re.sub(r"[\r\n]+", "%0A", to["refers_url"]) or "unknown:"
                    refers = record_id(target, _date_of(to["refers_to"]), label), target, iso_date(_date_of(to["refers_to"]))
                    extra = {"X-Refers-To-Page": str(to["refers_to"]), "X-Payload-Length": str(len(payload))}
                for r, warc in convert(io.BytesIO(arc), lambda r: None if r.url.startswith("filedesc:") else refers, lambda r: extra):  # noqa: B023
                    if not r.url.startswith("filedesc:"):
                        member = gzip.compress(warc, 1)
                        out.write(member)
                        size += len(member)
                        records += 1
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, records))
                    out = None
        if out is not None:
            out.close()
            files.append((name, records))
        names, counts = zip(*files, strict=True) if files else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return common.materialize(both.mapInArrow(run, "file string, records long"), "warc-manifest")


def read_back(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, date, payload_bytes, payload_digest, record_type, refers_to) of the records of the listed files.
    Each record's length and block digest are checked, and a response's payload digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for member in gunzip_members(content.as_py()):
                    head, block = read_warc_record(member)
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    if kind != "revisit" and sha1_label(payload) != head["WARC-Payload-Digest"]:
                        raise ValueError("a payload doesn't have its declared digest")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
                    size = int(head["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    refers = head.get("X-Refers-To-Page")
                    rows.append((None if page is None else int(page[1]), head["WARC-Target-URI"], head["WARC-Date"], size, digest, kind, None if refers is None else int(refers)))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    listed = files.join(manifest, F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi").select("content")
    return listed.mapInArrow(run, "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC and read them back. Null ids stay null and neither revisit nor are revisited; pages that
    share an id are told apart by their payloads."""
    common.bound_batches(pages)
    folder = common.fresh_path(pages.sparkSession, "warc")
    return read_back(pages.sparkSession, folder, written(pages, folder))
