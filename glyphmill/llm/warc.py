"""Legacy archive converter: ARC files of version 1 or 2 to WARC files, and both read back.

An ARC file starts with a version block whose third line names the fields of the header lines; a record is a header
line and as many bytes as the line's last field declares. The URL and the content type of a header line may hold spaces.
The converter gives each record what WARC asks for: an identifier (a UUID of the file's name and the record's offset), a
timestamp (the digits spelt out; what a date of under 14 digits leaves out is the first month, day, hour, and a date that
is none at all is that of the file), a type, and SHA-1 digests of block and payload. An HTTP response is a `response`
whose payload follows its head, which may end in bare line feeds and hold any bytes; any other block (dns, ftp, old
servers' headless answers) is a `resource`, all of it payload. A response whose payload an earlier key's record has
already is a `revisit`: it keeps its HTTP head, names that record and that payload's digest, and holds no payload.

Which record is the first of its payload is settled for all files together, by digest and length; equal keys by place.
Defined results: null or empty html: an empty payload; keys of any type that text can hold and that orders; a null key
sorts first and comes back as null; equal rows and ties: the first is the response; very long texts: whole, in a file of
their own size; null url: about:blank; null date: DATE; empty table: no files, no rows; other columns, of any name, are
not archived.
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
from datetime import datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import files
from glyphmill.llm.shared import dealt_files, fresh_folder, join_split, remove, written

#: Field names of the header lines, by version (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
FILE_BYTES = 8 << 20
#: The date of records without one.
DATE = "20240101000000"
_HEADER_START = re.compile(rb"(.*?) ([0-9A-Fa-f.:]+|-) (\d+|-) (.*)", re.DOTALL)
_FIRST_DATE = "00010101000000"
_NAMESPACE = uuid.UUID("6f1d2f6e-6f0b-5f39-9a55-0c3f3f1f7a11")


def _member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ARC


class ArcWriter:
    """An ARC file in memory; each record is a gzip member of its own."""

    def __init__(self, name: str, version: int, date: str):
        self.name, self.version, self.date = name, version, date
        second = f"{version} 0 glyphmill\n{FIELDS[version]}\n"
        self.parts, self.raw = [], 0
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain "
        self._put((head + ("200 - - 0 " + name + " " if version == 2 else "") + f"{len(second)}\n").encode() + second.encode() + b"\n")

    def _put(self, data: bytes) -> None:
        self.parts.append(_member(data))
        self.raw += len(data)

    def add(self, url: str, kind: str, block: bytes, date: str | None = None, ip: str = "0.0.0.0") -> None:
        line = f"{url} {ip} {date or self.date} {kind} "
        if self.version == 2:
            line += f"200 {zlib.crc32(block):08x} - {self.raw} {self.name} "
        self._put(f"{line}{len(block)}\n".encode() + block + b"\n")

    def content(self) -> bytes:
        return b"".join(self.parts)


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes
    #: the date in the file's version block
    file_date: str = DATE


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzip, after its version block."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    first = stream.readline()
    about = stream.read(int(first.rsplit(b" ", 1)[1]))
    version, names = int(about.split(b" ", 1)[0]), about.split(b"\n")[1].decode().split(" ")
    if version not in FIELDS or names[-1] != "Archive-length":
        raise ValueError(f"unknown archive version {version}")
    at, file_date = len(first) + len(about), first.split(b" ")[2].decode("ascii", "replace")
    while line := stream.readline():
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        values = _fields(line.rstrip(b"\r\n"), len(names))
        if values is None:
            raise ValueError(f"header line without its {len(names)} fields at {begin}")
        block = stream.read(int(values[-1]))
        if len(block) != int(values[-1]):
            raise ValueError(f"record at {begin} ends early")
        at += len(block)
        yield ArcRecord(begin, dict(zip(names, (v.decode("utf-8", "replace") for v in values), strict=True)), block, file_date)


def _fields(line: bytes, count: int) -> list[bytes] | None:
    """The fields of a header line: URL, address, date and type from the left, what follows the type from the right."""
    head, *tail = line.rsplit(b" ", count - 4)
    start = _HEADER_START.fullmatch(head)
    if start is None or len(tail) != count - 4 or not tail[-1].isdigit():
        return None
    return [*start.groups(), *tail]


def http_block(payload: bytes, key: str | None) -> bytes:
    named = "" if key is None else f"X-Archive-Key: {quote(key)}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload


def is_http(block: bytes) -> bool:
    return block.startswith(b"HTTP/")


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers by lower-case name, head, payload) of an HTTP response; of any other block, all is payload."""
    if not is_http(block):
        return {}, b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    head = block[: end.end()] if end else block
    pairs = (line.partition(b":") for line in head.splitlines()[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in pairs}, head, block[len(head) :]


def archive_key(headers: dict[str, str]) -> str | None:
    key = headers.get("x-archive-key")
    return None if key is None else unquote(key)


# ---------------------------------------------------------------- WARC


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{file.rsplit('/', 1)[-1]}#{offset}')}>"


def warc_date(arc_date: str, file_date: str = DATE) -> str:
    """A timestamp of the digits of an ARC date; of the file's where they are no date."""
    for digits in (arc_date, file_date, DATE):
        digits = digits[:14]
        try:
            when = datetime.strptime(digits + _FIRST_DATE[len(digits) :] if len(digits) >= 4 else "", "%Y%m%d%H%M%S")
        except ValueError:
            continue
        return when.isoformat() + "Z"
    raise ValueError(f"no date in {arc_date!r}")


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return _member(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def convert(file: str, record: ArcRecord, refers_to: str | None) -> bytes:
    """The WARC record of an ARC record; refers_to: the identifier of the response that has its payload already."""
    _, head, payload = split_http(record.block)
    http = is_http(record.block)
    refers_to = refers_to if http else None
    block = head if refers_to else record.block
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response" if http else "resource"),
        ("WARC-Record-ID", record_id(file, record.offset)),
        ("WARC-Date", warc_date(record.fields["Archive-date"], record.file_date)),
        ("WARC-Target-URI", record.fields["URL"]),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("Content-Type", "application/http; msgtype=response" if http else record.fields["Content-type"]),
        ("X-Payload-Length", str(len(payload))),
    ]
    if record.fields["IP-address"] not in ("0.0.0.0", "-"):
        headers.append(("WARC-IP-Address", record.fields["IP-address"]))
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    return warc_record(headers, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(headers["content-length"]))
        yield headers, block


# ---------------------------------------------------------------- tables


def write_arc(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: Column | None = None, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The rows as ARC files; a table (file). date: the 14 digits of each row's; versions: those that the rows are dealt
    over, by a hash of key and URL."""
    dealt = F.pmod(F.xxhash64(key, url), F.lit(len(versions))).cast("int")
    when = F.lit(DATE) if date is None else F.coalesce(date, F.lit(DATE))
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), when.alias("date"), dealt.alias("dealt"))

    def run(batches):
        open_: dict[int, ArcWriter] = {}
        for batch in batches:
            for k, u, h, d, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n not in open_:
                    open_[n] = ArcWriter(f"{uuid.uuid4().hex}.arc.gz", versions[n], d)
                open_[n].add("".join((u or "about:blank").split()) or "about:blank", "text/html", http_block((h or "").encode(), k), d)
                if open_[n].raw >= FILE_BYTES:
                    yield _named(files.create(folder, open_.pop(n).content(), ".arc.gz"))
        for arc in open_.values():
            yield _named(files.create(folder, arc.content(), ".arc.gz"))

    return rows.mapInArrow(run, "file string")


def _named(file: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])


def payloads(listing: DataFrame, key_type: str = "bigint") -> DataFrame:
    """file, offset, key, digest, bytes of each HTTP record of the ARC files."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                out = ([], [], [], [], [])
                for record in read_arc(files.load(file)):
                    if is_http(record.block):
                        headers, _, payload = split_http(record.block)
                        for column, value in zip(out, (file, record.offset, archive_key(headers), sha1_base32(payload), len(payload)), strict=True):
                            column.append(value)
                arrays = [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "offset", "key", "digest", "bytes"])

    return listing.select("file").mapInArrow(run, "file string, offset long, key string, digest string, bytes long").withColumn("key", F.col("key").cast(key_type))


def convert_files(listing: DataFrame, folder: str, least_bytes: int = 0, key_type: str = "bigint") -> DataFrame:
    """ARC files as WARC files, one for one; a table (file). Payloads under least_bytes are always responses."""
    found = written(payloads(listing, key_type), "payloads").where(F.col("bytes") >= least_bytes)
    firsts = found.groupBy("digest", "bytes").agg(F.min(F.struct("key", "file", "offset")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1"), "firsts")
    repeated = join_split(found, firsts, ["digest", "bytes"]).where("not (first.file = file and first.offset = offset)")
    # what a file's records refer to is bounded by the file
    notes = repeated.groupBy("file").agg(F.collect_list(F.struct("offset", F.col("first.file").alias("to_file"), F.col("first.offset").alias("to_offset"))).alias("notes"))
    work = listing.join(notes, "file", "left").select("file", "notes")

    def run(batches):
        for batch in batches:
            for file, notes_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = {n["offset"]: record_id(n["to_file"], n["to_offset"]) for n in notes_ or ()}
                name = f"{file.rsplit('/', 1)[-1]}"
                info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", warc_date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: glyphmill\r\n")
                parts = [info, *(convert(file, r, refers.get(r.offset)) for r in read_arc(files.load(file)))]
                yield _named(files.create(folder, b"".join(parts), ".warc.gz"))

    return work.mapInArrow(run, "file string")


def read_files(listing: DataFrame, key: str = "page_id", key_type: str = "bigint") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of each record of the WARC files."""

    def run(batches):
        names = ["key", "id", "payload_bytes", "payload_digest", "record_type", "refers_id"]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                out: tuple[list, ...] = tuple([] for _ in names)
                for headers, block in read_warc(files.load(file)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    http, _, payload = split_http(block)
                    named = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and sha1_base32(payload) != named:
                        raise ValueError(f"payload of {headers['warc-record-id']} in {file} does not match its digest")
                    row = (archive_key(http), headers["warc-record-id"], int(headers["x-payload-length"]), named, kind, headers.get("warc-refers-to"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    rows = listing.select("file").mapInArrow(run, "key string, id string, payload_bytes long, payload_digest string, record_type string, refers_id string")
    rows = written(rows.withColumn("key", F.col("key").cast(key_type)), "records")
    named = rows.where("refers_id is not null")
    uses = named.groupBy("refers_id").agg(F.count(F.lit(1)).alias("n"))
    targets = rows.where("record_type = 'response'").select(F.col("id").alias("refers_id"), F.col("key").alias("refers_to"))
    found = join_split(named, written(targets.join(uses, "refers_id"), "targets"), ["refers_id"]).drop("refers_id", "n")
    plain = rows.where("refers_id is null").drop("refers_id").withColumn("refers_to", F.lit(None).cast(key_type))
    return found.unionByName(plain).select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: Column | None = None, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The rows written as ARC, converted to WARC and read back."""
    spark = df.sparkSession
    arc_folder = fresh_folder(spark, "arc")
    key_type = df.select(key).schema[0].dataType.simpleString()
    arcs = written(write_arc(df, arc_folder, key, url, html, date, versions), "arcs")
    warcs = written(convert_files(dealt_files(arcs), fresh_folder(spark, "warc"), least_bytes, key_type), "warcs")
    remove(spark, arc_folder)
    return read_files(dealt_files(warcs), key, key_type)


def op9(spark, sf_dir: str) -> DataFrame:
    """All pages archived, converted and read back. The table has no dates; each URL gets a second of 2024 of its own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    second = F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(366 * 86400))
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + second), "yyyyMMddHHmmss")
    return archive(pages, date=date)
