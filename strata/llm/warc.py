"""WARC records in ZIP packages: writing, and reading by directory and range without extraction.

``write_archives`` turns pages into WARC records and packs them into ZIP files of bounded size
in the shared folder.  A package holds two stored members, ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (one line per record with its offset and length).
Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is
a response; the others are revisits that refer to it and carry its digest and length.

``read_archives`` finds the end of a package's central directory, follows the ZIP64 locator where
there is one, lists the members, locates the stored index and archives, and reads every record by
its byte range.

Task output reaches the packages through ``pyarrow.fs``, so the folder may be local, HDFS or an
object store.  Packages have unique names and only those of finished tasks are listed, so a lost
executor leaves no trace in the result.  Payloads are shuffled only if copies are many.

Defined results: null html is an empty payload; a null url is left out; rows that repeat an id
and a payload are all responses if the id is the smallest; a null id is never the one referred
to (equal payloads with null ids only are all responses); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import shared_folder, ship, written

ship(__name__)

PACKAGE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records -------------------------------------------------------------------------------------
def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response, or with ``refers_to`` a revisit, as WARC 1.1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<{RECORD_URN}{'' if x is None else urllib.parse.quote(str(x), safe='')}>"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": DATE,
            "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response",
            "Content-Length": str(len(block))}
    if url is not None:
        head["WARC-Target-URI"] = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
    if refers_to is not None:
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse_record(data: bytes) -> dict:
    """``page_id`` (text), ``url``, ``payload`` (of a response), ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to`` (text)."""
    head, rest = _headers(data)
    block = rest[:int(head["content-length"])]
    http, payload = _headers(block)
    named = lambda x: (urllib.parse.unquote(x[len(RECORD_URN) + 1:-1]) or None) if x else None
    kind = head["warc-type"]
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    size = len(payload) if kind == "response" else int(http["content-length"])
    found = digest(payload) if kind == "response" else stated
    if found != stated or size != int(http["content-length"]):
        raise ValueError(f"record {head['warc-record-id']}: its payload is not what its headers say")
    return {"page_id": named(head["warc-record-id"]), "url": head.get("warc-target-uri"),
            "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": found,
            "record_type": kind, "refers_to": named(head.get("warc-refers-to"))}


# --- ZIP directories ---------------------------------------------------------------------------------
@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


class Package:
    """Random access to the stored members of a ZIP file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"{n} bytes wanted at {at}, {len(data)} there")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65_557)  # the end record and the longest comment
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if locator >= 0 and (found := self.read(locator, 20))[:4] == b"PK\x06\x07":
            end64 = self.read(struct.unpack_from("<Q", found, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator leads nowhere")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        directory, i = self.read(at, length), 0
        for _ in range(count):
            if directory[i:i + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            method = struct.unpack_from("<H", directory, i + 10)[0]
            packed, size, names, extras, comment = struct.unpack_from("<IIHHH", directory, i + 20)
            header_at = struct.unpack_from("<I", directory, i + 42)[0]
            name = directory[i + 46:i + 46 + names].decode()
            extra = directory[i + 46 + names:i + 46 + names + extras]
            wide = self._wide(extra)
            for field in ("size", "packed", "header_at"):  # each present only where the short one is full
                if {"size": size, "packed": packed, "header_at": header_at}[field] == 0xFFFFFFFF:
                    value = next(wide)
                    size, packed, header_at = (value if field == "size" else size, value if field == "packed" else packed,
                                               value if field == "header_at" else header_at)
            yield Member(name, method, packed, header_at)
            i += 46 + names + extras + comment

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        """The 64-bit numbers of the ZIP64 extra field."""
        i = 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, i + 4)
            i += 4 + n

    def starts(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed; its records can't be read by range")
        local = self.read(m.header_at, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        names, extras = struct.unpack_from("<HH", local, 26)
        return m.header_at + 30 + names + extras

    def records(self) -> Iterator[dict]:
        """Every record that an index lists, read by its range."""
        for index in sorted(n for n in self.members if n.startswith("indexes/")):
            at, base = self.starts(index), {}
            for line in io.BytesIO(self.read(at, self.members[index].size)):
                entry = json.loads(line.split(b" ", 2)[2])
                name = f"archive/{entry['filename']}"
                start = base.setdefault(name, None) or self.starts(name)
                base[name] = start
                yield parse_record(gzip.decompress(self.read(start + entry["offset"], entry["length"])))


# --- jobs ----------------------------------------------------------------------------------------------
def _pack(rows: list[tuple[bytes, str]]) -> bytes:
    data, lines, at = [], [], 0
    for body, url in rows:
        data.append(body)
        entry = json.dumps({"url": url, "offset": at, "length": len(body), "filename": DATA.split("/")[1]})
        lines.append(f"{urllib.parse.quote(url, safe='')} {DATE.translate({45: None, 58: None, 84: None, 90: None})} {entry}\n")
        at += len(body)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), b"".join(data))
        z.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
    return out.getvalue()


def write_archives(pages: DataFrame, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """``page_id, url, html`` -> the packages written: ``path, records, bytes``."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    big = F.octet_length("html") >= least_bytes
    first = (rows.where(big).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull()).select("sha1", "first"))
    revisit = F.when(big & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(first, "sha1", "left").select("page_id", "url", "html", revisit.cast("string").alias("refers_to"))

    def run(batches):
        target, root = opened(folder)
        target.create_dir(root, recursive=True)
        held, size = [], 0

        def flush():
            name, data = f"{uuid.uuid4().hex}.wacz", _pack(held)
            with target.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page in zip(*columns, strict=True):
                page_id, url, text, refers_to = (x.as_py() for x in page)
                body = gzip.compress(record(page_id, url, text.encode(), refers_to), 6, mtime=0)
                held.append((body, url or ""))
                size += len(body)
                if size >= package_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "packages")


RECORD_COLUMNS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_archives(packages: DataFrame, payload: bool = False) -> DataFrame:
    """``path`` of packages -> one row per record; ids as text.  ``payload`` adds the payloads."""
    names = [*RECORD_COLUMNS, *["payload"] * payload]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, inner = opened(path)
                with source.open_input_file(inner) as f:
                    rows, size = [], 0
                    for r in Package(f, f.size()).records():
                        rows.append([r[c] for c in names])
                        size += r["payload_bytes"] if payload else 100
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names)
    files = max(1, packages.count())  # one row per package
    return packages.select("path").repartition(files).mapInArrow(run, schema)
