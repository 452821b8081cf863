"""WARC archives packaged in ZIP files: writing, and reading without extraction.

A package is a ZIP file of stored (uncompressed) members: archives, in which
every record is a gzip member of its own, and indexes with a line of JSON for
each record; those written here have one of each. The reader parses the end record, the ZIP64 locator and
end record, the central directory with its ZIP64 fields and the members' local
headers, and so knows where the stored members lie in the package; it then
fetches each index once and deals its entries out in slices, whose records are
fetched by byte range.

Of records with equal payloads the one with the smallest id is a response, the
others are revisits of it and carry no payload; payloads under ``min_bytes`` are
always responses. Rows that repeat the smallest id are responses, too. Null
payloads are empty. Null ids are written without a number, come last in a tie,
and read back as null; of equal payloads that all have null ids every one is a
response, since a revisit could name none. Packages are files in a shared folder; a manifest names
those of the attempts that succeeded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import fresh_path, materialize, values

#: The format's names and signatures.
ARCHIVES, INDEXES = "archive/", "indexes/"
ARCHIVE, INDEX = "data.warc.gz", "index.cdxj"
DATE = "2020-01-01T00:00:00Z"
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: A package is closed beyond so many bytes of archive, or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 128 << 20, 50_000
#: Records read by one task at a time.
SLICE = 2_000
#: A payload is joined apart if it makes up more than one in so many of the pages that share theirs; so many there are at most.
HOT = 1_000


# --- records -------------------------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> tuple[bytes, str]:
    """A WARC record and the digest of its payload."""
    digest = sha1_base32(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    body = HTTP_HEAD
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Identified-Payload-Length: {len(payload)}"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


class Record(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    payload_digest: str
    payload_bytes: int
    refers_to: int | None
    payload: bytes


def _number(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def parse_record(data: bytes) -> Record:
    """A record as it was written; the digest is that of the payload read, for a revisit that which it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(h["content-length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    stated = h["warc-payload-digest"].strip().removeprefix("sha1:")
    if h["warc-type"] == "revisit":
        return Record(_number(h["warc-record-id"]), h["warc-target-uri"], "revisit", stated, int(h["warc-identified-payload-length"]), _number(h["warc-refers-to"]), b"")
    found = sha1_base32(payload)
    if found != stated:
        raise ValueError(f"digest of {h['warc-record-id']} is {found}, not {stated}")
    return Record(_number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], found, len(payload), None, payload)


# --- packages: reading ---------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


class Package:
    """Stored members of a ZIP file, by byte ranges of a file that can seek."""

    def __init__(self, file, size: int):
        self.file = file
        self.members = {m.name: m for m in self._directory(size)}

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError(f"{n} bytes wanted at {at}, {len(out)} there")
        return out

    def _directory(self, size: int) -> Iterator[Member]:
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(END, 0, len(tail) - 18)
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):  # the mark may also occur in the comment
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != LOCATOR:
                raise ValueError("no ZIP64 locator")
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        entries, at = self.read(start, length), 0
        for _ in range(count):
            if entries[at : at + 4] != ENTRY:
                raise ValueError("central directory entry expected")
            method = struct.unpack_from("<H", entries, at + 10)[0]
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entries, at + 20)
            header = struct.unpack_from("<I", entries, at + 42)[0]
            name = entries[at + 46 : at + 46 + n_name].decode()
            extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = self._wide(extra)
            # In this order, and only those that are saturated, stand in the ZIP64 field.
            full, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (full, packed, header))
            yield Member(name, method, full, packed, header)
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                for i in range(at + 4, at + 4 + n - 7, 8):
                    yield struct.unpack_from("<Q", extra, i)[0]
            at += 4 + n

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin in the package."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed, not stored")
        local = self.read(m.header, 30)
        if local[:4] != LOCAL:
            raise ValueError("local header expected")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + n_name + n_extra

    def member(self, name: str) -> bytes:
        return self.read(self.start(name), self.members[name].size)


def open_package(path: str, out: str):
    fs, _ = pafs.FileSystem.from_uri(out)
    file = fs.open_input_file(path)
    return file, Package(file, file.size())


# --- packages: writing ---------------------------------------------------------------------------


class Writer:
    """One package: records go straight to the file; the index follows when it is closed."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVES + ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, url, payload: bytes, refers_to, is_revisit: bool) -> None:
        data, digest = record(page_id, url, payload, refers_to, is_revisit)
        packed = gzip.compress(data, 3, mtime=0)
        self.archive.write(packed)
        self.lines.append(json.dumps({"id": page_id, "url": url, "offset": self.at, "length": len(packed), "digest": digest, "filename": ARCHIVE}, ensure_ascii=False))
        self.at += len(packed)

    def close(self) -> None:
        self.archive.close()
        with self.zip.open(zipfile.ZipInfo(INDEXES + INDEX), "w") as index:
            for line in self.lines:
                index.write(line.encode() + b"\n")
        self.zip.close()


def _written(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(out)
        fs.create_dir(folder, recursive=True)
        writer = stream = None
        path, done = "", []

        def close() -> None:
            nonlocal writer
            writer.close()
            stream.close()
            done.append((path, len(writer.lines)))
            writer = None

        for batch in batches:
            for page_id, url, html, refers_to, is_revisit in zip(*map(values, batch.columns), strict=True):
                if writer is None:
                    path = f"{folder}/pages-{uuid.uuid4().hex}.zip"
                    stream = fs.open_output_stream(path)
                    writer = Writer(stream)
                writer.add(page_id, url, (html or "").encode(), refers_to, is_revisit)
                if writer.at >= PACKAGE_BYTES or len(writer.lines) >= PACKAGE_RECORDS:
                    close()
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_records"])

    return run


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to packages in the shared folder ``out``; the manifest: path, n_records."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    # Only payloads that several pages share; what is shuffled for it is an id and a digest a page, added up before.
    firsts = materialize(
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("same"), "first_id", "n"), "first-pages",
    )
    # Where the table of shared payloads is large, pages are shuffled to meet it; those with a hot payload are spread by id.
    least = firsts.agg((F.sum("n") / HOT).alias("least"))
    hot = materialize(firsts.join(F.broadcast(least), F.col("n") > F.col("least")).select(F.col("same").alias("hot"), F.col("first_id").alias("hot_id")), "hot-pages")
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    is_hot = F.col("hot").isNotNull()
    rows = rows.withColumn("meets", F.when(~is_hot, F.col("digest"))).withColumn("spread", F.when(is_hot, F.xxhash64("page_id", "url")).otherwise(0))
    joined = rows.join(firsts.select("same", "first_id"), (F.col("meets") == F.col("same")) & (F.col("spread") == 0), "left")
    joined = joined.withColumn("first_id", F.coalesce("hot_id", "first_id"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    parts = joined.select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"), again.alias("is_revisit"))
    return materialize(parts.mapInArrow(_written(out), "path string, n_records long"), "packages")


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


SLICES = pa.schema([("path", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def index_entries(package: Package) -> Iterator[tuple[int, int]]:
    """Where the records of all indexes lie in the package, and their lengths. An entry without file name is of the only archive."""
    starts = {n.removeprefix(ARCHIVES): package.start(n) for n in package.members if n.startswith(ARCHIVES) and not n.endswith("/")}
    for name in package.members:
        if not name.startswith(INDEXES) or name.endswith("/"):
            continue
        for line in package.member(name).splitlines():
            if (at := line.find(b"{")) < 0:
                continue
            e = json.loads(line[at:])
            of = e.get("filename") or (next(iter(starts)) if len(starts) == 1 else None)
            if of not in starts:
                raise ValueError(f"the index names the archive {of}, which the package doesn't hold")
            yield starts[of] + int(e["offset"]), int(e["length"])


def _slices(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file, package = open_package(path, out)
                with file:
                    found = list(index_entries(package))
                parts = [found[i : i + SLICE] for i in range(0, len(found), SLICE)]
                columns = [[path] * len(parts), [[at for at, _ in p] for p in parts], [[n for _, n in p] for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SLICES, strict=True)], schema=SLICES)

    return run


def _read(out: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    found, held = [], 0
                    for at, n in zip(offsets, lengths, strict=True):
                        file.seek(at)
                        found.append(parse_record(zlib.decompress(file.read(n), 31)))
                        held += len(found[-1].payload)
                        if len(found) >= 500 or held > 8 << 20:
                            yield _batch(found, with_payload)
                            found, held = [], 0
                    yield _batch(found, with_payload)

    return run


def _batch(found: list[Record], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * with_payload]
    columns = [pa.array([getattr(r, n) for r in found], k) for n, k in zip(("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"), kinds, strict=False)]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * with_payload])


def read_archives(manifest: DataFrame, out: str, with_payload: bool = False) -> DataFrame:
    """Every record of the packages, by range reads: page_id, url, record_type, payload_digest, payload_bytes, refers_to, and the payload if asked for."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = manifest.select("path").mapInArrow(_slices(out), "path string, offsets array<long>, lengths array<long>")
    return slices.repartition(parts, "path", F.col("offsets")[0]).mapInArrow(_read(out, with_payload), RECORDS + ", payload binary" * with_payload)


def query(spark, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_archives(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, '')) AS payload_bytes
  FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex),
d AS (
  SELECT hex, first_id, list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)
         ), 'string_agg', '') AS payload_digest
  FROM f)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN d.first_id IS NULL OR p.page_id = d.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = d.first_id THEN NULL ELSE d.first_id END AS refers_to
FROM p JOIN d ON p.hex = d.hex
"""
