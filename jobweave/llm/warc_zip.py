"""WARC archives packaged as ZIP files, and a reader that never unpacks them.

A package holds `archive/data.warc.gz` (one gzip member per record) and `indexes/index.cdxj` (one line per record with offset
and length), both stored without compression.  The reader finds the directory from the end of the file, in its ZIP64 form too,
takes the place of a stored member from its local header, reads the index, and then reads ranges of the archive: every record
can be read by its own offset.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import attach, shipped, stored, table
from jobweave.sources.workdir import shared_folder

MIN_REVISIT = 100
#: Bytes of records after which a task begins another package, and bytes that one read of the reader covers.
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    if re.match(r"[a-z][a-z0-9+.-]+:", uri) is None:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# ------------------------------------------------------------------------------------------------ records


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  Control signs and blanks of the address are percent-encoded; a missing one is about:blank."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page), "WARC-Date": DATE, "WARC-Target-URI": safe, "WARC-Payload-Digest": f"sha256:{digest}"}
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
        head |= {"X-Refers-To-Page": str(refers_to)} if refers_to is not None else {}
    head |= {"X-Page": str(page)} if page is not None else {}
    head |= {"X-Original-URI": json.dumps(url)} if url is None or safe != url else {}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    digest: str
    payload: bytes | None


def parsed(data: bytes) -> Record:
    """A record from its bytes; a payload that does not have its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    url = json.loads(fields["X-Original-URI"]) if "X-Original-URI" in fields else fields["WARC-Target-URI"]
    return Record(number("X-Page"), url, fields["WARC-Type"], number("X-Refers-To-Page"), digest, payload)


class Package:
    """One ZIP package while it is written; it gets its name when it is whole."""

    def __init__(self, folder: str) -> None:
        self.system, base = opened(folder)
        self.path = f"{base}/{uuid.uuid4().hex}.zip"
        self.sink = self.system.open_output_stream(f"{self.path}.part")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.offset = [], 0

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.data.write(member)
        self.index.append(json.dumps({"offset": self.offset, "length": len(member)}))
        self.offset += len(member)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.sink.close()
        self.system.move(f"{self.path}.part", self.path)
        return self.path, len(self.index)


def decisions(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html (never null) with payload digest, `keeper` and `revisit`.

    Of equal payloads of at least `min_revisit` bytes the smallest page_id is the keeper; all rows with another id revisit
    it, rows without an id too.  Rows that repeat the keeper's id are responses like it.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    again = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("keeper"))
    marked = attach(rows, again.filter("n > 1 AND keeper IS NOT NULL"), "digest", "n", ["page_id", "url"])
    return marked.withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every page; returns the packages: path, n_records.

    Each task streams into packages of its own with fresh names; the returned table names those of the attempts that
    counted, so a lost executor leaves at most files that no table names.  An empty table writes no package.
    """
    spark = shipped(pages.sparkSession)
    system, base = opened(folder)
    system.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page, url, html, digest, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or Package(folder)
                package.add(record(page, url, html.encode("utf-8", "surrogatepass"), digest, keeper if revisit else None, revisit))
                if package.offset >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    rows = decisions(pages, min_revisit).select("page_id", "url", "html", "digest", "keeper", "revisit")
    prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    paths = stored(rows.mapInArrow(write, "path string, n_records bigint"), "packages")
    return paths.withColumn("path", F.concat(F.lit(prefix), "path"))


# ------------------------------------------------------------------------------------------------ reading


@dataclass
class Member:
    name: str
    method: int
    size: int
    offset: int


def members(file: pa.NativeFile) -> list[Member]:
    """The central directory of a ZIP file, found from its end; ZIP64 fields win over the short ones."""
    size = file.size()
    tail_at = max(0, size - 22 - 65_535 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, directory_size, directory_at = struct.unpack("<10xHII", tail[end : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack("<8xQ", tail[end - 20 : end - 4])
        record64 = file.read_at(56, end64)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 directory")
        count, directory_size, directory_at = struct.unpack("<32xQQQ", record64)
    directory, at, found = file.read_at(directory_size, directory_at), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP directory")
        flags, method, packed, plain, n_name, n_extra, n_comment, offset = struct.unpack("<8xHH8xIIHHH8xI", directory[at : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, long = directory[at + 46 + n_name : at + 46 + n_name + n_extra], [plain, packed, offset]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                rest = extra[4 : 4 + n]
                for i, value in enumerate(long):
                    if value == 0xFFFFFFFF:
                        (long[i],), rest = struct.unpack("<Q", rest[:8]), rest[8:]
            extra = extra[4 + n :]
        found.append(Member(name, method, long[1], long[2]))
        at += 46 + n_name + n_extra + n_comment
    return found


def member_start(file: pa.NativeFile, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    head = file.read_at(30, member.offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    return member.offset + 30 + sum(struct.unpack("<26xHH", head))


def record_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole records, from the packages' own indexes: path, start, lengths.  Packages without an archive have none."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, base = opened(path)
                with system.open_input_file(base) as file:
                    by_name = {m.name: m for m in members(file)}
                    if DATA not in by_name or INDEX not in by_name:
                        continue
                    index, data = by_name[INDEX], member_start(file, by_name[DATA])
                    lines = file.read_at(index.size, member_start(file, index)).decode().splitlines()
                starts, lengths, own, total, at = [], [], [], 0, None
                for entry in map(json.loads, lines):
                    if own and (total + entry["length"] > range_bytes or data + entry["offset"] != at + total):
                        starts.append(at)
                        lengths.append(own)
                        own, total, at = [], 0, None
                    at = data + entry["offset"] if at is None else at
                    own.append(entry["length"])
                    total += entry["length"]
                if own:
                    starts.append(at)
                    lengths.append(own)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["path", "start", "lengths"])

    shipped(archives.sparkSession)
    return archives.select("path").mapInArrow(plan, "path string, start bigint, lengths array<bigint>")


def read_archives(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the packages: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Ranges are spread over tasks by number: the table of ranges is tiny, what it stands for is not.  Revisits have no payload
    and no size here; without `payloads` none is returned.
    """
    ranges = stored(record_ranges(archives, range_bytes), "ranges")
    tasks = max(1, min(-(-ranges.count() // 2), 100_000))
    ranges = ranges.repartition(tasks, "path", "start")
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                system, base = opened(path)
                with system.open_input_file(base) as file:
                    data, at, rows = file.read_at(sum(lengths), start), 0, []
                for length in lengths:
                    r = parsed(zlib.decompress(data[at : at + length], 31))
                    at += length
                    rows.append((r.page_id, r.url, r.kind, r.refers_to, r.digest, None if r.payload is None else len(r.payload), r.payload if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
    return ranges.mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records without payloads in which revisits have the size of the payload that they refer to."""
    records = stored(records.drop("payload"), "records")
    revisit = F.col("record_type") == "revisit"
    sizes = records.groupBy("payload_digest").agg(F.sum(revisit.cast("bigint")).alias("n"), F.max("payload_bytes").alias("_bytes"))
    rows = attach(records, sizes.filter("n > 0"), "payload_digest", "n", ["page_id", "url"])
    return rows.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages to packages and read them back."""
    archives = write_archives(table(spark, folder, "pages"), f"{shared_folder(spark)}/warc")
    rows = resolved(read_archives(archives, payloads=False))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
