"""Web archives in ZIP packages: written by tasks, read back by byte range without unpacking.

Each task writes packages with two *stored* members: ``archive/data.warc.gz``,
records compressed one by one, and ``indexes/index.cdxj``, a line per record
with its place.  The reader finds the end record, or its ZIP64 form, reads the
central directory, finds both members' bytes through their local headers, and
then reads runs of records by range.  Paths that a task has written come back
as rows of a stored manifest; what a lost task left behind is not on it.

Of records with equal payloads of at least ``least_bytes``, that with the
smallest id is the response and the others are revisits, which hold no payload.
Only digests are grouped, so a payload that a third of the pages share is no
large group.

Defined results: a null html is an empty payload; a row with a null id is a
response that nothing refers to; repeated rows give a record each; a url that
is null is left out of its record; an empty table writes no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantis.session import new_folder

from .common import only, prepared, stored, utf8

LEAST_BYTES = 0
PACKAGE_BYTES, RUN_BYTES = 1 << 28, 1 << 23
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record, compressed."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"),
              ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest_text(hashlib.sha1(payload).digest())}"),
              ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(data: bytes) -> dict:
    """The fields of an uncompressed record in lower case, its payload under "payload"."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    out = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[:int(out["content-length"])]
    return out | {"payload": block.partition(b"\r\n\r\n")[2]}


class Package:
    """A package being written to a stream; needs no way back in it."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.path, self.lines, self.size = path, [], 0
        self.stream = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, data: bytes) -> None:
        self.lines.append(json.dumps({"offset": self.size, "length": len(data)}))
        self.member.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.stream.close()


def _at(source, begin: int, size: int) -> bytes:
    source.seek(begin)
    return source.read(size)


def directory(source, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a package: name -> (method, offset of its local header, stored bytes)."""
    tail_at = max(0, size - 65_557)
    tail = _at(source, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP package")
    count, length, begin = struct.unpack("<HII", tail[end + 10:end + 20])
    locator = _at(source, tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        wide = _at(source, struct.unpack("<Q", locator[8:16])[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is damaged")
        count, length, begin = struct.unpack("<QQQ", wide[32:56])
    entries, members, at = _at(source, begin, length), {}, 0
    for _ in range(count):
        if entries[at:at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, plain = (struct.unpack("<H", entries[at + 10:at + 12])[0], *struct.unpack("<II", entries[at + 20:at + 28]))
        name_len, extra_len, note_len = struct.unpack("<HHH", entries[at + 28:at + 34])
        header, = struct.unpack("<I", entries[at + 42:at + 46])
        name = entries[at + 46:at + 46 + name_len].decode("utf-8", "replace")
        extra, x = entries[at + 46 + name_len:at + 46 + name_len + extra_len], 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[x:x + 4])
            if tag == 1:  # 64-bit values of the fields that are full, in this order
                values = iter(struct.unpack(f"<{n // 8}Q", extra[x + 4:x + 4 + n // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            x += 4 + n
        members[name] = (method, header, packed)
        at += 46 + name_len + extra_len + note_len
    return members


def stored_bytes(source, member: tuple[int, int, int]) -> tuple[int, int]:
    """(begin, size) of a stored member's bytes."""
    method, header, size = member
    if method:
        raise ValueError("only stored members can be read by range")
    local = _at(source, header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("the local header is damaged")
    name_len, extra_len = struct.unpack("<HH", local[26:30])
    return header + 30 + name_len + extra_len, size


def read_package(source, size: int) -> Iterator[dict]:
    """Records of a package, by ranges of about ``RUN_BYTES``."""
    members = directory(source, size)
    begin, _ = stored_bytes(source, members[RECORDS])
    places = [json.loads(x) for x in _at(source, *stored_bytes(source, members[INDEX])).decode().splitlines()]
    at = 0
    while at < len(places):
        upto, first = at + 1, places[at]["offset"]
        while upto < len(places) and places[upto]["offset"] + places[upto]["length"] - first <= RUN_BYTES:
            upto += 1
        last = places[upto - 1]
        run = _at(source, begin + first, last["offset"] + last["length"] - first)
        for p in places[at:upto]:
            yield parsed(gzip.decompress(run[p["offset"] - first:p["offset"] - first + p["length"]]))
        at = upto


def with_decisions(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to) of every row; refers_to is the response's id for revisits."""
    rows = only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn(
        "sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    marks = rows.select("page_id", "sha", F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).dropna()
    firsts = stored(marks.where(F.col("size") >= least_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "first"), "firsts")
    later = (marks.select("page_id", "sha").join(firsts, "sha").where("page_id != first")
             .select("page_id", "sha", F.col("first").alias("refers_to")).distinct())
    return rows.join(later, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) as packages in ``folder``; the stored manifest: (path, n_records)."""
    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        package, done = None, []
        for batch in batches:
            ids, refers = (batch.column(i).cast(pa.string()).to_pylist() for i in (0, 3))
            for page_id, url, payload, to in zip(ids, batch.column(1).to_pylist(), utf8(batch.column(2)), refers):
                package = package or Package(files, f"{root}/{uuid.uuid4().hex}.wacz")
                package.add(record(page_id, url, payload, to))
                if package.size >= package_bytes:
                    package.close()
                    done.append(package)
                    package = None
        if package:
            package.close()
            done.append(package)
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{p.path.rpartition('/')[2]}" for p in done], pa.string()),
                                          "n_records": pa.array([len(p.lines) for p in done], pa.int64())})

    return stored(records.mapInArrow(run, "path string, n_records long"), "manifest")


def read_packages(spark: SparkSession, manifest: DataFrame, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact and, if asked for, the payload.

    ``intact`` says whether a response's payload has the digest and length that its record names.
    """
    def rows(found: list[dict]) -> pa.RecordBatch:
        def page(v):
            return v[10:-1] if v and v.startswith("<urn:page:") else None

        same = [r["warc-type"] != "response" or
                (r["warc-payload-digest"] == f"sha1:{digest_text(hashlib.sha1(r['payload']).digest())}"
                 and int(r["warc-payload-length"]) == len(r["payload"])) for r in found]
        out = {"page_id": pa.array([page(r["warc-record-id"]) for r in found], pa.string()),
               "payload_bytes": pa.array([int(r["warc-payload-length"]) for r in found], pa.int64()),
               "payload_digest": pa.array([r["warc-payload-digest"].partition(":")[2] for r in found], pa.string()),
               "record_type": pa.array([r["warc-type"] for r in found], pa.string()),
               "refers_to": pa.array([page(r.get("warc-refers-to")) for r in found], pa.string()),
               "intact": pa.array(same, pa.bool_())}
        return pa.RecordBatch.from_pydict(out | ({"payload": pa.array([r["payload"] for r in found], pa.binary())} if with_payload else {}))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as source:
                    some, size = [], 0
                    for r in read_package(source, source.size()):
                        some.append(r)
                        size += len(r["payload"])
                        if size >= RUN_BYTES or len(some) >= 10_000:
                            yield rows(some)
                            some, size = [], 0
                    if some:
                        yield rows(some)

    parts = max(1, min(manifest.count(), 10_000))
    out = manifest.select("path").repartition(parts).mapInArrow(
        run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"
        + ", payload binary" * with_payload)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page to packages in the shared folder and read the records back."""
    spark = prepared(pages.sparkSession)
    manifest = write_packages(with_decisions(pages, least_bytes, id_col, url_col, html_col), new_folder(spark, "packages"))
    return read_packages(spark, manifest, pages.schema[id_col].dataType.simpleString())
