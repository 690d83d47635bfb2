"""WARC records in ZIP packages: a writer, and a reader that takes records by ranges.

A package holds the members ``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.cdxj`` (record places), both stored, so that a record is one range of the file. The
reader fetches the tail, follows the end record or its ZIP64 form to the central directory, finds
where the stored members begin from their local headers, reads the index and then each record by
its range; nothing is extracted. Files are reached through Arrow's file systems, by the uri of the
folder that driver and executors share.

Equal payloads of ``min_bytes`` or more are written once: of their pages the one of the largest
page_id is a ``response`` record, the others are ``revisit`` records that refer to it.

Defined results: a null html is an empty payload; a null url leaves the target out; a null page_id
is never preferred, and its record answers with a null page_id; rows that share the largest
page_id of a payload are all responses; payloads of any length are written whole; an empty table
gives an empty result. Of the pages only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batch_rows
from tidemark.session import input_bytes, remove_at_exit, shared_dir, stage, tasks_for

#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 16_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A payload of more pages than one in so many, and than so many pages, is frequent: there are fewer such
#: payloads than the first number, whatever the crawl.
FREQUENT_SHARE, FREQUENT_PAGES = 1000, 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:tidemark:page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record with an HTTP block; a revisit has the block's header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", "sha1:" + digest_of(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Package:
    """Records gathered for one ZIP file."""

    def __init__(self):
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), 3, mtime=0)
        self.lines.append(json.dumps({"offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((DATA, self.data.getbuffer()), (INDEX, "\n".join(self.lines).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(content)
        return out.getvalue()


class PackageReader:
    """Reads a ZIP package through ``read(offset, length)`` of a file of ``size`` bytes."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = self._directory()

    def _directory(self) -> dict[str, dict]:
        tail_at = max(0, self.size - 65_557 - 76)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark may stand in a comment
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        entries, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
        if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
            locator = tail[end - 20 : end]
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("ZIP64 locator is missing")
            record64 = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record is missing")
            entries, length, offset = struct.unpack("<QQQ", record64[32:56])
        directory, at, members = self.read(offset, length), 0, {}
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
            crc, packed, full, n_name, n_extra, n_comment = struct.unpack("<IIIHHH", directory[at + 16 : at + 34])
            (start,) = struct.unpack("<I", directory[at + 42 : at + 46])
            raw = directory[at + 46 : at + 46 + n_name]
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    start = wide.pop(0) if start == 0xFFFFFFFF else start
                extra = extra[4 + n :]
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
            members[name] = {"method": method, "packed": packed, "size": full, "header": start, "crc": crc}
            at += 46 + n_name + n_extra + n_comment
        return members

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError(f"{name} is compressed: its records have no ranges")
        if "at" not in member:
            local = self.read(member["header"], 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"local header of {name} is damaged")
            member["at"] = member["header"] + 30 + sum(struct.unpack("<HH", local[26:30]))
        return member["at"], member["size"]

    def index(self, name: str = INDEX) -> list[tuple[int, int]]:
        at, size = self.place(name)
        return [(e["offset"], e["length"]) for e in map(json.loads, self.read(at, size).decode().splitlines())]

    def records(self, data: str = DATA, index: str = INDEX) -> Iterator[dict]:
        at, size = self.place(data)
        for offset, length in self.index(index):
            if offset + length > size:
                raise ValueError("the index points beyond its archive")
            yield parse(gzip.decompress(self.read(at + offset, length)))


def parse(raw: bytes) -> dict:
    """Fields of a WARC record with the HTTP block's length and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    page = lambda k: int(v) if (v := fields.get(k, "").strip("<>").removeprefix(_URN)) else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest_of(payload) != digest:
        raise ValueError("payload and digest differ")
    return {
        "page_id": page("warc-record-id"),
        "record_type": fields["warc-type"],
        "refers_to": page("warc-refers-to"),
        "target": fields.get("warc-target-uri"),
        "payload_bytes": int(stated[1]) if stated else len(payload),
        "payload_digest": digest,
        "payload": payload,
    }


def located(uri: str):
    """Arrow's file system and path of a uri or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def with_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) with ``refers_to`` of the pages that repeat another's payload.

    Digests meet as (digest, largest id, pages) after partial aggregation. Pages of frequent payloads, fewer
    than ``FREQUENT_SHARE`` of them, find their response in a broadcast and are then dealt by their own keys,
    so that no task gets all pages of one; the others are joined by digest, broadcast or shuffled as
    Catalyst finds it best."""
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    held = held.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    several = held.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    several = stage(several.filter("n > 1 AND first IS NOT NULL"), "payloads", tasks_for(input_bytes(pages)))
    limit = max(FREQUENT_PAGES, (several.agg(F.sum("n")).first()[0] or 0) // FREQUENT_SHARE)
    often = several.filter(F.col("n") > limit).select("digest", "size", F.col("first").alias("often"))
    marked = held.join(F.broadcast(often), ["digest", "size"], "left")
    own = F.concat_ws(":", "digest", "size")
    marked = marked.withColumn("key", F.when(F.col("often").isNull(), own).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    rest = several.filter(F.col("n") <= limit).select(own.alias("key"), "first")
    joined = marked.join(rest, "key", "left").withColumn("first", F.coalesce("often", "first"))
    return joined.select("page_id", "url", "payload", F.expr("if(page_id <=> first, null, first)").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Pages with ``payload`` and ``refers_to`` → (path, n_records) of the packages written.

    A package has a name of its own, and only those of tasks that ended well are in the result, so
    a task that runs twice leaves at most an unused file. Staged, as reading it again would write again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(folder)
        files.create_dir(base, recursive=True)

        def done(package: Package) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(package.close())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(package.lines)]})

        package = Package()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                package.add(*row)
                if package.data.tell() >= package_bytes:
                    yield done(package)
                    package = Package()
        if package.lines:
            yield done(package)

    with batch_rows(pages.sparkSession, 500):
        return stage(pages.mapInArrow(run, "path string, n_records bigint"), "packages")


_COLUMNS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_packages(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """(path) of packages → one row per record; ``with_payload`` adds target and payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["target", "payload"] if with_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = located(path)
                with files.open_input_file(at) as f:
                    reader, held = PackageReader(lambda offset, n, f=f: f.read_at(n, offset), f.size()), []
                    for found in reader.records():
                        held.append({n: found[n] for n in names})
                        if len(held) == 500:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    return paths.select("path").mapInArrow(run, _COLUMNS + (", target string, payload binary" if with_payload else ""))


def query(spark, sf_dir: str) -> DataFrame:
    pages = with_responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    remove_at_exit(folder)
    paths = write_packages(pages, folder)
    return read_packages(paths.repartition(max(1, min(10_000, paths.count()))))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, max(page_id) AS first FROM p GROUP BY html
), h AS (
  SELECT p.page_id, p.html, g.first, sha1(p.html) AS hex FROM p JOIN g USING (html)
), b AS (
  SELECT *, [instr('0123456789abcdef', c) - 1 FOR c IN string_split(hex, '')] AS nibbles FROM h
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((nibbles[(5 * k) // 4 + 1] * 16 + coalesce(nibbles[(5 * k) // 4 + 2], 0)) >> (3 - (5 * k) % 4)) & 31)::INT + 1, 1)
         FOR k IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
