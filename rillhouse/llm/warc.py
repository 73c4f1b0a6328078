"""WARC archives packaged in ZIP files: writing, and reading records by range.

A package is a ZIP file with two stored (uncompressed) members: `archive/data.warc.gz`, whose
records are gzip members of their own, and `indexes/index.cdxj`, a line for each record with its
offset and length. The reader never extracts: it reads the end of the file for the end-of-central-
directory record (and the ZIP64 one where a field overflows), the central directory, the index's
bytes, and then the bytes of each record.
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
from dataclasses import dataclass
from itertools import chain
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, ship

#: Payloads of this many bytes or more are written once; others that are equal revisit it.
REVISIT = 1000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records that one reading task takes in a go, as far as records allow.
SPLIT = 8 << 20
_DATE = "2024-01-01T00:00:00Z"  # records carry no capture time: the pages have none


def open_binary(path: str, mode: str = "rb") -> BinaryIO:
    """A file of the shared store: local, or any that pyarrow can open (hdfs, s3, gs, ...)."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if mode == "rb":
        return system.open_input_file(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


# --- ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int  # offset of the local header


def directory(f: BinaryIO, size: int) -> list[Member]:
    """Members of a ZIP file, from its central directory. Raises ValueError on a damaged file."""
    tail = min(size, 22 + 65535 + 20)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(end[at + 20 : at + 22], "little") != len(end):
        at = end.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if at < 20 or end[at - 20 : at - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        where = struct.unpack("<Q", end[at - 12 : at - 4])[0]
        f.seek(where)
        wide = f.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    f.seek(start)
    data, at, out = f.read(length), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        stored, plain, n, extra, note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8")
        fields, k = data[at + 46 + n : at + 46 + n + extra], 0
        while k + 4 <= len(fields):
            tag, width = struct.unpack("<HH", fields[k : k + 4])
            if tag == 1:  # ZIP64: the overflowed ones, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", fields[k + 4 : k + 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                stored = next(values) if stored == 0xFFFFFFFF else stored
                header = next(values) if header == 0xFFFFFFFF else header
            k += 4 + width
        out.append(Member(name, method, plain, stored, header))
        at += 46 + n + extra + note
    return out


def data_start(f: BinaryIO, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: its records can't be read by range")
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


# --- WARC records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, gzipped on its own. A revisit holds the response's HTTP headers and no payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{i}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzipped record; a payload that does not match its
    digest raises ValueError."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload and digest differ")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page"), "payload": payload}


# --- Spark


def plan_records(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of `least` bytes or more, all but
    the one with the largest page_id refer to that. A null html is an empty payload.

    Only ids and digests of large pages meet by digest; payloads are joined with what these say by
    page and digest, so that a digest of many pages is spread."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").select("digest", "kept")
    refers = slim.join(first, "digest").where("page_id is null or page_id <> kept").groupBy("page_id", "digest").agg(F.max("kept").alias("refers_to"))
    refers = refers.select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "refers_to")
    held = rows.join(refers, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
    return held.select("page_id", "url", "payload", "digest", "refers_to")


class _Stream:
    """What a package is written to: bytes go to the shared store at once, none are looked at again."""

    def __init__(self, out: BinaryIO):
        self.out, self.size = out, 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write a package for each partition of `records` (see `plan_records`) into `folder`; returns
    (path, bytes, records). A task that runs again writes a file of its own; only files listed in
    the result count. Records go to the shared store one by one, the directory last; memory holds a
    record and the index."""
    ship(records.sparkSession)
    # as strings: a column of numbers with nulls reaches pandas as doubles
    records = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], strict=True))
        first = next(rows, None)
        if first is None:
            return
        path, offset, index = f"{folder}/part-{uuid.uuid4().hex}.zip", 0, []
        with open_binary(path, "wb") as out:
            stream = _Stream(out)
            with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as z:
                with z.open(ARCHIVE, "w", force_zip64=True) as member:
                    for page_id, url, payload, digest, to in chain([first], rows):
                        page, to = (None if pd.isna(x) else int(x) for x in (page_id, to))
                        data = record(page, url, payload, digest, to, to is not None)
                        member.write(data)
                        index.append(f"{digest} {page} {json.dumps({'offset': offset, 'length': len(data)})}\n")
                        offset += len(data)
                with z.open(INDEX, "w", force_zip64=True) as member:
                    for line in index:
                        member.write(line.encode())
        yield pd.DataFrame({"path": [path], "bytes": [stream.size], "records": [len(index)]})

    return materialize(records.mapInPandas(run, "path string, bytes long, records long"), "warc-files")


def locate(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, start, ranges) for packages (path, bytes): the place of the archive member, and runs
    of its records, `split` bytes each or one record, as (offset, length) by the index."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size in zip(batch["path"], batch["bytes"], strict=True):
                with open_binary(path) as f:
                    members = {m.name: m for m in directory(f, int(size))}
                    start = data_start(f, members[ARCHIVE])
                    f.seek(data_start(f, members[INDEX]))
                    lines = f.read(members[INDEX].stored).decode().splitlines()
                run_, total = [], 0
                for line in lines:
                    place = json.loads(line.split(" ", 2)[2])
                    if run_ and total + place["length"] > split:
                        yield pd.DataFrame({"path": [path], "start": [start], "ranges": [run_]})
                        run_, total = [], 0
                    run_.append({"offset": place["offset"], "length": place["length"]})
                    total += place["length"]
                if run_:
                    yield pd.DataFrame({"path": [path], "start": [start], "ranges": [run_]})

    return files.select("path", "bytes").mapInPandas(run, "path string, start long, ranges array<struct<offset: long, length: long>>")


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the packages: page_id, url, record_type, payload_bytes and
    payload_digest (of the full payload, for revisits too), refers_to, and with `payloads` the
    payload (empty for revisits)."""
    ship(files.sparkSession)
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, ranges in zip(batch["path"], batch["start"], batch["ranges"], strict=True):
                rows = []
                with open_binary(path) as f:
                    for r in ranges:
                        f.seek(start + r["offset"])
                        rows.append(parse(f.read(r["length"])))
                made = pd.DataFrame(rows)[columns]
                for c in ("page_id", "refers_to"):
                    made[c] = pd.array([r[c] for r in rows], dtype="Int64")
                yield made

    n = max(8, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return locate(files.repartition(n)).repartition(n).mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to packages in the shared folder and read every record back.

    Null urls and htmls are empty; a null page_id stays null and its page is never the one that
    others refer to unless all equal ones are null, then each is a response; pages with equal id
    and payload are all responses if that id is the largest; pages of any length are one record;
    no pages give no rows; no column but page_id, url and html is looked at."""
    files = write(plan_records(pages), new_path(pages.sparkSession, "warc"))
    return read(files)
