"""Web archives in ZIP packages: writing deduplicated WARC records, and reading them by ranges.

A package holds stored members only: `archive/data.warc.gz`, a gzip member to each record, and
`indexes/index.cdxj`, a line to each record with its place. Since members are stored, a record
is one range of the package; the reader (zipstore.py) parses the central and ZIP64 directories,
reads the index, and fetches records without unpacking anything.

Payloads are the pages' html in UTF-8. Of records with equal payloads (same SHA-1, SHA-256 and
length) of at least `min_bytes`, the one with the largest page_id is the response; the others are
revisits that name it. Packages are written by the tasks to the shared folder, under names of
their own, and only those that a finished task reports are read.

Defined results: a null html is an empty payload; a null page_id ranks below all others and its
record refers to the group's largest id if there is one; rows that tie for the largest page_id are
all responses; a null url leaves the target out; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zipfile
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, materialize
from .arrowio import slices
from .joins import left_join_split
from .zipstore import ZipRanges

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
READ_AHEAD = 4 << 20
WHEN = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record; with `refers_to` a revisit, whose block keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"]
    head += [f"WARC-Date: {WHEN:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """(WARC headers, HTTP head, HTTP headers, payload as held) of one record; header names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Counted(io.RawIOBase):
    """What ZipFile writes to: a stream that only goes forward."""

    def __init__(self, out):
        self._out, self.size = out, 0

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self._out.write(bytes(b))
        self.size += len(b)
        return len(b)


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write page_id, url, body, refers_to as packages under `folder`; gives path, size and records of each.

    A retried task writes under new names, so what a lost one left is never read.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        state: dict = {}

        def start() -> None:
            name = f"{uuid.uuid4().hex}.wacz"
            out = store.open_output_stream(f"{root}/{name}")
            counted = _Counted(out)
            z = zipfile.ZipFile(counted, "w", zipfile.ZIP_STORED, allowZip64=True)
            member = z.open(zipfile.ZipInfo(DATA, WHEN.timetuple()[:6]), "w", force_zip64=True)
            state.update(name=name, out=out, counted=counted, z=z, member=member, at=0, lines=[])

        def finish() -> pa.RecordBatch:
            state["member"].close()
            index = "".join(f"{line}\n" for line in sorted(state["lines"])).encode()
            with state["z"].open(zipfile.ZipInfo(INDEX, WHEN.timetuple()[:6]), "w", force_zip64=True) as m:
                m.write(index)
            state["z"].close()
            state["out"].close()
            row = pa.RecordBatch.from_pydict({"path": [state["name"]], "size": pa.array([state["counted"].size], pa.int64()), "records": pa.array([len(state["lines"])], pa.int64())})
            state.clear()
            return row

        for batch in batches:
            for part in slices(batch):
                for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    if not state:
                        start()
                    body = body or b""
                    digest = payload_digest(body)
                    packed = gzip.compress(record(page_id, url, body, refers_to, digest), 1, mtime=0)
                    state["member"].write(packed)
                    line = {"offset": state["at"], "length": len(packed), "filename": DATA, "digest": f"sha1:{digest}"}
                    state["lines"].append(f"{url or '-'} {WHEN:%Y%m%d%H%M%S} {json.dumps(line)}".replace("\n", " "))
                    state["at"] += len(packed)
                    if state["at"] >= package_bytes:
                        yield finish()
        if state:
            yield finish()

    return records.mapInArrow(run, "path string, size long, records long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_packages(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of packages listed by path and size, fetched by the ranges their indexes name."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{path}") as f:

                    def fetch(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    yield from _records(ZipRanges(fetch, size), payloads)

    return packages.select("path", "size").mapInArrow(run, READ)


def _records(package: ZipRanges, payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    places = []
    for name in package.members:
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in package.read(name).decode("utf-8").splitlines():
                entry = json.loads(line[line.index(" {") + 1 :])
                places.append((entry["filename"], entry["offset"], entry["length"]))
    places.sort()
    rows, held = [], 0
    ahead, ahead_of, ahead_at = b"", "", 0
    for name, at, length in places:
        if name != ahead_of or at < ahead_at or at + length > ahead_at + len(ahead):
            left = package.members[name].size - at
            ahead, ahead_of, ahead_at = package.read(name, at, max(length, min(READ_AHEAD, left))), name, at
        fields, _, http, payload = parse_record(zlib.decompress(ahead[at - ahead_at : at - ahead_at + length], 31))
        number = lambda k: int(fields[k]) if k in fields else None
        full = int(http["content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and (len(payload) != full or payload_digest(payload) != digest):
            raise ValueError("a record's payload isn't what its digest says")
        rows.append((number("x-page-id"), fields.get("warc-target-uri"), full, digest, fields["warc-type"], number("x-refers-to-page-id"), payload if payloads else None))
        held += len(payload)
        if len(rows) >= 5_000 or held > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def marked_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, body and refers_to (null: a response) of every row.

    Which payloads repeat is decided on hashes, lengths and ids alone. A payload that a great share of all pages has is one row
    of a broadcast of at most `MOST_HOT` rows, so that its pages aren't brought together.
    """
    body = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    each = each.withColumn("_same", F.unhex(F.concat(F.sha1("body"), F.substring(F.sha2("body", 256), 1, 24)))).withColumn("_n", F.length("body"))
    largest = each.groupBy("_same", "_n").agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows"))
    repeated = materialize(largest.where((F.col("_rows") > 1) & (F.col("_n") >= min_bytes)), "repeated-payloads")
    joined = left_join_split(each, repeated, ["_same", "_n"], "_rows", each.count(), [F.col("page_id"), F.col("url")])
    return joined.select("page_id", "url", "body", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> tuple[DataFrame, str]:
    """Write all pages as packages; gives the list of packages and their folder."""
    folder = folder or fresh_path(pages.sparkSession, "wacz")
    return materialize(write_packages(marked_revisits(pages, min_bytes), folder, package_bytes), "packages"), folder


def archived_and_read(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write all pages, then read every record back: a task to a package, which adaptive execution doesn't put together."""
    packages, folder = archive(pages, None, min_bytes)
    return read_packages(packages.repartition(max(1, packages.count()), "path"), folder, payloads)


#: What the archives say, straight from the pages; base 32 by 20 bits, that is five hex digits, at a time.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p),
d AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(h, CAST(i // 4 AS BIGINT) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31) + 1 AS BIGINT), 1)) AS letters FROM r)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
