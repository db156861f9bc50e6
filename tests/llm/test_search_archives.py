"""Neighbours against brute force, archives by round trip, ZIP directories against the standard library."""

import base64
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import neighbours, warc, zipstore


def test_neighbours_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[100:140] = x[100]  # copies
    rows = [(k, v.tolist(), "t") for k, v in enumerate(x)]
    rows += [(5000, None, "t"), (5100, [0.0] * 16, "t"), (5200, [1.0] * 15 + [None], "t"), (5300, [float("nan")] * 16, "t"), (5400, [1.0, 2.0], "t"), (None, x[0].tolist(), "t"), (7, x[7].tolist(), "t")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect()
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert set(by) == set(range(0, 3000, 100))
    hits, x = 0, x.astype(float)
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [k for k in np.lexsort((np.arange(3000), d)) if k != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(f[2] - d[f[1]]) < 1e-12 for f in found)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(want))
    assert hits >= 0.9 * 10 * len(by)
    assert [f[1] for f in by[100]] == list(range(101, 111))


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 2), (0, 1)]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(few, F.lit(False)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    r = random.Random(2)
    bodies = [None, "", "<p>é</p>", "<p>é</p>", "x" * 100_000, "a\r\n\r\nb"] + [f"<p>{r.randrange(20)}</p>" for _ in range(80)]
    rows = [(k, f"https://a.com/{k}" if k % 5 else None, b, "z") for k, b in enumerate(bodies)] + [(None, "u", "<p>é</p>", "z"), (3, "https://again/", "<p>é</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, body string")
    packages, folder = warc.archive(df, f"file://{tmp_path}/w", package_bytes=4000)
    assert packages.count() > 2
    got = warc.read_packages(packages, folder).collect()
    largest = {}
    for i, _, b, _ in rows:
        largest[b or ""] = max(largest.get(b or "", -1), -1 if i is None else i)
    want = []
    for i, _, b, _ in rows:
        raw, first = (b or "").encode(), largest[b or ""]
        other = first if first != i else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if other is None else "revisit", other))
    assert sorted(((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got), key=str) == sorted(want, key=str)
    assert all(bytes(g["payload"]) == (rows[g["page_id"]][2] or "").encode() for g in got if g["record_type"] == "response" and g["page_id"] != 3)
    none = warc.archived_and_read(df, min_bytes=10**6)
    assert none.where("record_type = 'revisit'").count() == 0
    assert warc.archived_and_read(df.limit(0)).count() == 0


@pytest.mark.parametrize("force", [False, True])
def test_zip_ranges(force):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            with z.open(f"d/é{k}", "w", force_zip64=force) as m:
                m.write(bytes(range(256)) * (k + 1))
        z.comment = b"PK\x05\x06 not the end"
    data = out.getvalue()
    package = zipstore.ZipRanges(lambda at, n: data[at : at + n], len(data))
    assert {n: m.size for n, m in package.members.items()} == {f"d/é{k}": 256 * (k + 1) for k in range(3)}
    assert package.read("d/é2", 250, 12) == bytes([250, 251, 252, 253, 254, 255, 0, 1, 2, 3, 4, 5])
    with pytest.raises(zipstore.ZipError):
        package.read("d/é0", 200, 100)
    with pytest.raises(zipstore.ZipError):
        zipstore.ZipRanges(lambda at, n: b"x" * n, 500)


def test_zip64_directory():
    """A package whose end record defers to ZIP64 and whose entry keeps its sizes in the extra field."""
    name, body = b"a", b"hello"
    import struct

    local = zipstore.LOCAL.pack(b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<2H2Q", 1, 16, 5, 5) + body
    extra = struct.pack("<2H3Q", 1, 24, 5, 5, 0)
    central = zipstore.CENTRAL.pack(b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = zipstore.EOCD64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = zipstore.EOCD64_AT.pack(b"PK\x06\x07", 0, len(local) + len(central), 1)
    data = local + central + end64 + locator + zipstore.EOCD.pack(b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert zipstore.ZipRanges(lambda at, n: data[at : at + n], len(data)).read("a") == body
