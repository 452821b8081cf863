import base64
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.llm import shared, warc


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 7)
    rng = random.Random(1)
    same = "<p>same</p>" * 50
    rows = [(i, f"http://h/{i}", rng.choice([same, f"page {i} ü", "", None, "x\r\n\r\ny" * i])) for i in range(120)] + [(500, None, "é" * 40_000), (3, "http://h/3", "again")]
    rows = list({r[0]: r for r in rows}.values())
    out = shared.fresh_path(spark, "w")
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(df, out), out, with_payload=True).collect()}
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    for i, url, h in rows:
        data, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.url == (url or "")
        if first[h or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", first[h or ""])


def test_small_payloads_repeated_rows_nulls_and_no_rows(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (2, "u", "abcdef"), (4, "u", "abcdef"), (2, "u", "abcdef"), (None, "u", "abcdef")]
    out = shared.fresh_path(spark, "w")
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), out, min_bytes=3), out).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", "response", "None"), ("2", "response", "None"), ("2", "response", "None"), ("2", "response", "None"), ("4", "revisit", "2"), ("None", "revisit", "2")]
    )
    out = shared.fresh_path(spark, "w")
    nobody = spark.createDataFrame([(None, " u ", "same"), (None, "v", "same")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(nobody, out), out).collect()
    assert sorted((r.url, r.record_type, r.refers_to) for r in got) == [(" u ", "response", None), ("v", "response", None)]
    out = shared.fresh_path(spark, "w")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, out), out).collect() == []


def test_packages_are_split(spark, monkeypatch):
    out = shared.fresh_path(spark, "w")
    df = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).coalesce(1)
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 10)
    manifest = warc.write_archives(df, out)
    assert warc.read_archives(manifest, out).count() == 60


class Wide(io.BytesIO):
    """A package whose end record and entry are saturated, so that only the ZIP64 fields tell."""


def zip64(data: bytes) -> bytes:
    import struct

    name = b"m"
    local = struct.pack("<4sHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HH", 99, 2) + b"zz" + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", warc.ENTRY, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", warc.LOCATOR, 0, len(local) + len(entry), 1)
    return local + entry + end64 + locator + struct.pack("<4sHHHHIIH", warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"PK\x05"


def test_directories():
    data = zip64(b"hello")
    assert warc.Package(io.BytesIO(data), len(data)).member("m") == b"hello"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b", b"stored", compress_type=zipfile.ZIP_STORED)
        z.writestr("c", b"packed" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"with PK\x05\x06 inside"
    p = warc.Package(buffer, buffer.getbuffer().nbytes)
    assert p.member("a/b") == b"stored"
    with pytest.raises(ValueError):
        p.member("c")
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"x" * 100), 100)


def test_all_archives_and_indexes_of_a_package():
    import gzip
    import json

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        lines = {}
        for name in ("a.warc.gz", "b.warc.gz"):
            packed = [gzip.compress(warc.record(i, f"u{i}", name.encode(), None, False)[0]) for i in (1, 2)]
            z.writestr(f"archive/{name}", b"".join(packed))
            lines[name] = [json.dumps({"offset": str(len(packed[0]) * i), "length": len(p), "filename": name}) for i, p in enumerate(packed)]
        z.writestr("indexes/one.cdxj", f"org,u)/ 2020 {lines['b.warc.gz'][0]}\n\n{lines['a.warc.gz'][1]}\n")
        z.writestr("indexes/two.cdxj", lines["a.warc.gz"][0])
        z.writestr("pages/pages.jsonl", "{}")
    p = warc.Package(buffer, buffer.getbuffer().nbytes)
    found = [warc.parse_record(gzip.decompress(p.read(at, n))) for at, n in warc.index_entries(p)]
    assert [(r.page_id, r.payload) for r in found] == [(1, b"b.warc.gz"), (2, b"a.warc.gz"), (1, b"a.warc.gz")]


def test_a_hot_payload_where_pages_are_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = shared.fresh_path(spark, "w")
        rows = [(i, "u", "hot" if i % 3 else f"pair {i // 6}") for i in range(3000)]
        got = {r.page_id: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), out), out).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first: dict = {}
    for i, _, h in rows:
        assert got[i].refers_to == (first[h] if h in first else None)
        first.setdefault(h, i)
