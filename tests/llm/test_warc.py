"""Archives: round trips, damaged files against the bytes that were left whole, and odd rows."""

import glob
import gzip
import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc
from plumbline.llm.common import shared_folder

SCHEMA = "page_id long, url string, html binary, offset long, key string"


def pages(rng, n):
    body = lambda k: bytes(rng.choice(b"<p>abcdefgh \n\xc3\xa9") for _ in range(k))
    big = body(1500)
    rows = [(i, f"http://e.com/{i}", body(rng.randrange(0, 3000)), 1, "k") for i in range(n)]
    rows += [(500 + i, None, big, 1, "k") for i in range(20)] + [(None, "http://e.com/\r\nx y", big, None, None)]
    rows += [(600 + i, "u", b"short", 1, "k") for i in range(3)] + [(610, "u", None, 1, "k"), (None, "u", None, 1, "k")]
    rows += [(700, "u", b"WARC/1.1\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\n" * 40, 1, "k"), (701, "u", warc.MEMBER * 50 + gzip.compress(b"x" * 99), 1, "k")]
    rows += [(800, "u", body(1200), 1, "k")] * 3 + [(None, "u", b"q" * 1000, 1, "k")] * 2
    return rows


def expected(rows, least=1000):
    greatest, count = {}, {}
    for i, _, html, *_ in rows:
        greatest[html] = max((x for x in (i, greatest.get(html)) if x is not None), default=None)
        count[html] = count.get(html, 0) + 1
    out = []
    for i, _, html, *_ in rows:
        revisit = html is not None and len(html) >= least and count[html] > 1 and i != greatest[html]
        html = html or b""
        out.append(str((i, len(html), hashlib.sha1(html).hexdigest(), "revisit" if revisit else "response", greatest[html] if revisit else None)))
    return sorted(out)


def as_rows(found):
    rows = found.filter("fault IS NULL").select(warc.row_id("record_id"), "payload_bytes", "payload_digest", "record_type", warc.row_id("refers_to"))
    return sorted(str(tuple(r)) for r in rows.collect())


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, small_splits, compress):
    rows = pages(random.Random(1), 60)
    path = shared_folder(spark, "warc")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.write_archives(df, path, compress=compress)
    found = warc.read_archives(spark, path, compress)
    assert found.filter("fault IS NOT NULL").count() == 0
    assert as_rows(found) == expected(rows)
    full = warc.with_payloads(found)
    assert sorted(bytes(r.payload) for r in full.select("payload").collect()) == sorted(r[2] or b"" for r in rows)
    assert "http://e.com/%0D%0Ax%20y" in [r.uri for r in found.select("uri").collect()]
    assert as_rows(warc.read_archives(spark, path, compress, payloads=False)) == expected(rows)


def test_standard_tools_can_unpack(spark):
    path = shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages(random.Random(2), 10), SCHEMA).coalesce(1), path)
    for f in glob.glob(f"{path}/part-*"):
        with open(f, "rb") as file:
            text = gzip.decompress(file.read())
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_no_rows(spark):
    path = shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).collect() == []


def damaged(rng, data):
    """Some bytes changed, cut out and put in; the original places that stay whole and start where they did or not."""
    out, harmed = bytearray(), []
    at = 0
    for place in sorted(rng.sample(range(len(data)), 6)):
        if place < at:
            continue
        out += data[at:place]
        kind = rng.choice(["flip", "cut", "put"])
        if kind == "flip":
            out.append(data[place] ^ (1 << rng.randrange(8)))
            at = place + 1
        elif kind == "cut":
            at = min(len(data), place + rng.randrange(1, 400))
        else:
            out += bytes(rng.randrange(256) for _ in range(rng.randrange(1, 400)))
            at = place
        harmed.append((place, max(at, place + 1)))
    return bytes(out + data[at:]), harmed


@pytest.mark.parametrize("compress,name", [(True, "a"), (False, "a"), (True, "a.gz")])
def test_whole_records_of_damaged_files_come_back(spark, small_splits, tmp_path, compress, name):
    rng = random.Random(7)
    clean, bad = shared_folder(spark, "warc"), tmp_path / "bad"
    warc.write_archives(spark.createDataFrame(pages(rng, 80), SCHEMA).coalesce(1), clean, compress=compress)
    parts = [p for p in glob.glob(f"{clean}/part-*") if os.path.getsize(p)]
    places = {r.record_id + (r.payload_digest or ""): [] for r in warc.read_archives(spark, clean, compress).collect()}
    for r in warc.read_archives(spark, clean, compress).collect():
        places[r.record_id + (r.payload_digest or "")].append((os.path.basename(r.file), r.offset, r.offset + r.length))
    bad.mkdir()
    sizes, whole = {}, []
    for i in range(4):
        for p in parts:
            data, harmed = damaged(rng, open(p, "rb").read())
            (bad / f"{i}{os.path.basename(p)}{name}").write_bytes(data)
            sizes[f"{i}{os.path.basename(p)}{name}"] = len(data)
            for key, spots in places.items():
                whole += [(f"{i}{f}{name}", key) for f, a, b in spots if f == os.path.basename(p) and all(hi <= a or b <= lo for lo, hi in harmed)]
    found = warc.read_archives(spark, str(bad), compress).collect()
    got = [(os.path.basename(r.file), r.record_id + (r.payload_digest or "")) for r in found if r.fault is None]
    if compress:
        assert sorted(got) == sorted(whole)
    else:  # no digest guards a header's values
        assert not Counter(whole) - Counter(got) and len(got) - len(whole) < len(sizes) * 6
    assert {r.fault for r in found} - {None}
    # Records, gaps and what stands between members are the file, without overlap.
    empty = len(warc._EMPTY)
    for f, size in sizes.items():
        at = 0
        for r in sorted((r for r in found if os.path.basename(r.file) == f), key=lambda r: r.offset):
            assert r.offset >= at and (r.offset - at) % empty == 0 if compress else r.offset == at
            at = r.offset + r.length
        assert (size - at) % empty == 0 if compress else size == at


def test_limits_and_foreign_records():
    plain = lambda data, limit=1000: list(warc.salvage(data.split(warc.VERSION), warc.VERSION, warc.take_record, limit))
    must = b"WARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
    one = b"WARC/1.0\r\n" + must + b"WARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    info = b"WARC/1.0\r\n" + must + b"WARC-Type: warcinfo\r\nWARC-Block-Digest: sha1:" + hashlib.sha1(b"ab").hexdigest().encode() + b"\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(x.offset, x.fault, x.record and x.record.payload) for x in plain(one + info)] == [(0, None, b"hello"), (len(one), None, b"ab")]
    long = b"WARC/1.0\r\n" + must + b"WARC-Type: response\r\nContent-Length: 99999\r\n\r\n"
    assert [(x.offset, x.length, x.fault) for x in plain(b"junk" + long + one)] == [(0, 4 + len(long), "no start"), (4 + len(long), len(one), None)]
    assert [x.fault for x in plain(one.replace(b": 5", b": 6") + one)] == ["length", None]
    assert [x.fault for x in plain(info.replace(b"ab\r", b"ac\r") + one)] == ["block digest", None]
    assert [x.fault for x in plain(one[:-6])] == ["cut off"]
    assert plain(b"") == []
    two = gzip.compress(one + info) + gzip.compress(b"no record") + gzip.compress(one)
    found = list(warc.salvage(two.split(warc.MEMBER), warc.MEMBER, warc.take_member))
    assert [(x.fault, x.record and x.record.record_type) for x in found] == [(None, "resource"), (None, "warcinfo"), ("no start", None), (None, "resource")]
