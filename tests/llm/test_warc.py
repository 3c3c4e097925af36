import base64
import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from fluvial.llm import warc
from fluvial.staging import new_path

ROWS = [(1, "http://a/", "<p>x</p>"), (4, "http://b/", "<p>x</p>"), (2, "u", "é" * 3000), (3, None, None), (9, "u", ""), (None, "u", "<p>x</p>"), (7, "a b\r\nc: d", "\r\n\r\n" * 2000), (None, "n", "alone"), (6, "x", "once"), (5, "x", "WARC/1.1\r\n")]


@pytest.mark.parametrize("size", [64, 1000, warc.CHUNK])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, size, least):
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in ROWS], "page_id long, url string, html string, payload_bytes long").repartition(3)
    path = new_path(spark, "archives")
    warc.write_archives(pages, path, least, size)
    got = Counter(tuple(r) for r in warc.read_archives(spark, path).collect())
    want = Counter()
    for i, _, h in ROWS:
        data = (h or "").encode()
        same = [j for j, _, g in ROWS if (g or "") == (h or "") and j is not None]
        top = max(same, default=None)
        revisit = len(data) >= least and top is not None and i != top
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)] += 1
    assert got == want
    chunks = spark.read.parquet(path)
    assert chunks.selectExpr("max(length(data))").first()[0] <= max(size, 600) + 4


def test_records_are_warc(spark):
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(ROWS[:1], "page_id long, url string, html string"), path, size=50)
    record = b"".join(r.data for r in spark.read.parquet(path).orderBy("archive", "record", "chunk").collect())
    head, http, rest = record.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest == b"<p>x</p>\r\n\r\n"
    assert int(head.split(b"Content-Length: ")[1]) == len(http) + 4 + 8


def test_damage_is_found():
    chunks = list(warc.record_chunks(warc.head(1, "u", 9, warc.payload_digest(np.frombuffer(b"123456789", np.uint8)), None), np.frombuffer(b"123456789", np.uint8), 16))
    reader = warc.Reader()
    for _, _, crc, data in chunks:
        reader.feed(crc, data)
    assert reader.done()[:2] == (1, 9)
    reader = warc.Reader()
    with pytest.raises(ValueError):
        for _, _, crc, data in chunks[1:]:
            reader.feed(crc, data)


def test_empty(spark):
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0 and os.sep in path


def test_long_payloads_of_many_production_chunks(spark):
    rows = [(1, "u", "xy" * 1_700_000), (2, "u", "xy" * 1_700_000), (3, "u", "é" * 600_000), (4, "u", "z" * warc.CHUNK), (4, "u", "z" * warc.CHUNK)]
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([(*r, 5, "a") for r in rows], "page_id long, url string, html string, archive int, crc string"), path)
    got = Counter(tuple(r) for r in warc.read_archives(spark, path).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == Counter([(1, 3_400_000, digest(rows[0][2]), "revisit", 2), (2, 3_400_000, digest(rows[0][2]), "response", None), (3, 1_200_000, digest(rows[2][2]), "response", None)] + 2 * [(4, warc.CHUNK, digest(rows[3][2]), "response", None)])
    assert spark.read.parquet(path).filter("chunk > 2").count() == 1


def test_many_shared_digests_are_joined_by_shuffle(spark, monkeypatch):
    from fluvial import staging

    monkeypatch.setattr(warc, "SHARED", 0)
    monkeypatch.setattr(staging, "LEAST_HOT", 10)
    monkeypatch.setattr(staging, "hot_groups", lambda spark: 10**9)
    rows = [(i, "u", "same") for i in range(200)] + [(1000 + i, "u", f"own {i // 2}") for i in range(60)]
    path = new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: ("response", None) if i == 199 else ("revisit", 199) for i in range(200)} | {1000 + i: ("response", None) if i % 2 else ("revisit", 1001 + i) for i in range(60)}
