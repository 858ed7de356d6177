"""WARC bundles: exact round trips, the two public formats, revisits, damage."""

import glob
import hashlib
import io
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from auditmill.llm import warc

ROWS = [(1, "http://a/", "<p>" + "x" * 200), (2, "http://b/", "<p>" + "x" * 200), (3, None, None), (4, "u\r\nWARC-Type: x", ""), (5, "é ü", "short"), (6, "v", "short"),
        (7, "http://c/", "WARC/1.1\r\n\r\n" * 30), (8, "w", "é" * 50), (9, "w", "é" * 50), (10, "big", "Ünïcode 😀 " * 50_000),
        (None, "n", "<p>" + "x" * 200), (None, None, "y" * 99), (11, "r", "z" * 100), (11, "r", "z" * 100), (11, "r", "z" * 100), (12, "r", "z" * 99), (12, "r", "z" * 99)]


def table(spark, rows=ROWS, parts=3):
    return spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, record_type string").repartition(parts)


def expected(rows):
    first, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= 100 and data in first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, i)
    return sorted(out, key=str)


@pytest.mark.parametrize("frame_bytes, bundle_bytes", [(1, 1), (1000, 1 << 20), (warc.FRAME_BYTES, warc.BUNDLE_BYTES)])
def test_round_trip(spark, tmp_path, frame_bytes, bundle_bytes):
    archive = warc.write(table(spark), str(tmp_path / "out"), frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    records = archive.records()
    assert sorted(map(tuple, warc.summary(records).collect()), key=str) == expected(ROWS)
    kept = sorted(((r.page and int(r.page), r.url, r.payload.decode()) for r in records.filter("record_type = 'response'").collect()), key=str)
    want = {(i, h or "") for i, _, h in ROWS}
    assert {(p, text) for p, _, text in kept} <= want and {hashlib.sha256(t.encode()).digest() for _, _, t in kept} == {
        hashlib.sha256(t.encode()).digest() for _, t in want}
    assert {u for p, u, _ in kept if p == 4} == {"u%0D%0AWARC-Type:%20x"} and {u for p, u, _ in kept if p == 5} == {"é%20ü"}
    index = archive.index.collect()
    assert len({r.record_id for r in index}) == len(ROWS)
    for r in index:  # every place leads to its record
        if frame_bytes == 1:
            assert r.offset == 0
        at, packed, plain, check = warc.seek_table(r.bundle)[r.frame]
        with open(r.bundle, "rb") as file:
            file.seek(at)
            data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
        found, end = warc.parse(data, r.offset)
        assert found["record_id"] == r.record_id and end - r.offset == r.length
    some = archive.index.filter("page in (2, 10) or page is null").select("record_id")
    got = archive.fetch(some.union(some))
    assert sorted(r.record_id for r in got.collect()) == sorted(r.record_id for r in some.collect())


def test_bundles_are_plain_zstandard(spark, tmp_path):
    archive = warc.write(table(spark, parts=1), str(tmp_path / "out"), frame_bytes=500)
    [path] = glob.glob(f"{tmp_path}/out/*.warc.zst")
    with open(path, "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
    at, n = 0, 0
    while at < len(whole):
        _, at = warc.parse(whole, at)
        n += 1
    assert n == len(ROWS) and archive.index.agg(F.max("frame")).first()[0] > 2


def test_damage_is_seen(spark, tmp_path):
    archive = warc.write(table(spark, parts=1), str(tmp_path / "out"))
    [path] = glob.glob(f"{tmp_path}/out/*.warc.zst")
    with open(path, "r+b") as file:
        file.seek(os.path.getsize(path) // 2)
        old = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([old[0] ^ 1]))
    with pytest.raises(Exception, match="damaged|match|rror"):
        archive.records().collect()


def test_same_records_by_place_in_file(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "in"))
    pages = spark.read.parquet(str(tmp_path / "in"))
    uid = F.md5(F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").cast("binary"))
    assert sorted(map(tuple, warc.summary(warc.write(pages, uid=uid).records()).collect()), key=str) == expected(ROWS)


def test_many_copies_and_empty_table(spark):
    rng = random.Random(1)
    rows = [(i, "u", "copy " * 40 if i % 3 == 0 else "t" * rng.randint(0, 300)) for i in range(900)]
    assert sorted(map(tuple, warc.summary(warc.write(table(spark, rows)).records()).collect()), key=str) == expected(rows)
    none = warc.write(table(spark).filter("page_id < 0"))
    assert none.index.collect() == [] and none.records().collect() == []
