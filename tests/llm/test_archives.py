from __future__ import annotations

import hashlib
import io
import os
import struct

import pytest
import zstandard
from oracle import compare, connect
from pyspark.sql import functions as F

from tapeloom.llm import archives as ar

SCHEMA = "page_id long, url string, html string, payload string, digest string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "own", "own", -1) for i, u, h in rows], SCHEMA)


LONG = "<p>" + "word " * 60_000
ROWS = [
    (5, "http://a/", "<html>" + "x" * 200),
    (2, "http://b/", "<html>" + "x" * 200),
    (9, None, "<html>" + "x" * 200),
    (3, "http://c/\r\nX-Evil: 1", "short"),
    (4, "http://d/", "short"),
    (6, "", None),
    (7, "http://e/", ""),
    (8, "http://f/", LONG),
    (8, "http://f/", LONG),
    (10, "http://g/", "é" * 50),
    (11, "http://h/", "é" * 50),
    (None, "http://i/", "<html>" + "x" * 200),
    (None, None, None),
]


def test_round_trip_of_odd_rows(spark, tmp_path):
    made = ar.write_archives(pages(spark, ROWS).repartition(3), f"{tmp_path}/warc", ar.Settings(file_bytes=300))
    got = ar.read_archives(made).collect()
    assert len(got) == len(ROWS) and made.count() > 1
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in ROWS)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    kind = {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id is not None}
    assert kind[2] == ("response", None) and kind[5] == kind[9] == ("revisit", 2)
    assert kind[3] == kind[4] == kind[6] == kind[7] == kind[8] == ("response", None)
    assert kind[10] == ("response", None) and kind[11] == ("revisit", 10)
    assert {(r.record_type, r.refers_to) for r in got if r.page_id is None and r.payload_bytes} == {("revisit", 2)}
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
        else:
            assert r.payload is None


def test_empty_table(spark, tmp_path):
    made = ar.write_archives(pages(spark, []), f"{tmp_path}/none")
    assert made.count() == 0 and ar.read_archives(made).count() == 0


def archive(dictionary: bytes, records: list[bytes]) -> bytes:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(dict_data=data, write_checksum=True)
    return ar.dictionary_frame(dictionary, 3) + b"".join(packer.compress(r) for r in records)


def one(i: int, payload: bytes = b"hello") -> bytes:
    return ar.page_record(i, "http://x/", payload, hashlib.sha256(payload).hexdigest(), None)


@pytest.mark.parametrize("dictionary", [b"", b"raw words of a dictionary " * 20])
def test_frames_and_dictionary(dictionary):
    content = archive(dictionary, [one(1), one(2, b"y" * 300_000), one(3)])
    if dictionary:
        assert struct.unpack("<I", content[:4])[0] == ar.DICTIONARY_MAGIC
    for step in (1, 7, 1 << 20):

        class Slow(io.BytesIO):
            def read(self, n=-1, step=step):
                return super().read(min(n, step) if n > 0 else n)

        got = [ar.parse(f) for f in ar.frames(Slow(content) if step > 1 else io.BytesIO(content))]
        assert [p.page_id for p in got] == [1, 2, 3] and got[1].payload_bytes == 300_000


def test_plain_dictionary_and_other_skippable_frames():
    dictionary = b"raw words of a dictionary " * 20
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    content = struct.pack("<II", ar.DICTIONARY_MAGIC, len(dictionary)) + dictionary + packer.compress(one(1))
    content += struct.pack("<II", 0x184D2A50, 5) + b"notes" + packer.compress(one(2))
    assert [ar.parse(f).page_id for f in ar.frames(io.BytesIO(content))] == [1, 2]


@pytest.mark.parametrize("cut", [3, 6, 30, -1, -7])
def test_truncated_archives_are_damaged(cut):
    content = archive(b"raw words of a dictionary " * 20, [one(1), one(2)])
    with pytest.raises(ar.Damaged):
        list(map(ar.parse, ar.frames(io.BytesIO(content[:cut]))))


@pytest.mark.parametrize("change", [
    (b"WARC/1.1", b"WARC/9.9"),
    (b"WARC-Date", b"WARC-Dote"),
    (b"Content-Length: 83", b"Content-Length: 82"),
    (b"hello", b"jello"),
    (b"<urn:page:1>", b"<urn:else:1>"),
    (b"sha256:", b"sha1:"),
    (b"WARC-Type: response", b"WARC-Type: revisit"),
])
def test_damaged_records_are_refused(change):
    record = one(1)
    assert change[0] in record
    with pytest.raises(ar.Damaged):
        ar.parse(record.replace(*change))


def test_wrong_count_ends_the_job(spark, tmp_path):
    path = f"{tmp_path}/a.warc.zst"
    with open(path, "wb") as f:
        f.write(archive(b"", [one(1), one(2)]))
    assert ar.read_archives(spark.createDataFrame([(path, None)], "path string, records long")).count() == 2
    with pytest.raises(Exception, match="3 announced"):
        ar.read_archives(spark.createDataFrame([(path, 3)], "path string, records long")).collect()


def test_files_hold_a_dictionary(spark, sf, tmp_path):
    made = ar.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), f"{tmp_path}/warc")
    for r in made.collect():
        with open(r.path, "rb") as f:
            assert struct.unpack("<I", f.read(4))[0] == ar.DICTIONARY_MAGIC
        assert abs(os.path.getsize(r.path) - r.bytes) <= 70_000


def test_query_equals_sql(spark, sf):
    assert compare(spark, "op3", ar.op3_warc_round_trip, ar.SQL, sf, connect(sf)) is None


def test_every_archive_is_read_by_a_task_of_its_own(spark, tmp_path):
    made = ar.write_archives(pages(spark, [(i, f"http://{i}/", f"<html>{i}" + "y" * 150) for i in range(24)]).repartition(6), f"{tmp_path}/warc", ar.Settings(file_bytes=600))
    files = made.count()
    read = ar.read_archives(made)
    assert files > 6 and read.rdd.getNumPartitions() == files
    per = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) >= files - 1 and sum(r["count"] for r in per) == 24
