import base64
import gzip
import hashlib
import json
import os

from pyspark.sql import functions as F

from precis.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, ordinal int"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b\r\nX: y", None), (4, "", ""), (5, "u", "x" * 3_000_000),
        (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (None, "u", "only null"), (1, "u", "<p>é</p>"), (7, "u", "")]


def archived(spark, rows):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(3)
    folder, index = warc.archive_pages(df)
    return folder, index, warc.read_back(spark, index.select("archive").distinct(), folder)


def test_round_trip(spark):
    _, _, back = archived(spark, ROWS)
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()], key=repr)
    assert got == brute(ROWS)


def test_members_and_sidecar(spark):
    folder, index, _ = archived(spark, ROWS)
    path = folder[5:] if folder.startswith("file:") else folder
    names = {r.archive for r in index.collect()}
    assert names == {x for x in os.listdir(path) if x.endswith(".warc.gz")}
    for name in names:
        data = open(f"{path}/{name}", "rb").read()
        at = 0
        for line in open(f"{path}/{name}.idx"):
            x = json.loads(line)
            assert x["offset"] == at
            record = gzip.decompress(data[at:at + x["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            at += x["length"]
        assert at == len(data)
        whole = gzip.decompress(data)  # the members are also one valid gzip file
        assert whole.count(b"WARC-Record-ID") == sum(1 for _ in open(f"{path}/{name}.idx"))


def test_small_blocks_and_mixed_members():
    import io
    import zlib
    records = [warc.record("response", k, "u", n, "D", None, b"z" * n) for k, n in enumerate([0, 1, 5000])]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    stream = gz.compress(records[0] + records[1]) + gz.flush() + gzip.compress(records[2])
    for block in (1, 7, 1 << 16):
        assert [len(p) for _, p in warc.stream_records(io.BytesIO(stream), block)] == [0, 1, 5000]


def test_archives_roll(spark):
    rows = [(i, "u", f"page {i % 4}") for i in range(10)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).coalesce(1)
    folder, index = warc.archive_pages(df, archive_records=3)
    assert index.select("archive").distinct().count() == 4
    back = warc.read_back(spark, index.select("archive").distinct(), folder).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert archived(spark, [])[2].collect() == []


def test_archives_are_shared_out_to_several_tasks(spark):
    rows = [(i, "u", f"page {i}") for i in range(24)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).coalesce(1)
    mono, final = warc.scratch(spark, "whole"), warc.scratch(spark, "warc")
    records = warc.stored(warc.write_monolithic(df, mono, archive_records=1), "records")
    index = warc.stored(warc.normalise(warc.with_types(records), mono, final).withColumn("task", F.spark_partition_id()), "index")
    back = warc.read_back(spark, index.select("archive").distinct(), final).withColumn("task", F.spark_partition_id())
    assert index.select("task").distinct().count() > 1
    assert back.select("task").distinct().count() > 1
