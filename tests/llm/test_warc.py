import base64
import gzip
import hashlib
import zlib

import pytest

from pyspark.sql import functions as F

from shardflow.llm.common import shared_dir, stored
from shardflow.llm.warc import normalise, parse, plan_records, read_archives, round_trip, write_archives


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (3, "", None), (4, "u", ""), (5, "é ü", "ünïcode\r\n\r\nWARC/1.0\r\n"), (6, "v", "x" * 300_000), (7, "w", "x" * 300_000), (7, "w", "x" * 300_000), (8, "q", "unique")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((r.asDict() for r in round_trip(df, least, roll_bytes=1000).collect()), key=lambda r: r["page_id"])
    assert len(got) == len(rows)
    for (page, _, html), r in zip(rows, got, strict=True):
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        revisit = page != first and len(data) >= least
        assert r == {"page_id": page, "payload_bytes": len(data), "payload_digest": base64.b32encode(hashlib.sha1(data).digest()).decode(), "record_type": "revisit" if revisit else "response", "refers_to": first if revisit else None}


def test_both_ways_of_joining(spark):
    df = spark.createDataFrame([(k, None, f"p{k % 7}") for k in range(50)], "page_id long, url string, html string")
    found = [sorted((r["page_id"], r["refers_to"]) for r in plan_records(df, broadcast_groups=n).collect()) for n in (0, 100)]
    assert found[0] == found[1] == [(k, None if k < 7 else k % 7) for k in range(50)]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "u", "a"), (3, "u", "a")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in round_trip(df).collect()) == [(0, "revisit"), (3, "response")]
    assert round_trip(df.limit(0)).count() == 0


def test_members_and_index(spark):
    folder = shared_dir(spark, "warc-test")
    df = spark.createDataFrame([(k, f"http://x/{k}", f"page {k % 4}") for k in range(40)], "page_id long, url string, html string").coalesce(1)
    raw = write_archives(plan_records(df), f"{folder}/raw").collect()
    for r in raw:
        data = open(r["path"].removeprefix("file://"), "rb").read()
        stream = zlib.decompressobj(31)
        stream.decompress(data)
        assert stream.eof and not stream.unused_data  # one member
    new = normalise(spark.createDataFrame(raw), f"{folder}/normal").collect()
    seen = 0
    for r in new:
        path = r["path"].removeprefix("file://")
        data = open(path, "rb").read()
        end = 0
        for line in open(path + ".idx"):
            offset, length, kind, record_id, _ = line.rstrip("\n").split("\t")
            assert int(offset) == end
            end += int(length)
            ((headers, _, _),) = parse(__import__("io").BytesIO(gzip.decompress(data[int(offset) : end])))
            assert headers["warc-type"] == kind and headers["warc-record-id"] == record_id
            seen += 1
        assert end == len(data)
    assert seen == 40


def test_archives_are_dealt_out(spark):
    folder = shared_dir(spark, "warc-test")
    df = spark.createDataFrame([(k, None, f"page {k}") for k in range(40)], "page_id long, url string, html string").coalesce(1)
    raw = stored(write_archives(plan_records(df).coalesce(1), f"{folder}/raw", roll_bytes=1), "warc-raw")
    assert raw.count() == 40
    tasks = normalise(raw, f"{folder}/normal").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) == 40 and all(t["count"] == 1 for t in tasks)
    normal = normalise(raw, f"{folder}/normal-2")
    assert read_archives(stored(normal, "warc-normal")).rdd.getNumPartitions() == 40
