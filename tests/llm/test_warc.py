"""WARC: ranges among tasks, records that swell, are large or are damaged, and payloads that many pages share."""

import gzip

import pytest
from pyspark.sql import functions as F

from folioscan.llm import warc
from folioscan.llm.common import shared_dir


def stored(tmp_path, name, *members):
    root = tmp_path / "archives"
    root.mkdir(exist_ok=True)
    (root / name).write_bytes(b"".join(members))
    return f"file://{root}"


def record(i, payload):
    return warc._record(i, "u", payload, "X", None, "d")


def test_ranges_are_read_by_as_many_tasks(spark, tmp_path):
    root = stored(tmp_path, "a.warc", *(record(i, b"x" * 900) for i in range(200)))
    found = warc.candidates(spark, root, 4096).withColumn("task", F.spark_partition_id())
    n = warc._ranges(spark, root, 4096).count()
    assert n > 50 and found.select("task").distinct().count() > n / 2
    got = warc.read_archives(spark, root, 4096).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page_id for r in got) == list(range(200)) and len({r.task for r in got}) > n / 2


@pytest.mark.parametrize("compress", [True, False])
def test_large_records_have_no_payload(spark, tmp_path, compress):
    pack = gzip.compress if compress else lambda x: x
    big = bytes(range(256)) * 8000
    root = stored(tmp_path, f"a.warc{'.gz' * compress}", pack(record(1, b"small")), pack(record(2, big)), pack(record(3, b"")))
    got = {r.page_id: r for r in warc.read_archives(spark, root, max_block=1 << 20).collect()}
    assert bytes(got[1].payload) == b"small" and bytes(got[3].payload) == b"" and got[3].payload_bytes == 0
    assert got[2].payload is None and got[2].payload_bytes > len(big)
    whole = {r.page_id: r for r in warc.read_archives(spark, root).collect()}
    assert bytes(whole[2].payload) == big and whole[2].payload_bytes == len(big)


def test_members_that_swell_or_break_end_their_chain(spark, tmp_path):
    good = gzip.compress(record(1, b"one"))
    swollen = gzip.compress(record(2, b"two")[:-4] + b"\0" * (64 << 20))
    root = stored(tmp_path, "a.warc.gz", good, swollen, gzip.compress(record(3, b"three")))
    file = warc._File(root + "/a.warc.gz", len(good) + len(swollen))
    assert sum(len(p) for p, _ in file.unpacked(len(good))) > 64 << 20  # what it would swell to
    held = []
    real = file.unpacked
    file.unpacked = lambda at: (held.append(len(x[0])) or x for x in real(at))
    assert file.record(len(good), True, 0) is None and sum(held) < 1 << 20  # given up long before
    stored(tmp_path, "b.warc.gz", gzip.compress(record(4, b"four")), gzip.compress(record(5, b"five"))[:-9])
    stored(tmp_path, "c.warc", record(6, b"six"), b"WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n")
    stored(tmp_path, "d.warc", b"no archive at all")
    stored(tmp_path, "e.warc", b"")
    assert sorted(r.page_id for r in warc.read_archives(spark, root).collect()) == [1, 4, 6]


def test_ids_and_lengths_out_of_range_are_null(spark, tmp_path):
    raw = record(1, b"body").replace(b"x-page:1>", b"x-page:" + b"9" * 40 + b">").replace(b"Content-Length: 4\r\n", b"Content-Length: " + b"9" * 25 + b"\r\n")
    raw = raw.replace(raw.split(b"\r\n\r\n")[0].rsplit(b" ", 1)[1], str(len(raw.split(b"\r\n\r\n", 1)[1]) - 4).encode())
    root = stored(tmp_path, "a.warc", raw)
    (row,) = warc.read_archives(spark, root).collect()
    assert row.page_id is None and row.payload_bytes == 4 and bytes(row.payload) == b"body"


def test_equal_payloads_are_spread_and_have_one_response(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "the same error page") for i in range(5, 400)] + [(1, None, None), (None, None, "the same error page")], "page_id long, url string, html string")
    rows = warc.assign_records(pages, "page_id", "url", F.col("html"), 0)
    got = {r.page_id: r.refers_to for r in rows.collect()}
    assert got[5] is None and got[1] is None and got[None] == 5 and all(got[i] == 5 for i in range(6, 400))
    root = shared_dir(spark, "warc-same")
    warc.write_archives(pages, root)
    assert warc.read_archives(spark, root).where("record_type = 'response'").count() == 2
