import hashlib
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from turnwise.llm.common import opened
from turnwise.llm.warc import capture_plan, read_bundles, read_payloads, seek_table, write_bundles

BODY = "<p>" + "shared " * 40 + "</p>"
SCHEMA = "page_id long, url string, html string, digest string, kind int, bundle string"


def made_pages(spark):
    rng = random.Random(5)
    rows = [(i, f"http://x.example/{i}?a=%20é", BODY if i % 3 == 0 else f"<p>{rng.random()}</p>" * rng.randrange(1, 40),
             "c", 1, "d") for i in range(200)]
    rows += [(500, None, BODY, None, None, None), (501, "", None, None, None, None), (502, "u\r\nv", "", None, None, None),
             (None, "n", BODY, None, None, None), (None, None, "é" * 60, None, None, None),
             (503, "short", "x" * 99, None, None, None), (504, "short", "x" * 99, None, None, None),
             (505, "long", "y" * 5_000_000, None, None, None), (506, "long", "y" * 5_000_000, None, None, None)]
    rows += [rows[1], rows[3], (-7, "first", BODY, None, None, None), (-7, "first", BODY, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(rows):
    """Type and original of each page, by one pass over the rows in order."""
    out, first = [], {}
    for page, url, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        out.append((page, len(data), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, page)
    return sorted(out, key=repr)


def test_bundles_give_back_every_record(spark, tmp_path):
    rows, pages = made_pages(spark)
    index = write_bundles(pages, f"{tmp_path}/w", frame_bytes=5_000, bundle_bytes=20_000)
    back = read_bundles(index).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in back), key=repr) == plain(rows)
    assert {(r["page_id"], r["url"]) for r in back} == {(p, u) for p, u, *_ in rows}
    # Index and archives agree on every place, and identifiers are unique.
    place = lambda r: (r["record_id"], r["bundle"], r["frame"], r["record_at"], r["record_bytes"])
    entries = index.collect()
    assert {place(r) for r in entries} == {place(r) for r in back} and len({r["record_id"] for r in entries}) == len(rows)
    # One record is read from its frame alone.
    wanted = index.filter("page_id in (505, 506, 1, 500)")
    got = {r["record_id"]: bytes(r["payload"]) for r in read_payloads(wanted).collect()}
    by_id = {r["record_id"]: r for r in wanted.collect()}
    html = {p: (h or "").encode() for p, _, h, *_ in rows}
    assert len(got) == 5
    for key, payload in got.items():
        assert payload == (html[by_id[key]["page_id"]] if by_id[key]["record_type"] == "response" else b"")


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    _, pages = made_pages(spark)
    index = write_bundles(pages, f"file:{tmp_path}/w", frame_bytes=5_000)
    for (path,) in index.select("bundle").distinct().collect():
        local = opened(path)[1]
        with open(local, "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        frames = seek_table(path)
        assert len(whole) == sum(f[4] for f in frames) and whole.startswith(b"WARC/1.1\r\n")
        last = frames[-1]
        assert last[2] + last[3] + 8 + 12 * len(frames) + 9 == os.path.getsize(local)


def test_damaged_frames_are_noticed(spark, tmp_path):
    index = write_bundles(spark.createDataFrame([(1, "u", "z" * 300, "", 0, "")], SCHEMA), f"{tmp_path}/w")
    path = index.first()["bundle"]
    with open(path, "r+b") as f:
        f.seek(-13, os.SEEK_END)
        f.write(b"\0\0\0\1")
    with pytest.raises(Exception, match="checksum"):
        read_bundles(index).collect()


def test_hot_payload_spreads(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(BODY).alias("html"))
    sizes = capture_plan(pages).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 5000
    kinds = {r["kind"]: r["count"] for r in capture_plan(pages).groupBy("kind").count().collect()}
    assert kinds == {"response": 1, "revisit": 4999}


def test_no_pages(spark, tmp_path):
    index = write_bundles(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert index.count() == 0 and read_bundles(index).count() == 0 and read_payloads(index).count() == 0
