import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.llm import warc


def test_pages_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 80
    rows = [(1, "u", long), (7, "u", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u\r\nX: y", None), (8, "u", ""), (9, "u", long + "!"), (None, "u", long), (10, "u", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    got = sorted(warc.archive_pages(pages, str(tmp_path / "a")).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        assert by_id[page_id]["payload_bytes"] == len(payload)
        assert by_id[page_id]["payload_digest"] == hashlib.sha256(payload).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in by_id.items() if r["record_type"] == "revisit"} == {3: ("revisit", 1), 7: ("revisit", 1)}
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pushdown_and_skipping(spark, tmp_path, compression):
    rows = [(f"<urn:{i}>", "response" if i % 2 else "metadata", f"http://h{i % 3}/x", b"p" * (i * 5000)) for i in range(8)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary")
    path = str(tmp_path / compression)
    warc.write_warc(df.coalesce(2), path, compression=compression)
    whole = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, path).collect()}
    assert whole == {i: p for i, _, _, p in rows}
    some = warc.read_warc(spark, path).filter("record_type = 'response' AND target_uri LIKE 'http://h1%'")
    assert {r["record_id"] for r in some.collect()} == {i for i, t, u, _ in rows if t == "response" and u.startswith("http://h1")}
    bare = warc.read_warc(spark, path, payload=False).filter(F.col("record_type").isin("metadata", "none"))
    assert {(r["record_id"], r["payload"]) for r in bare.collect()} == {(i, None) for i, t, _, _ in rows if t == "metadata"}


def test_unwanted_members_are_not_inflated():
    data = b"".join(warc.gzip_member(warc.record_bytes({"record_id": f"<{i}>", "record_type": "response", "payload": bytes(range(256)) * 4000})) for i in range(5))
    reader, counter = warc.WarcReader({"path": "x"}), {}
    reader.tests = [("record_id", "is", "<none>")]
    assert list(reader.records("x.gz", pa.BufferReader(data), counter)) == [] and counter["inflated"] < 100_000
    assert len(gzip.decompress(data)) > 5_000_000


def test_foreign_files_parse(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <a>\r\nContent-Length: 25\r\nX-Long: a\r\n b\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<html>\r\n\r\n"
    second = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <b>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "one.warc").write_bytes(record + second)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(second))
    got = sorted((r["record_id"], r["record_type"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == [("<a>", "response", b"<html>")] * 2 + [("<b>", "warcinfo", b"abc")] * 2


def test_records_need_not_follow_gzip_members(spark, tmp_path):
    """One member for a whole file, members that end inside records, and members of this library among foreign ones."""
    rows = [{"record_id": f"<{i}>", "record_type": "response" if i % 2 else "metadata", "payload": bytes([65 + i]) * (i * 3000)} for i in range(7)]
    data = [warc.record_bytes(r) for r in rows]
    flat = b"".join(data)
    forms = {
        "whole": gzip.compress(flat), "split": b"".join(gzip.compress(flat[i : i + 1009]) for i in range(0, len(flat), 1009)),
        "mixed": warc.gzip_member(data[0]) + gzip.compress(b"".join(data[1:4])) + warc.gzip_member(data[4]) + warc.gzip_member(data[5]) + gzip.compress(data[6]),
    }
    for name, packed in forms.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(packed)
        got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / name)).collect()}
        assert got == {r["record_id"]: r["payload"] for r in rows}, name
        some = warc.read_warc(spark, str(tmp_path / name)).filter("record_type = 'metadata'").collect()
        assert {r["record_id"]: bytes(r["payload"]) for r in some} == {r["record_id"]: r["payload"] for r in rows if r["record_type"] == "metadata"}, name
    (tmp_path / "cut").mkdir()
    for form in (gzip.compress(flat)[:-20], gzip.compress(flat[:-900])):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.WarcReader({"path": "x"}).records("x.gz", pa.BufferReader(form)))


def test_repeated_page_ids_and_temporary_archives(spark, tmp_path):
    long = ["a" * 200, "b" * 200]
    rows = [(1, "u", long[0]), (1, "u", long[1]), (2, "u", long[1]), (2, "u", long[1]), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect())
    mark = [hashlib.sha256(x.encode()).hexdigest() for x in (*long, "")]
    assert got == sorted([(1, mark[0], "response", None), (1, mark[1], "response", None), (2, mark[1], "revisit", 1), (2, mark[1], "revisit", 1), (3, mark[2], "response", None)], key=lambda r: r[:3])


def test_overwrite_replaces_old_archives(spark, tmp_path):
    path = str(tmp_path / "x")
    for n in (3, 2):
        warc.write_warc(spark.createDataFrame([(f"<{n}-{i}>", "metadata") for i in range(n)], "record_id string, record_type string"), path, mode="overwrite")
    assert {r["record_id"] for r in warc.read_warc(spark, path).collect()} == {"<2-0>", "<2-1>"}
