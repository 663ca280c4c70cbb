"""Archives of pages: round trip, revisit resolution, odd payloads."""

import gzip
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from opinara.llm import warc


def brute(rows):
    """{(page_id, digest): sorted [(n_bytes, kind, refers_to)]} of (page_id, html)."""
    out, groups = {}, {}
    for i, html in rows:
        data = (html or "").encode()
        groups.setdefault(data, []).append(i)
    for data, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        key = hashlib.sha256(data).hexdigest()
        for k, i in enumerate(ids):
            late = k > 0 and len(data) >= warc.LEAST
            out.setdefault((i, key), []).append((len(data), "revisit" if late else "response", ids[0] if late else None))
    return {k: sorted(v, key=str) for k, v in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.page_id, r.payload_digest), []).append((r.payload_bytes, r.record_type, r.refers_to))
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.fixture(scope="module")
def pages(spark):
    inside = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    texts = [None, "", "\n", "\r\n\r\n", "x" * 99, "x" * 100, "é" * 50, inside, "end\r\n", "\r\n" * 80, "y" * 300_000, "null \x00 byte" * 20, "\U0001f642" * 40]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)] + [(100 + i, "http://h/é b\r\nX: 1", t) for i, t in enumerate(texts)]
    rows += [(5, "http://h/5", "x" * 100), (None, None, "x" * 100), (None, None, "only here" * 30), (None, None, "only here" * 30)]
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, record_id string, digest string").repartition(3)


def test_resolution_equals_plain_python(pages):
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert got(warc.report(pages)) == brute(rows)
    assert warc.report(pages.limit(0)).collect() == []


def test_archives_hold_what_the_format_asks_for(spark, pages, tmp_path):
    plain = warc.write(pages, str(tmp_path / "plain"), date="2024-01-02T03:04:05Z")
    rows = warc.read(spark, plain).collect()
    assert sorted(((r.page_id, r.payload) for r in rows), key=str) == sorted(((r.page_id, (r.html or "").encode()) for r in pages.collect()), key=str)
    assert {r.date for r in rows} == {"2024-01-02T03:04:05Z"} and len({r.record_id for r in rows}) == len(rows)
    assert {r.url for r in rows if r.page_id == 100} == {"http://h/é%20b%0D%0AX:%201"}
    target = warc.dedup(spark, plain, str(tmp_path / "less"))
    less = {r.record_id: r for r in warc.read(spark, target).collect()}
    assert len(less) == len(rows) and not set(less) & {r.record_id for r in rows}
    for r in less.values():
        if r.kind == "revisit":
            first = less[r.refers_to]
            assert first.kind == "response" and first.digest == r.digest and r.payload is None
    data = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(target).glob("part-*"))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Refers-To: <urn:uuid:") == sum(r.kind == "revisit" for r in less.values())
    assert data.count(b"y" * 300_000) == 1
    with pytest.raises(Exception, match="not a response"):
        warc.dedup(spark, target, str(tmp_path / "again"))


def test_broken_archives_raise(spark, pages, tmp_path):
    def archive(name, data):
        path = tmp_path / name
        path.mkdir()
        (path / "a.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
        return str(path)

    record = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    rows = warc.read(spark, archive("members", record * 3)).collect()
    assert [r.payload for r in rows] == [b"ab\r\nc"] * 3 and {r.page_id for r in rows} == {None}
    wrong = record.replace(b"WARC-Record", b"WARC-Payload-Digest: sha256:" + b"0" * 64 + b"\r\nWARC-Record")
    for name, data, said in (("short", record[:-7], "inside a record"), ("long", record.replace(b"Content-Length: 5", b"Content-Length: 2"), "Content-Length|no record"), ("none", record.replace(b"Content-Length: 5\r\n", b""), "without Content-Length"), ("wrong", wrong, "differs")):
        with pytest.raises(Exception, match=said):
            warc.read(spark, archive(name, data)).collect()


def test_a_payload_of_a_third_of_all_rows(spark):
    rows = [(i, ("common " * 40) if i % 3 == 0 else f"page {i} " * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    assert got(warc.report(df)) == brute(rows)
