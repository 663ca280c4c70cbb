"""WARC archives of pages, with equal payloads resolved to revisit records.

1. `write` turns every row into one response record of a WARC/1.1 archive.  Records are strings
   that Spark's text writer puts down with the record separator, gzipped: any store that Spark
   writes to will do, and a task's archives hold at most `RECORDS` records each.
2. `read` streams the archives: lines are joined again and cut by `Content-Length` alone, so a
   payload may hold anything, separators and whole records too.  A task keeps one record.
3. `resolved` shuffles headers only, by payload digest: the records of a digest are counted down
   to their first one before the shuffle, and every record is joined with it.
4. `dedup` writes the deduplicated archives with fresh headers: new record ids and lengths; a
   revisit names the new id, the address and the date of its response and carries no payload.
   Revisits are made of headers alone; the payloads of responses are read once more and meet
   the ids that go in an anti join: shipped up to `SHIPPED` of them, shuffled beyond.
5. `page_records` reads such archives back; a revisit finds its payload's length by the join with the
   response it refers to.

Records have one payload if SHA-256, as computed from the bytes read, and length agree.  The first of them is the one with the
smallest page id; ids that are null come last, and of rows that agree in this the smallest record
id decides.  Payloads under `LEAST` bytes are never revisits.

Defined results: null html is an empty payload; a null url leaves out the address, and blank or
control characters in one are percent-encoded; a null page id leaves out that field and reads
back as null; repeated rows are records of their own; an empty table gives an archive without
records; other columns are ignored.  Archives that end inside a record, hold a record without a
length or a payload that differs from its SHA-256 raise an error, as do archives without gzip
that Spark would split inside records; `dedup` takes response records and raises one for others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import scratch
from opinara.session import scratch_path

LEAST = 100  # bytes; smaller payloads cost less than their revisit record
RECORDS = 20_000  # of an archive
SHIPPED = 200_000  # record ids that every task may hold
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, page_id long, kind string, url string, date string, digest string, refers_to string, payload binary"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _safe(url: Column) -> Column:
    """The address without characters that would end a header line or its field."""
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _named(key: Column) -> Column:
    """A record id out of 32 hex digits."""
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _fresh(record_id: Column) -> Column:
    """The id that a record gets in the deduplicated archive; others can be named before they are written."""
    return _named(F.md5(F.concat(F.lit("deduplicated "), record_id).cast("binary")))


def _record(kind: Column, record_id: Column, fields: list[Column], payload: Column) -> Column:
    """A whole record as text; `payload` is null where the record has none."""
    body = F.coalesce(payload, F.lit(""))
    length = F.octet_length(body).cast("string")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(payload.isNotNull(), F.concat(F.lit("Content-Length: "), length, F.lit("\r\n"))).otherwise(""), F.lit("\r\n"), body)
    return F.concat(
        F.lit(f"{_VERSION}\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_id),
        *fields,
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def _save(records: DataFrame, path: str) -> str:
    # Spark puts the separator after each value, as the format wants it after each record.
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS).text(path)
    return path


def write(pages: DataFrame, path: str, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """One response record per row under `path`; `date` is the records' date, now by default."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    day = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_col).cast("long").cast("string").alias("_id"), _safe(F.col(url_col).cast("string")).alias("_url"), html.alias("_html"))
    fields = [
        _field("WARC-Date", day),
        _field("WARC-Target-URI", F.col("_url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2("_html", 256))),
        _field("Page-Id", F.col("_id")),
    ]
    return _save(rows.select(_record(F.lit("response"), _named(F.regexp_replace(F.expr("uuid()"), "-", "")), fields, F.col("_html")).alias("value")), path)


def _head(data: bytes) -> dict[bytes, bytes]:
    first, *lines = data.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no record starts here: {first[:40]!r}")
    pairs = (line.partition(b":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Archive:
    """Cuts the lines of one archive into (header fields, block)."""

    def __init__(self) -> None:
        self.data, self.need, self.head, self.start = bytearray(), 0, None, 0

    def feed(self, line: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
        self.data += line
        self.data += b"\n"
        if self.head is None:
            # A header ends with an empty line; empty lines before it end the record before.
            if line != b"\r":
                return None
            if not self.data.strip():
                self.data.clear()
                return None
            self.start = len(self.data)
            self.head = _head(bytes(self.data[:-4]))
            if b"content-length" not in self.head:
                raise ValueError("a record without Content-Length")
            self.need = self.start + int(self.head[b"content-length"])
        if len(self.data) < self.need + 4:
            return None
        out = self.head, bytes(self.data[self.start : self.need])
        del self.data[: self.need + 4]
        if self.data:
            raise ValueError("a record is longer than its Content-Length")
        self.head = None
        return out

    def close(self) -> None:
        if self.head is not None or self.data.strip():
            raise ValueError("an archive ends inside a record")


def _bare(name: bytes | None) -> str | None:
    return None if name is None else name.decode()


def _row(head: dict[bytes, bytes], block: bytes, payloads: bool) -> tuple:
    names = (b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-date", b"warc-refers-to", b"warc-payload-digest")
    record_id, kind, url, date, refers, digest = (_bare(head.get(n)) for n in names)
    page = head.get(b"page-id")
    page = None if page is None else int(page)
    digest = digest and digest.removeprefix("sha256:")
    if kind != "response":
        return record_id, page, kind, url, date, digest, refers, None, None
    http = head.get(b"content-type", b"").startswith(b"application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    found = hashlib.sha256(payload).hexdigest()
    if digest and len(digest) == 64 and digest != found:
        raise ValueError(f"the payload of {record_id} differs from its digest")
    return record_id, page, kind, url, date, found, refers, payload if payloads else None, len(payload)


def _parse(payloads: bool):
    names = [f.split()[0] for f in _RECORD.split(", ")] + ["n_bytes"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, archive, out, held = None, _Archive(), [], 0
        for part in batches:
            if not part.num_rows:
                continue
            if not pc.all(part.column("whole")).as_py():
                raise ValueError("an archive was split inside its records; archives must be gzipped")
            files = part.column("file").to_pylist()
            for file, line in zip(files, part.column("line").to_pylist(), strict=True):
                if file != at:
                    archive.close()
                    at, archive = file, _Archive()
                if found := archive.feed(line):
                    out.append(_row(*found, payloads))
                    held += len(found[1]) if payloads else 200
                    if held > 4_000_000:
                        yield batch(out)
                        out, held = [], 0
        archive.close()
        if out:
            yield batch(out)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, page_id, kind, url, date, digest, refers_to, payload, n_bytes), one row per
    record; payload and its length n_bytes are null for revisits, payload also on request."""
    lines = spark.read.option("lineSep", "\n").text(path)
    whole = F.col("_metadata.file_block_length") == F.col("_metadata.file_size")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), whole.alias("whole"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_parse(payloads), f"{_RECORD}, n_bytes long")


def resolved(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(record_id, page_id, url, date, digest, first): the records that are revisits, and the
    first record of their payload.

    `records` needs the columns of `read` but for payloads.
    """
    large = records.where(F.col("n_bytes") >= least).select("digest", "n_bytes", "record_id", "page_id", "url", "date")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url", "date")
    firsts = large.groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    # A payload that very many pages share is one row here; Spark splits the pages' side.
    rows = large.join(firsts, ["digest", "n_bytes"]).where(F.col("record_id") != F.col("first.record_id"))
    return rows.select("record_id", "page_id", "url", "date", "digest", "first")


def dedup(spark: SparkSession, source: str, target: str, least: int = LEAST) -> str:
    """Writes the archives of `source` to `target`, each payload once."""
    revisits = scratch(resolved(read(spark, source, payloads=False), least))
    # Payloads stay where they are while the ids that go are few enough to ship.
    gone = revisits.select("record_id")
    gone = F.broadcast(gone) if gone.count() <= SHIPPED else gone
    only = F.when(F.col("kind") == "response", F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("not a response: "), F.coalesce("kind", F.lit("a record without a type")))))
    responses = read(spark, source).withColumn("kind", only).join(gone, "record_id", "left_anti")
    fields = [
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("Page-Id", F.col("page_id").cast("string")),
    ]
    links = [
        _field("WARC-Profile", F.lit(_PROFILE)),
        _field("WARC-Refers-To", _fresh(F.col("first.record_id"))),
        _field("WARC-Refers-To-Target-URI", F.col("first.url")),
        _field("WARC-Refers-To-Date", F.col("first.date")),
    ]
    record_id = _fresh(F.col("record_id"))
    full = responses.select(_record(F.col("kind"), record_id, fields, F.col("payload").cast("string")).alias("value"))
    short = revisits.select(_record(F.lit("revisit"), record_id, fields + links, F.lit(None).cast("string")).alias("value"))
    return _save(full.unionByName(short), target)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of deduplicated archives."""
    records = scratch(read(spark, path, payloads=False).drop("payload", "url", "date"))
    response = records.where("kind = 'response'")
    first = response.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("n_bytes").alias("_bytes"))
    revisits = records.where("kind = 'revisit'").join(first, "refers_to", "left")
    row = lambda n, page: ["page_id", n.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page.alias("refers_to")]
    return response.select(*row(F.col("n_bytes"), F.lit(None).cast("long"))).unionByName(revisits.select(*row(F.col("_bytes"), F.col("_page"))))


def report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives the pages, deduplicates the archives and reads them back."""
    spark = pages.sparkSession
    plain = write(pages, scratch_path(spark, "warc"))
    return page_records(spark, dedup(spark, plain, scratch_path(spark, "warc-deduplicated"), least))


def oracle(least: int = LEAST) -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {least} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {least} AND page_id > first THEN first END AS refers_to
FROM f"""
