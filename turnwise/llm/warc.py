"""Web archives as seekable Zstandard bundles.

A WARC record is written per page. Records are gathered into independent Zstandard frames of about ``FRAME_BYTES``; a
bundle is frames one after another and a footer, the seek table of the public seekable format (a skippable frame, so any
Zstandard reader reads the bundle as one plain WARC file). The index maps a record's identifier to its bundle, frame and
offset inside the decompressed frame: reading one record means one ranged read and one frame.

Deduplication by payload digest: among equal payloads of at least ``REVISIT_FROM`` bytes the first page is ``response``,
the others ``revisit`` it and carry no payload. Decisions are made on slim rows (identifiers and digests), pre-aggregated
before the digest shuffle; pages move once, keyed by page, url and digest together, so a payload that a third of all
pages share spreads over all tasks.

Bundles are written by the tasks to storage that every executor reaches, under names of their own for each attempt. Only
bundles that the written index names count: a task that ran twice leaves a file that nothing refers to.

Defined results: a null html is an empty payload; a null url has no target header and comes back null; a null page_id
comes after all others and comes back null; of equal payloads the smallest (page_id, url) is ``response``, and of fully
repeated rows one; payloads of any length are one record in one frame; an empty table gives no bundles and an empty
index; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import opened, table
from turnwise.llm.registry import query
from turnwise.session import materialize, scratch_dir

REVISIT_FROM = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 29
# Fixed values of the public formats: seekable Zstandard, WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER_BYTES = 9
ENTRY_BYTES = 12
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = ("record_id string, page_id long, record_type string, bundle string, frame int, frame_at long, "
          "frame_bytes long, record_at long, record_bytes long")
_FRAMES = "bundle string, frame int, frame_at long, frame_bytes long, raw_bytes long, checksum long"
_RECORDS = ("record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
            "payload_digest string, bundle string, frame int, record_at long, record_bytes long")


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow_schema(ddl)
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# Records

def record_id(page_id: int | None, url: str | None, digest: str, nth: int) -> str:
    """Identifier of a page's record: equal on every run, another for every row."""
    own = hashlib.sha256(f"{'' if url is None else '=' + url}\n{digest}".encode()).hexdigest()[:16]
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{own}:{nth}>"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return None if page == "none" else int(page)


def render(identifier: str, kind: str, url: str | None, digest: str, payload: bytes, size: int, refers_to: str | None,
           date: str) -> bytes:
    """One WARC record. ``size`` is that of the full payload, which a revisit does not carry."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=~-._')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:]), end + 4


def parse(data: bytes) -> Iterator[tuple]:
    """(record_id, page_id, url, type, refers_to, payload bytes, payload digest, offset, length) of each record.

    A response's size and digest are taken from the payload itself and must match its headers; a revisit's come from
    its headers, as it has no payload.
    """
    at = 0
    while at < len(data):
        head, body = _headers(data, at)
        end = body + int(head["Content-Length"])
        http, payload = _headers(data, body)
        size, digest = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response":
            held = memoryview(data)[payload:end]
            if len(held) != size or hashlib.sha256(held).hexdigest() != digest:
                raise ValueError(f"payload of {head['WARC-Record-ID']} is not what its headers say")
        elif payload != end:
            raise ValueError(f"{head['WARC-Record-ID']} is a revisit with a payload")
        target = head.get("WARC-Target-URI")
        original = head.get("WARC-Refers-To")
        yield (head["WARC-Record-ID"], page_of(head["WARC-Record-ID"]), None if target is None else unquote(target),
               head["WARC-Type"], None if original is None else page_of(original), size, digest, at, end + 4 - at)
        at = end + 4


# Bundles

@dataclass
class _Frame:
    packed: int
    raw: int
    checksum: int


class BundleWriter:
    """Writes records into frames and ends the bundle with its seek table. Holds one open frame in memory."""

    def __init__(self, path: str, frame_bytes: int, level: int = 3):
        self.path, self.frame_bytes = path, frame_bytes
        fs, local = opened(path)
        self.out = fs.open_output_stream(local, compression=None)  # it would go by the name
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[_Frame] = []
        self.open: list[bytes] = []
        self.open_bytes = self.size = 0
        self.waiting: list[tuple] = []

    def add(self, identifier: str, page_id: int | None, kind: str, record: bytes) -> list[tuple]:
        """Index rows of the frames that this record closed."""
        done = self.flush() if self.open and self.open_bytes + len(record) > self.frame_bytes else []
        self.waiting.append((identifier, page_id, kind, self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        return done

    def flush(self) -> list[tuple]:
        if not self.open:
            return []
        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        rows = [(i, page, kind, self.path, len(self.frames), self.size, len(packed), at, n)
                for i, page, kind, at, n in self.waiting]
        self.frames.append(_Frame(len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        self.open, self.waiting, self.open_bytes = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<III", f.packed, f.raw, f.checksum) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return rows


def seek_table(path: str) -> list[tuple]:
    """(bundle, frame, frame_at, frame_bytes, raw_bytes, checksum) of each frame, from the bundle's last bytes."""
    fs, local = opened(path)
    with fs.open_input_file(local) as source:
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        entries = source.read_at(count * ENTRY_BYTES, size - FOOTER_BYTES - count * ENTRY_BYTES)
    rows, at = [], 0
    for frame, (packed, raw, checksum) in enumerate(struct.iter_unpack("<III", entries)):
        rows.append((path, frame, at, packed, raw, checksum))
        at += packed
    return rows


def read_frame(source: pa.NativeFile, frame_at: int, frame_bytes: int, checksum: int | None = None) -> bytes:
    """One frame, decompressed by itself."""
    raw = zstandard.ZstdDecompressor().decompress(source.read_at(frame_bytes, frame_at))
    if checksum is not None and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
        raise ValueError(f"frame at {frame_at} does not match its checksum")
    return raw


# Jobs

def capture_plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), digest, size, nth, kind, first_page, first_url, one row per row of ``pages``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")) \
        .withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long")) \
        .withColumn("key", F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                                              F.coalesce(F.concat(F.lit("="), "url"), F.lit("")), "digest")
                                  .cast("binary"), 256))
    slim = rows.filter(F.col("size") >= REVISIT_FROM).select("key", "digest", "page_id", "url")
    in_order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"),
                        F.col("url").alias("url"), F.col("key").alias("key"))
    firsts = slim.groupBy("digest").agg(F.min(in_order).alias("first"))
    known = slim.dropDuplicates(["key"]).join(firsts, "digest").select(
        "key", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url"),
        (F.col("first.key") == F.col("key")).alias("is_first"))
    in_key = Window.partitionBy("key").orderBy("key")
    return rows.join(known, "key", "left").withColumn("nth", F.row_number().over(in_key)) \
        .withColumn("kind", F.when(F.col("is_first").isNull() | (F.col("is_first") & (F.col("nth") == 1)), "response")
                    .otherwise("revisit")) \
        .select("page_id", "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "digest", "size",
                "nth", "kind", "first_page", "first_url")


def _writer(folder: str, frame_bytes: int, bundle_bytes: int,
            date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0
        bundle: BundleWriter | None = None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                page, url, html, digest, size, nth, kind, first_page, first_url = (c[i].as_py() for c in batch.columns)
                if bundle is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{made}.warc.zst"
                    bundle, made = BundleWriter(posixpath.join(folder, name), frame_bytes), made + 1
                identifier = record_id(page, url, digest, nth)
                refers_to = record_id(first_page, first_url, digest, 1) if kind == "revisit" else None
                record = render(identifier, kind, url, digest, html or b"", size, refers_to, date)
                done += bundle.add(identifier, page, kind, record)
                if bundle.size >= bundle_bytes:
                    done += bundle.close()
                    bundle = None
            if done:
                yield _batch(done, _INDEX)
        if bundle is not None:
            yield _batch(bundle.close(), _INDEX)

    return write


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives of (page_id, url, html) under ``folder``; the written index, one row per record."""
    fs, local = opened(folder)
    fs.create_dir(local, recursive=True)
    return materialize(capture_plan(pages).mapInArrow(_writer(folder, frame_bytes, bundle_bytes, date), _INDEX))


def _frame_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            yield _batch(seek_table(path), _FRAMES)


def frames_of(bundles: DataFrame) -> DataFrame:
    """The frames of the bundles in column ``bundle``, from their footers."""
    return bundles.select("bundle").distinct().mapInArrow(_frame_lists, _FRAMES)


def _frame_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, source = None, None
    for batch in batches:
        for bundle, frame, at, size, checksum in zip(*(batch.column(n).to_pylist() for n in (
                "bundle", "frame", "frame_at", "frame_bytes", "checksum"))):
            if bundle != path:
                fs, local = opened(bundle)
                path, source = bundle, fs.open_input_file(local)
            raw = read_frame(source, at, size, checksum)
            yield _batch([(i, page, url, kind, first, n, digest, bundle, frame, start, length)
                          for i, page, url, kind, first, n, digest, start, length in parse(raw)], _RECORDS)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, without payloads; frames are dealt over tasks, each read by itself."""
    return frames_of(bundles).repartition("bundle", "frame").mapInArrow(_frame_records, _RECORDS)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple = (None, None)
    raw = b""
    for batch in batches:
        for identifier, bundle, at, size, start, length in zip(*(batch.column(n).to_pylist() for n in (
                "record_id", "bundle", "frame_at", "frame_bytes", "record_at", "record_bytes"))):
            if held != (bundle, at):
                fs, local = opened(bundle)
                with fs.open_input_file(local) as source:
                    held, raw = (bundle, at), read_frame(source, at, size)
            record = raw[start:start + length]
            body = _headers(record, 0)[1]
            yield _batch([(identifier, record[_headers(record, body)[1]:-4])], "record_id string, payload binary")


def read_payloads(entries: DataFrame) -> DataFrame:
    """record_id and payload of index rows, by ranged reads; rows of one frame are read together, a revisit's is empty."""
    return entries.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "record_at") \
        .mapInArrow(_payloads, "record_id string, payload binary")


_SQL = f"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, row_number() OVER same AS nth, first_value(page_id) OVER same AS first_page FROM p
  WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {REVISIT_FROM} OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {REVISIT_FROM} OR nth = 1 THEN NULL ELSE first_page END AS refers_to
FROM f
"""


@query("op11_warc_bundles", _SQL)
def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(table(spark, sf_dir, "pages"), f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
