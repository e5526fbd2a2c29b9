"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import scratch_folder

from .common import small_batches, stored, table
from .registry import query

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = 1 << 16


class Settings(NamedTuple):
    level: int = 3
    file_bytes: int = 64 << 20  #: compressed bytes after which a task starts its next archive
    sample: int = 400  #: pages behind the dictionary, at most
    sample_chars: int = 8192  #: characters of each of them
    dictionary_bytes: int = 65536
    least_bytes: int = 100  #: shorter payloads are never written as revisits


class Damaged(ValueError):
    """An archive whose frames, headers or lengths do not hold."""


# ---- one archive --------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes, level: int) -> bytes:
    """The skippable frame that carries the (compressed) dictionary; nothing without a dictionary."""
    if not dictionary:
        return b""
    body = zstandard.ZstdCompressor(level=level).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block + END


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names the response and has no payload of its own."""
    name = "" if page_id is None else page_id
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = HTTP_HEAD + b"%d" % len(payload) + END
    if refers_to is None:
        return record(headers, head + payload)
    return record([*headers, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)], head)


def _exactly(stream: BinaryIO, n: int) -> bytes:
    out = b""
    while len(out) < n:
        more = stream.read(n - len(out))
        if not more:
            raise Damaged("the archive ends inside a frame")
        out += more
    return out


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each frame of an archive, one at a time; memory is that of one record and a chunk."""
    rest, dictionary, first = stream.read(8), None, True
    while rest:
        if len(rest) < 8:
            rest += stream.read(8 - len(rest))
        magic = struct.unpack("<I", rest[:4])[0] if len(rest) >= 4 else 0
        if magic in SKIPPABLE:
            if len(rest) < 8:
                raise Damaged("the archive ends inside a frame")
            n = struct.unpack("<I", rest[4:8])[0]
            held = rest[8:]
            body = held[:n] + (_exactly(stream, n - len(held)) if n > len(held) else b"")
            rest = held[n:] or stream.read(CHUNK)
            if first and magic == DICTIONARY_MAGIC:
                plain = zstandard.ZstdDecompressor().decompressobj().decompress(body) if body[:4] == FRAME_MAGIC else body
                dictionary = zstandard.ZstdCompressionDict(plain)
            first = False
            continue
        if rest[:4] != FRAME_MAGIC:
            raise Damaged("no Zstandard frame where one must begin")
        first = False
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts = []
        try:
            while True:
                parts.append(one.decompress(rest))
                if one.eof:
                    rest = one.unused_data or stream.read(CHUNK)
                    break
                rest = stream.read(CHUNK)
                if not rest:
                    raise Damaged("the archive ends inside a frame")
        except zstandard.ZstdError as error:
            raise Damaged(str(error)) from error
        yield b"".join(parts)


class Page(NamedTuple):
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    url: str
    payload: bytes | None


_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length")


def _page_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise Damaged(f"record id {urn!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parse(content: bytes) -> Page:
    """One record, its headers and lengths checked, and its digest where it holds the payload."""
    head, mark, rest = content.partition(END)
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise Damaged("no WARC/1.1 record head")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged(f"header line {line[:60]!r}")
        headers[key.decode().strip().lower()] = value.decode().strip()
    if missing := [k for k in _NEEDED if k not in headers]:
        raise Damaged(f"no {missing[0]} header")
    try:
        length, payload_length = int(headers["content-length"]), int(headers["x-payload-length"])
    except ValueError as error:
        raise Damaged(str(error)) from error
    if len(rest) != length + len(END) or rest[length:] != END:
        raise Damaged(f"block of {len(rest) - len(END)} bytes, {length} announced")
    algorithm, _, digest = headers["warc-payload-digest"].partition(":")
    kind = headers["warc-type"]
    http, mark, payload = rest[:length].partition(END)
    if algorithm != "sha256" or kind not in ("response", "revisit") or not mark or not http.startswith(b"HTTP/"):
        raise Damaged("not a page record")
    refers = None
    if kind == "revisit":
        if "warc-refers-to" not in headers or payload:
            raise Damaged("a revisit needs a response to refer to, and no payload")
        refers = _page_of(headers["warc-refers-to"])
    elif len(payload) != payload_length or hashlib.sha256(payload).hexdigest() != digest:
        raise Damaged("the payload is not the one announced")
    return Page(_page_of(headers["warc-record-id"]), payload_length, digest, kind, refers, headers.get("warc-target-uri", ""), payload if refers is None else None)


# ---- tables -------------------------------------------------------------------------------------


def _train(pages: DataFrame, s: Settings) -> bytes:
    """A dictionary from the pages with the smallest hashes of their ids; none where they are too few."""
    few = pages.where("html IS NOT NULL").select("page_id").orderBy(F.xxhash64(F.lit("dictionary"), "page_id"), "page_id").limit(s.sample)
    ids = [(r.page_id,) for r in few.collect() if r.page_id is not None]
    wanted = F.broadcast(pages.sparkSession.createDataFrame(ids, "page_id long").distinct())  # at most s.sample ids
    rows = pages.join(wanted, "page_id").select(F.substring("html", 1, s.sample_chars).alias("t")).collect()
    try:
        return zstandard.train_dictionary(s.dictionary_bytes, sorted(r.t.encode() for r in rows), level=s.level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in ``folder``; returns their (path, records, bytes).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the
    response and the others revisit it; rows that repeat that id, and rows without an id where no row of
    the group has one, are responses too. A null html is an empty payload. Tasks write files of their own
    names, and the returned list, kept in the shared folder, has only those of tasks that ended well, so a
    repeated task leaves nothing that is read. An empty table gives no archives.
    """
    spark, s = pages.sparkSession, settings
    small_batches(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    light = stored(pages.select("page_id", F.octet_length(html).alias("n"), F.sha2(html.cast("binary"), 256).alias("digest")), "warc-digests")
    groups = light.where(F.col("n") >= s.least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    groups = groups.where("copies > 1 AND first IS NOT NULL").select("digest", "first")
    whole = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    whole = whole.join(stored(groups, "warc-groups"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    whole = whole.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    dictionary = _train(pages, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=s.level, dict_data=data, write_checksum=True)
        sink, done, held = None, [], [None, 0, 0]

        def close() -> None:
            sink.close()
            done.append(tuple(held))

        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    sink, held = store.open_output_stream(f"{root}/{name}", compression=None), [f"{folder}/{name}", 0, 0]
                    held[2] += sink.write(dictionary_frame(dictionary, s.level)) or 0
                frame = packer.compress(page_record(page_id, url, text.encode("utf-8", "surrogatepass"), digest, refers_to))
                sink.write(frame)
                held[1] += 1
                held[2] += len(frame)
                if held[2] >= s.file_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return stored(whole.mapInArrow(run, "path string, records long, bytes long"), "warc-list")


PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The pages of ``archives(path, records)``: each archive is one task's stream, a record at a time.

    Frames, headers, lengths and payload digests are checked, and so is the number of records where it is
    not null; ``Damaged`` ends the job. Revisits have no payload of their own. Order is not kept.
    """
    small_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                rows, size, n = [], 0, 0
                with store.open_input_stream(at, compression=None) as stream:
                    for content in frames(stream):
                        page = parse(content)
                        rows.append(page if with_payload else page._replace(payload=None))
                        n += 1
                        size += len(content) if with_payload else 0
                        if len(rows) >= 4096 or size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if records is not None and n != records:
                    raise Damaged(f"{n} records, {records} announced: {path}")
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[Page]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=PAGE_SCHEMA.names)

    # As many ranges of paths as archives: a given number of partitions is not merged again, however short
    # the list is, and ranges of so few rows are exact.
    listed = archives.select("path", "records")
    return listed.repartitionByRange(max(1, listed.count()), "path").mapInArrow(run, PAGE_SCHEMA)


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


@query("op3_warc_round_trip", SQL)
def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive record says after a round trip through archives in the shared folder."""
    archives = write_archives(table(spark, sf_dir, "pages"), scratch_folder(spark, "warc"))
    return read_archives(archives, with_payload=False).drop("url", "payload")
