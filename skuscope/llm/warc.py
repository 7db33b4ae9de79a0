"""WARC archives: written as one gzip stream, normalised to a member a record with an offset index, read back.

Archives are files in a folder that all executors reach (any file system that
pyarrow opens by URI). A task writes under a temporary name and renames, so a
repeated task leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, shuffle_width, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit (HTTP headers only) if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(raw: bytes) -> dict:
    """Headers of a record and of its HTTP message, and the payload (of a revisit: empty)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    own = headers(head)
    http, _, payload = rest[: int(own["content-length"])].partition(b"\r\n\r\n")
    return {"warc": own, "http": headers(http), "payload": payload}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of inflated bytes; holds one record and one chunk."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"the archive ends within a record: {len(held)} bytes are left")


def inflated(source, size: int = _CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, at most a chunk at a time, however well they
    were compressed; a file that ends within a member raises."""
    engine, within = zlib.decompressobj(31), False
    while raw := source.read(size):
        while raw:
            if out := engine.decompress(raw, size):
                yield out
            within, raw = not engine.eof, engine.unused_data if engine.eof else engine.unconsumed_tail
            if engine.eof:
                engine = zlib.decompressobj(31)
    if within:
        raise ValueError("the archive ends within a gzip member")


def _moved(fs, source: str, target: str) -> None:
    """Renames; a file that an earlier attempt of the task has put there goes first."""
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        fs.delete_file(target)
    fs.move(source, target)


def _gzip(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def _write_whole(folder: str, level: int, most: int):
    """Each task's records in archives of one gzip stream each, of about `most` bytes before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task, number, size, out, engine, temporary, n = TaskContext.get().partitionId(), 0, 0, None, None, "", 0
        done = []

        def close():
            out.write(engine.flush())
            out.close()
            final = f"{root}/whole-{task:06d}-{number:04d}.warc.gz"
            _moved(fs, temporary, final)
            done.append((final.rpartition("/")[2], n))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    out, engine, size, n = fs.open_output_stream(temporary, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                raw = record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["refers_to"])
                out.write(engine.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= most:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["archive", "records"])

    return run


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])


def normalised(folder: str, archive: str, level: int) -> list[dict]:
    """Rewrites one archive: inflates its stream once, gives each record a gzip
    member of its own, and writes the offset index beside it (a JSON line a record)."""
    fs, root = pafs.FileSystem.from_uri(folder)
    name = archive.replace("whole-", "records-")
    temporary = [f"{root}/.{uuid.uuid4().hex}" for _ in range(2)]
    rows, offset = [], 0
    with fs.open_input_stream(f"{root}/{archive}", compression=None) as source, fs.open_output_stream(temporary[0], compression=None) as out:
        for raw in split_records(inflated(source)):
            member = _gzip(raw, level)
            out.write(member)
            rows.append({"archive": name, "offset": offset, "length": len(member), "record_id": headers(raw.partition(b"\r\n\r\n")[0])["warc-record-id"]})
            offset += len(member)
    with fs.open_output_stream(temporary[1], compression=None) as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    _moved(fs, temporary[0], f"{root}/{name}")
    _moved(fs, temporary[1], f"{root}/{name}.index")
    return rows


def _normalise(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(normalised(folder, archive, level), _INDEX)

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    name, source = row["archive"], fs.open_input_file(f"{root}/{row['archive']}")
                got = parse(zlib.decompress(source.read_at(row["length"], row["offset"]), 31))
                page, refers = (None if x is None or x == "<urn:page:none>" else int(x[10:-1]) for x in (got["warc"]["warc-record-id"], got["warc"].get("warc-refers-to")))
                out.append({"page_id": page, "url": got["warc"]["warc-target-uri"], "payload": got["payload"], "payload_bytes": int(got["http"]["content-length"]), "payload_digest": got["warc"]["warc-payload-digest"].removeprefix("sha1:"), "record_type": got["warc"]["warc-type"], "refers_to": refers})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return run


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers_to: of equal payloads of at least
    least_bytes, all but that with the largest page_id refer to it. Only digests
    that occur more than once are joined back: broadcast up to a million of
    them, by a shuffle beyond."""
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    known = pages.filter(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = written(known, "digests")
    joined = pages.join(F.broadcast(repeated) if repeated.count() <= 1_000_000 else repeated, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("kept"), F.col("kept")).alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0, level: int = 4, most: int = 256 << 20) -> DataFrame:
    """Writes a record for each page, normalises the archives and returns their index:
    archive, offset, length, record_id. The folder has whole-*.warc.gz, records-*.warc.gz
    and records-*.warc.gz.index.

    Null html is the empty payload; a null page_id is always a response and never
    referred to; pages of equal id and payload are all responses if the largest; a
    null url is written as urn:unknown; an empty table gives no archive; other
    columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    pages = with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")), least_bytes)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    whole = written(pages.mapInArrow(_write_whole(folder, 1, most), "archive string, records long"), "archives")
    width = max(1, min(whole.count(), 4 * shuffle_width(spark)))
    index = whole.repartition(width).mapInArrow(_normalise(folder, level), "archive string, offset long, length long, record_id string")
    return written(index, "index").withColumn("folder", F.lit(folder))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Reads the records of an index by their offsets: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.select("archive", "offset", "length").mapInArrow(_read(folder), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(archive_pages(pages, folder), folder)


ORACLE_OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY sha1(b)) AS kept FROM p),
bits AS (SELECT *, list_transform(generate_series(0, 31), lambda i: (CAST('0x' || substr(hex || '0', CAST((i * 5) // 4 + 1 AS INT), 2) AS INT) >> CAST(8 - 5 - (i * 5) % 4 AS INT)) & 31) AS v FROM d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to
FROM bits
"""
