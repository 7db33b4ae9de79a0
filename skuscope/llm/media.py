"""Media columns: ISO base media containers written, walked and read back without a decoder."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, text_or_empty, written

#: A sample is one 8 x 8 picture of 8-bit red, green and blue.
SIDE, SAMPLE = 8, 192
RATE, KEY_EVERY, SAMPLES_A_CHUNK = 25, 12, 64
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _numbers(values, kind: str = ">u4") -> bytes:
    return np.asarray(values).astype(kind).tobytes()


def padded(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of a sample."""
    return raw + b" " * (max(1, -(-len(raw) // SAMPLE)) * SAMPLE - len(raw))


def to_media(payload: bytes) -> bytes:
    """A movie with one uncompressed video track whose samples are the payload; the same payload gives the same bytes."""
    n = len(payload) // SAMPLE
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    data = _box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    chunks = np.arange(0, n, SAMPLES_A_CHUNK, dtype=np.int64) * SAMPLE + first
    last = n - (len(chunks) - 1) * SAMPLES_A_CHUNK
    runs = [(1, min(n, SAMPLES_A_CHUNK), 1)] + ([(len(chunks), last, 1)] if len(chunks) > 1 and last < SAMPLES_A_CHUNK else [])
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", -(-n // KEY_EVERY)), _numbers(np.arange(1, n + 1, KEY_EVERY))),
        _full(b"stsc", struct.pack(">I", len(runs)), _numbers(runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"stco", struct.pack(">I", len(chunks)), _numbers(chunks)) if chunks[-1] < 1 << 32 else _full(b"co64", struct.pack(">I", len(chunks)), _numbers(chunks, ">u8")),
    )
    reference = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), reference, table),
    )
    track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join((head, data, _box(b"moov", movie, _box(b"trak", track, media))))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, first byte, last byte + 1) of the content of each box, nested boxes after their container.
    What is cut short or has no valid size ends the walk at that level."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


class _Table:
    """A full box's entries of `fields` big-endian integers each; no more than stand in the box."""

    def __init__(self, data: bytes, span: tuple[int, int], kind: str, fields: int, skip: int = 4):
        start = span[0] + skip + 4
        n = struct.unpack_from(">I", data, span[0] + skip)[0] if start <= span[1] else -1
        width = np.dtype(kind).itemsize * fields
        self.ok = 0 <= n and start + n * width <= span[1]
        self.values = np.frombuffer(data, kind, n * fields, start).reshape(-1, fields).astype(np.int64) if self.ok else np.zeros((0, fields), np.int64)


def _tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """Of each track: the first box of each kind."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (a, b))
    return found


def _read_track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict | None:
    if not {b"stsd", b"stts", b"stsc", b"mdhd"} <= set(boxes) or not {b"stco", b"co64"} & set(boxes) or not {b"stsz", b"stz2"} & set(boxes):
        return None
    a, b = boxes[b"stsd"]
    if b - a < 16:
        return None
    codec = data[a + 12 : a + 16].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, a + 40) if boxes.get(b"hdlr") and data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12] == b"vide" and a + 44 <= b else (None, None)
    at, end = boxes[b"mdhd"]
    long_times = end > at and data[at] == 1
    where = at + (20 if long_times else 12)
    scale = struct.unpack_from(">I", data, where)[0] if where + 4 <= end else 0
    spans = _Table(data, boxes[b"stts"], ">u4", 2)
    runs = _Table(data, boxes[b"stsc"], ">u4", 3)
    places = _Table(data, boxes[b"stco"], ">u4", 1) if b"stco" in boxes else _Table(data, boxes[b"co64"], ">u8", 1)
    if not scale or not (spans.ok and runs.ok and places.ok):
        return None
    n = int(spans.values[:, 0].sum())
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        if end - at < 12:
            return None
        size, count = struct.unpack_from(">II", data, at + 4)
        if size:
            if count != n or count * size > len(data):
                return None
            sizes = np.full(count, size, np.int64)
        else:
            table = _Table(data, boxes[b"stsz"], ">u4", 1, skip=8)
            if not table.ok:
                return None
            sizes = table.values[:, 0]
    else:  # compact sizes of 4, 8 or 16 bits
        at, end = boxes[b"stz2"]
        if end - at < 12 or data[at + 7] not in (4, 8, 16):
            return None
        bits, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if at + 12 + -(-count * bits // 8) > end:
            return None
        raw = np.frombuffer(data, np.uint8, -(-count * bits // 8), at + 12)
        sizes = (np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:count] if bits == 4 else raw if bits == 8 else raw.view(">u2")).astype(np.int64)
    chunks = places.values[:, 0]
    first, each = runs.values[:, 0], runs.values[:, 1]
    if len(sizes) != n or n and (not len(first) or first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > len(chunks) or each.max() > n):
        return None
    each = np.repeat(each, np.diff(np.append(first, len(chunks) + 1))) if len(first) else each
    if each.sum() != n:
        return None
    chunk = np.repeat(np.arange(len(each)), each)
    before = np.cumsum(sizes) - sizes
    starts = chunks[chunk] + before - before[np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64)[chunk]] if n else np.zeros(0, np.int64)
    if n and (starts.min() < 0 or (starts + sizes).max() > len(data)):
        return None
    keys = np.arange(n)
    if b"stss" in boxes:
        table = _Table(data, boxes[b"stss"], ">u4", 1)
        keys = table.values[:, 0] - 1
        if not table.ok or len(keys) and (keys.min() < 0 or keys.max() >= n):
            return None
    duration = float((spans.values[:, 0] * spans.values[:, 1]).sum() / scale)
    return {"codec": codec, "width": width, "height": height, "duration": duration, "starts": starts, "ends": starts + sizes, "keys": keys}


def probe(data: bytes | None) -> dict | None:
    """Codec, size (of pictures), duration in seconds, and the byte ranges of the samples, from the sample
    tables alone, of the first video track, else the first track, whose tables are whole and fit the file.

    None where there is none: tables are read track by track, counts are held
    against their boxes, and samples against the file, before anything is
    allocated. Fragments (moof) are not read: a movie that keeps its samples in
    them has none here.
    """
    data = data or b""
    found = [(track, x) for track in _tracks(data) if (x := _read_track(data, track)) is not None]
    pictures = [x for track, x in found if x["width"] is not None]
    return pictures[0] if pictures else found[0][1] if found else None


def samples(data: bytes, found: dict) -> bytes:
    """The samples' bytes in order; samples that touch are read at once."""
    if not len(found["starts"]):
        return b""
    cut = np.flatnonzero(found["starts"][1:] != found["ends"][:-1]) + 1
    begin, stop = found["starts"][np.append(0, cut)], found["ends"][np.append(cut - 1, -1)]
    return b"".join(data[a:b] for a, b in zip(begin.tolist(), stop.tolist()))


_STORED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            raw = [x.encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_media(padded(x)) for x in raw], pa.binary())], schema=_STORED)


def store_as_media(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each whole text, padded, as the samples of a movie: id, n_bytes (unpadded) and media.

    Null texts are empty, which gives one sample of spaces; nulls stay in id;
    repeated rows have a row each; other columns are not read.
    """
    return docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(docs, text_column).alias("text")).mapInArrow(frugal(_store), "id long, n_bytes long, media binary")


_RANGE = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """Adds what the container of `column` says: codec, width, height, duration (seconds),
    n_samples and keyframes (byte ranges), all null where it isn't such a container or is damaged.
    Only boxes and sample tables are read, no sample. Columns of df with these names are replaced."""
    new = {"codec": pa.string(), "width": pa.int32(), "height": pa.int32(), "duration": pa.float64(), "n_samples": pa.int64(), "keyframes": pa.list_(_RANGE)}
    df = df.drop(*(n for n in new if n != column))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                out: dict[str, list] = {n: [] for n in new}
                for data in batch.column(at).to_pylist():
                    found = probe(data)
                    values = [None] * len(new) if found is None else [*(found[n] for n in ("codec", "width", "height", "duration")), len(found["starts"]), [{"start": int(found["starts"][i]), "end": int(found["ends"][i])} for i in found["keys"]]]
                    for n, v in zip(out, values):
                        out[n].append(v)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, new[n]) for n, v in out.items())], names=[*batch.schema.names, *new])

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "codec string", "width int", "height int", "duration double", "n_samples long", "keyframes array<struct<start: bigint, end: bigint>>"]
    return df.mapInArrow(frugal(run), ", ".join(fields))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(row: dict) -> dict:
        data = row["media"]
        payload = samples(data, probe(data))
        keys = [v for r in row["keyframes"] for v in (r["start"], r["end"])]
        feature = f"{row['codec'].strip()} {row['width']}x{row['height']} {row['duration']:.2f}s {row['n_samples']} samples {len(keys) // 2} keyframes {zlib.crc32(_numbers(keys, '>u8')):08x}"
        return {"doc_id": row["id"], "n_bytes": row["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature}

    for batch in batches:
        for k in range(0, len(batch), 512):
            yield pa.RecordBatch.from_pylist([digest(row) for row in batch.slice(k, 512).to_pylist()])


def stored_digests(docs: DataFrame) -> DataFrame:
    """Stores all documents as media in a table, reads that back, and digests what it holds.

    Null and empty texts hold one sample of spaces; texts of any length are
    stored whole; nulls stay in doc_id; repeated rows have a row each; an empty
    table gives an empty result; other columns are not read.
    """
    stored = written(store_as_media(docs), "media")
    return media_columns(stored).mapInArrow(frugal(_digest), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
