"""Bounded-space online packing: a fixed number of open windows a task, best fit, leftovers merged at the end."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _Ids, token_ids
from .shared import frugal, text_or_empty, written

_ROUND, _GROUP = 58, 31  # a sequence's id: the merging round, then the task or group, then its number there


class OpenWindows:
    """At most `most` open windows of `capacity` places.

    What comes goes into the open window with the least room that holds it,
    else into a new window if fewer than `most` are open, else its first part
    fills the fullest window, which is closed, and the rest comes again.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.made = capacity, most, 0
        self.rooms: list[tuple[int, int]] = []  # room and number of the open windows, the fullest first

    def place(self, length: int) -> list[tuple[int, int, int]]:
        """(window, offset, length) of the parts; a window is closed when it is full."""
        parts = []
        while length:
            at = bisect_left(self.rooms, (length, -1)) if length < self.capacity else len(self.rooms)
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
            elif len(self.rooms) < self.most or length >= self.capacity:
                room, window = self.capacity, self.made
                self.made += 1
            else:
                room, window = self.rooms.pop(0)
            part = min(length, room)
            parts.append((window, self.capacity - room, part))
            if part < room:
                insort(self.rooms, (room - part, window))
            length -= part
        return parts


_PIECE = pa.schema([("open", pa.bool_()), ("task", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECE_DDL = "open boolean, task long, window long, id long, start long, length long, doc_tokens long, offset long, ids binary"


def _packed(path: str, capacity: int, most: int, end_id: int, rows: int = 2000, most_bytes: int = 8 << 20):
    """Token ids of each document, then end_id, placed as they come. A window's pieces go out when it is closed;
    those of the windows that are open at the end of the task are marked."""

    def batch_of(windows: list[tuple[bool, int, list]], task: int) -> pa.RecordBatch:
        listed = [(is_open, task, window, *piece) for is_open, window, pieces in windows for piece in pieces]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*listed), _PIECE)], schema=_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, windows = _Ids(path), TaskContext.get().partitionId(), OpenWindows(capacity, most)
        end = array("I", [end_id]).tobytes()
        held: dict[int, list] = {}  # pieces of the open windows
        done: list[tuple[bool, int, list]] = []
        size = 0
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                everything, begin = token_ids(batch.column(1), known)
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    ids = everything[4 * begin[k] : 4 * begin[k + 1]] + end
                    tokens, start = len(ids) // 4, 0
                    for window, offset, length in windows.place(tokens):
                        held.setdefault(window, []).append((doc_id, start, length, tokens, offset, ids[4 * start : 4 * (start + length)]))
                        start += length
                        if offset + length == capacity:
                            done.append((False, window, held.pop(window)))
                            size += 4 * capacity
                            if size >= most_bytes:
                                yield batch_of(done, task)
                                done, size = [], 0
        done += [(True, window, pieces) for window, pieces in held.items()]
        if done:
            yield batch_of(done, task)

    return run


_SEGMENT = "task long, window long, start long, length long, offset long"
_MERGED = f"round int, group long, window long, open boolean, segments array<struct<{_SEGMENT.replace(' long', ':long')}>>"


def merged(windows: list[list[dict]], capacity: int, most: int, last: bool) -> list[tuple[bool, list[dict]]]:
    """Packs open windows, each a list of segments, into windows again, the fullest first: (open, segments) of each.

    In the last round what is still open is poured into one window after the
    other, and the rest is cut by its binary digits, as a sequence of a power
    of two needs no padding.
    """

    def poured(contents: list[list[dict]], packer: OpenWindows) -> list[list[dict]]:
        out: dict[int, list[dict]] = {}
        for segments in sorted(contents, key=lambda x: (-sum(s["length"] for s in x), x[0]["task"], x[0]["window"], x[0]["start"])):
            for window, offset, length in packer.place(sum(s["length"] for s in segments)):
                first, segments = _cut(segments, length)
                for s in first:
                    out.setdefault(window, []).append({**s, "offset": offset})
                    offset += s["length"]
        return list(out.values())

    size = lambda x: sum(s["length"] for s in x)
    found = poured(windows, OpenWindows(capacity, most))
    full, rest = [x for x in found if size(x) == capacity], [x for x in found if size(x) < capacity]
    if not last:
        return [(False, x) for x in full] + [(True, x) for x in rest]
    for x in poured(rest, OpenWindows(capacity, 1)):
        while size(x) < capacity and x:
            first, x = _cut(x, 1 << (size(x).bit_length() - 1))
            full += poured([first], OpenWindows(capacity, 1))
        full += [x] if x else []
    return [(False, x) for x in full]


def _cut(segments: list[dict], length: int) -> tuple[list[dict], list[dict]]:
    """The first `length` places of segments, and the rest."""
    first, at = [], 0
    while length:
        s = segments[at]
        if s["length"] > length:
            return [*first, {**s, "length": length}], [{**s, "start": s["start"] + length, "length": s["length"] - length}, *segments[at + 1 :]]
        first.append(s)
        length -= s["length"]
        at += 1
    return first, segments[at:]


def _merge(capacity: int, most: int, number: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        found = merged(table.column("segments").to_pylist(), capacity, most, last)
        out = [{"round": number, "group": group, "window": k, "open": is_open, "segments": x} for k, (is_open, x) in enumerate(found)]
        return pa.Table.from_pylist(out, _MERGED_ARROW)

    return run


_MERGED_ARROW = pa.schema([("round", pa.int32()), ("group", pa.int64()), ("window", pa.int64()), ("open", pa.bool_()), ("segments", pa.list_(pa.struct([(n, pa.int64()) for n in ("task", "window", "start", "length", "offset")])))])


def pack_online(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096, end_id: int = 2, open_windows: int = 32, fan: int = 64) -> DataFrame:
    """Packs documents in one pass into sequences of `capacity` tokens.

    1. Each task tokenizes its documents, adds end_id to each and places them
       as they come: `open_windows` windows are open at most, best fit first; if
       none fits, the fullest is filled with the document's first tokens and
       goes out, so only these documents and those longer than a window are cut.
       Windows that went out are final: their token ids are written once and
       never shuffled.
    2. What is open at the end of the tasks, `open_windows` a task at most, is
       merged as lists of segments in rounds, `fan` tasks a group and then `fan`
       groups, by the same rule; the last round, which has at most fan *
       open_windows windows, pours the rest together. What then is less than
       a sequence becomes sequences of powers of two.
    3. The pieces of these windows alone are joined with their segments.

    So no sequence has padding. Null or empty texts give the one token end_id;
    repeated rows are packed each; null ids stay; texts of any length are cut
    at windows; an empty table gives an empty result; other columns are not
    read.

    Returns id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset.
    """
    pieces = written(docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(docs, text_column).alias("text")).mapInArrow(frugal(_packed(path, capacity, open_windows, end_id)), _PIECE_DDL), "pieces")
    out = [F.col("id").alias(id_column), "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    final = pieces.filter(~F.col("open")).withColumn("sequence_id", F.shiftleft("task", _GROUP) + F.col("window"))
    left = pieces.filter("open")
    windows = left.groupBy("task", "window").agg(F.sum("length").alias("length"))
    waiting = windows.select(F.col("task").alias("group"), F.array(F.struct("task", "window", F.lit(0).cast("long").alias("start"), "length", F.lit(0).cast("long").alias("offset"))).alias("segments"))
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    closed = None
    number = 0
    while True:
        number, tasks = number + 1, -(-tasks // fan)
        grouped = waiting.withColumn("group", F.floor(F.col("group") / fan).cast("long"))
        found = written(grouped.groupBy("group").applyInArrow(_merge(capacity, open_windows, number, tasks == 1), _MERGED), "merged")
        full = found.filter(~F.col("open"))
        closed = full if closed is None else closed.unionByName(full)
        if tasks == 1:
            break
        waiting = found.filter("open").select("group", "segments")
    sequence = F.shiftleft(F.col("round").cast("long"), _ROUND) + F.shiftleft("group", _GROUP) + F.col("window")
    placed = closed.select(sequence.alias("sequence_id"), F.explode("segments").alias("s")).select("sequence_id", "s.task", "s.window", F.col("s.start").alias("s_start"), (F.col("s.start") + F.col("s.length")).alias("s_end"), F.col("s.offset").alias("s_offset"))
    begin, end = F.greatest("offset", "s_start"), F.least(F.col("offset") + F.col("length"), F.col("s_end"))
    parts = left.join(placed, ["task", "window"]).withColumn("begin", begin).withColumn("end", end).filter("begin < end")
    parts = parts.select(
        "id", (F.col("start") + F.col("begin") - F.col("offset")).alias("start"), (F.col("end") - F.col("begin")).alias("length"), F.expr("substring(ids, cast(4 * (begin - offset) + 1 as int), cast(4 * (end - begin) as int))").alias("ids"),
        "doc_tokens", "sequence_id", (F.col("s_offset") + F.col("begin") - F.col("s_start")).alias("offset"),
    )
    return final.select(out).unionByName(parts.select(out))
