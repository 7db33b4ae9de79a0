"""Removal of repeated byte strings across documents, by suffix sorting of sharded windows.

1. A document's windows of `length` bytes are cut into stretches whose least
   hashed k-gram (minimizer) is the same. Equal windows have equal minimizers,
   so all copies of a window meet at its minimizer.
   (Exact copies of a smaller document go whole and take no further part.)
2. Stretches whose minimizer occurs in one document only can't repeat; the
   others' bytes go to the shard of their minimizer.
3. A shard sorts the suffixes of its distinct stretches by external induced
   sorting (`suffixes`), and marks each window that stands in a group of equal
   ones with a smaller document. Oversized places are cut finer and dealt again.
4. Each document removes what its marked windows cover.

Hot passages stay bounded: a task sends a minimizer, and later a stretch, once
for all its documents. Arrays travel as packed columns of many rows; Spark
partitions and shuffles them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frugal, shuffle_width, text_or_empty, written
from .suffixes import sorted_blocks

LENGTH = 50
GRAM = 20
_BATCH_BYTES = 4 << 20
SHARDS_A_PLACE = 4  # shards that travel together; a task sorts them one by one
FINER_GRAMS = (35, LENGTH)  # by which oversized places are cut
MEMORY = 512 << 20
_BLOB_DDL = "place int, cols binary"
_BLOB = pa.schema([("place", pa.int32()), ("cols", pa.binary())])

#: rid: of a document's row; doc: its id; start, count: a stretch of windows.
ANCHOR = (("h", "<u4"), ("rid", "<i8"), ("start", "<u4"), ("count", "u1"), ("known", "u1"))
STRETCH = (("h", "<u4"), ("rid", "<i8"), ("start", "<u4"), ("count", "<u4"))
FRAGMENT = (("h", "<u4"), ("rid", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("count", "<u4"), ("size", "<u4"))


def pack(fields, columns: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    n = len(columns[fields[0][0]])
    return b"".join([n.to_bytes(8, "little"), *(np.ascontiguousarray(columns[k], dtype=t).tobytes() for k, t in fields), tail])


def unpack(fields, raw: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    n, at = int.from_bytes(raw[:8], "little"), 8
    columns = {}
    for k, t in fields:
        columns[k] = np.frombuffer(raw, t, n, at)
        at += columns[k].nbytes
    return columns, raw[at:]


def joined(fields, raws: Iterable[bytes]) -> dict[str, np.ndarray]:
    parts = [unpack(fields, x)[0] for x in raws]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in fields}


def by_place(fields, columns: dict[str, np.ndarray], place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each place, packed."""
    order = np.argsort(place, kind="stable")
    found, cuts = np.unique(place[order], return_index=True)
    for p, at in zip(found.tolist(), np.split(order, cuts[1:])):
        yield p, pack(fields, {k: v[at] for k, v in columns.items()})


def _rows(found: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    places, cols, size = [], [], 0
    for p, c in found:
        places.append(p)
        cols.append(c)
        size += len(c)
        if size > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(cols, pa.binary())], schema=_BLOB)
            places, cols, size = [], [], 0
    if places:
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(cols, pa.binary())], schema=_BLOB)


def stretches(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that stand one after the other in raw, up to `ends`: minimizer, first window and
    number of windows of each stretch. Windows don't cross documents."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base, code, size = 0x9E3779B97F4A7C15, raw.astype(np.uint64), 1
    single, power = code, base
    for bit in bin(gram)[3:]:
        code, size = code[: n - 2 * size + 1] * np.uint64(power) + code[size:], 2 * size
        power = power * power % (1 << 64)
        if bit == "1":
            code, size = code[: n - size] * np.uint64(base) + single[size:], size + 1
            power = power * base % (1 << 64)
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    least, span, width = code, 1, length - gram + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    edge = np.zeros(n + 2, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    np.add.at(edge, np.maximum(starts, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[: len(least)]) == 0
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(change)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | change[1:]
    return least[first], first, np.flatnonzero(last) + 1 - first


def _batches(batches: Iterator[pa.RecordBatch], most: int = _BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    rids, docs, texts, size = [], [], [], 0
    for batch in batches:
        for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            rids.append(rid)
            docs.append(doc)
            texts.append(raw)
            size += len(raw)
            if size >= most:
                yield np.array(rids, np.int64), np.array(docs, np.int64), texts
                rids, docs, texts, size = [], [], [], 0
    if texts:
        yield np.array(rids, np.int64), np.array(docs, np.int64), texts


def _anchors(buckets: int, places: int):
    """Sends each stretch's minimizer to its bucket; those seen in two documents of this batch
    go to their documents at once (place -1 - p), and one of them to the bucket, marked known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, docs, texts in _batches(batches):
            ends = np.cumsum([len(x) for x in texts])
            h, first, count = stretches(np.frombuffer(b"".join(texts), np.uint8), ends)
            owner = np.searchsorted(ends, first, side="right")
            start = first - (ends - np.array([len(x) for x in texts]))[owner]
            pieces = -(-count // 255)  # a count is one byte
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            h, owner, start = (np.repeat(x, pieces) for x in (h, owner, start))
            start, count = start + 255 * nth, np.minimum(np.repeat(count, pieces) - 255 * nth, 255)
            columns = {"h": (h // np.uint64(buckets)).astype(np.uint32), "rid": rids[owner], "start": start, "count": count}
            order = np.lexsort((docs[owner], h))
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            doc = docs[owner][order]
            last = np.concatenate([at[1:], [len(h)]]) - 1 if len(h) else at
            several = doc[at] != doc[last]
            known = np.zeros(len(h), bool)
            known[order] = several[group] if len(h) else known
            sent = ~known
            sent[order[at[several]]] = True
            columns["known"] = known
            here = {k: v[known] for k, v in columns.items() if k in dict(STRETCH)}
            here["h"] = (h[known] % np.uint64(buckets)).astype(np.uint32)
            yield from _rows((-1 - p, raw) for p, raw in by_place(STRETCH, here, here["rid"] % places))
            yield from _rows(by_place(ANCHOR, {k: v[sent] for k, v in columns.items()}, (h[sent] % np.uint64(buckets)).astype(np.int64)))

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of each place; they come sorted by it."""
    place, held = None, []
    for batch in batches:
        for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != place and held:
                yield place, held
                held = []
            place = p
            held.append(raw)
    if held:
        yield place, held


class _Held:
    """Columns of STRETCH that wait to be sent together; they go when they have `most` bytes, however many places a task has."""

    def __init__(self, most: int = 64 << 20):
        self.most, self.size, self.parts = most, 0, []

    def add(self, columns: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        self.parts.append(columns)
        self.size += sum(x.nbytes for x in columns.values())
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[dict[str, np.ndarray]]:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            yield {k: np.concatenate([x[k] for x in parts]) for k, _ in STRETCH}


def _shared(places: int):
    """Passes on the stretches whose minimizer is in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Held()
        for place, raws in _grouped(batches):
            if place < 0:
                yield from _rows([(-1 - place, pack(STRETCH, joined(STRETCH, raws)))])
                continue
            columns = joined(ANCHOR, raws)
            order = np.argsort(columns["h"], kind="stable")
            h, rid = columns["h"][order], columns["rid"][order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = (np.minimum.reduceat(rid, at) != np.maximum.reduceat(rid, at)) | (np.maximum.reduceat(columns["known"][order], at) > 0)
            mask = np.zeros(len(h), bool)
            mask[order] = np.repeat(several, np.diff(np.append(at, len(h))))
            mask &= columns["known"] == 0  # the known ones have been passed on
            found = {k: columns[k][mask] for k, _ in STRETCH}
            found["h"] = np.full(mask.sum(), place, np.uint32)
            for whole in kept.add(found):
                yield from _rows(by_place(STRETCH, whole, whole["rid"] % places))
        for whole in kept.rest():
            yield from _rows(by_place(STRETCH, whole, whole["rid"] % places))

    return run


def _stretch_texts():
    """In the group that has some documents and their shared stretches: sends each distinct stretch once to
    its shard, with the smallest document; larger documents' copies are marked at once (place -1 - p)."""

    def run(key, left, right):
        where = key[0].as_py()
        texts = {r: (d, t) for r, d, t in zip(*(left.column(n).to_pylist() for n in ("rid", "doc", "text")))}
        columns = joined(STRETCH, right.column("cols").to_pylist())
        order = np.lexsort((columns["start"], columns["rid"]))
        best: dict[bytes, tuple] = {}
        more, marked = [], []
        raw_of, raw, doc = None, b"", 0
        for h, rid, start, count in zip(*(columns[k][order].tolist() for k, _ in STRETCH)):
            if rid != raw_of:
                raw_of, (doc, text) = rid, texts[rid]
                raw = text.encode("utf-8", "surrogatepass")
            part = raw[start : start + count - 1 + LENGTH]
            held = best.get(part)
            own = (doc, rid, start, count, h)
            if held is None:
                best[part] = own
            elif held[0] < doc:
                marked.append(own)
            elif held[0] > doc:
                best[part] = own
                marked.append(held)
            elif held[1] == rid:
                more.append((own, part))  # again in the same document
            else:
                more.append((own, part))
        everything = [*((v, k) for k, v in best.items()), *more]
        shard: dict[int, list] = {}
        for own, part in everything:
            shard.setdefault(own[4] // SHARDS_A_PLACE, []).append((own, part))
        out_places, out = [], []
        for place, found in shard.items():
            cols = {"h": [o[4] for o, _ in found], "doc": [o[0] for o, _ in found], "rid": [o[1] for o, _ in found], "start": [o[2] for o, _ in found], "count": [o[3] for o, _ in found], "size": [len(p) for _, p in found]}
            out_places.append(place)
            out.append(pack(FRAGMENT, {k: np.array(v) for k, v in cols.items()}, b"".join(p for _, p in found)))
        if marked:
            cols = {"h": [0] * len(marked), "rid": [m[1] for m in marked], "start": [m[2] for m in marked], "count": [m[3] for m in marked]}
            out_places.append(-1 - where)
            out.append(pack(STRETCH, {k: np.array(v) for k, v in cols.items()}))
        return pa.table({"place": pa.array(out_places, pa.int32()), "cols": pa.array(out, pa.binary())})

    return run


def repeated_windows(fragments: list[bytes], docs: np.ndarray, counts: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> np.ndarray:
    """Of the windows at the first counts[i] places of each fragment, one after the other: which ones
    equal a window of a fragment with a smaller document. Suffixes come in order, block by block; those with
    a common prefix of `length` are one group, of which only the one that is still open is held."""
    ends = np.cumsum([len(x) for x in fragments], dtype=np.int64)
    start_of = ends - np.array([len(x) for x in fragments], np.int64)
    found = np.zeros(ends[-1] if len(ends) else 0, bool)
    held, held_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(suffixes: np.ndarray, doc: np.ndarray, group: np.ndarray) -> None:
        if len(suffixes):
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(doc))))
            found[suffixes[doc > least]] = True

    for suffixes, common in sorted_blocks(np.frombuffer(b"".join(fragments), np.uint8), length, memory):
        owner = np.searchsorted(ends, suffixes, side="right")
        window = suffixes - start_of[owner] < counts[owner]
        # A suffix that is no window may stand between two equal ones: the least common prefix carries over.
        group = np.cumsum(common < length)
        suffixes, doc = np.concatenate([held, suffixes[window]]), np.concatenate([held_docs, docs[owner[window]]])
        closed = np.concatenate([np.zeros(len(held), np.int64), group[window]])
        still = closed == group[-1]
        settle(suffixes[~still], doc[~still], closed[~still])
        held, held_docs = suffixes[still], doc[still]
    settle(held, held_docs, np.zeros(len(held), np.int64))
    is_window = np.zeros(len(found) + 1, np.int64)
    np.add.at(is_window, start_of, 1)
    np.add.at(is_window, start_of + counts, -1)
    return found[np.cumsum(is_window[:-1]) > 0]


def compared(fragments: list[bytes], gram: int) -> np.ndarray:
    """Which fragments have a minimizer that another one has too: only these can have a window in common."""
    ends = np.cumsum([len(x) for x in fragments], dtype=np.int64)
    h, first, _ = stretches(np.frombuffer(b"".join(fragments), np.uint8), ends, LENGTH, gram)
    owner = np.searchsorted(ends, first, side="right")
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at) if len(at) else new
    found = np.zeros(len(fragments), bool)
    found[owner[np.repeat(several, np.diff(np.append(at, len(h))))]] = True
    return found


def _finer(raw: bytes, gram: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The fragments of an oversized place by the minimizers of a longer gram: equal windows meet there as well."""
    columns, tail = unpack(FRAGMENT, raw)
    ends = np.cumsum(columns["size"].astype(np.int64))
    text = np.frombuffer(tail, np.uint8)
    h, first, count = stretches(text, ends, LENGTH, gram)
    owner = np.searchsorted(ends, first, side="right")
    inside = first - (ends - columns["size"])[owner]
    count = np.minimum(count, columns["count"][owner].astype(np.int64) - inside)
    keep = count > 0
    h, first, count, owner, inside = h[keep], first[keep], count[keep], owner[keep], inside[keep]
    shard = (h % np.uint64(buckets)).astype(np.int64)
    for k in np.unique(shard).tolist():
        at = np.flatnonzero(shard == k)
        cols = {"h": shard[at], "rid": columns["rid"][owner[at]], "doc": columns["doc"][owner[at]], "start": columns["start"][owner[at]] + inside[at], "count": count[at], "size": count[at] - 1 + LENGTH}
        yield k // SHARDS_A_PLACE, pack(FRAGMENT, cols, b"".join(tail[x : x + n] for x, n in zip(first[at].tolist(), cols["size"].tolist())))


def _sorted_shards(places: int, memory: int, most: int, own_gram: int, gram: int | None, buckets: int):
    """Marks the windows of a shard's stretches that repeat one of a smaller document. Stretches whose minimizers, of
    GRAM bytes and of 35, no other text has (passages that are the same wherever they stand) need no sorting. A place with over `most`
    bytes is not sorted (unless gram is None) but sent on, cut finer by a longer gram; of it no more than `most` is held."""

    def shards(raws: list[bytes]) -> Iterator[list[tuple[tuple, bytes]]]:
        parts = [unpack(FRAGMENT, raw) for raw in raws]
        for h in np.unique(np.concatenate([c["h"] for c, _ in parts])).tolist():
            found = []
            for columns, tail in parts:
                at = np.flatnonzero(columns["h"] == h)
                first = np.cumsum(columns["size"].astype(np.int64)) - columns["size"]
                for doc, rid, start, count, size, begin in zip(*(columns[k][at].tolist() for k in ("doc", "rid", "start", "count", "size")), first[at].tolist()):
                    found.append(((doc, rid, start, count), tail[begin : begin + size]))
            yield found

    def marks(members: list[tuple[tuple, bytes]]) -> dict[str, np.ndarray]:
        best: dict[bytes, tuple] = {}
        more, marked = [], []
        for own, part in members:
            held = best.get(part)
            if held is None:
                best[part] = own
            elif held[0] < own[0]:
                marked.append(own)
            elif held[0] > own[0]:
                best[part] = own
                marked.append(held)
            else:
                more.append((own, part))  # equal ids don't count against each other
        fragments = list(best)
        info = np.array([best[x] for x in fragments], np.int64)
        some = compared(fragments, own_gram)
        if own_gram < FINER_GRAMS[0] and some.any():  # of these, those that have a longer gram in common as well
            some[some] = compared([x for x, ok in zip(fragments, some) if ok], FINER_GRAMS[0])
        flags = np.zeros(info[:, 3].sum(), bool)
        if some.any():
            flags[np.repeat(some, info[:, 3])] = repeated_windows([x for x, ok in zip(fragments, some) if ok], info[some, 0], info[some, 3], memory=memory)
        first = np.cumsum(info[:, 3]) - info[:, 3]
        place_of = {x: k for k, x in enumerate(fragments)} if more else {}
        rids, starts, counts = [[m[1] for m in marked]], [[m[2] for m in marked]], [[m[3] for m in marked]]
        edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            k = int(np.searchsorted(first, a, side="right")) - 1
            while a < b:  # a run of windows may go on in the next stretch
                stop = min(b, int(first[k] + info[k, 3]))
                rids.append([info[k, 1]])
                starts.append([info[k, 2] + a - first[k]])
                counts.append([stop - a])
                a, k = stop, k + 1
        for own, part in more:
            k = place_of[part]
            hit = np.arange(own[3]) if best[part][0] < own[0] else np.flatnonzero(flags[first[k] : first[k] + info[k, 3]])
            rids.append([own[1]] * len(hit))
            starts.append(own[2] + hit)
            counts.append([1] * len(hit))
        return {n: np.concatenate([np.array(x, np.int64) for x in v]) for n, v in (("rid", rids), ("start", starts), ("count", counts))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Held()
        held: list[bytes] = []
        size, place, over = 0, None, False

        def sent(whole: dict) -> Iterator[pa.RecordBatch]:
            return _rows((-1 - p, raw) for p, raw in by_place(STRETCH, whole, whole["rid"] % places))

        def sort() -> Iterator[pa.RecordBatch]:
            if held and not over:
                for members in shards(held):
                    columns = marks(members)
                    for whole in found.add({**columns, "h": np.zeros(len(columns["rid"]), np.uint32)}):
                        yield from sent(whole)
            held.clear()

        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p < 0:
                    yield from _rows([(p, raw)])
                    continue
                if p != place:
                    yield from sort()
                    place, size, over = p, 0, False
                held.append(raw)
                size += len(raw)
                if size > most and gram is not None:
                    over = True
                    for x in held:
                        yield from _rows(_finer(x, gram, buckets))
                    held.clear()
        yield from sort()
        for whole in found.rest():
            yield from sent(whole)

    return run


def _removed(with_text: bool):
    """In the group that has some documents and their marked windows: what is left of each document."""

    def run(key, left, right):
        columns = joined(STRETCH, right.column("cols").to_pylist())
        order = np.lexsort((columns["start"], columns["rid"]))
        rid = columns["rid"][order]
        start = columns["start"][order].astype(np.int64)
        end = start + columns["count"][order].astype(np.int64) - 1 + LENGTH
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for own, doc, text, copy in zip(*(left.column(n).to_pylist() for n in ("rid", "doc", "text", "copy"))):
            raw = text.encode("utf-8", "surrogatepass")
            a, b = np.searchsorted(rid, [own, own + 1]) if doc is not None else (0, 0)
            spans = []
            if copy:
                spans = [(0, len(raw))] if len(raw) >= LENGTH else []
            elif a < b:
                s, e = start[a:b], np.maximum.accumulate(end[a:b])
                heads = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                spans = list(zip(s[heads].tolist(), e[np.append(heads[1:], len(s)) - 1].tolist()))
            edges = [0, *(x for span in spans for x in span), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            values = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans], kept.decode("utf-8", "ignore") if with_text else None)
            for n, v in zip(out, values):
                out[n].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        return pa.table({"row": left.column("row"), **{n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)}})

    return run


def with_copies(rows: DataFrame) -> DataFrame:
    """Marks rows(doc, text) whose text a smaller doc has too (by its SHA-256). All windows of such a
    copy are the smaller document's, and what repeats it repeats that, so copies need no sorting.

    The digests that occur more than once are broadcast up to a million of them, and joined by a shuffle beyond.
    """
    rows = rows.withColumn("sha", F.sha2("text", 256))
    several = rows.filter("doc is not null").groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("sha", "least")
    several = written(several, "copies")
    joined = rows.join(F.broadcast(several) if several.count() <= 1_000_000 else several, "sha", "left")
    return joined.withColumn("copy", F.coalesce(F.col("doc") > F.col("least"), F.lit(False))).drop("sha", "least")


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), with_text: bool = False, memory: int = MEMORY, shard_bytes: int = 2 << 20, most: int = 32 << 20) -> DataFrame:
    """Removes each byte covered by a 50-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; matches never cross documents; strings are judged on
    the input. Rows with equal ids don't count against each other. Null texts
    are empty; rows with a null id stay whole and remove nothing; texts under
    50 bytes stay whole; repeated rows have a row each; an empty table gives an
    empty result; columns other than the two and those in `carry` are not read.

    There are as many shards and groups of documents as the texts' bytes need.
    Where a place (SHARDS_A_PLACE shards) has over `most` bytes all the same,
    for one frequent 20-byte string, its stretches are cut anew by minimizers of
    35 bytes, and then by whole windows, and dealt again. A sort holds about
    `memory` bytes, however large its shard.

    Returns row (a struct of the id and what is carried), n_bytes, n_removed,
    n_spans, kept_sha256, spans (start, end) and kept (with_text; a character
    that lost a byte goes with it).
    """
    width = shuffle_width(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(docs, text_column)))).first()[0] or 0
    buckets, places = max(SHARDS_A_PLACE * width, size // shard_bytes), max(4 * width, size // (2 * shard_bytes))
    row = F.struct(F.col(id_column), *[F.col(c) for c in carry if c != id_column]).alias("row")
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), text_or_empty(docs, text_column).alias("text"), row)
    rows = rows.withColumn("rid", F.xxhash64("doc", "text").bitwiseAND(F.lit((1 << 62) - 1)))
    rows = with_copies(rows)
    held = rows.select("rid", "doc", "text", "copy", "row", F.pmod("rid", F.lit(places)).cast("int").alias("place")).repartition(width, "place")
    anchors = rows.filter("doc is not null and not copy").select("rid", "doc", "text").mapInArrow(frugal(_anchors(buckets, places)), _BLOB_DDL)
    shared = anchors.repartition(width, "place").sortWithinPartitions("place").mapInArrow(_shared(places), _BLOB_DDL)
    sent = held.groupBy("place").cogroup(shared.groupBy("place")).applyInArrow(_stretch_texts(), _BLOB_DDL)
    marks, left = [], sent
    for own_gram, gram in zip((GRAM, *FINER_GRAMS), (*FINER_GRAMS, None)):
        done = written(left.repartition(width, "place").sortWithinPartitions("place").mapInArrow(frugal(_sorted_shards(places, memory, most, own_gram, gram, buckets)), _BLOB_DDL), "marks")
        marks.append(done.filter("place < 0").select((-1 - F.col("place")).alias("place"), "cols"))
        left = done.filter("place >= 0")
        if gram is None or left.isEmpty():
            break
    marked = functools.reduce(DataFrame.unionByName, marks)
    spans = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))
    schema = T.StructType().add("row", held.schema["row"].dataType)
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("spans", spans), ("kept", T.StringType())):
        schema = schema.add(name, kind)
    return held.groupBy("place").cogroup(marked.groupBy("place")).applyInArrow(_removed(with_text), schema)


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """docs with their texts less what repeats; all other columns stay as they are."""
    left = remove_repeats(docs, carry=tuple(c for c in docs.columns if c != "text"), with_text=True, **settings)
    return left.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])
