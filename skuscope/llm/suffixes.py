"""External induced suffix sorting with common prefixes, to a bounded depth.

Suffix types and the induction follow the published induced-sorting scheme:
sorted LMS suffixes give the L suffixes in one ascending pass over first
symbols, these give the S suffixes in one descending pass. What a pass finds
goes to a priority queue by first symbol that keeps the order of arrival and
moves to disk in sorted runs beyond its memory. Over bytes its tuples carry
the suffix and its common prefix with the tuple before it, which is one more
than the least common prefix passed since; as only the first `depth` bytes
count, all common prefixes are cut there.

LMS suffixes get their order by recursion: a first induction sorts LMS
substrings, equal ones get one name, and the string of names is sorted the
same way, by inductions of its own over a large alphabet. There the queue's
buckets hold ranges of symbols, so that a pass goes by a bucket, not by a
symbol, at a time.

Text, types, positions, names and sorted lists larger than a share of
`memory` are files that the system maps; queues spill; and the sorted suffixes
come out block by block. So memory stays in proportion to `memory`, and
the files take about 40 bytes a byte of text.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import numpy as np

_FAR = 255
_BASE = 1 << 15  # names that are sorted directly


class Scratch:
    """Arrays and spill files of one sort, in the task's temporary folder while it lasts."""

    def __init__(self, memory: int):
        self.memory, self.block = memory, max(64, memory // 256)
        self.files: list = []

    def file(self):
        self.files.append(tempfile.TemporaryFile())
        return self.files[-1]

    def array(self, n: int, kind) -> np.ndarray:
        """Zeros; in a mapped file if they are large."""
        if n * np.dtype(kind).itemsize <= self.memory // 16:
            return np.zeros(n, kind)
        held = self.file()
        held.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(held, kind, "r+", shape=(n,))

    def blocks(self, n: int) -> Iterator[slice]:
        return (slice(k, min(k + self.block, n)) for k in range(0, n, self.block))

    def close(self) -> None:
        for x in self.files:
            x.close()
        self.files.clear()


class Runs:
    """Tuples (arrays of equal length) that are appended and read again block by block; on disk beyond `memory` bytes."""

    def __init__(self, scratch: Scratch, kinds: tuple, memory: int | None = None, disk=None):
        self.scratch, self.kinds, self.memory, self.disk = scratch, kinds, scratch.memory // 16 if memory is None else memory, disk
        self.held, self.size, self.stored, self.count = [], 0, [], 0

    def push(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.held.append(columns)
            self.count += len(columns[0])
            self.size += sum(x.nbytes for x in columns)
            if self.size > self.memory:
                self.spill()

    def spill(self) -> None:
        self.disk = self.disk or self.scratch.file()
        for part in self._in_blocks(self.held):
            self.stored.append((self.disk.seek(0, 2), len(part[0])))
            self.disk.write(b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in zip(part, self.kinds)))
        self.held, self.size = [], 0

    def _in_blocks(self, held: list) -> Iterator[tuple]:
        if held:
            whole = held[0] if len(held) == 1 else tuple(np.concatenate(x) for x in zip(*held))
            for part in self.scratch.blocks(len(whole[0])):
                yield tuple(x[part] for x in whole)

    def _read(self, at: int, n: int) -> tuple:
        self.disk.seek(at)
        return tuple(np.frombuffer(self.disk.read(n * np.dtype(t).itemsize), t) for t in self.kinds)

    def taken(self) -> Iterator[tuple]:
        """All tuples in order of arrival, those too that are pushed meanwhile."""
        done = 0
        while done < len(self.stored) or self.held:
            if done < len(self.stored):
                yield self._read(*self.stored[done])
                done += 1
            else:
                held, self.held, self.size = self.held, [], 0
                yield from self._in_blocks(held)

    def reversed(self) -> Iterator[tuple]:
        for columns in reversed([*self._in_blocks(self.held)]):
            yield tuple(x[::-1] for x in columns)
        for at, n in reversed(self.stored):
            yield tuple(x[::-1] for x in self._read(at, n))


class SpillingQueue:
    """A priority queue of tuples by bucket (a symbol, or a range of symbols), first in first out within a
    bucket. Beyond its memory all buckets move to disk, as a run sorted by bucket."""

    def __init__(self, scratch: Scratch, buckets: int, kinds: tuple):
        self.scratch, self.kinds, self.memory = scratch, kinds, scratch.memory // 8
        self.buckets: dict[int, Runs] = {}
        self.disk, self.runs = None, 0

    def push(self, bucket: int, *columns: np.ndarray) -> None:
        if bucket not in self.buckets:
            self.buckets[bucket] = Runs(self.scratch, self.kinds, 1 << 62, self.disk)
        self.buckets[bucket].push(*columns)
        self.runs += sum(x.nbytes for x in columns)
        if self.runs > self.memory and sum(x.size for x in self.buckets.values()) > self.memory:
            self.disk = self.disk or self.scratch.file()
            for _, runs in sorted(self.buckets.items()):
                if runs.held:
                    runs.disk = self.disk
                    runs.spill()
        if self.runs > self.memory:
            self.runs = sum(x.size for x in self.buckets.values())

    def pop(self, bucket: int) -> Iterator[tuple]:
        """The tuples of a bucket block by block, those too that are pushed meanwhile."""
        if bucket in self.buckets:
            yield from self.buckets[bucket].taken()
            del self.buckets[bucket]


def _types(text: np.ndarray, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Which of the first n suffixes are small (less than the next; the last one is), and the LMS ones in order."""
    small = scratch.array(n, bool)
    small[n - 1] = True
    for part in reversed([*scratch.blocks(n - 1)]):
        here = np.asarray(text[part.start : part.stop + 1]).astype(np.int64)
        differs = np.flatnonzero(here[:-1] != here[1:])
        found = np.full(part.stop - part.start, small[part.stop], bool)
        if len(differs):
            found[: differs[-1] + 1] = np.repeat(here[differs] < here[differs + 1], np.diff(np.concatenate([[-1], differs])))
        small[part] = found
    kept = Runs(scratch, ("<i8",))
    for part in scratch.blocks(n):
        own = np.asarray(small[part])
        before = np.concatenate([[part.start == 0 or small[part.start - 1]], own[:-1]])
        kept.push(np.flatnonzero(own & ~before) + part.start)
    leftmost = scratch.array(kept.count, np.int64)
    at = 0
    for (x,) in kept.taken():
        leftmost[at : at + len(x)] = x
        at += len(x)
    return small, leftmost


class _Induction:
    """One pass over bytes: hands the suffixes that are scanned on to the queues of their predecessors."""

    def __init__(self, text, small, symbols: int, depth: int, scratch: Scratch, to_small: bool):
        self.text, self.small, self.depth, self.to_small = text, small, depth, to_small
        self.queue = SpillingQueue(scratch, symbols, ("<i8", "u1"))
        self.least = np.full(symbols, _FAR, np.uint8)  # least common prefix scanned since a symbol's last tuple
        self.begun = np.zeros(symbols, bool)

    def scan(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """common: with the suffix scanned before."""
        before = suffixes - 1
        wanted = (suffixes > 0) & (self.small[before] == self.to_small)
        target = np.where(wanted, self.text[before].astype(np.int16), np.int16(-1))
        order = np.argsort(target, kind="stable")
        found, cuts = np.unique(target[order], return_index=True)
        whole = common.min()
        untouched = np.ones(len(self.least), bool)
        for k, t in enumerate(found.tolist()):
            if t < 0:
                continue
            at = order[cuts[k] : cuts[k + 1] if k + 1 < len(cuts) else None]
            starts = np.concatenate([[0], at + 1])
            tail = starts[-1] < len(common)
            lows = np.minimum.reduceat(common, starts if tail else starts[:-1])
            shared = lows[: len(at)].copy()
            shared[0] = min(shared[0], self.least[t]) if self.begun[t] else 0
            shared = np.minimum(shared.astype(np.int16) + 1, self.depth).astype(np.uint8)
            if not self.begun[t]:
                shared[0] = 0
            self.begun[t], untouched[t] = True, False
            self.least[t] = lows[-1] if tail else _FAR
            self.queue.push(t, before[at], shared)
        self.least[untouched] = np.minimum(self.least[untouched], whole)


def _run_length(text: np.ndarray, at: int, depth: int) -> int:
    part = text[at : at + depth]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _induced(text, small, seeds: Iterator[tuple], symbols: int, depth: int, scratch: Scratch) -> Iterator[tuple]:
    """From LMS suffixes with common prefixes, in the wanted order within each first symbol: all suffixes in
    descending order, block by block, each with its common prefix with the one before it in that stream."""
    shared_run = lambda x, y: min(_run_length(text, x, depth), _run_length(text, y, depth))
    first = SpillingQueue(scratch, symbols, ("<i8", "u1"))
    for suffixes, common in seeds:
        target = text[suffixes]
        order = np.argsort(target, kind="stable")
        found, cuts = np.unique(target[order], return_index=True)
        for t, at in zip(found.tolist(), np.split(order, cuts[1:])):
            first.push(t, suffixes[at], common[at])
    up = _Induction(text, small, symbols, depth, scratch, False)
    spilled = scratch.file()
    large = [Runs(scratch, ("<i8", "u1"), scratch.memory // (8 * symbols), spilled) for _ in range(symbols)]
    for c in range(symbols):
        last = None
        for suffixes, common in up.queue.pop(c):
            large[c].push(suffixes, common)
            up.scan(suffixes, common)
            last = int(suffixes[-1])
        head = True
        for suffixes, common in first.pop(c):
            if head:
                common, head = common.copy(), False
                common[0] = 0 if last is None else shared_run(last, int(suffixes[0]))
            up.scan(suffixes, common)
    down = _Induction(text, small, symbols, depth, scratch, True)
    for c in reversed(range(symbols)):
        last = carried = None
        for suffixes, common in down.queue.pop(c):
            yield suffixes, common
            down.scan(suffixes, common)
            last = int(suffixes[-1])
        for suffixes, common in large[c].reversed():
            if carried is None:
                carried = 0 if last is None else shared_run(last, int(suffixes[0]))
            shifted = np.concatenate([np.array([carried], np.uint8), common[:-1]])  # with the next larger one
            carried = int(common[-1])
            yield suffixes, shifted
            down.scan(suffixes, shifted)


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the strings at a and b, up to `most` symbols."""
    found = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    k = 0
    while len(live):
        live = live[most[live] > k]
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        found[live] = k
    return found


def _names(stream: Iterator[np.ndarray], text, small, leftmost, most: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """LMS suffixes in descending order of their LMS substrings -> the string of names of these, in the order of
    the text, and how many names there are. Substrings are compared up to `most` symbols."""
    total = len(leftmost)
    names, count = scratch.array(total, np.int64), 0
    last_at, last_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for suffixes in stream:
        own = suffixes[(suffixes > 0) & small[suffixes]]
        own = own[~small[own - 1]]
        if not len(own):
            continue
        place = np.searchsorted(leftmost, own)
        size = np.where(place + 1 < total, leftmost[np.minimum(place + 1, total - 1)] - own + 1, 1)
        at, sizes = np.concatenate([last_at, own]), np.concatenate([last_size, size])
        same = sizes[1:] == sizes[:-1]
        compared = np.where(same, np.minimum(sizes[1:], most), 0)
        new = ~(same & (_common_prefix(text, at[:-1], at[1:], compared) == compared))
        if not len(last_at):
            new = np.concatenate([[True], new])
        names[place] = count + np.cumsum(new)
        count += int(new.sum())
        last_at, last_size = own[-1:], size[-1:]
    for part in scratch.blocks(total):
        names[part] = count - names[part]
    return names, count


def _parted(bucket: np.ndarray, suffixes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The suffixes of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    sorted_buckets, suffixes = bucket[order], suffixes[order]
    cuts = [0, *(np.flatnonzero(sorted_buckets[1:] != sorted_buckets[:-1]) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield int(sorted_buckets[a]), suffixes[a:b]


class _NamePass:
    """One induction over a string of names. Buckets are ranges of names; within one, what it induces into itself
    is taken in where it belongs, and what goes to later buckets is sent at its end. Symbols are 2 * name, and
    one more where the suffix is small."""

    def __init__(self, symbols: np.ndarray, bucket_of, sizes, scratch: Scratch, to_small: bool):
        self.symbols, self.bucket_of, self.sizes, self.to_small = symbols, bucket_of, sizes, to_small
        self.queue = SpillingQueue(scratch, len(sizes), ("<i8",))

    def _before(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix: the one before it, and that one's bucket, or -1 where it isn't of the wanted type."""
        before = suffixes - 1
        symbol = self.symbols[before]  # of suffix 0 the last symbol, which is small and 0
        wanted = (symbol & 1) == self.to_small
        wanted &= before >= 0
        return before, np.where(wanted, self.bucket_of[symbol >> 1], -1)

    def _send(self, before: np.ndarray, bucket: np.ndarray) -> None:
        for b, part in _parted(bucket, before):
            if b >= 0:
                self.queue.push(b, part)

    def single(self, b: int, then: Iterator[tuple]) -> Iterator[tuple[np.ndarray, bool]]:
        """A bucket of one name, block by block: (suffixes in order, whether they are of this pass's type)."""
        for came, source in ((True, self.queue.pop(b)), (False, then)):
            for (suffixes,) in source:
                self._send(*self._before(suffixes))
                yield suffixes, came

    def several(self, b: int, then: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A bucket of several names: the same, at once. What it induces into itself is found wave by wave; it
        stands, within its name, after what came by the queue, in the order of what induced it; seeds stand last."""
        parts = [[x for (x,) in self.queue.pop(b)], [x for (x,) in then]]
        if not parts[0] and not parts[1]:
            return
        whole = np.concatenate([*parts[0], *parts[1]])
        queued = sum(map(len, parts[0]))
        before, bucket = self._before(whole)
        kind = np.where(np.arange(len(whole)) < queued, 0, 2)
        inner = np.flatnonzero(bucket == b)
        parent = None
        if len(inner):
            waves, befores, buckets, parents, first = [whole], [before], [bucket], [np.zeros(len(whole), np.int64)], 0
            while len(inner):
                parents.append(inner + first)
                first += len(waves[-1])
                waves.append(befores[-1][inner])
                before, bucket = self._before(waves[-1])
                befores.append(before)
                buckets.append(bucket)
                inner = np.flatnonzero(bucket == b)
            whole, before, bucket, parent = (np.concatenate(x) for x in (waves, befores, buckets, parents))
            kind = np.concatenate([kind, np.ones(len(whole) - len(kind), np.int64)])
        m = len(whole)
        name = (self.symbols[whole] >> 1).astype(np.int64)
        name = name.max() - name if self.to_small else name - name.min()
        key, place = (name * 3 + kind) * m, np.arange(m)
        if parent is None:
            order = np.argsort(key + place)
        else:
            induced = kind == 1
            tie, rank = np.where(induced, 0, place), np.empty(m, np.int64)
            while True:
                order = np.argsort(key + tie, kind="stable")
                rank[order] = place
                ranked = np.where(induced, rank[parent], place)
                if (ranked == tie).all():
                    break
                tie = ranked
        later = bucket[order]
        at = order[(later != b) & (later >= 0)]
        self._send(before[at], bucket[at])
        yield whole[order], kind[order] != 2

    def bucket(self, b: int, then: Iterator[tuple]) -> Iterator[tuple[np.ndarray, bool | np.ndarray]]:
        return self.single(b, then) if self.sizes[b] == 1 else self.several(b, then)


def _buckets(text: np.ndarray, names: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each name, and the number of names of each bucket: buckets of about equally many
    suffixes, and a bucket of its own for a name that has as many as that."""
    counts = scratch.array(names, np.int64)
    for part in scratch.blocks(len(text)):
        found, n = np.unique(text[part], return_counts=True)
        counts[found] += n
    wanted = min(1024, max(4, int(len(text) ** 0.5 / 16)))
    each = max(1, len(text) // wanted)
    bucket_of = scratch.array(names, np.int32)
    passed, last, number = 0, -1, -1
    heavy_before = True
    for part in scratch.blocks(names):
        n = np.asarray(counts[part])
        slot = (passed + np.cumsum(n) - n) // each
        heavy = n >= each
        new = np.concatenate([[slot[0] != last], slot[1:] != slot[:-1]]) | heavy | np.concatenate([[heavy_before], heavy[:-1]])
        bucket_of[part] = number + np.cumsum(new)
        number, passed, last, heavy_before = int(bucket_of[part.stop - 1]), passed + int(n.sum()), int(slot[-1]), bool(heavy[-1])
    sizes = np.zeros(number + 1, np.int64)
    for part in scratch.blocks(names):
        np.add.at(sizes, bucket_of[part], 1)
    return bucket_of, sizes


def _descending(symbols, seeds: Iterator[np.ndarray], bucket_of, sizes, scratch: Scratch) -> Iterator[np.ndarray]:
    """From LMS suffixes, in the wanted order within each name: all suffixes of a string of names, descending."""
    first = SpillingQueue(scratch, len(sizes), ("<i8",))
    for suffixes in seeds:
        for b, part in _parted(bucket_of[symbols[suffixes] >> 1], suffixes):
            first.push(b, part)
    spilled = scratch.file()
    large = [Runs(scratch, ("<i8",), scratch.memory // (8 * len(sizes)), spilled) for _ in sizes]
    up = _NamePass(symbols, bucket_of, sizes, scratch, False)
    for b in range(len(sizes)):
        for suffixes, came in up.bucket(b, first.pop(b)):
            large[b].push(suffixes[came] if isinstance(came, np.ndarray) else suffixes if came else suffixes[:0])
    down = _NamePass(symbols, bucket_of, sizes, scratch, True)
    for b in reversed(range(len(sizes))):
        for suffixes, _ in down.bucket(b, large[b].reversed()):
            yield suffixes
    yield np.array([len(symbols) - 1])  # nothing induces the last suffix


def _by_doubling(text: np.ndarray) -> np.ndarray:
    rank, step = np.asarray(text).astype(np.int64), 1
    while True:
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        if rank.max(initial=0) + 1 == len(rank):
            return np.argsort(rank)
        step *= 2


def sorted_names(text: np.ndarray, names: int, scratch: Scratch) -> np.ndarray:
    """All suffixes of a string of names 0 to names - 1 in ascending order; its last name is 0 and stands nowhere else."""
    n = len(text)
    out = scratch.array(n, np.int64)
    if names == n:
        for part in scratch.blocks(n):
            out[text[part]] = np.arange(part.start, part.stop)
        return out
    if n <= _BASE:
        out[:] = _by_doubling(text)
        return out
    small, leftmost = _types(text, n, scratch)
    bucket_of, sizes = _buckets(text, names, scratch)
    symbols = scratch.array(n, np.int64 if names >> 30 else np.int32)
    for part in scratch.blocks(n):
        symbols[part] = 2 * text[part] + small[part]
    seeds = (np.asarray(leftmost[part]) for part in scratch.blocks(len(leftmost)))
    shorter, fewer = _names(_descending(symbols, seeds, bucket_of, sizes, scratch), text, small, leftmost, n, scratch)
    order = sorted_names(shorter, fewer, scratch)
    seeds = (leftmost[np.asarray(order[part])] for part in scratch.blocks(len(order)))
    end = n
    for suffixes in _descending(symbols, seeds, bucket_of, sizes, scratch):
        out[end - len(suffixes) : end] = suffixes[::-1]
        end -= len(suffixes)
    return out


def sorted_blocks(raw: np.ndarray, depth: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of raw in descending order of their first `depth` bytes, block by block, each with its common
    prefix with the one before it in that stream, up to depth. raw may hold any bytes below 255."""
    n = len(raw)
    if not n:
        return
    scratch = Scratch(memory)
    try:
        text = scratch.array(n + 1 + depth, np.uint8)
        symbols = 1
        for part in scratch.blocks(n):
            text[part] = np.asarray(raw[part]) + 1  # 0 ends the text
            symbols = max(symbols, int(text[part].max()) + 1)
        small, leftmost = _types(text, n + 1, scratch)
        unknown = lambda x: np.zeros(len(x), np.uint8)
        seeds = ((x, unknown(x)) for x in (np.asarray(leftmost[part]) for part in scratch.blocks(len(leftmost))))
        stream = itertools.chain((suffixes for suffixes, _ in _induced(text, small, seeds, symbols, depth, scratch)), [np.array([n])])  # nothing induces the last suffix
        names, count = _names(stream, text, small, leftmost, depth, scratch)
        order = sorted_names(names, count, scratch)

        def sorted_seeds() -> Iterator[tuple]:
            last = np.zeros(0, np.int64)
            for part in scratch.blocks(len(order)):
                own = leftmost[np.asarray(order[part])]
                both = np.concatenate([last, own])
                common = _common_prefix(text, both[:-1], both[1:], np.full(len(both) - 1, depth)).astype(np.uint8)
                yield own, common if len(last) else np.concatenate([unknown(own[:1]), common])
                last = own[-1:]

        for suffixes, common in _induced(text, small, sorted_seeds(), symbols, depth, scratch):
            yield suffixes, common
    finally:
        scratch.close()


def sorted_suffixes(raw: bytes, depth: int, memory: int = 32 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All of sorted_blocks at once, ascending: suffixes, and each one's common prefix with the one before."""
    found = [*sorted_blocks(np.frombuffer(raw, np.uint8), depth, memory)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    suffixes, common = (np.concatenate(x) for x in zip(*found))
    return suffixes[::-1].copy(), np.concatenate([np.zeros(1, np.uint8), common[:0:-1]])
