"""Best-fit packing of token sequences after Martello and Toth's dominance reduction."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import frugal, text_or_empty, written
from .tokens import tokenizer


class Instance:
    """Items to pack, as a count for each length: at most `capacity` lengths, whatever the corpus."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({k: v for k, v in counts.items() if v > 0})
        self.lengths = sorted(self.counts)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.counts[x] -= times
        for x in set(lengths):
            if not self.counts[x]:
                self.lengths.remove(x)

    def repeats(self, lengths: tuple[int, ...]) -> int:
        """How many times this set can be taken."""
        return min(self.counts[x] // n for x, n in Counter(lengths).items())

    def left(self, x: int, without: tuple[int, ...]) -> int:
        return self.counts[x] - without.count(x)

    def largest(self, room: int, without: tuple[int, ...]) -> int | None:
        """The largest length of at most room that is there beside `without`."""
        for k in range(bisect_right(self.lengths, room) - 1, -1, -1):
            if self.left(self.lengths[k], without) > 0:
                return self.lengths[k]
        return None

    def smallest(self, n: int, without: tuple[int, ...]) -> list[int]:
        found: list[int] = []
        for x in self.lengths:
            found += [x] * min(n - len(found), max(0, self.left(x, without)))
            if len(found) == n:
                break
        return found

    def best_pair(self, room: int, without: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair a >= b with the largest sum of at most room; of equal sums that with the larger a."""
        best = None
        for a in reversed(self.lengths[: bisect_right(self.lengths, room)]):
            if self.left(a, without) <= 0 or (best and 2 * a < sum(best)):
                continue
            b = self.largest(min(a, room - a), (*without, a))
            if b is not None and (best is None or a + b > sum(best)):
                best = (a, b)
        return best


def reduce_by_dominance(items: Instance, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction: fixes, for the largest item first, the set of at
    most three items that dominates every other set with that item, and takes it out;
    so the rest has an optimal packing together with what is fixed. Works on counts:
    a set is fixed as often as it can be, for taking items out leaves it dominant.

    - nothing fits beside the item: it stays alone;
    - no two items fit beside it, or one fills the rest exactly: the largest fitting one;
    - no three fit: the largest fitting one if it is no smaller than the best pair;
      else that pair, if it has the largest fitting one and at most one item lies between
      the two, or no pair of the items just before the smaller one fits.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for x in list(reversed(items.lengths)):
            while items.counts[x] > 0:
                found = _dominant(items, x, capacity)
                if not found:
                    break
                times = max(1, items.repeats(found))
                items.take(found, times)
                fixed.append((found, times))
                changed = True
    return fixed


def _dominant(items: Instance, x: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - x
    one = items.largest(room, (x,))
    if one is None:
        return (x,)
    few = items.smallest(3, (x,))
    if one == room or sum(few[:2]) > room or len(few) < 2:
        return (x, one)
    if len(few) == 3 and sum(few) <= room:
        return None
    a, b = items.best_pair(room, (x,))
    if one >= a + b:
        return (x, one)
    if a == one:
        between = [y for y in items.lengths if b < y < a]
        number = sum(items.left(y, (x,)) for y in between)
        if number <= 1:
            return (x, a, b)
        before = [y for y in between for _ in range(min(2, items.left(y, (x,))))][:2]  # the two just before b, in descending order of place
        if sum(before) > room:
            return (x, a, b)
    return None


def best_fit(items: Instance, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: each length in turn goes into the open bins with
    the least room that holds it; equal bins are filled together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for x in sorted(items.counts, reverse=True):
        n = items.counts[x]
        while n:
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                each = capacity // x
                full, rest = divmod(n, each)
                for times, k in ((full, each), (1, rest)):
                    if times and k:
                        _open(rooms, capacity - k * x, (x,) * k, times)
                n = 0
                continue
            pattern, bins = next(iter(rooms[room].items()))
            each = min(room // x, n)
            times = min(bins, n // each)
            rooms[room][pattern] -= times
            if not rooms[room][pattern]:
                del rooms[room][pattern]
            if not rooms[room]:
                del rooms[room]
            _open(rooms, room - each * x, pattern + (x,) * each, times)
            n -= each * times
    return [(p, n) for found in rooms.values() for p, n in found.items()]


def _open(rooms: dict, room: int, pattern: tuple[int, ...], times: int) -> None:
    kept = rooms.setdefault(room, {})
    kept[pattern] = kept.get(pattern, 0) + times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: (length, first rank, last rank + 1, first bin, items a bin, first offset).

    The k-th item of a length (k from first rank on) is in bin first_bin + (k -
    first_rank) // items_a_bin at first_offset + length * ((k - first_rank) %
    items_a_bin). Its size depends on capacity only.
    """
    full = counts.get(capacity, 0)
    items = Instance({k: v for k, v in counts.items() if k < capacity})
    bins = [((capacity,), full)] if full else []
    bins += reduce_by_dominance(items, capacity)
    bins += best_fit(items, capacity)
    rows, used, first = [], Counter(), 0
    for pattern, times in bins:
        offset = 0
        for x, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((x, used[x], used[x] + k * times, first, k, offset))
            used[x] += k * times
            offset += k * x
        first += times
    return rows


#: A word of these characters only is cut by the tokenizer where letters and marks meet,
#: and lower-cased letter by letter; so its ids are those of its runs.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")


_SIMPLE = re.compile(r"[a-zß-öø-ÿ]+")


class _Ids(dict):
    """Token ids (as bytes) of words without spaces, each tokenized once while it is among the
    last words seen: two generations of up to `cached` words are kept."""

    def __init__(self, path: str, cached: int = 300_000):
        from tokenizers import pre_tokenizers

        whole = tokenizer(path)
        self.encode, self.tokenize, self.cached, self.old = whole.encode, whole.model.tokenize, cached, {}
        # A run of letters is one pre-token: the model takes it in the byte-level alphabet, in which ASCII stays as it is.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            if _SIMPLE.fullmatch(word):
                found = array("I", [x.id for x in self.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()
            elif _PLAIN.fullmatch(word) and "<|" not in word and len(runs := _RUN.findall(word.lower())) > 1:
                found = b"".join([self[x] for x in runs])
            else:
                found = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found


def token_ids(texts: pa.Array, known: _Ids) -> tuple[bytes, np.ndarray]:
    """The ids of texts, one after the other, and where each text's begin (and the last one's end).

    Each distinct word of the texts is looked up once; its ids are then put
    wherever the word stands.
    """
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = words.flatten().dictionary_encode()
    parts = [known[x] for x in coded.dictionary.to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    first = np.cumsum(lengths) - lengths
    at = coded.indices.to_numpy(zero_copy_only=False)
    each = lengths[at]
    begin = np.concatenate([[0], np.cumsum(each)])
    ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(first[at] - begin[:-1], each) + np.arange(begin[-1])]
    ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
    return ids.tobytes(), begin[np.concatenate([[0], ends]).astype(np.int64)]


def _pieces(path: str, capacity: int, end_id: int, rows: int = 2000):
    """Token ids of each document, then end_id, cut into pieces of `capacity`; nth counts the
    pieces of the same length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = _Ids(path), TaskContext.get().partitionId()
        end, seen = array("I", [end_id]).tobytes(), [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                out: dict[str, list] = {n: [] for n in _PIECE.names}
                everything, begin = token_ids(batch.column(1), known)
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    ids = everything[4 * begin[k] : 4 * begin[k + 1]] + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        length = len(part) // 4
                        for n, v in zip(out, (task, seen[length], doc_id, piece, start // 4, length, part)):
                            out[n].append(v)
                        seen[length] += 1
                yield pa.RecordBatch.from_pydict(out, _PIECE)

    return run


_PIECE = pa.schema([("task", pa.int32()), ("nth", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])


def _by_length(capacity: int):
    """(task, lengths, before) as one array a task, in which the place is the length less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.zeros((len(batch), capacity), np.int64)
            for row, (lengths, before) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                wide[row, np.array(lengths) - 1] = before
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(wide), pa.list_(pa.int64()))], names=["task", "before"])

    return run


def pack_documents(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 0, broadcast_tasks: int = 4_000) -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens, as few as it can.

    1. Documents are tokenized (each distinct word once a task; white space
       parts this tokenizer's tokens, so a text's ids are its words' ids one
       after the other), end_id is added, and only documents longer than a
       sequence are cut. The pieces, with their ids, go to a table, each with
       its number among the pieces of its length in its task.
    2. The number of pieces of each length, at most `capacity` rows, comes to
       the driver, which reduces that instance by dominance and packs the rest
       by best fit. The plan says for ranks within a length where they go; its
       size depends on capacity alone, and so it is broadcast.
    3. A piece's rank within its length is its number in the task and what the
       tasks before have of that length (at most `capacity` numbers a task).
       These numbers are broadcast for up to `broadcast_tasks` tasks, so that
       token ids are written once and never shuffled; beyond it pieces are
       joined with them by a shuffle.

    Null or empty texts give the one token end_id; repeated rows are packed
    each; null ids stay; an empty table gives an empty result; other columns
    are not read.

    Returns id, piece, start, length, ids (little-endian unsigned 32-bit),
    sequence_id and offset.
    """
    spark = docs.sparkSession
    schema = "task int, nth long, id long, piece int, start long, length int, ids binary"
    pieces = written(docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(docs, text_column).alias("text")).mapInArrow(frugal(_pieces(path, capacity, end_id)), schema), "pieces")
    own = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length int, first_rank long, end_rank long, first_bin long, each long, first_offset long").hint("broadcast")
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    ahead = own.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")).groupBy("task").agg(F.collect_list(F.struct("length", "before")).alias("x"))
    ahead = written(ahead.select("task", "x.length", "x.before").mapInArrow(_by_length(capacity), "task int, before array<long>"), "piece-ranks")
    ranked = pieces.join(F.broadcast(ahead) if ahead.count() <= broadcast_tasks else ahead, "task").withColumn("rank", F.get("before", F.col("length") - 1) + F.col("nth"))
    k = F.col("rank") - F.col("first_rank")
    return ranked.join(slots, "length").filter("rank >= first_rank and rank < end_rank").select(
        F.col("id").alias(id_column), "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("first_bin") + F.floor(k / F.col("each")).cast("long")).alias("sequence_id"), (F.col("first_offset") + F.col("length") * (k % F.col("each"))).alias("offset"),
    )
