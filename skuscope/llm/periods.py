"""Periodic runs of words, found by recompression: a run-length grammar answers how far candidates extend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frugal, text_or_empty

_BLOCKS, _PAIRS = 0, 1


class _Level:
    """The string at one level of the grammar: for each place its symbol (negative: a separator), and for the
    level below where each symbol's first child is (one more at the end) and which symbol each child belongs to."""

    def __init__(self, symbols: np.ndarray, kind: int, first: np.ndarray):
        self.symbols, self.kind, self.first = symbols, kind, first
        self.parent = np.repeat(np.arange(len(symbols), dtype=np.int32), np.diff(first))


class Grammar:
    """A run-length grammar by recompression of a string of symbols, equal substrings alike wherever they stand.

    By turns, blocks of one repeated symbol become one symbol, and pairs of a left
    and a right symbol become one; which symbols are left and which right follows
    from the symbol and the level alone. Symbols below zero are separators, each
    of which occurs once; they are never joined to others. Levels are made when a
    query gets to them.
    """

    def __init__(self, symbols: np.ndarray):
        self.base = symbols.astype(np.int64)
        self.levels: list[_Level] = []
        self.used = int(self.base.max(initial=0)) + 1

    def symbols(self, k: int) -> np.ndarray:
        return self.levels[k - 1].symbols if k else self.base

    def above(self, k: int) -> _Level:
        """Level k + 1."""
        while len(self.levels) <= k:
            below = self.symbols(len(self.levels))
            self.levels.append(self._pairs(below) if len(self.levels) % 2 else self._blocks(below))
        return self.levels[k]

    def _named(self, keys: np.ndarray) -> np.ndarray:
        names, which = np.unique(keys, return_inverse=True)
        self.used += len(names)
        return self.used - len(names) + which

    def _blocks(self, s: np.ndarray) -> _Level:
        begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        first = np.concatenate([begins, [len(s)]])
        length, out = np.diff(first), s[begins]
        many = length > 1
        out[many] = self._named((out[many] << 32) | length[many])
        return _Level(out, _BLOCKS, first)

    def _pairs(self, s: np.ndarray) -> _Level:
        mixed = (s.view(np.uint64) + np.uint64(len(self.levels) * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
        side = ((mixed >> np.uint64(41)) ^ (mixed >> np.uint64(23))) & np.uint64(1)
        text = s >= 0
        near = text[:-1] & text[1:]
        one, other = near & (side[:-1] < side[1:]), near & (side[:-1] > side[1:])
        joined = one if np.count_nonzero(one) >= np.count_nonzero(other) else other
        begins = np.concatenate([[True], ~joined])
        first = np.concatenate([np.flatnonzero(begins), [len(s)]])
        out = s[first[:-1]]
        left = np.flatnonzero(joined)
        out[np.diff(first) == 2] = self._named((s[left] << 32) | s[left + 1])
        return _Level(out, _PAIRS, first)

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from i and from j on are equal (back: before i and before j), for i and j between the same two separators.

        Up: where both stand at the border of a symbol above, they go up, else at
        most one symbol or block is compared to get there, until symbols differ.
        Down: symbols that differ have at most one child or block in common.
        """
        a, b = i.astype(np.int64), j.astype(np.int64)
        shift = -1 if back else 0
        sign = -1 if back else 1
        stopped: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        query = np.arange(len(a))
        k = 0
        while len(query):
            s, up = self.symbols(k), self.above(k)
            stopped.append([])
            equal = s[a + shift] == s[b + shift]
            stopped[k].append((query[~equal], a[~equal], b[~equal]))
            query, a, b = query[equal], a[equal], b[equal]
            at_border = (up.first[up.parent[a]] == a) & (up.first[up.parent[b]] == b)
            if up.kind == _BLOCKS:
                left_a, left_b = self._left(up, a, back), self._left(up, b, back)
                step = np.minimum(left_a, left_b)
                apart = left_a != left_b
                go = apart | ~at_border
                a, b = np.where(go, a + sign * step, a), np.where(go, b + sign * step, b)
                stopped[k].append((query[apart], a[apart], b[apart]))
                query, a, b = query[~apart], a[~apart], b[~apart]
            else:
                a, b = np.where(at_border, a, a + sign), np.where(at_border, b, b + sign)
            a, b = up.parent[a].astype(np.int64), up.parent[b].astype(np.int64)
            k += 1
        query, a, b = (np.zeros(0, np.int64),) * 3
        for k in range(len(stopped) - 1, -1, -1):
            if len(query):
                level, s = self.levels[k], self.symbols(k)
                length_a, length_b = level.first[a + shift + 1] - level.first[a + shift], level.first[b + shift + 1] - level.first[b + shift]
                a, b = level.first[a], level.first[b]
                step = np.where(s[a + shift] == s[b + shift], np.minimum(length_a, length_b) if level.kind == _BLOCKS else 1, 0)
                a, b = a + sign * step, b + sign * step
            query, a, b = (np.concatenate(x) for x in zip((query, a, b), *stopped[k]))
        found = np.zeros(len(i), np.int64)
        found[query] = (a - i[query]) * sign
        return found

    @staticmethod
    def _left(level: _Level, at: np.ndarray, back: bool) -> np.ndarray:
        """What is left of the block at a place, in the direction of the comparison."""
        return at - level.first[level.parent[at - 1]] if back else level.first[level.parent[at] + 1] - at


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = 6, times: int = 4, most: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """All runs of documents whose words (as numbers from 0) stand one after the other: (document, start, length, period), by document, start and period.

    A stretch with period p and at least max(least, times * p) words that no
    neighbouring word extends holds, of any max(least, times * p) - 2p + 1
    places in a row, one at which w[i..i+p) and w[i+p..i+2p) are equal; so
    each p needs candidates only at places that far apart, about n log n of them over all
    p. The grammar's extensions to both sides make each candidate an exact
    stretch; of equal stretches the smallest period is the period. Candidates
    within a run whose period divides p would give that run again.
    """
    order = np.argsort(-lengths, kind="stable")  # so that the documents long enough for a period stand first
    count = len(lengths)
    sizes = lengths[order]
    first = np.cumsum(sizes + 1) - sizes  # a separator before each document, and one at the end
    text = np.empty(int(sizes.sum()) + count + 1, np.int64)
    separators = np.concatenate([first - 1, [len(text) - 1]])
    is_word = np.ones(len(text), bool)
    is_word[separators] = False
    text[separators] = -1 - np.arange(count + 1)
    begins = np.cumsum(lengths) - lengths
    text[is_word] = words[np.repeat(begins[order] - (first - 1 - np.arange(count)), sizes) + np.arange(len(words))]
    owner = np.repeat(np.arange(count + 1), np.concatenate([sizes + 1, [1]]))  # the separator before a document is its own
    grammar = Grammar(text)
    covered, period_of = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)  # where the longest run known at a place ends, and its period
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def extended(i: np.ndarray, p: np.ndarray) -> None:
        begin = i - grammar.extension(i, i + p, back=True)
        end = i + p + grammar.extension(i, i + p)
        enough = end - begin >= np.maximum(least, times * p)
        begin, end, p = begin[enough], end[enough], p[enough]
        keep = np.lexsort((p, end, begin))
        keep = keep[np.concatenate([[True], (begin[keep][1:] != begin[keep][:-1]) | (end[keep][1:] != end[keep][:-1])])] if len(keep) else keep
        found.append((begin[keep], end[keep], p[keep]))
        for x, y, q in zip(begin[keep].tolist(), end[keep].tolist(), p[keep].tolist()):
            longer = covered[x:y] - x < y - x
            covered[x:y][longer], period_of[x:y][longer] = y, q

    longest = int(sizes.max(initial=0))
    waiting: list[tuple[np.ndarray, int]] = []

    def flush() -> None:
        if not waiting:
            return
        i = np.concatenate([x for x, _ in waiting])
        p = np.repeat([q for _, q in waiting], [len(x) for x, _ in waiting]).astype(np.int64)
        waiting.clear()
        q = period_of[i]
        known = (q > 0) & (p % np.maximum(q, 1) == 0) & (i + 2 * p <= covered[i])
        i, p = i[~known], p[~known]
        if len(i):
            extended(i, p)

    held, doubled = 0, 1
    for p in range(1, longest // times + 1 if longest >= least else 1):
        if p == doubled or held > most:
            flush()
            held, doubled = 0, doubled * 2 if p == doubled else doubled
        need = max(least, times * p)
        end = int(first[np.searchsorted(-sizes, -need, side="right") - 1] + sizes[np.searchsorted(-sizes, -need, side="right") - 1])
        i = np.arange(1, end - 2 * p + 1, need - 2 * p + 1)
        i = i[text[i] == text[i + p]]
        i = i[(text[i + p - 1] == text[i + 2 * p - 1]) & (text[i + p // 2] == text[i + p // 2 + p])]
        i = i[(owner[i] == owner[i + 2 * p - 1]) & is_word[i]]
        if len(i):
            waiting.append((i, p))
            held += len(i)
    flush()
    if not found:
        return (np.zeros(0, np.int64),) * 4
    begin, end, p = (np.concatenate(x) for x in zip(*found))
    keep = np.lexsort((p, end, begin))
    begin, end, p = begin[keep], end[keep], p[keep]
    keep = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])])[: len(begin)]
    begin, end, p = begin[keep], end[keep], p[keep]
    doc = owner[begin]
    start, doc = begin - first[doc], order[doc]
    keep = np.lexsort((p, start, doc))
    return doc[keep], start[keep], (end - begin)[keep], p[keep]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(at: int, names: list[str], words_a_batch: int = 200_000):
    def finished(rows: list[pa.RecordBatch], texts: list[list[bytes]]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        lengths = np.array([len(x) for x in texts], np.int64)
        flat = pa.array([y for x in texts for y in x], pa.binary()).dictionary_encode()
        doc, start, length, period = runs_of(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN)))
        kept = list(texts)
        for k in np.flatnonzero(np.diff(cuts)):
            gone = np.zeros(len(texts[k]), bool)
            for x in range(cuts[k], cuts[k + 1]):
                gone[start[x] + period[x] : start[x] + length[x]] = True
            kept[k] = [texts[k][i] for i in np.flatnonzero(~gone)]
        kept_text = pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(lengths), runs, kept_text], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        held = 0
        for whole in batches:
            begin = 0
            for k, text in enumerate(whole.column(at)):
                texts.append(text.as_buffer().to_pybytes().split())
                held += len(texts[-1]) + 1
                if held >= words_a_batch:
                    rows.append(whole.slice(begin, k + 1 - begin).drop_columns(["__text"]))
                    yield finished(rows, texts)
                    rows, texts, held, begin = [], [], 0, k + 1
            if begin < len(whole):
                rows.append(whole.slice(begin).drop_columns(["__text"]))
        if texts:
            yield finished(rows, texts)

    return run


def periodic_runs(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """Adds n_words, runs (an array of start, length, period; by start, then period) and kept_text to docs, whose text column goes.

    Words are the maximal stretches of characters other than ASCII white space,
    numbered from 0. A run is a stretch of consecutive words with smallest
    period q and at least max(6, 4q) words that no neighbouring word extends
    keeping the period. kept_text has the words, joined by one space, without
    those that any run contains after its first q.

    Documents go through no shuffle; a task works on some 200,000 words at once,
    or on one document that is longer. Whole texts count, whatever their length;
    null and empty texts have no words and no runs, and an empty kept_text;
    repeated rows have a row each; other columns stay as they are (columns of docs
    named n_words, runs or kept_text are replaced); an empty table gives an empty result.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "runs", "kept_text", text_column)), text_or_empty(docs, f"`{text_column}`").alias("__text"))
    names = [*docs.columns[:-1], "n_words", "runs", "kept_text"]
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = docs.drop("__text").schema.add("n_words", T.LongType()).add("runs", T.ArrayType(run)).add("kept_text", T.StringType())
    return docs.mapInArrow(frugal(_found(len(docs.columns) - 1, names)), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The op12 contract's documents: for ids with h = crc32(decimal id), h % 10 = 0, the words from a on repeat the p words there (a null id plants nothing)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text_or_empty(docs), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    known = docs.select(docs.doc_id.cast("long").alias("doc_id"), text_or_empty(docs).alias("text"), F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g")).withColumn("n", F.size("w"))
    known = known.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.array_join(F.transform(F.expr("sequence(0, n - 1)"), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " ")
    return known.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The op12 contract's columns of periodic_runs' result."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
