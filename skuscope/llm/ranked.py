"""Ranked lexical search the other way round: items' terms are the index, and documents stream through it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import frugal, text_or_empty

_SEPARATE = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_CELLS = 2_000_000  # of the table of scores of some documents against a block's items
_EXACT = 1 << 53  # integers below it are exact as doubles
_FOUND = "item int, item_id long, doc_id long, score long"


def _letters() -> bytes:
    """For bytes.translate: separators become spaces, A-Z lower case; all bytes of other characters stay."""
    return bytes(0x20 if b in _SEPARATE else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


_TABLE = _letters()


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class ItemIndex:
    """An inverted index over a block of items: for each term the items that hold it, and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [x for x, _ in items]
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for k, (_, text) in enumerate(items):
            for term, times in Counter(terms_of(text)).items():
                at = self.terms.setdefault(term, len(self.terms))
                if at == len(postings):
                    postings.append([])
                postings[at].append((k, times))
        self.lengths = np.array([len(x) for x in postings], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        flat = np.array([y for x in postings for y in x], np.int64).reshape(-1, 2)
        self.item, self.times = flat[:, 0], flat[:, 1]


def blocks_of(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[ItemIndex]:
    """The items in blocks of about `block_bytes` of text, one partition of them at a time at the driver."""
    held: list[tuple[int | None, str | None]] = []
    size = 0
    for row in items.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        size += 64 + len(row[1] or "")
        if size >= block_bytes:
            yield ItemIndex(held)
            held, size = [], 0
    if held:
        yield ItemIndex(held)


def _statistics(sent):
    """Per task: documents with a term (row -2), all terms of documents (row -1), documents that hold each of the index's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value.terms
        holding, with_terms, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms_of(text)
                with_terms += bool(words)
                total += len(words)
                holding.update(terms.keys() & set(words))
        rows = [(-2, with_terms), (-1, total), *((terms[x], n) for x, n in holding.items())]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    return run


class _Heaps:
    """The k best documents of each item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.zeros(items, np.int64)  # score of the k-th; 0 while there are fewer
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: a row a document, a column an item."""
        bound = np.maximum(self.least, 1)
        if len(scores) > self.k:
            bound = np.maximum(bound, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        doc, item = np.nonzero(scores >= bound)
        if not len(doc):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[doc, item]])
        own, gone = np.concatenate([self.id, ids[doc]]), np.concatenate([self.null, null[doc]])
        order = np.lexsort((own, gone, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - first[item[order]]
        order = order[place < self.k]
        self.item, self.score, self.id, self.null = item[order], score[order], own[order], gone[order]
        number = np.bincount(self.item, minlength=len(self.least))
        full = np.flatnonzero(number == self.k)
        self.least[full] = self.score[np.cumsum(number)[full] - 1]


def _streamed(sent, weights: np.ndarray, documents: int, total: int, k: int):
    """In each task: documents' term counts go through the index, and each item's k best documents come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        terms, items = index.terms, len(index.ids)
        heaps, most = _Heaps(items, k), max(1, _CELLS // items)
        each = np.bincount(index.item, np.repeat(weights, index.lengths) * index.times * 1e6, items)
        doubles = each.max(initial=0) < _EXACT

        def scored(ids: list, owner: list[int], sizes: list[int], at: list[int], tf: list[int]) -> None:
            if not at:
                return
            own, term, times = np.array(owner, np.int64), np.array(at, np.int64), np.array(tf, np.int64)
            m = np.array([25 + 75 * n * documents // total for n in sizes], np.int64)[own]
            value = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m))
            number = index.lengths[term]
            begin = np.cumsum(number) - number
            place = np.arange(number.sum()) - np.repeat(begin - index.first[term], number)
            cell = np.repeat(own * items, number) + index.item[place]
            value = np.repeat(value, number) * index.times[place]
            if doubles:
                scores = np.bincount(cell, value, len(ids) * items).astype(np.int64)
            else:
                scores = np.zeros(len(ids) * items, np.int64)
                np.add.at(scores, cell, value)
            null = np.array([x is None for x in ids])
            heaps.offer(scores.reshape(-1, items), np.array([x or 0 for x in ids], np.int64), null)

        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                ids, owner, sizes, at, tf = part.column(0).to_pylist(), [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    sizes.append(len(words))
                    counts = Counter(words)
                    held = terms.keys() & counts.keys()
                    owner += [row] * len(held)
                    at += [terms[x] for x in held]
                    tf += [counts[x] for x in held]
                scored(ids, owner, sizes, at, tf)
        found = [[int(x), index.ids[x], None if gone else int(own), int(score)] for x, own, gone, score in zip(heaps.item, heaps.id, heaps.null, heaps.score)]
        columns = list(zip(*found)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["item", "item_id", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Each item's k best documents by term weights: item_id, rank (from 1), the document's id and score.

    Items are cut into blocks of about `block_bytes` of text (so the index that
    is broadcast has a bound, whatever their number); for each block

    1. documents are read for the number of those with terms, all their terms,
       and how many hold each term of the block; sums by task, then by term;
    2. documents are read again: each one's term counts go through the block's
       inverted index, and a task keeps the k best documents of each item;
    3. tasks' bests, k an item at most, are merged by item.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document's
    score is a sum of integers, saturating in the term's count and falling with
    the document's length. Only scores above 0 count; ties go to the smaller
    id, null ids last. Null and empty texts have no terms; an item without
    terms, or whose terms no document has, has no rows; repeated documents
    stand there each; repeated items are answered each; empty tables give an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    found = []
    for index in blocks_of(items, item_column, item_text, block_bytes):
        if not index.terms:
            continue
        sent = spark.sparkContext.broadcast(index)
        sums = dict(wanted.select("text").mapInArrow(frugal(_statistics(sent)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
        documents, total = sums.get(-2, 0), sums.get(-1, 0)
        if not total:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * sums.get(x, 0) + 1))) for x in range(len(index.terms))], np.int64)
        best = wanted.mapInArrow(frugal(_streamed(sent, weights, documents, total, k)), _FOUND)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found.append(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("item"))
    if not found:
        found = [spark.createDataFrame([], "item_id long, doc_id long, score long, rank int")]
    return reduce(DataFrame.unionByName, found).select(F.col("item_id").alias(item_column), "rank", F.col("doc_id").alias(id_column), "score")


ORACLE_OP13 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark
), it AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(words) AS term FROM i) GROUP BY ALL),
dt AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(words) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS N, sum(len(words))::BIGINT AS L FROM d WHERE len(words) > 0),
w AS (SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM dt, s WHERE term IN (SELECT term FROM it) GROUP BY term),
m AS (SELECT d, doc_id, 100 - 75 + ((75 * len(words) * N) // L) AS m FROM d, s WHERE len(words) > 0),
scored AS (
  SELECT i, item_id, doc_id, m.d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM it JOIN w USING (term) JOIN dt USING (term) JOIN m ON m.d = dt.d GROUP BY ALL
), ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, d))::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
