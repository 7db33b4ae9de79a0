"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shuffle_width, written

SEGMENT_BITS = 16


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for vector in batch.column(1).to_pylist():
            signs = np.array([x is not None and x > 0 for x in vector or ()], bool)
            found.append(np.packbits(signs, bitorder="little").tobytes().rstrip(b"\0"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "code"])


def binary_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and code: bit i is set if element i is above zero; null, NaN and missing elements aren't, so codes end with their last set bit."""
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(_codes, "id long, code binary")


class SegmentIndex:
    """Codes of one length by the value of each of their 16-bit segments."""

    def __init__(self, codes: np.ndarray):
        self.words = codes  # a row of unsigned 64-bit words a code
        self.segments = np.ascontiguousarray(codes).view("<u2").reshape(len(codes), -1)
        self.number = self.segments.shape[1]
        self.order = [np.argsort(self.segments[:, s], kind="stable") for s in range(self.number)]
        self.first = [np.searchsorted(self.segments[o, s], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in enumerate(self.order)]

    def distances(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[at] ^ code).sum(axis=1, dtype=np.int64)

    def at_radius(self, code: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Places of the codes with a segment that differs from the query's by one of the masks."""
        found = []
        for s, value in enumerate(code.view("<u2")):
            probes = (masks ^ value).astype(np.int64)
            a, n = self.first[s][probes], self.first[s][probes + 1] - self.first[s][probes]
            n_all = n.sum()
            if n_all:
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n_all)
                found.append(self.order[s][at])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def nearest(self, code: np.ndarray, k: int, members: np.ndarray, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes no farther than the k-th nearest row (a code counts as `members` rows).

        After radius r every code within segments * (r + 1) - 1 bits has been seen, for
        in some segment it differs in r bits at most; the radius grows until the k-th
        verified distance is covered.
        """
        near = np.zeros(0, np.int64)
        for r in range(SEGMENT_BITS + 1):
            near = np.union1d(near, self.at_radius(code, masks[r]))
            distance = self.distances(near, code)
            seen = np.bincount(distance, members[near], self.number * SEGMENT_BITS + 1).cumsum()
            bound = int(np.searchsorted(seen, k))
            if bound <= self.number * (r + 1) - 1 or len(near) == len(self.words):
                break
        keep = distance <= bound
        return near[keep], distance[keep]


def _masks() -> list[np.ndarray]:
    bits = np.bitwise_count(np.arange(1 << SEGMENT_BITS, dtype=np.uint32))
    return [np.flatnonzero(bits == r).astype(np.uint16) for r in range(SEGMENT_BITS + 1)]


def _wide(codes: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(8 * words, b"\0") for x in codes), "<u8").reshape(len(codes), words)


_FOUND = pa.schema([("query", pa.binary()), ("code", pa.binary()), ("distance", pa.int32()), ("rows", pa.int64())])
_LEAST_SHARDS = 32  # where one would do, so that small tables are searched by several tasks


def _searched(k: int, words: int):
    """A task has whole shards, one after the other: each shard's codes first (query false), of which the
    index is built once, then all queries, which pass through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, shard, codes, rows, index, members = _masks(), None, [], [], None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _FOUND.names}
            for own, query, code, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own != shard:
                    shard, codes, rows, index = own, [], [], None
                if not query:
                    codes.append(code)
                    rows.append(n)
                    continue
                if not codes:
                    continue
                if index is None:
                    index, members = SegmentIndex(_wide(codes, words)), np.array(rows)
                at, distance = index.nearest(_wide([code], words)[0], k, members, masks)
                out["query"] += [code] * len(at)
                out["code"] += [codes[i] for i in at.tolist()]
                out["distance"] += distance.tolist()
                out["rows"] += members[at].tolist()
            yield pa.RecordBatch.from_pydict(out, _FOUND)

    return run


def top_k(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10, every: int = 50, shard: int = 100_000) -> DataFrame:
    """The k nearest rows by Hamming distance of the vectors' sign codes, for every row whose id is divisible by `every`.

    Equal codes are one entry of the index, with the number of its rows and its
    k smallest ids, which is all of it that can be in an answer. Codes are
    dealt out to shards of at most about `shard` codes, some 32 where these would
    be fewer. A shard's index is built once, and the query codes stream through it
    in sorted order, searched exactly by multi-index hashing; of the shards'
    answers, those that fewer than k rows are nearer than get their ids. Ties go to
    the smaller id; a query is among its own neighbours.

    All elements of a vector count, however many; shorter vectors count as if
    zeros followed; null, NaN and missing elements are not above zero. Null ids
    are neither queries nor neighbours; repeated rows count once; an empty
    table gives an empty result; other columns are not read.

    Returns query_id, rank (from 1), neighbour_id and distance.
    """
    spark = vectors.sparkSession
    codes = written(binary_codes(vectors, id_column, vector_column).filter("id is not null").distinct(), "codes")
    first = codes.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k)
    entries = written(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    wanted = codes.filter(F.col("id") % every == 0)
    found = entries.agg(F.count("*").alias("n"), F.max(F.octet_length("code")).alias("size")).first()
    words = max(1, -(-(found["size"] or 0) // 8))
    shards = max(min(shuffle_width(spark), _LEAST_SHARDS), -(-found["n"] // shard))
    right = entries.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "code", F.size("ids").alias("rows"))
    left = wanted.select("code").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "code", F.lit(0).alias("rows"))
    dealt = right.unionByName(left).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    answers = dealt.mapInArrow(_searched(k, words), "query binary, code binary, distance int, rows long")
    nearer = F.coalesce(F.sum("rows").over(W.partitionBy("query").orderBy("distance").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    answers = answers.withColumn("nearer", nearer).filter(F.col("nearer") < k)
    rows = answers.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour_id"))).filter(F.col("rank") <= k)
    return wanted.join(ranked, wanted["code"] == ranked["query"]).select(F.col("id").alias("query_id"), "rank", "neighbour_id", "distance")


ORACLE_OP5 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AND NOT isnan(x) AS INT)) AS bits FROM embeddings WHERE vec_id IS NOT NULL),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.bits[i] - v.bits[i]))) AS INT) AS distance FROM q, v),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INT) AS rank FROM d)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
