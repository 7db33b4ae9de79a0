"""Near copies by the similarity of their word shingles: candidates from SimHash and MinHash, each link verified on the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .shared import frugal, text_or_empty, written

# Bands of so many minimal hashes; a pair at 0.8 shares no band with a chance of 0.0023.
BANDS, BAND_ROWS = 20, 6
WORDS = 8  # of 64 parity bits
_HASHES = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
_FLIPS, _FACTORS = _HASHES[0][:, None], _HASHES[1][:, None] | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], shingle: int) -> set[bytes]:
    """The distinct runs of `shingle` words; fewer words make one, no words none."""
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))


def hashed(found: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, simhash.SEED) for x in found), np.uint64, len(found))


def parities(hashes: np.ndarray) -> list[int]:
    """For each of the places that shingles are hashed to, whether their number there is odd, in signed longs. Two
    sets differ in at least as many shingles as these bits do."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of the MinHash of a set, as signed longs."""
    if not len(hashes):
        return []
    least = np.full(len(_FLIPS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, k : k + 4096] ^ _FLIPS) * _FACTORS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, bits, sizes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = hashed(shingles(words, shingle))
                nodes.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
                prints.append(simhash.fingerprint(text))
                keys.append(bands(found))
                bits.append(parities(found))
                sizes.append(len(found))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "node", "fp", "bands", "bits", "size"])

    return run


def _hashed_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = hashed(shingles(words_of(text), shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], names=["node", "shingle"])

    return run


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, set()
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, left = a, shingles(words_of(a), shingle)
                right = shingles(words_of(b), shingle)
                both = len(left & right)
                keep.append(both > 0 and both >= similarity * (len(left) + len(right) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs(u, v) of nodes whose texts are similar."""
    left, right = texts.select(F.col("node").alias("v"), F.col("text").alias("a")), texts.select(F.col("node").alias("u"), F.col("text").alias("b"))
    return written(pairs.join(right, "u").join(left, "v").select("u", "v", "a", "b").mapInArrow(frugal(_similar(shingle, similarity)), "u long, v long"), "verified")


def _can_be_similar(similarity: float):
    """Whether two nodes a and b can have this similarity at all: what only one of them has is not in common,
    and the sets differ in at least as many shingles as their parity bits do."""
    common, sizes = F.least("a.shared", "b.shared"), F.col("a.size") + F.col("b.size")
    apart = sum(F.bit_count(F.get("a.bits", k).bitwiseXOR(F.get("b.bits", k))) for k in range(WORDS))
    return (common >= similarity * (sizes - common)) & ((1 + similarity) * apart <= (1 - similarity) * sizes + 1e-6)


def near_copies(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """id and component_id, the smallest id reachable by links of texts whose `shingle`-word shingles have a
    Jaccard similarity of `similarity` or more, a row for each distinct pair of these.

    Texts with the same words are one node. Nodes that share a MinHash band or a
    SimHash fingerprint, or have fingerprints within the operator's reach, are in
    one bucket. Shingles that no other node of any bucket has are counted, and
    with parity bits of the sets bound what two nodes can have in common: nodes,
    and later pairs, that can't be similar go. A bucket's head is the node that has the least of its own (the
    original, where there is one). Each node is compared with the best of its
    heads; then with its other heads that are in another component; then, where
    a bucket still has several components, the pairs across these that can be
    similar are compared, each in the first bucket that has both. So a large
    group of near copies makes rows in proportion to its size, and every link is
    verified on the texts. Null and empty texts are one node and link to no
    other; rows without an id are left out; texts of any length are taken
    whole; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(docs, text_column).alias("text")).filter("id is not null")
    marked = written(rows.mapInArrow(frugal(_marks(shingle)), "id long, text string, node long, fp long, bands array<long>, bits array<long>, size int"), "near-marks")
    nodes = written(marked.groupBy("node").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size")), "near-nodes")
    near = simhash.near_links(nodes.select("fp").distinct())
    other = F.lit(BANDS).alias("slot")
    linked = near.select(other, F.xxhash64("u", "v").alias("key"), F.explode(F.array("u", "v")).alias("fp")).join(nodes, "fp").select("slot", "key", "node")
    equal = nodes.select(other, F.xxhash64("fp").alias("key"), "node")
    buckets = written(marked.select(F.posexplode("bands").alias("slot", "key"), "node").unionByName(equal).unionByName(linked).distinct(), "near-buckets")
    several = lambda df: df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = written(buckets.join(several(buckets), "key"), "near-members")

    wanted = written(buckets.select("node").distinct().join(nodes, "node").select("node", F.col("first").alias("id"), "size"), "near-wanted")
    sent = wanted.select("node", "id")
    texts = marked.join(F.broadcast(sent) if sent.count() <= 2_000_000 else sent, ["node", "id"])  # two longs a row
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "candidate-texts")
    single = texts.select("node", "text").mapInArrow(frugal(_hashed_shingles(shingle)), "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    own = single.groupBy("node").agg(F.count("*").alias("own"))
    weighed = wanted.join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")).filter((F.col("shared") > 0) & (F.col("shared") >= similarity * F.col("size")))
    buckets = written(buckets.join(weighed.join(texts.select("node", "bits"), "node"), "node"), "near-weighed")

    best = F.max(F.struct((F.col("shared") / F.col("size")).alias("share"), "node", "size", "shared", "bits")).alias("b")
    heads = buckets.groupBy("key").agg(F.count("*").alias("n"), best).filter("n > 1").select("key", "b.share", "b.node", "b.size", "b.shared", "b.bits")
    stars = buckets.alias("a").join(heads.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & _can_be_similar(similarity))
    stars = written(stars.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), "b.share").distinct(), "near-stars")
    nearest = stars.groupBy("u").agg(F.max(F.struct("share", "v"))["v"].alias("v"))  # the most original of all heads first
    links = _verified(nearest, texts, shingle, similarity)
    parts = written(connected_components(links), "near-parts")
    component = lambda c, name: F.coalesce(F.col(f"{name}.component"), F.col(c))
    apart = stars.join(parts.alias("p"), F.col("u") == F.col("p.node"), "left").join(parts.alias("q"), F.col("v") == F.col("q.node"), "left").filter(component("u", "p") != component("v", "q"))
    apart = written(apart.select("u", "v").join(nearest, ["u", "v"], "left_anti"), "near-apart")
    links = links.unionByName(_verified(apart, texts, shingle, similarity))
    parts = written(connected_components(links), "near-parts")

    cells = buckets.join(parts, "node", "left").select("key", "slot", "node", "size", "shared", "bits", F.coalesce("component", "node").alias("component"))
    open_keys = cells.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    cells = written(cells.join(open_keys, "key").join(texts.select("node", "bands"), "node"), "near-cells")
    first_slot = F.array_position(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), True) - 1
    first_slot = F.when(first_slot < 0, BANDS).otherwise(first_slot)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & _can_be_similar(similarity) & (F.col("a.slot") == first_slot)
    across = cells.alias("a").join(cells.alias("b"), on).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
    done = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    across = written(across.join(done, ["u", "v"], "left_anti"), "near-across")
    more = _verified(across, texts, shingle, similarity)
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    of_node = simhash.component_names(nodes.select(F.col("node").alias("key"), "first"), parts, "key").withColumnRenamed("key", "node")
    return marked.select("id", "node").join(of_node, "node").select(F.col("id").alias(id_column), "component_id").distinct()
