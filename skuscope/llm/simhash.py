"""SimHash near-duplicates: a grid range join of segment bit counts, then exact distances."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import broadcast_few, frugal, shuffled, text_or_empty, written

SEED = 42
_ODD_BITS = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text's word shingles, as a signed long.

    A-Z are lower-cased, words are runs of anything but the six ASCII white
    spaces; fewer words than a shingle has make one shingle, no words 0. A bit
    is 1 if it is set in over half the shingles' XXH64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 4096)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return run


def segment_counts(fp: Column) -> Column:
    """The bit counts (0, 1 or 2) of a fingerprint's 32 two-bit segments, each
    written as that many ones: the Manhattan distance of two embeddings is then
    the number of bits in which these codes differ."""
    either = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_ODD_BITS))
    twice = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_ODD_BITS))
    return either.bitwiseOR(F.shiftleft(twice, 1))


_EQUAL = 3 / 8  # chance that two random two-bit segments have the same bit count


def _blocks(blocks: int) -> list[int]:
    """The bits of each of so many blocks of segments."""
    return [sum(3 << 2 * int(k) for k in part) for part in np.array_split(np.arange(32), blocks)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def grid_for(n: int, distance: int) -> tuple[int, int]:
    """(blocks, dropped) of the grid for n fingerprints: the coarsest one in which a fingerprint expects less than one random cell mate.

    Of a pair within reach, some choice of `dropped` blocks leaves at most
    reach_of(...) to the others. Two blocks with neighbouring cells are a
    coarse grid of few cells a fingerprint; finer ones drop as many blocks as
    bits may differ and need more cells.
    """
    plans = [(2, 1)] if distance == 3 else []
    plans += [(distance + k, distance) for k in (3, 5, 7, 9, 13, 17) if distance + k <= 32]
    for blocks, dropped in plans:
        kept = 32 * (blocks - dropped) / blocks
        neighbours = 1 + 4 * kept / 3 * reach_of(distance, blocks, dropped)
        if math.comb(blocks, dropped) * _EQUAL**kept * neighbours * n < 1:
            break
    return blocks, dropped


def reach_of(distance: int, blocks: int, dropped: int) -> int:
    """How far apart the embeddings of a pair within `distance` can be in the blocks that stay when the `dropped` most different ones go."""
    return min(distance - dropped, distance * (blocks - dropped) // blocks)


def _cells(coded: DataFrame, distance: int, blocks: int, dropped: int) -> DataFrame:
    """fp, code -> a row for each table (choice of blocks that stay) and cell: the fingerprint's own cell,
    and as a probe (own false) each neighbouring cell one step further out in one segment, where a step is in reach."""
    code = F.col("code")
    found = []
    for table, chosen in enumerate(itertools.combinations(range(blocks), blocks - dropped)):
        mask = sum(_blocks(blocks)[k] for k in chosen)
        kept = code.bitwiseAND(F.lit(_signed(mask)))
        found.append(F.struct(F.lit(table).alias("table"), kept.alias("cell"), F.lit(True).alias("own")))
        if reach_of(distance, blocks, dropped):
            for k in (k for k in range(32) if mask >> 2 * k & 3):
                one, two = F.lit(_signed(1 << 2 * k)), F.lit(_signed(2 << 2 * k))
                further = F.when(code.bitwiseAND(one) == 0, kept.bitwiseOR(one)).when(code.bitwiseAND(two) == 0, kept.bitwiseOR(two))
                found.append(F.struct(F.lit(table).alias("table"), further.alias("cell"), F.lit(False).alias("own")))
    return coded.select("fp", "code", F.inline(F.array(*found))).filter("cell is not null")


def _first_table(table: Column, apart: Column, blocks: int, dropped: int) -> Column:
    """Of the tables in which a pair is in one cell, whether this is the first: the blocks that are dropped
    though the pair is equal in them all come before those that stay."""
    musts = []
    for chosen in itertools.combinations(range(blocks), blocks - dropped):
        after = [_blocks(blocks)[k] for k in range(chosen[0] + 1, blocks) if k not in chosen]
        musts.append([*map(_signed, after), *[-1] * (dropped - len(after))])
    columns = [F.get(F.array(*[F.lit(m[k]) for m in musts]), table) for k in range(dropped)]
    conditions = [(mask == -1) | (apart.bitwiseAND(mask) != 0) for mask in columns]
    return functools.reduce(lambda x, y: x & y, conditions)


def _local_stars(distance: int):
    """Within a pair of chunks of a crowded cell: links each fingerprint to the smallest one of its local component."""

    def run(key, table):
        fp = np.unique(table.column("fp").to_numpy())
        raw = fp.view(np.uint64)
        near = np.bitwise_count(raw[:, None] ^ raw[None, :]) <= distance
        label = np.arange(len(fp))
        while True:
            lower = np.where(near, label[None, :], len(fp)).min(axis=1)
            lower = np.minimum(lower, lower[lower])
            if (lower == label).all():
                break
            label = lower
        own = label != np.arange(len(fp))
        return pa.table({"u": fp[own], "v": fp[label[own]]})

    return run


def near_links(fingerprints: DataFrame, *, distance: int = 3, grid: tuple[int, int] | None = None, crowded: int = 64, chunk: int = 1000) -> DataFrame:
    """fingerprints(fp), distinct -> links(u, v) with the components of all pairs within `distance` bits.

    A fingerprint is embedded as its segments' bit counts. The Manhattan
    distance of two embeddings is at most their Hamming distance, so a range
    join of the embeddings finds every pair. Its grid is made of blocks of
    segments: for each choice of blocks that stay, a cell holds equal counts in
    these, and cells one step apart are joined where that is within reach
    (`reach_of`). The grid comes from the number of fingerprints (`grid_for`),
    so that random cell mates stay fewer than fingerprints. Pairs within the
    Manhattan bound are verified bit by bit, and each comes out of one table.

    Cells of up to `crowded` fingerprints emit their pairs. In larger ones
    (groups of near copies) all that are near the cell's least fingerprint are
    linked to it, and the rest is compared with the whole cell by pairs of
    chunks of about `chunk`, each a task's group, which give links to local
    representatives.
    """
    blocks, dropped = grid or grid_for(fingerprints.count(), distance)
    coded = fingerprints.select("fp", segment_counts(F.col("fp")).alias("code"))
    cells = _cells(coded, distance, blocks, dropped)
    members = cells.groupBy("table", "cell").agg(F.count("*").alias("n"), F.min(F.when(F.col("own"), F.col("fp"))).alias("least")).filter("n > 1 and least is not null")
    cells = written(cells.drop("code").join(shuffled(members), ["table", "cell"]), "cells")
    few = cells.filter(F.col("n") <= crowded).select("table", "cell", "fp", "own", segment_counts(F.col("fp")).alias("code"))
    same_cell = (F.col("a.table") == F.col("b.table")) & (F.col("a.cell") == F.col("b.cell"))
    pairs = few.alias("a").join(shuffled(few.filter("own")).alias("b"), same_cell & (~F.col("a.own") | (F.col("a.fp") < F.col("b.fp"))))
    apart = F.col("a.code").bitwiseXOR(F.col("b.code"))
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    once = F.lit(True) if reach_of(distance, blocks, dropped) else _first_table(F.col("a.table"), apart, blocks, dropped)
    links = pairs.filter(F.bit_count(apart) <= distance).filter(exact).filter(once).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v"))

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= distance
    many = cells.filter(F.col("n") > crowded)
    stars = many.filter(near & (F.col("fp") != F.col("least"))).select(F.col("fp").alias("u"), F.col("least").alias("v"))
    far = many.filter(~near)
    sizes = broadcast_few(far.groupBy("table", "cell").agg(F.count("*").alias("far")).select("table", "cell", F.ceil(F.col("far") / chunk).cast("int").alias("far_chunks")))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    part = lambda of: F.pmod(F.xxhash64("fp"), of).cast("int")
    left = far.join(sizes, ["table", "cell"]).select("table", "cell", part(F.col("far_chunks")).alias("i"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("j"), "fp")
    right = many.join(sizes, ["table", "cell"]).select("table", "cell", F.explode(F.sequence(F.lit(0), F.col("far_chunks") - 1)).alias("i"), part(chunks).alias("j"), "fp")
    found = left.unionByName(right).groupBy("table", "cell", "i", "j").applyInArrow(_local_stars(distance), "u long, v long")
    return links.unionByName(stars).unionByName(found).distinct()


def component_names(nodes: DataFrame, parts: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """nodes(key, first), parts(node, component) -> key and component_id, the least `first` of the key's component.
    Nodes without a link need no name but their own; the others are joined by component and a salt, so a large component is many keys."""
    linked = nodes.join(shuffled(parts), nodes[key] == parts["node"], "left").select(key, "first", "component")
    members = linked.filter("component is not null")
    named = members.groupBy("component").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = members.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(shuffled(named), ["component", "salt"])
    return joined.select(key, "component_id").unionByName(linked.filter("component is null").select(key, F.col("first").alias("component_id")))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links of at most `distance` bits.

    Documents with equal fingerprints are one node, so copies are never paired.
    Null, empty and white-space texts have fingerprint zero and are linked like
    any other; null ids get a component but never name one; repeated rows have
    a row each; an empty table gives an empty result; other columns are not read.
    """
    marked = written(docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(docs, text_column).alias("text")).mapInArrow(frugal(_fingerprints(shingle)), "id long, fp long"), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    of_fp = component_names(nodes, connected_components(near_links(nodes.select("fp"), distance=distance)), "fp")
    return marked.join(shuffled(of_fp), "fp").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
