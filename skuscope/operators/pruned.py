"""Exact search that leaves out blocks which can't hold a result.

An index is cut into blocks around centres. A block's vectors x are within its
radius r of its centre c, so q.x <= q.c + |q| r. A first round searches the block
whose bound is best for each query; its k-th score is a threshold, and the second
round searches only blocks whose bound reaches it. What comes out is what
`search_topk` gives over all blocks. Blocks lie in pieces of some thousand rows: a
query goes once to a piece in which it has blocks, with the list of these, so also
where few blocks can be left out its vector is not sent block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.functions.vectors import matrix
from skuscope.operators.search import KEY, block_pairs, rank_results
from skuscope.sources.scratch import stored

_SLACK = 1e-9  # of a bound, for rounding


@dataclass
class CutIndex:
    """vectors (key, sku, row_pos, embedding, block) and blocks (key, block, embedding of the centre, radius, n), both stored."""

    vectors: DataFrame
    blocks: DataFrame


def _nearest(key, left, right):
    x, c = matrix(left.column("embedding")), matrix(right.column("embedding"))
    squares = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :]
    at = squares.argmin(axis=1)
    distance = np.linalg.norm(x - c[at], axis=1)
    return pa.table({"sku": left.column("sku"), "row_pos": left.column("row_pos"), **_of(key, len(x)), "block": right.column("block").take(pa.array(at)), "distance": distance})


def _of(key, n: int) -> dict[str, pa.Array]:
    kinds = (pa.string(), pa.string(), pa.bool_())
    return {c: pa.array([k.as_py()] * n, t) for c, k, t in zip(KEY, key, kinds)}


def cut_index(index: DataFrame, rows_a_block: int = 4096, most_blocks: int = 1024) -> CutIndex:
    """Cuts index(key, sku, row_pos, embedding) into about as many blocks a group as its rows need, at most some `most_blocks`.

    Centres are vectors of the group, picked by the hash of their place (the one
    with the smallest hash always); each vector goes to the nearest. So all
    centres of a group are a bounded table, however many vectors it has, and
    larger blocks are dealt to several tasks where they are searched.
    """
    index = index.select(*KEY, "sku", "row_pos", F.col("embedding").cast("array<double>").alias("embedding"))
    ticket = F.pmod(F.xxhash64("row_pos", "sku"), F.lit(1 << 30))
    sizes = index.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(ticket).alias("least"))
    share = F.least(F.ceil(F.col("n") / rows_a_block), F.lit(most_blocks)) / F.col("n")
    picked = index.withColumn("ticket", ticket).join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, KEY).filter((F.col("ticket") < share * (1 << 30)) | (F.col("ticket") == F.col("least")))
    centres = stored(picked.select(*KEY, F.row_number().over(W.partitionBy(*KEY).orderBy("ticket", "row_pos", "sku")).alias("block"), "embedding"), "centres")
    near = block_pairs(index, centres, KEY, ["sku", "row_pos"], ["block"], _nearest, "sku string,row_pos long,category_slug string,backend string,remove_bg boolean,block int,distance double", 8192, 1 << 30)
    placed = stored(index.join(near.hint("merge"), [*KEY, "sku", "row_pos"]), "cut-index")
    radius = placed.groupBy(*KEY, "block").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    return CutIndex(placed.drop("distance"), stored(centres.join(radius, [*KEY, "block"]), "blocks"))


def _bounds(left, right) -> np.ndarray:
    q = matrix(left.column("embedding"))
    radius = right.column("radius").to_numpy()
    bound = q @ matrix(right.column("embedding")).T + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
    return bound + _SLACK * (1 + np.abs(bound))


def _likeliest(key, left, right):
    at = pa.array(_bounds(left, right).argmax(axis=1))
    return pa.table({"query_id": left.column("query_id"), **_of(key, len(at)), "piece": right.column("piece").take(at), "block": right.column("block").take(at)})


def _within(key, left, right):
    right = right.sort_by([("piece", "ascending"), ("block", "ascending")])
    blocks, piece = right.column("block").to_numpy(), right.column("piece").to_numpy()
    reach = _bounds(left, right) >= left.column("threshold").to_numpy()[:, None]
    reach &= left.column("first").to_numpy()[:, None] != blocks[None, :]
    row, column = np.nonzero(reach)
    fresh = np.ones(len(row), bool)  # where a query or a piece begins
    fresh[1:] = (row[1:] != row[:-1]) | (piece[column[1:]] != piece[column[:-1]])
    starts = np.flatnonzero(fresh)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(blocks[column], pa.int32()))
    return pa.table({"query_id": left.column("query_id").take(pa.array(row[starts])), **_of(key, len(starts)), "piece": pa.array(piece[column[starts]], pa.int32()), "blocks": lists})


def _best_in_blocks(k: int, query_rows: int = 256):
    """The k best SKUs of each query among its own blocks of a piece; so many queries are scored at a time."""

    def pair(key, left, right):
        skus, code = np.unique(np.array(right.column("sku").to_pylist(), object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        vectors, starts = matrix(right.column("embedding"))[order], np.searchsorted(code[order], np.arange(len(skus)))
        blocks, at = np.unique(right.column("block").to_numpy()[order], return_inverse=True)
        places = [np.flatnonzero(at == b) for b in range(len(blocks))]
        found = []
        for part in (left.slice(n, query_rows) for n in range(0, len(left), query_rows)):
            queries, lists = matrix(part.column("embedding")), part.column("blocks").combine_chunks()
            row, own = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            here = np.isin(own, blocks)  # a large piece is dealt to several tasks, which have some of its blocks
            visits = np.zeros((len(part), len(blocks)), bool)
            visits[row[here], np.searchsorted(blocks, own[here])] = True
            scores = np.full((len(part), len(vectors)), -np.inf)
            for b in np.flatnonzero(visits.any(axis=0)):
                who = np.flatnonzero(visits[:, b])
                scores[np.ix_(who, places[b])] = queries[who] @ vectors[places[b]].T
            best = np.maximum.reduceat(scores, starts, axis=1)
            least = np.partition(best, len(skus) - k, axis=1)[:, len(skus) - k] if len(skus) > k else np.full(len(best), -np.inf)
            row, column = np.nonzero((best >= least[:, None]) & (best > -np.inf))
            order = np.lexsort((column, -best[row, column], row))  # ties go to the smaller SKU
            row, column = row[order], column[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column = row[keep], column[keep]
            columns = {"query_id": part.column("query_id").take(pa.array(row)), **dict(list(_of(key, len(row)).items())[:2])}
            found.append(pa.table(columns | {"sku": pa.array(skus[column].tolist(), pa.string()), "similarity_score": best[row, column]}))
        return pa.concat_tables(found)

    return pair


def search_pruned(queries: DataFrame, cut: CutIndex, k: int = 10, piece_rows: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """`search_topk` with scoring "image_max" over a cut index (with one vector a SKU: over its centroids), and the blocks that
    each query was compared with (key, query_id, block). Query ids are unique within a key; k is at least 1."""
    queries = queries.select(*KEY, "query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = queries.schema["query_id"].dataType.simpleString()
    on = [*KEY, "query_id"]
    place = f"query_id {kind},category_slug string,backend string,remove_bg boolean,piece int"
    scored = f"query_id {kind},category_slug string,backend string,sku string,similarity_score double"
    before = F.sum("n").over(W.partitionBy(*KEY).orderBy("block")) - F.col("n")
    blocks = stored(cut.blocks.withColumn("piece", F.floor(before / piece_rows).cast("int")), "pieces")
    pieces = blocks.select(*KEY, "block", "piece")
    pieces = F.broadcast(pieces) if pieces.limit(100_001).count() <= 100_000 else pieces.hint("merge")
    vectors = cut.vectors.join(pieces, [*KEY, "block"])
    first = stored(block_pairs(queries, blocks, KEY, ["query_id"], ["block"], _likeliest, f"{place},block int", 8192, 1 << 30), "first-blocks")

    def compared(visits: DataFrame, name: str) -> DataFrame:
        # A row of visits is a few bytes of a file, so Spark would broadcast millions of them
        found = block_pairs(queries.join(visits.hint("merge"), on), vectors, [*KEY, "piece"], ["query_id"], ["sku", "row_pos"], _best_in_blocks(k), scored, 16_384, 2 * piece_rows)
        return stored(found.groupBy("query_id", "category_slug", "backend", "sku").agg(F.max("similarity_score").alias("similarity_score")), name)

    by = ["query_id", "category_slug", "backend"]
    one = compared(first.select(*on, "piece", F.array("block").alias("blocks")), "first-scores")
    least = rank_results(one, by).filter(F.col("rank") == k).select(*by, F.col("similarity_score").alias("threshold"))
    waiting = queries.join(first.select(*on, F.col("block").alias("first")).hint("merge"), on).join(least.hint("merge"), by, "left").fillna(float("-inf"), ["threshold"])
    more = stored(block_pairs(waiting, blocks, KEY, ["query_id"], ["block"], _within, f"{place},blocks array<int>", 8192, 1 << 30), "more-blocks")
    both = one.unionByName(compared(more, "more-scores")) if more.limit(1).count() else one
    found = both.groupBy(*by, "sku").agg(F.max("similarity_score").alias("similarity_score"))
    visited = first.select(*on, "block").unionByName(more.select(*on, F.explode("blocks").alias("block")))
    return rank_results(found, by).filter(F.col("rank") <= k), visited


def impostors_pruned(vectors: DataFrame, cut: CutIndex) -> DataFrame:
    """`impostor_scores` over a cut index of the centroids: each image's best similarity to each foreign category of its backend."""
    targets = cut.blocks.select("backend", "remove_bg", F.col("category_slug").alias("target")).distinct()
    sides = vectors.select("backend", "remove_bg", "category_slug", "row_pos", "embedding").join(targets, ["backend", "remove_bg"]).filter("category_slug <> target")
    found, _ = search_pruned(sides.select(F.col("target").alias("category_slug"), "backend", "remove_bg", F.col("row_pos").alias("query_id"), "embedding"), cut, 1)
    return found.select(F.col("query_id").alias("row_pos"), "backend", F.col("category_slug").alias("target_slug"), F.col("similarity_score").alias("score"))
