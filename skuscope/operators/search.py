"""Centroids, exact top-k search, leave-one-out ranks and impostor scores over embedding tables.

Vectors that were made differently never meet: backend and background treatment
are part of every key. Pairs are scored block by block with NumPy inside
tasks; blocks of a large category go to many tasks, so no category is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.functions.vectors import l2_normalize, matrix, unit_rows
from skuscope.sources.scratch import stored

KEY = ["category_slug", "backend", "remove_bg"]


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], pair: Callable, schema: str, left_rows: int = 4096, right_rows: int = 8192, few_groups: int = 100_000) -> DataFrame:
    """pair(key, left block, right block) over all pairs of blocks of each group that both sides have.

    Each group has as many blocks as its own rows need, so small groups aren't
    copied for the sake of large ones. The number of blocks a group is
    broadcast for up to `few_groups` groups and joined by a shuffle beyond.
    """
    right = right.toDF(*right.columns)  # its own columns, also where both sides come from one table
    blocks = lambda df, rows, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = blocks(left, left_rows, "_a").join(blocks(right, right_rows, "_b"), keys)
    sizes = F.broadcast(sizes) if sizes.limit(few_groups + 1).count() <= few_groups else sizes.hint("merge")
    left = left.join(sizes, keys).withColumn("lb", F.pmod(F.xxhash64(*left_id), F.col("_a")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_a", "_b")
    right = right.join(sizes, keys).withColumn("rb", F.pmod(F.xxhash64(*right_id), F.col("_b")).cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("_a") - 1))).drop("_a", "_b")
    on = [*keys, "lb", "rb"]

    def both(key, x, y):
        out = pair(key, x, y) if x.num_rows and y.num_rows else None
        return out if out is not None else empty

    empty = pa.Table.from_pylist([], _arrow(schema))
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(both, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in schema.split(","))])


def _partial_sums(most: int = 20_000):
    """Sums of the vectors of each SKU that a task has, for up to `most` SKUs at a time."""

    def run(batches):
        held: dict[tuple, list] = {}

        def rows():
            out = [(*key, total.tolist(), n, first) for key, (total, n, first) in held.items()]
            held.clear()
            names = [*KEY, "sku", "total", "n", "first_pos"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int64()))], names=names)

        for batch in batches:
            vectors = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            names = list(zip(*(batch.column(c).to_pylist() for c in (*KEY, "sku"))))
            positions = batch.column("row_pos").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                values = matrix(vectors.take(pa.array(at)))
                codes: dict[tuple, int] = {}
                code = np.fromiter((codes.setdefault(names[k], len(codes)) for k in at), np.int64, len(at))
                order = np.argsort(code, kind="stable")
                starts = np.searchsorted(code[order], np.arange(len(codes)))
                sums, firsts = np.add.reduceat(values[order], starts, axis=0), np.minimum.reduceat(positions[at][order], starts)
                counts = np.diff(np.append(starts, len(at)))
                for key, k in codes.items():
                    own = held.get(key)
                    if own is None:
                        held[key] = [sums[k], int(counts[k]), int(firsts[k])]
                    else:
                        total = np.zeros(max(size, len(own[0])))
                        total[: len(own[0])] += own[0]
                        total[:size] += sums[k]
                        held[key] = [total, own[1] + int(counts[k]), min(own[2], int(firsts[k]))]
            if len(held) > most:
                yield rows()
        if held:
            yield rows()

    return run


def sku_sums(vectors: DataFrame, salts: int = 64) -> DataFrame:
    """The sum of each SKU's vectors and their number: by task first, then by SKU and salt, then by SKU."""
    parts = vectors.select(*KEY, "sku", "row_pos", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_partial_sums(), "category_slug string, backend string, remove_bg boolean, sku string, total array<double>, n long, first_pos long")
    added = F.aggregate(F.slice(F.col("totals"), 2, F.greatest(F.size("totals") - 1, F.lit(0))), F.get("totals", 0), lambda a, x: F.zip_with(a, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0))))
    merge = lambda df, *by: df.groupBy(*KEY, "sku", *by).agg(F.collect_list("total").alias("totals"), F.sum("n").alias("n"), F.min("first_pos").alias("first_pos")).withColumn("total", added).drop("totals")
    salted = merge(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))), "salt")
    return merge(salted).select(*KEY, "sku", "total", F.col("n").alias("n_vectors"), "first_pos")


def sku_centroids(vectors: DataFrame) -> DataFrame:
    """The unit mean of each SKU's vectors; a zero mean stays as it is."""
    return centroids_of(sku_sums(vectors))


def centroids_of(sums: DataFrame) -> DataFrame:
    """The centroids of a table of `sku_sums`."""
    mean = F.transform("total", lambda x: x / F.col("n_vectors"))
    return sums.select(*KEY, "sku", l2_normalize(mean).alias("centroid"), "n_vectors", "first_pos")


def _best(k: int, query_column: str):
    def pair(key, left, right):
        scores = matrix(left.column("embedding")) @ matrix(right.column("embedding")).T
        skus, code = np.unique(np.array(right.column("sku").to_pylist(), object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        best = np.maximum.reduceat(scores[:, order], np.searchsorted(code[order], np.arange(len(skus))), axis=1)
        least = np.partition(best, len(skus) - k, axis=1)[:, len(skus) - k] if len(skus) > k else np.full(len(best), -np.inf)
        row, column = np.nonzero(best >= least[:, None])
        order = np.lexsort((column, -best[row, column], row))  # ties go to the smaller SKU
        row, column = row[order], column[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, column = row[keep], column[keep]
        return pa.table({query_column: left.column(query_column).take(pa.array(row)), "category_slug": pa.array([key[0].as_py()] * len(row), pa.string()), "backend": pa.array([key[1].as_py()] * len(row), pa.string()), "sku": pa.array(skus[column].tolist(), pa.string()), "similarity_score": best[row, column]})

    return pair


def search_topk(queries: DataFrame, index: DataFrame, k: int | None = 10, *, scoring: str = "centroid", default_k: int = 10) -> DataFrame:
    """The k best SKUs of each query in its category: query_id, category_slug, backend, sku, similarity_score, rank.

    index has one vector a SKU (column centroid) or, with scoring "image_max",
    one an image (column embedding), where a SKU counts with its best image.
    Ties go to the smaller SKU. k None is the default, 0 or less gives nothing.
    """
    k = default_k if k is None else k
    by_image = ["row_pos"] if scoring == "image_max" else []
    index = index.select(*KEY, "sku", *by_image, F.col("embedding" if by_image else "centroid").alias("embedding"))
    queries = queries.select(*KEY, "query_id", "embedding")
    kind = queries.schema["query_id"].dataType.simpleString().replace("bigint", "long")
    if k <= 0:
        index = index.limit(0)
    found = block_pairs(queries, index, KEY, ["query_id"], ["sku", *by_image], _best(max(k, 1), "query_id"), f"query_id {kind}, category_slug string, backend string, sku string, similarity_score double")
    found = found.groupBy("query_id", "category_slug", "backend", "sku").agg(F.max("similarity_score").alias("similarity_score"))
    return rank_results(found, ["query_id", "category_slug", "backend"]).filter(F.col("rank") <= k)


def rank_results(df: DataFrame, by=("query_id",)) -> DataFrame:
    """1-based ranks by similarity, ties by SKU."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("similarity_score"), "sku")))


def search_products_table(queries: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Search over the products' own embedding columns: category without regard to case, the
    column by the query's dimension, products without that vector left out."""
    by_size = F.when(F.size("embedding") == 768, "embedding_768").when(F.size("embedding") == 512, "embedding_512")
    found = None
    for column in ("embedding_768", "embedding_512"):
        side = products.filter(F.col(column).isNotNull()).select(F.lower("category").alias("category_slug"), F.lit(column).alias("backend"), F.lit(False).alias("remove_bg"), "sku", F.col(column).alias("centroid"))
        found = side if found is None else found.unionByName(side)
    queries = queries.select(F.lower("category").alias("category_slug"), by_size.alias("backend"), F.lit(False).alias("remove_bg"), "query_id", "embedding").filter("backend is not null")
    return search_topk(queries, found, k).select("query_id", "sku", "similarity_score", "rank")


def _loo(key, left, right):
    vectors, totals = matrix(left.column("embedding")), matrix(left.column("total"))
    own = (vectors * unit_rows(totals - vectors)).sum(axis=1)
    scores = vectors @ unit_rows(matrix(right.column("total"))).T
    skus, firsts = np.array(right.column("sku").to_pylist(), object), right.column("first_pos").to_numpy()
    own_sku, own_first = np.array(left.column("sku").to_pylist(), object), left.column("own_first").to_numpy()
    other = skus[None, :] != own_sku[:, None]
    better = other & ((scores > own[:, None]) | (scores == own[:, None]) & (firsts[None, :] < own_first[:, None]))
    masked = np.where(other, scores, -np.inf)
    order = np.argsort(firsts, kind="stable")
    best = order[masked[:, order].argmax(axis=1)]
    some = other.any(axis=1)
    return pa.table({
        "row_pos": left.column("row_pos"), "category_slug": pa.array([key[0].as_py()] * len(own), pa.string()), "backend": pa.array([key[1].as_py()] * len(own), pa.string()), "sku": left.column("sku"), "own_score": own,
        "better": better.sum(axis=1), "rival": pa.array([skus[j] if ok else None for j, ok in zip(best, some)], pa.string()), "rival_score": pa.array([float(masked[i, j]) if ok else None for i, (j, ok) in enumerate(zip(best, some))], pa.float64()),
    })


def loo_ranks(vectors: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Leave-one-out: each image of a SKU with two or more is a query against its category's centroids,
    its own SKU's made without it: rank of the true SKU, and the best SKU with its score.

    A centroid without one image is the SKU's sum less that image, scaled to
    unit length. SKUs of one image are only rivals. Equal scores rank the SKU
    that came first. sums: a stored table of the vectors' `sku_sums`, which is made where there is none.
    """
    sums = stored(sku_sums(vectors), "sums") if sums is None else sums
    several = sums.filter("n_vectors >= 2").select(*KEY, "sku", "total", F.col("first_pos").alias("own_first"))
    queries = vectors.select(*KEY, "sku", "row_pos", "embedding").join(several, [*KEY, "sku"])
    schema = "row_pos long,category_slug string,backend string,sku string,own_score double,better long,rival string,rival_score double"
    part = block_pairs(queries, sums.select(*KEY, "sku", "total", "first_pos"), KEY, ["row_pos"], ["sku"], _loo, schema, 2048, 4096)
    best = F.max(F.when(F.col("rival").isNotNull(), F.struct("rival_score", "rival")))
    whole = part.groupBy("row_pos", "category_slug", "backend", "sku").agg(F.max("own_score").alias("own_score"), (F.sum("better") + 1).alias("rank"), best.alias("best"))
    wins = (F.col("rank") > 1) & F.col("best").isNotNull()
    return whole.select("row_pos", "category_slug", "backend", "sku", "rank", F.when(wins, F.col("best.rival")).otherwise(F.col("sku")).alias("top_sku"), F.when(wins, F.col("best.rival_score")).otherwise(F.col("own_score")).alias("top_score"), "own_score")


def _same(key, left, right):
    scores = matrix(left.column("embedding")) @ matrix(right.column("embedding")).T
    scores[left.column("row_pos").to_numpy()[:, None] == right.column("row_pos").to_numpy()[None, :]] = -np.inf
    best = scores.max(axis=1)
    keep = np.isfinite(best)
    return pa.table({"row_pos": left.column("row_pos").to_numpy()[keep], "score": best[keep]})


def loo_image_max(vectors: DataFrame) -> DataFrame:
    """Each image's best similarity to another image of its SKU; images that are their SKU's only one have no row."""
    side = vectors.select(*KEY, "sku", "row_pos", "embedding")
    found = block_pairs(side, side, [*KEY, "sku"], ["row_pos"], ["row_pos"], _same, "row_pos long,score double", 2048, 2048)
    best = found.groupBy("row_pos").agg(F.max("score").alias("score"))
    return side.select("row_pos", "category_slug", "backend", "sku").join(best, "row_pos")


def _foreign(key, left, right):
    scores = matrix(left.column("embedding")) @ matrix(right.column("embedding")).T
    own, targets = np.array(left.column("category_slug").to_pylist(), object), np.array(right.column("category_slug").to_pylist(), object)
    out_pos, out_target, out_score = [], [], []
    for target in sorted(set(targets)):
        rows = own != target
        if rows.any():
            best = scores[np.ix_(rows, targets == target)].max(axis=1)
            out_pos.append(left.column("row_pos").to_numpy()[rows])
            out_target += [target] * len(best)
            out_score.append(best)
    if not out_pos:
        return None
    return pa.table({"row_pos": np.concatenate(out_pos), "backend": pa.array([key[0].as_py()] * len(out_target), pa.string()), "target_slug": pa.array(out_target, pa.string()), "score": np.concatenate(out_score)})


def impostor_scores(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """Each image's best similarity to the SKUs of every other category of its backend: row_pos, backend, target_slug, score."""
    keys = ["backend", "remove_bg"]
    left = vectors.select(*keys, "category_slug", "row_pos", "embedding")
    right = index.select(*keys, "category_slug", "sku", F.col("centroid").alias("embedding"))
    found = block_pairs(left, right, keys, ["row_pos"], ["sku"], _foreign, "row_pos long,backend string,target_slug string,score double", 2048, 4096)
    return found.groupBy("row_pos", "backend", "target_slug").agg(F.max("score").alias("score"))


def index_stats(vectors: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per category: vectors, SKUs, dimension, how many vectors have each dimension, backend, per_image or per_sku, whether
    every SKU has one vector; with ids (category_slug, row_pos, sku) their number, and whether it differs from the vectors'."""
    by_size = vectors.groupBy("category_slug", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    dims = by_size.groupBy("category_slug").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dim", "n")))).alias("n_by_dim"))
    found = vectors.groupBy("category_slug").agg(F.count("*").alias("n_vectors"), F.countDistinct("sku").alias("n_skus"), F.max(F.size("embedding")).alias("dim"), F.max("backend").alias("backend")).join(dims, "category_slug")
    found = found.withColumn("vectors", F.when(F.col("n_vectors") != F.col("n_skus"), "per_image").otherwise("per_sku")).withColumn("one_each", F.col("n_vectors") == F.col("n_skus"))
    if ids is None:
        return found
    known = ids.groupBy("category_slug").agg(F.count("*").alias("n_ids"))
    return found.join(known, "category_slug", "full").fillna(0, ["n_ids", "n_vectors"]).withColumn("mismatch", F.col("n_ids") != F.col("n_vectors"))


def dominant_backend(products: DataFrame) -> DataFrame:
    """The most frequent backend of each category's products, ties by name."""
    counts = products.filter("embedding_backend is not null").groupBy(F.lower("category").alias("category"), "embedding_backend").count()
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.desc("count"), "embedding_backend")))
    return ranked.filter("r = 1").select("category", F.col("embedding_backend").alias("backend"), F.col("count").alias("n_products"))
