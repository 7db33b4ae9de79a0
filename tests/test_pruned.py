"""Pruned search against the search over all blocks: same rows, fewer block pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuscope.operators import pruned as pr
from skuscope.operators import search as se

VECTORS = "category_slug string, backend string, remove_bg boolean, sku string, row_pos long, embedding array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [("hot", "dinov2", True, f"s{i % 40}", i, (centres[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [("few", "dinov2", True, "one", 5000, [1.0] * 8), ("few", "dinov2", True, "one", 5001, [1.0] * 8), ("few", "openclip", True, "two", 5002, [0.0] * 8)]
    rows += [("hot", "dinov2", True, "s1", 6000 + i, rows[0][5]) for i in range(30)]  # repeated vectors
    return spark.createDataFrame(rows, VECTORS)


def rows(df):
    return sorted((str(r.query_id), r.category_slug, r.backend, r.sku, r["rank"], round(r.similarity_score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 100])
def test_same_rows_fewer_pairs(clustered, k):
    queries = clustered.select("category_slug", "backend", "remove_bg", F.col("row_pos").alias("query_id"), "embedding")
    cut = pr.cut_index(clustered, rows_a_block=40)
    found, visited = pr.search_pruned(queries, cut, k)
    assert rows(found) == rows(se.search_topk(queries, clustered, k, scoring="image_max"))
    every = queries.join(cut.blocks.select(*se.KEY, "block"), se.KEY).count()
    assert visited.distinct().count() == visited.count() <= every
    if k < 10:
        assert visited.count() < every / 2


def test_blocks_hold_every_vector_within_their_radius(clustered):
    cut = pr.cut_index(clustered, rows_a_block=40)
    assert cut.vectors.count() == clustered.count() and cut.blocks.agg(F.sum("n")).first()[0] == clustered.count()
    radius = {(r.category_slug, r.backend, r.block): (np.array(r.embedding), r.radius) for r in cut.blocks.collect()}
    for r in cut.vectors.collect():
        centre, most = radius[r.category_slug, r.backend, r.block]
        assert np.linalg.norm(np.array(r.embedding) - centre) <= most + 1e-12
    assert len({k for k in radius if k[0] == "hot"}) > 10
    assert pr.cut_index(clustered, rows_a_block=1, most_blocks=5).blocks.filter("category_slug = 'hot'").count() < 20


def test_impostors(clustered, spark):
    other = clustered.filter("category_slug = 'hot'").withColumn("category_slug", F.concat(F.lit("c"), F.col("row_pos") % 4)).withColumn("embedding", F.reverse("embedding"))
    vectors = clustered.unionByName(other)
    centroids = se.sku_centroids(vectors)
    cut = pr.cut_index(centroids.withColumn("row_pos", F.col("first_pos")).withColumnRenamed("centroid", "embedding"), rows_a_block=8)
    side = lambda df: sorted((r.row_pos, r.backend, r.target_slug, round(r.score, 9)) for r in df.collect())
    own = vectors.filter("category_slug = 'hot'")
    assert side(pr.impostors_pruned(own, cut)) == side(se.impostor_scores(own, centroids))


def test_nothing_to_search(clustered):
    queries = clustered.select("category_slug", "backend", "remove_bg", F.col("row_pos").alias("query_id"), "embedding")
    assert pr.search_pruned(queries, pr.cut_index(clustered.limit(0)), 3)[0].count() == 0
    assert pr.search_pruned(queries.limit(0), pr.cut_index(clustered), 3)[0].count() == 0


def test_blocks_to_visit_are_not_broadcast_nor_sent_with_a_vector_each(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([("c", "dinov2", True, f"s{i % 30}", i, rng.normal(size=16).tolist()) for i in range(1500)], VECTORS)  # nothing to leave out
    queries = vectors.select("category_slug", "backend", "remove_bg", F.col("row_pos").alias("query_id"), "embedding")
    plans, sent = [], []

    def noted(left, right, keys, *rest, pairs=pr.block_pairs):
        if any(k in keys for k in ("block", "piece")):  # where vectors are compared
            plans.append(left._jdf.queryExecution().executedPlan().toString())
            sent.append(left.count())
        return pairs(left, right, keys, *rest)

    cut = pr.cut_index(vectors, rows_a_block=16)
    monkeypatch.setattr(pr, "block_pairs", noted)
    found, visited = pr.search_pruned(queries, cut, 5)
    assert visited.count() > 1500 * 50
    assert sent == [1500, 1500] and not any("Broadcast" in plan for plan in plans)
    assert rows(found) == rows(se.search_topk(queries, vectors, 5, scoring="image_max"))


@pytest.mark.parametrize("piece_rows", [1, 100])
def test_pieces_of_a_group_give_the_same_rows(clustered, piece_rows):
    queries = clustered.select("category_slug", "backend", "remove_bg", F.col("row_pos").alias("query_id"), "embedding")
    cut = pr.cut_index(clustered, rows_a_block=40)
    found, visited = pr.search_pruned(queries, cut, 5, piece_rows)
    assert rows(found) == rows(se.search_topk(queries, clustered, 5, scoring="image_max")) and visited.distinct().count() == visited.count()
