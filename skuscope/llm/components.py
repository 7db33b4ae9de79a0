"""Connected components of links between long ids: contracted within tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, shuffled, temporary_tables, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars: each node with the least one that it reaches by them."""
    found = [batch for batch in batches if len(batch)]
    if not found:
        return
    ends = [np.concatenate([batch.column(k).to_numpy() for batch in found]) for k in (0, 1)]
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    left, right = np.split(place, 2)
    least = np.arange(len(nodes))
    while (apart := least[left] != least[right]).any():
        a, b = least[left[apart]], least[right[apart]]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (further := least[least]).tobytes() != least.tobytes():
            least = further
    own = least != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[least[own]])], names=["u", "v"])


def connected_components(links: DataFrame, *, task_links: int = 1_000_000) -> DataFrame:
    """links(u, v) -> (node, component), component the smallest node reachable.

    Tasks of at most about `task_links` links first replace theirs by stars, at
    most one link a node. Where there is one such task, these are the components.
    Beyond, each round hangs the larger neighbours of every node on its smallest one
    (large star), then the smaller ones (small star), until nothing changes:
    a number of rounds that grows with the logarithm of the longest path. A
    node's smallest neighbour is a grouped minimum that is joined back: a hub's
    links pass through that join one by one, in one task unless adaptive execution
    splits it, and are never held as a group. Rounds are cut by tables in the
    shared folder. Nodes without a link (or linked to themselves only) have no row.
    """
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    spark = links.sparkSession
    with temporary_tables(spark) as made:  # of the rounds only the last one's table stays
        edges = written(links.filter("u <> v").select(big, small), "links")
        tasks = -(-edges.count() // task_links)
        dealt = edges.repartition(tasks) if tasks > 1 else edges.coalesce(1)
        stars = dealt.mapInArrow(frugal(_stars), "u long, v long")
        edges = _rounds(stars.distinct()) if tasks > 1 else written(stars, "links")
        made.pop()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _rounds(links: DataFrame) -> DataFrame:
    edges = written(links, "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(shuffled(least), "u")
        stars = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(stars.distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            return edges
