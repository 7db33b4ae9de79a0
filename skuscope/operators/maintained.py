"""Tables that follow their source by deltas: products, sums of vectors, vectors of new images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuscope.functions.vectors import unit_rows
from skuscope.operators import catalog as ca
from skuscope.operators.search import KEY, sku_sums
from skuscope.sources.buckets import BucketedTable
from skuscope.sources.scratch import stored

# Products.


def upsert_into(table: BucketedTable, batch_id: str, incoming: DataFrame, columns=None) -> bool:
    """`upsert_products` of a batch, in the buckets it touches."""
    return table.merge(batch_id, incoming, lambda old, new: ca.upsert_products(old, new, columns))


def change_in(table: BucketedTable, batch_id: str, changes: DataFrame) -> tuple[bool, DataFrame]:
    """`apply_product_changes` of a batch, in the buckets it touches: whether it is new, and its rejects (none of a batch done before)."""
    rejects = stored(ca.apply_product_changes(table.read(), changes)[1], "rejects") if not table._exists("done", batch_id) else changes.limit(0).select("sku", "op", F.lit("").alias("reason"))
    return table.merge(batch_id, changes, lambda old, new: ca.apply_product_changes(old, new)[0]), rejects


def confirm_in(table: BucketedTable, batch_id: str, confirmations: DataFrame) -> bool:
    """`apply_confirmations` of a batch, in the buckets it touches; an audit row without a confirmation in the batch keeps its own."""
    from skuscope.operators.audit import apply_confirmations

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        before = old.filter("confirmed_at is not null").select("id", "confirmed_at", "confirmed_sku", "disambiguation")
        return apply_confirmations(old, before.unionByName(new, allowMissingColumns=True))[0].drop("corrected")

    return table.merge(batch_id, confirmations, merged)


# Sums of vectors.

SUMS = "category_slug string, backend string, remove_bg boolean, sku string, total array<double>, n_vectors long, first_pos long"


def update_sums(table: BucketedTable, batch_id: str, added: DataFrame, removed: DataFrame, vectors: DataFrame | None = None) -> bool:
    """Adds the sums of added vectors and takes off those of removed ones, SKU by SKU; a SKU without vectors goes.

    Where a SKU's first vector is removed, its first position is looked up in
    `vectors` (the vectors as they are after the batch); without them it stays.
    Sums of doubles drift by rounding, as much as a sum in another order does.
    """
    plus, minus = sku_sums(added), sku_sums(removed)
    minus = minus.select(*KEY, "sku", F.transform("total", lambda x: -x).alias("total"), (-F.col("n_vectors")).alias("n_vectors"), F.lit(None).cast("long").alias("first_pos"), F.col("first_pos").alias("gone"))
    delta = stored(plus.withColumn("gone", F.lit(None).cast("long")).unionByName(minus), "delta-sums")

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        whole = old.withColumn("gone", F.lit(None).cast("long")).unionByName(new)
        added_up = F.aggregate(F.slice("totals", 2, F.greatest(F.size("totals") - 1, F.lit(0))), F.get("totals", 0), lambda a, x: F.zip_with(a, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0))))
        # At most three rows a SKU: what was there, what came and what went.
        sums = whole.groupBy(*KEY, "sku").agg(F.collect_list("total").alias("totals"), F.sum("n_vectors").alias("n_vectors"), F.min("first_pos").alias("first_pos"), F.min("gone").alias("gone")).filter("n_vectors > 0").withColumn("total", added_up)
        if vectors is None:
            return sums
        lost = sums.filter("gone <= first_pos").select(*KEY, "sku")
        first = vectors.join(lost, [*KEY, "sku"], "left_semi").groupBy(*KEY, "sku").agg(F.min("row_pos").alias("now"))
        return sums.join(first, [*KEY, "sku"], "left").withColumn("first_pos", F.coalesce("now", "first_pos"))

    return table.merge(batch_id, delta, merged)


# Vectors of new images.


def embed_new(images: DataFrame, done: DataFrame, loaders: dict[str, Callable[[], Callable]], *, column: str = "data", tta: bool = True, width: int = 64) -> DataFrame:
    """Vectors of what no run has encoded yet: digest, backend, remove_bg, embedding, reason.

    images(backend, remove_bg, `column`, ...): an input counts by the SHA-256 of its
    content, its backend and its background treatment; done(digest, backend,
    remove_bg, ...) has those encoded before. Equal inputs are encoded once. Inputs
    are dealt by backend and a salt, so a task holds one model at a time (loaders
    has for each backend what loads it; other backends are left out, with a
    reason) and a backend with most of the images has many tasks. Null inputs are left out.
    """
    content = F.sha2(F.col(column).cast("binary") if not images.schema[column].dataType.simpleString().startswith("array") else F.to_json(column).cast("binary"), 256)
    keyed = images.filter(F.col(column).isNotNull()).select(content.alias("digest"), "backend", "remove_bg", F.col(column).alias("input"))
    on = ["digest", "backend", "remove_bg"]
    new = keyed.dropDuplicates(on).join(done.select(*on), on, "left_anti")
    dealt = new.repartition(width, "backend", F.pmod(F.hash("digest"), F.lit(width))).sortWithinPartitions("backend")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, Callable | None] = (None, None)
        for frame in frames:
            for backend, part in frame.groupby("backend", sort=True):
                if backend not in loaders:
                    yield _encoded(part, [(None, "no encoder for the backend")] * len(part))
                    continue
                if held[0] != backend:
                    held = (backend, loaders[backend]())
                yield _encoded(part, _vectors(held[1], list(part["input"]), tta))

    return dealt.mapInPandas(run, "digest string, backend string, remove_bg boolean, embedding array<float>, reason string")


def _encoded(part: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"digest": part["digest"].values, "backend": part["backend"].values, "remove_bg": part["remove_bg"].values, "embedding": [v for v, _ in found], "reason": [r for _, r in found]})


def _vectors(encode: Callable, inputs: list, tta: bool) -> list[tuple]:
    """Unit vectors of all inputs at once; where one fails, row by row, to tell which."""

    def of(some: list) -> list[tuple]:
        sides = [unit_rows(np.asarray(encode(some, mirrored), np.float64)) for mirrored in ((False, True) if tta else (False,))]
        return [(v, None) for v in unit_rows(np.mean(sides, axis=0)).astype("float32").tolist()]

    try:
        return of(inputs)
    except Exception:  # noqa: BLE001  an encoder may fail in any way
        out = []
        for x in inputs:
            try:
                out += of([x])
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"))
        return out


def embed_into(images: DataFrame, path: str, loaders: dict[str, Callable[[], Callable]], *, column: str = "data", tta: bool = True, width: int = 64) -> dict[str, int]:
    """Encodes what is new of images and appends it to the table of done inputs at path; failures stay out, and come again in the next run.

    Returns how many were encoded and how many failed, counted as the rows were written.
    """
    from pyspark.sql import Observation

    spark = images.sparkSession
    schema = "digest string, backend string, remove_bg boolean, embedding array<float>"
    done = spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)
    seen = Observation("embed")
    found = embed_new(images, done, loaders, column=column, tta=tta, width=width)
    counted = found.observe(seen, F.count_if(F.col("reason").isNull()).alias("encoded"), F.count_if(F.col("reason").isNotNull()).alias("failed"))
    counted.filter("reason is null").drop("reason").write.mode("append").parquet(path)
    return seen.get


def _there(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def with_vectors(images: DataFrame, done: DataFrame, column: str = "data") -> DataFrame:
    """images with the vectors of their content, null where there is none."""
    content = F.sha2(F.col(column).cast("binary") if not images.schema[column].dataType.simpleString().startswith("array") else F.to_json(column).cast("binary"), 256)
    return images.withColumn("digest", content).join(done, ["digest", "backend", "remove_bg"], "left").drop("digest")
