"""Catalog maintenance, lookups, relations and reports over products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.functions import text as t

# The catalog's own columns.
UPSERTED = ["product_name", "brand", "category", "description", "manufacturer_part_number", "attributes", "image_paths", "replacement_sku", "alternative_skus", "accessory_skus", "compatible_vehicles"]


def list_products(df: DataFrame, category: str | None = None, brand: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """By category, else by brand, else all from `offset` on; in order of SKU."""
    limit = min(max(limit, 1), 200)
    if category is not None:
        return df.filter(F.col("category") == category).orderBy("sku").limit(limit)
    if brand is not None:
        return df.filter(F.col("brand") == brand).orderBy("sku").limit(limit)
    return df.orderBy("sku").offset(offset).limit(limit)


def get_product(df: DataFrame, sku: str) -> DataFrame:
    return df.filter(F.col("sku") == sku)


def exists(df: DataFrame, sku: str) -> bool:
    return not get_product(df, sku).limit(1).isEmpty()


def search_products(df: DataFrame, query: str = "", category: str | None = None, brand: str | None = None, limit: int | None = None) -> DataFrame:
    """Products whose name, SKU or brand has the query in it, whatever its case."""
    needle = F.lit(query.strip().lower())
    hit = F.lower("product_name").contains(needle) | F.lower("sku").contains(needle) | F.lower("brand").contains(needle)
    found = df.filter(hit)
    if category:
        found = found.filter(F.col("category") == category)
    if brand:
        found = found.filter(F.col("brand") == brand)
    return found if limit is None else found.orderBy("sku").limit(limit)


def filter_fitment(df: DataFrame, query: str) -> DataFrame:
    """compatible_vehicles that have the query in "make model"."""
    needle = query.strip().lower()
    return df.withColumn("compatible_vehicles", F.filter("compatible_vehicles", lambda v: F.lower(F.concat(v["make"], F.lit(" "), v["model"])).contains(needle)))


def validate_products(df: DataFrame) -> DataFrame:
    """Products with the reasons against each; an empty array means it is valid."""
    reasons = [F.when(F.coalesce(t.strip(F.col(c)), F.lit("")) == "", F.lit(f"{c} is blank")) for c in ("sku", "product_name", "brand", "category")]
    blank = lambda c: F.coalesce(t.strip(c), F.lit("")) == ""
    bad_name = F.exists("compatible_vehicles", lambda v: blank(v["make"]) | blank(v["model"]))
    bad_year = F.exists("compatible_vehicles", lambda v: v["year"].isNull() | (v["year"] < 1900) | (v["year"] > 2100))
    reasons += [F.when(bad_name, F.lit("vehicle without a name")), F.when(bad_year, F.lit("vehicle year out of range"))]
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def validate_seeds(df: DataFrame, most: int = 25) -> DataFrame:
    """Session candidates with the reasons against each."""
    n = F.count("*").over(W.partitionBy("session_id"))
    reasons = [F.when(n > most, F.lit("too many candidates")), F.when(~F.coalesce(F.col("similarity").between(-1, 1), F.lit(False)), F.lit("similarity out of range")), F.when(F.coalesce(t.strip(F.col("sku")), F.lit("")) == "", F.lit("sku is blank"))]
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def upsert_products(existing: DataFrame, incoming: DataFrame, columns=None) -> DataFrame:
    """Inserts or updates by SKU: the listed columns are replaced, all others keep their values.

    A SKU that comes twice in one batch stops the job.
    """
    columns = [c for c in (columns or UPSERTED) if c in existing.columns]
    n = F.count("*").over(W.partitionBy("sku"))
    batch = incoming.withColumn("n", n).select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate sku "), "sku"))).otherwise(F.col("sku")).alias("sku"), F.struct(*columns).alias("new"))
    both = existing.withColumn("old", F.lit(True)).join(batch, "sku", "full")
    changed = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns}
    return both.select(*[changed.get(c, F.col(c)) for c in existing.columns])


def apply_product_changes(products: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes(sku, op, fields map) -> products after them, and the rejected changes with a reason.

    create needs a new SKU, update and delete a known one; update touches only
    the fields given. At most one change a SKU in a batch.
    """
    text_columns = [f.name for f in products.schema.fields if f.name != "sku" and f.dataType.simpleString() == "string"]
    joined = products.withColumn("known", F.lit(True)).join(changes.select("sku", "op", "fields"), "sku", "full")
    known = F.coalesce("known", F.lit(False))
    reason = F.when((F.col("op") == "create") & known, "conflict").when(F.col("op").isin("update", "delete") & ~known, "not found")
    joined = joined.withColumn("reason", reason)
    rejects = joined.filter("reason is not null").select("sku", "op", "reason")
    takes = F.col("reason").isNull() & F.col("op").isin("create", "update")
    new = {c: F.when(takes & F.map_contains_key("fields", F.lit(c)), F.try_element_at("fields", F.lit(c))).otherwise(F.col(c)).alias(c) for c in text_columns}
    stays = known | ((F.col("op") == "create") & F.col("reason").isNull())
    deleted = F.coalesce((F.col("op") == "delete") & F.col("reason").isNull(), F.lit(False))
    return joined.filter(stays & ~deleted).select(*[new.get(c, F.col(c)) for c in products.columns]), rejects


def attach_embeddings(products: DataFrame, vectors: DataFrame, mode: str = "last") -> DataFrame:
    """vectors(sku, row_pos, embedding, backend) into the column of their dimension; of several a SKU the last row,
    or with mode "centroid" their unit mean. Unknown backends and dimensions are left out."""
    from skuscope.operators.search import sku_centroids

    usable = vectors.filter((F.col("backend") != "unknown") & F.size("embedding").isin(768, 512))
    if mode == "last":
        one = usable.groupBy("sku").agg(F.max_by(F.struct("embedding", "backend"), "row_pos").alias("v")).select("sku", "v.*")
    else:
        sides = usable.select(F.lit("").alias("category_slug"), F.concat_ws("/", "backend", F.size("embedding")).alias("backend"), F.lit(False).alias("remove_bg"), "sku", "row_pos", "embedding")
        one = sku_centroids(sides).select("sku", F.split("backend", "/")[0].alias("backend"), F.col("centroid").cast("array<float>").alias("embedding"))
    wide = one.groupBy("sku").agg(*[F.max(F.when(F.size("embedding") == d, F.col("embedding"))).alias(f"embedding_{d}") for d in (768, 512)], F.max("backend").alias("embedding_backend"))
    return products.drop("embedding_768", "embedding_512", "embedding_backend").join(wide, "sku", "left")


def unattached_vectors(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """What attach_embeddings leaves out: sku, rows and the reason (no product, unknown backend, other dimension)."""
    reason = F.when(F.coalesce(F.col("backend"), F.lit("unknown")) == "unknown", "unknown backend").when(~F.coalesce(F.size("embedding"), F.lit(0)).isin(768, 512), "other dimension")
    known = products.select("sku").distinct().withColumn("known", F.lit(True))
    joined = vectors.withColumn("reason", reason).join(known, "sku", "left")
    joined = joined.withColumn("reason", F.coalesce("reason", F.when(F.col("known").isNull(), "no product")))
    return joined.filter("reason is not null").groupBy("sku", "reason").agg(F.count("*").alias("n"))


def drift_report(vectors: DataFrame, products: DataFrame) -> DataFrame:
    """SKUs with vectors and no product, and the other way round."""
    a, b = vectors.select("sku").distinct(), products.select("sku").distinct()
    return a.join(b, "sku", "left_anti").withColumn("reason", F.lit("no product")).unionByName(b.join(a, "sku", "left_anti").withColumn("reason", F.lit("no vectors")))


def repoint_image_paths(products: DataFrame, urls: DataFrame, force: bool = False) -> DataFrame:
    """Image paths replaced by urls(sku, image_paths), unless all are hosted already; `updated` says where."""
    joined = products.join(urls.select("sku", F.col("image_paths").alias("hosted")), "sku", "left")
    done = F.forall("image_paths", lambda p: p.startswith("http")) & (F.size("image_paths") > 0)
    take = F.col("hosted").isNotNull() & (F.lit(force) | ~done)
    return joined.withColumn("updated", take).withColumn("image_paths", F.when(take, F.col("hosted")).otherwise(F.col("image_paths"))).drop("hosted")


def recommend(products: DataFrame) -> DataFrame:
    """sku, kind, position, related_sku: alternatives (replacement first, each once, never itself) and
    accessories (as given), without SKUs that have no product."""
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    chain = F.filter(F.array_distinct(F.concat(F.array("replacement_sku"), some("alternative_skus"))), lambda x: x.isNotNull() & (x != F.col("sku")))
    alternatives = products.select("sku", F.lit("alternative").alias("kind"), F.posexplode(chain).alias("position", "related_sku"))
    accessories = products.select("sku", F.lit("accessory").alias("kind"), F.posexplode(some("accessory_skus")).alias("position", "related_sku"))
    known = products.select(F.col("sku").alias("related_sku"))
    return alternatives.unionByName(accessories).join(known, "related_sku").select("sku", "kind", "position", "related_sku")


def relationships(products: DataFrame) -> DataFrame:
    """Each product with its replacement's name, null if there is none."""
    other = products.select(F.col("sku").alias("replacement_sku"), F.col("product_name").alias("replacement_name"))
    return products.join(other, "replacement_sku", "left").select("sku", "replacement_sku", "replacement_name")


def enrich_candidates(results: DataFrame, products: DataFrame, top: int = 3) -> DataFrame:
    """The first ranks with their product's name, brand and category, or stand-ins for them."""
    info = products.select("sku", "product_name", "brand", F.col("category").alias("own_category"))
    joined = results.filter(F.col("rank") <= top).join(info, "sku", "left")
    return joined.select("query_id", "rank", "sku", "similarity_score", F.coalesce("product_name", "sku").alias("product_name"), F.coalesce("brand", F.lit("Unknown")).alias("brand"), F.coalesce("own_category", "category").alias("category"))


def ring_alternatives(df: DataFrame) -> DataFrame:
    """alternative_sku: the next SKU of the category, of the last the first; null if there is one only."""
    w = W.partitionBy("category").orderBy("sku")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = F.coalesce(F.lead("sku").over(w), F.first("sku").over(whole))
    return df.withColumn("alternative_sku", F.when(F.count("*").over(whole) >= 2, following))


def best_splitter(products: DataFrame) -> DataFrame:
    """Of each category with two products or more: the attribute that all have with several values and the smallest largest share."""
    sizes = products.groupBy("category").agg(F.count("*").alias("n")).filter("n >= 2")
    values = products.select("category", F.explode("attributes").alias("key", "value")).groupBy("category", "key", "value").count()
    keys = values.groupBy("category", "key").agg(F.sum("count").alias("total"), F.max("count").alias("worst"), F.count("*").alias("distinct_values"))
    good = keys.join(sizes, "category").filter((F.col("total") == F.col("n")) & (F.col("distinct_values") > 1))
    best = good.groupBy("category").agg(F.min(F.struct("worst", "key", "distinct_values")).alias("b"))
    return sizes.join(best, "category", "left").select("category", "n", F.coalesce("b.key", F.lit("none")).alias("splitter"), F.col("b.distinct_values").alias("distinct_values"), F.col("b.worst").alias("worst"))


def empty_attributes(products: DataFrame) -> DataFrame:
    return products.filter(F.size("attributes") == 0).select("sku")


def import_report(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("products"), F.sum(F.size("image_paths")).alias("images"), F.sum(F.size("compatible_vehicles")).alias("vehicle_years"), F.sum(F.size("skipped_vehicles")).alias("unparsed"), F.count_if(F.size("image_paths") == 0).alias("without_images")
    )


def filter_options(products: DataFrame) -> DataFrame:
    """kind and value of the filters: distinct categories and brands."""
    return products.select(F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("value")))).alias("o")).select("o.*").distinct()


def catalog_stats(products: DataFrame) -> DataFrame:
    """Products per category, per brand and in all."""
    return products.groupingSets([["category"], ["brand"], []], "category", "brand").agg(F.count("*").alias("n"))
