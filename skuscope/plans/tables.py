"""The catalog tables that the registered queries use, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("C"), F.col("label")).alias("category_slug"), F.when(F.col("label") % 2 == 0, "dinov2").otherwise("openclip").alias("backend"), F.lit(True).alias("remove_bg"),
        (F.col("label") * 5 + F.col("vec_id") % 5).cast("string").alias("sku"), F.col("vec_id").alias("row_pos"), "embedding",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_vectors(spark, sf_dir).select("category_slug", "backend", "remove_bg", F.col("row_pos").alias("query_id"), "embedding")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    p = ((F.col("vec_id") * 37) % 100) / 100
    label = lambda c: F.concat(F.lit("C"), c)
    ranking = F.array(F.struct(label(F.col("label")).alias("label"), p.alias("probability")), F.struct(label((F.col("label") + 1) % 10).alias("label"), ((1 - p) / 2).alias("probability")))
    return e.select(F.col("vec_id").alias("query_id"), ranking.alias("ranking"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector a backend for each query, as a query may be routed to either."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit("dinov2"), F.lit("openclip"))).alias("backend"), F.lit(True).alias("remove_bg"), "embedding")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    text = lambda c: c.cast("string")
    return p.select(
        text(key).alias("sku"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.concat(F.lit("M"), key % 700).alias("manufacturer_part_number"),
        F.when(key % 3 == 0, text(key + 1)).alias("replacement_sku"), F.array(text(key + 1), text(key + 2), text(key)).alias("alternative_skus"), F.array(text(key * 2), text(key * 2)).alias("accessory_skus"),
        F.create_map(F.lit("size"), text(F.col("p_size") % 4), F.lit("word"), F.split("p_name", " ")[0]).alias("attributes"), F.array(F.when(key % 2 == 0, F.concat(F.lit("https://img/"), key)).otherwise("local.png")).alias("image_paths"),
    )


def fitment_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n = (read(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    joined = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("l_partkey").cast("string").alias("sku"), F.col("n_name").alias("make"), F.col("c_mktsegment").alias("model"), F.year("o_orderdate").alias("year"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(read(spark, sf_dir, "events"))


def audit_rows(e: DataFrame) -> DataFrame:
    """Events (a table or a stream) as predictions with confirmations."""
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("predicted_category"), F.col("value").alias("confidence"), F.when(k % 4 != 0, k.cast("string")).alias("top_sku"),
        F.when(F.col("user_id") % 2 == 0, "dinov2").otherwise("openclip").alias("embedding_backend"), F.when(k % 3 == 0, (k - k % 2).cast("string")).alias("confirmed_sku"), F.col("user_id"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: one for each size of part and 400 keys, with those parts as candidates."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.concat_ws("-", F.col("p_size"), F.floor(F.col("p_partkey") / 400)).alias("session_id"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_brand").alias("brand"),
        ((F.col("p_partkey") * 7919) % 1000 / 1000).alias("similarity"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("M"), F.col("p_partkey") % 5)).alias("mpn"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part-number answer a session: that of the smallest SKU that has one."""
    c = candidates(spark, sf_dir)
    first = c.filter("mpn is not null").groupBy("session_id").agg(F.min_by("mpn", "sku").alias("mpn"))
    chosen = c.join(first, ["session_id", "mpn"]).groupBy("session_id").agg(F.array_sort(F.collect_set("sku")).alias("skus"), F.first("mpn").alias("label"))
    none, year = F.lit(None).cast("string"), F.lit(None).cast("int")
    return chosen.select("session_id", F.lit(0).alias("turn_no"), F.lit("mpn").alias("facet"), F.lit("Is one of these numbers on the part?").alias("prompt"), "label", "skus", none.alias("make"), none.alias("model"), year.alias("year_start"), year.alias("year_end"), F.lit(False).alias("skipped"))
