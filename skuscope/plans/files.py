"""Registered queries that write the catalog's files and read them again: CSV, images, sidecars, vector tables, audit rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuscope.functions import images as im
from skuscope.functions import text as t
from skuscope.operators import catalog as ca
from skuscope.plans import tables as d
from skuscope.plans.catalogue import AU, IV, registered
from skuscope.sources import catalog as src
from skuscope.sources.scratch import shared_path


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with all that a catalog CSV holds: quotes, line ends, blanks, lists and vehicles."""
    p = d.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku"), "p_size")
    vehicles = F.transform(F.sequence(F.lit(2000), F.lit(2000) + F.col("p_size") % 4), lambda y: F.struct(F.lit("Make").alias("make"), F.concat(F.lit("M"), F.col("p_size")).alias("model"), y.alias("year")))
    made = d.products(spark, sf_dir).join(p, "sku").withColumn("compatible_vehicles", vehicles).withColumn("description", F.concat(F.lit('Says "'), "product_name", F.lit('",\nsecond line')))
    return made.withColumn("brand", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("brand")))


def _read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "catalog-csv")
    src.write_catalog_csv(_catalog(spark, sf_dir), path)
    return src.catalog_to_products(src.read_catalog_csv(spark, path))


CSV = """cs AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, CASE WHEN p_size % 7 = 0 THEN 'Unknown' ELSE p_brand END AS brand, p_type AS category, 'Says "' || p_name || '",' || chr(10) || 'second line' AS description, 'M' || p_partkey % 700 AS manufacturer_part_number,
CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) END AS replacement_sku, (p_partkey + 1) || ',' || (p_partkey + 2) || ',' || p_partkey AS alternatives, (p_partkey * 2) || ',' || (p_partkey * 2) AS accessories, CAST(p_size % 4 + 1 AS INT) AS vehicle_years, 'size=' || p_size % 4 || ';word=' || string_split(p_name, ' ')[1] AS attributes FROM part)"""


@registered(f"WITH {CSV} SELECT * FROM cs")
def catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _read_back(spark, sf_dir).select(
        "sku", "product_name", "brand", "category", "description", "manufacturer_part_number", "replacement_sku", F.array_join("alternative_skus", ",").alias("alternatives"), F.array_join("accessory_skus", ",").alias("accessories"),
        F.size("compatible_vehicles").alias("vehicle_years"), shown.alias("attributes"),
    )


@registered(
    f"WITH {IV}, im AS (SELECT sku, count(*) AS n FROM iv GROUP BY sku) SELECT count(*) AS products, CAST(sum(coalesce(n, 0)) AS BIGINT) AS images, CAST(sum(p_size % 4 + 1) AS BIGINT) AS vehicle_years, count(*) FILTER (WHERE p_size % 5 = 0) AS unparsed, count(*) FILTER (WHERE n IS NULL) AS without_images FROM part LEFT JOIN im ON im.sku = CAST(p_partkey AS VARCHAR)"
)
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an import with images by SKU, and with a vehicle entry in one of five products that can't be parsed."""
    path = shared_path(spark, "catalog-csv")
    src.write_catalog_csv(_catalog(spark, sf_dir), path)
    rows = src.read_catalog_csv(spark, path)
    odd = d.read(spark, sf_dir, "part").filter("p_size % 5 = 0").select(F.col("p_partkey").cast("string").alias("sku"), F.lit(" | Universal Fitment").alias("more"))
    rows = rows.join(odd, "sku", "left").withColumn("compatible_vehicles", F.concat("compatible_vehicles", F.coalesce("more", F.lit("")))).drop("more")
    return ca.import_report(src.catalog_to_products(rows, src.list_images(spark, _images(spark, sf_dir))))


def _gray_png(pixels: list[int]) -> bytes:
    """Eight rows of eight grey pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(pixels[k : k + 8]) for k in range(0, 64, 8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _images(spark: SparkSession, sf_dir: str) -> str:
    """Each vector as a picture, <sku>/<row>.png."""

    def drawn(frames):
        for frame in frames:
            level = [np.clip(np.floor((np.asarray(e, np.float64) + 1) * 127.5), 0, 255).astype(int).tolist() for e in frame["embedding"]]
            yield pd.DataFrame({"path": frame["sku"] + "/" + frame["row_pos"].astype(str) + ".png", "data": [_gray_png(x) for x in level]})

    root = shared_path(spark, "images")
    src.write_files(d.image_vectors(spark, sf_dir).select("sku", "row_pos", "embedding").mapInPandas(drawn, "path string, data binary"), root)
    return root


PX = "px AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS DOUBLE)) AS p FROM embeddings)"


@registered(
    f"""WITH {PX}, l AS (SELECT vec_id, list_avg(p) AS luma, unnest(list_transform(list_filter(range(64), lambda i: i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6), lambda i: p[i - 7] + p[i + 9] + p[i] + p[i + 2] - 4 * p[i + 1])) AS lap FROM px),
s AS (SELECT vec_id AS row_pos, any_value(luma) AS luma, var_pop(lap) AS sharpness FROM l GROUP BY vec_id)
SELECT row_pos, round(luma, 3) AS luma, round(sharpness, 2) AS sharpness, CASE WHEN sharpness < 40 THEN 'poor' WHEN sharpness < 120 OR luma < 40 OR luma > 215 THEN 'fair' ELSE 'good' END AS grade FROM s"""
)
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = im.image_quality(src.read_images(spark, f"{_images(spark, sf_dir)}/*"))
    row = F.regexp_extract("image.origin", r"(\d+)\.png$", 1).cast("long")
    return found.select(row.alias("row_pos"), F.round("luma", 3).alias("luma"), F.round("sharpness", 2).alias("sharpness"), "grade")


@registered(f"WITH {IV} SELECT sku, count(*) AS n, min(row_pos || '.png') AS first FROM iv GROUP BY sku")
def listed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = src.image_paths_by_sku(src.list_images(spark, _images(spark, sf_dir)))
    return found.select("sku", F.size("image_paths").cast("long").alias("n"), F.element_at(F.split(F.get("image_paths", 0), "/"), -1).alias("first"))


@registered(
    f"WITH {IV}, s AS (SELECT category_slug, sku, count(*) AS n FROM iv GROUP BY ALL) SELECT sku, category_slug || ' ' || sku AS product_name, category_slug AS category, sku AS manufacturer_part_number, 'images/' || sku AS image_folder, CAST(n AS VARCHAR) AS image_count, CASE WHEN count(*) OVER (PARTITION BY category_slug) >= 2 THEN coalesce(lead(sku) OVER (PARTITION BY category_slug ORDER BY sku), first_value(sku) OVER (PARTITION BY category_slug ORDER BY sku)) ELSE '' END AS alternative_sku FROM s"
)
def catalog_from_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = src.list_images(spark, _images(spark, sf_dir)).withColumn("category", F.concat(F.lit("C"), F.floor(F.col("sku").cast("int") / 5).cast("string")))
    return src.build_catalog_from_images(listed).select("sku", "product_name", "category", "manufacturer_part_number", "image_folder", "image_count", "alternative_sku")


@registered(
    "SELECT CAST(p_partkey AS VARCHAR) AS sku, p_partkey % 6 = 3 AS updated, CASE WHEN p_partkey % 6 = 3 THEN 'https://cdn/' || p_partkey WHEN p_partkey % 2 = 0 THEN 'https://img/' || p_partkey END AS image FROM part"
)
def repointed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.products(spark, sf_dir)
    urls = p.filter(F.col("sku").cast("int") % 3 == 0).select("sku", F.array(F.concat(F.lit("https://cdn/"), "sku")).alias("image_paths"))
    return ca.repoint_image_paths(p, urls).select("sku", "updated", t.displayable_image(F.col("image_paths")).alias("image"))


def _sidecars(spark: SparkSession, sf_dir: str) -> str:
    """Sidecars of each category: C9 has no meta, C8's meta says nothing, C7's ids can't be read, C6 has none."""
    root = shared_path(spark, "sidecars")
    iv = d.image_vectors(spark, sf_dir)
    skus = F.transform(F.sort_array(F.collect_list(F.struct("row_pos", "sku"))), lambda e: e["sku"])
    groups = iv.groupBy("category_slug", "backend").agg(F.to_json(skus).alias("ids"))
    ids = groups.filter("category_slug <> 'C6'").select(F.concat("category_slug", F.lit(".ids.json")).alias("path"), F.when(F.col("category_slug") == "C7", "[cut").otherwise(F.col("ids")).alias("data"))
    said = F.to_json(F.struct("backend", F.lit(True).alias("remove_bg"), F.lit("per_image").alias("vectors")))
    meta = groups.filter("category_slug <> 'C9'").select(F.concat("category_slug", F.lit(".meta.json")).alias("path"), F.when(F.col("category_slug") == "C8", "{}").otherwise(said).alias("data"))
    src.write_files(ids.unionByName(meta), root)
    return root


@registered(f"WITH {IV} SELECT category_slug, CAST(row_number() OVER (PARTITION BY category_slug ORDER BY row_pos) - 1 AS INT) AS row_pos, sku, CASE WHEN category_slug IN ('C8', 'C9') THEN 'unknown' ELSE backend END AS backend, CASE WHEN category_slug NOT IN ('C8', 'C9') THEN true END AS remove_bg FROM iv WHERE category_slug NOT IN ('C6', 'C7')")
def index_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_index_sidecars(spark, _sidecars(spark, sf_dir)).select("category_slug", "row_pos", "sku", "backend", "remove_bg")


@registered(f"WITH {IV} SELECT DISTINCT category_slug, CASE category_slug WHEN 'C6' THEN 'skipped: no ids' WHEN 'C7' THEN 'skipped: ids unreadable' WHEN 'C8' THEN 'backend unknown: not in meta' ELSE 'backend unknown: no meta' END AS problem FROM iv WHERE category_slug IN ('C6', 'C7', 'C8', 'C9')")
def sidecar_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.sidecar_problems(spark, _sidecars(spark, sf_dir))


@registered(f"WITH {IV}, k AS (SELECT * FROM iv WHERE category_slug <> 'C3' OR row_pos % 2 = 0) SELECT category_slug, backend, count(*) AS n, CAST(sum(row_pos) AS BIGINT) AS positions, CASE WHEN count(*) = count(DISTINCT sku) THEN 'per_sku' ELSE 'per_image' END AS vectors, CAST(max(len(e)) AS INT) AS dim, true AS remove_bg FROM k GROUP BY category_slug, backend")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written by category, one category then replaced alone, and read with how they were built."""
    path, iv = shared_path(spark, "vectors"), d.image_vectors(spark, sf_dir)
    src.write_vectors(iv, path)
    src.write_vectors(iv.filter("row_pos % 2 = 0"), path, only="C3")
    counts = src.read_vectors(spark, path).groupBy("category_slug").agg(F.count("*").alias("n"), F.sum("row_pos").alias("positions"))
    return counts.join(src.read_built(spark, path).drop("n_vectors"), "category_slug")


def _wide_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 768, 512 and (label 9) other dimensions; some of no known backend, some of no product."""
    label, row = (F.col(c) for c in ("label", "vec_id"))
    copies = F.when(label == 9, 1).when(label % 2 == 0, 12).otherwise(8)
    return d.read(spark, sf_dir, "embeddings").select(
        F.when(row % 13 == 0, F.concat(F.lit("X"), label)).otherwise((label * 5 + row % 5).cast("string")).alias("sku"), row.alias("row_pos"), F.when(row % 11 == 0, "unknown").otherwise(F.when(label % 2 == 0, "dinov2").otherwise("openclip")).alias("backend"),
        F.flatten(F.array_repeat("embedding", copies)).alias("embedding"),
    )


WV = "wv AS (SELECT CASE WHEN vec_id % 13 = 0 THEN 'X' || label ELSE CAST(label * 5 + vec_id % 5 AS VARCHAR) END AS sku, vec_id, CASE WHEN vec_id % 11 = 0 THEN 'unknown' WHEN label % 2 = 0 THEN 'dinov2' ELSE 'openclip' END AS backend, CASE WHEN label = 9 THEN 64 WHEN label % 2 = 0 THEN 768 ELSE 512 END AS dim, embedding FROM embeddings)"


@registered(f"WITH {WV}, u AS (SELECT sku, arg_max(struct_pack(b := backend, d := dim, x := CAST(embedding[1] AS DOUBLE)), vec_id) AS v FROM wv WHERE backend <> 'unknown' AND dim <> 64 GROUP BY sku) SELECT CAST(p_partkey AS VARCHAR) AS sku, v.b AS embedding_backend, CASE WHEN v.d = 768 THEN 768 WHEN v.d = 512 THEN 512 END AS dim, round(v.x, 5) AS first FROM part LEFT JOIN u ON u.sku = CAST(p_partkey AS VARCHAR)")
def attached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ca.attach_embeddings(d.products(spark, sf_dir), _wide_vectors(spark, sf_dir))
    held = F.coalesce("embedding_768", "embedding_512")
    return found.select("sku", "embedding_backend", F.when(held.isNotNull(), F.size(held)).alias("dim"), F.round(F.get(held, 0).cast("double"), 5).alias("first"))


@registered(f"WITH {WV} SELECT sku, CASE WHEN backend = 'unknown' THEN 'unknown backend' WHEN dim = 64 THEN 'other dimension' ELSE 'no product' END AS reason, count(*) AS n FROM wv WHERE backend = 'unknown' OR dim = 64 OR sku LIKE 'X%' GROUP BY ALL")
def unattached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.unattached_vectors(d.products(spark, sf_dir), _wide_vectors(spark, sf_dir))


@registered(f"WITH {AU} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(top_sku) AS matched FROM au GROUP BY ALL")
def audit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows appended in two batches, by day."""
    path, a = shared_path(spark, "audit-table"), d.audit(spark, sf_dir)
    src.append_audit(a.filter("id % 2 = 0"), path, "even")
    for _ in range(2):  # the second batch comes twice
        src.append_audit(a.filter("id % 2 = 1"), path, "odd")
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count("top_sku").alias("matched"))
