"""Reading and writing the catalog, image listings, vector tables and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skuscope.functions import text as t

# Fixed values of the catalog format.
CSV_COLUMNS = ["sku", "product_name", "brand", "category", "manufacturer_part_number", "compatible_vehicles", "replacement_sku", "alternative_sku", "accessory_skus", "description", "image_folder", "image_count", "attributes"]
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
MAX_UPLOAD = 10 * 1024 * 1024
# End of the fixed values.


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text rows of a catalog CSV by its header; rows without a SKU are dropped, missing columns are null."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in CSV_COLUMNS]
    return rows.select(*columns).filter(t.blank_to_null(F.col("sku")).isNotNull())


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files under <root>/<sku>/: sku, image_path, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    files = files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png|webp)$"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("sku"), F.col("path").alias("image_path"), "length")


def image_paths_by_sku(images: DataFrame) -> DataFrame:
    return images.groupBy("sku").agg(F.sort_array(F.collect_list("image_path")).alias("image_paths"))


def catalog_to_products(rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Flat CSV rows as products: names and brands filled in, blanks null, lists split, vehicles a row a year, attributes parsed."""
    sku = t.strip(F.col("sku"))
    products = rows.select(
        sku.alias("sku"),
        F.coalesce(t.blank_to_null(F.col("product_name")), sku).alias("product_name"),
        F.coalesce(t.blank_to_null(F.col("brand")), F.lit("Unknown")).alias("brand"),
        t.strip(F.col("category")).alias("category"),
        *[t.blank_to_null(F.col(c)).alias(c) for c in ("description", "manufacturer_part_number", "replacement_sku")],
        t.split_list(F.col("alternative_sku")).alias("alternative_skus"),
        t.split_list(F.col("accessory_skus")).alias("accessory_skus"),
        t.parse_vehicles(F.col("compatible_vehicles")).alias("compatible_vehicles"),
        t.skipped_vehicles(F.col("compatible_vehicles")).alias("skipped_vehicles"),
        t.parse_attributes(F.col("attributes")).alias("attributes"),
    )
    empty = F.array().cast("array<string>")
    if images is None:
        return products.withColumn("image_paths", empty)
    return products.join(image_paths_by_sku(images), "sku", "left").withColumn("image_paths", F.coalesce("image_paths", empty))


def build_catalog_from_images(images: DataFrame) -> DataFrame:
    """images(category, sku, image_path) -> a CSV row for each SKU that has images, with the next SKU of its category as alternative."""
    from skuscope.operators.catalog import ring_alternatives

    rows = images.groupBy("category", "sku").agg(F.count("*").alias("n"))
    rows = ring_alternatives(rows)
    name = F.concat_ws(" ", "category", "sku")
    blank = F.lit("")
    values = {"sku": F.col("sku"), "product_name": name, "category": F.col("category"), "manufacturer_part_number": F.col("sku"), "image_folder": F.concat(F.lit("images/"), "sku"), "image_count": F.col("n").cast("string"), "alternative_sku": F.coalesce("alternative_sku", blank)}
    return rows.select(*[values.get(c, blank).alias(c) for c in CSV_COLUMNS])


def catalog_rows(products: DataFrame) -> DataFrame:
    """Products as flat rows of text, the way catalog_to_products reads them: lists joined by '|', a vehicle
    entry a year, attributes as a JSON object with sorted keys. Columns that products lack are null; columns
    that are text already stay."""
    kind = {f.name: f.dataType.simpleString() for f in products.schema.fields}
    plain = lambda c: F.col(c).cast("string") if c in kind else F.lit(None).cast("string")
    joined = lambda c: F.array_join(c, "|") if kind.get(c, "").startswith("array") else plain(c)
    values = {c: plain(c) for c in CSV_COLUMNS}
    values |= {"accessory_skus": joined("accessory_skus"), "alternative_sku": joined("alternative_skus") if "alternative_skus" in kind else plain("alternative_sku")}
    if kind.get("compatible_vehicles", "").startswith("array"):
        entry = lambda v: F.concat(v["make"], F.lit(" "), v["model"], F.lit(" ("), v["year"].cast("string"), F.lit(")"))
        values["compatible_vehicles"] = F.array_join(F.transform("compatible_vehicles", entry), "|")
    if kind.get("attributes", "").startswith("map"):
        values["attributes"] = F.to_json(F.map_from_entries(F.sort_array(F.map_entries("attributes"))))
    if "image_paths" in kind and "image_count" not in kind:
        values["image_count"] = F.size("image_paths").cast("string")
    return products.select(*[v.alias(c) for c, v in values.items()])


def write_catalog_csv(df: DataFrame, path: str) -> None:
    """Writes products, or rows of a catalog CSV, as a catalog CSV."""
    catalog_rows(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def _sidecars(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    files = spark.read.text(f"{folder}/*.{kind}.json", wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), rf"([^/]+)\.{kind}\.json", 1).alias("category_slug"), "value")


def read_index_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """<slug>.ids.json and <slug>.meta.json -> category_slug, row_pos, sku, backend, remove_bg; without meta the backend is unknown."""
    ids = _sidecars(spark, folder, "ids").select("category_slug", F.posexplode(F.from_json("value", "array<string>")).alias("row_pos", "sku"))
    meta = _sidecars(spark, folder, "meta").select("category_slug", F.from_json("value", "backend string, remove_bg boolean, vectors string").alias("m")).select("category_slug", "m.*")
    return ids.join(meta, "category_slug", "left").fillna("unknown", ["backend"])


def sidecar_problems(spark: SparkSession, folder: str) -> DataFrame:
    """category_slug and what is wrong with its sidecars: skipped ones, and those without how they were built."""
    ids = _sidecars(spark, folder, "ids").select("category_slug", F.from_json("value", "array<string>").isNull().alias("bad_ids"))
    meta = _sidecars(spark, folder, "meta").select("category_slug", F.from_json("value", "backend string")["backend"].isNull().alias("bad_meta"))
    both = ids.join(meta, "category_slug", "full")
    reason = F.when(F.col("bad_ids").isNull(), "skipped: no ids").when(F.col("bad_ids"), "skipped: ids unreadable").when(F.col("bad_meta").isNull(), "backend unknown: no meta").when(F.col("bad_meta"), "backend unknown: not in meta")
    return both.select("category_slug", reason.alias("problem")).filter("problem is not null")


def write_vectors(df: DataFrame, path: str, only: str | None = None) -> None:
    """Writes vectors by category, and in _built how each category's were made; with `only`, that category's folders alone are replaced."""
    rows = df if only is None else df.filter(F.col("category_slug") == only)
    put = lambda part, where: part.write.partitionBy("category_slug").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(where)
    put(rows, path)
    kind = F.when(F.count("*") == F.countDistinct("sku"), "per_sku").otherwise("per_image")
    put(rows.groupBy("category_slug", "backend", "remove_bg").agg(kind.alias("vectors"), F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dim")), f"{path}/_built")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_built(spark: SparkSession, path: str) -> DataFrame:
    """How the vectors of each category were made: backend, remove_bg, vectors (per_image or per_sku), n_vectors, dim."""
    return spark.read.parquet(f"{path}/_built")


def write_files(df: DataFrame, root: str) -> int:
    """Writes each row's `data` to root/`path`, in the tasks; a task that runs again writes the same files. Returns how many."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{top}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return df.select(F.col("path").cast("string"), F.col("data").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).load(path)


def append_audit(df: DataFrame, path: str, batch: str) -> None:
    """Appends rows by day; a batch that is appended again replaces its own rows."""
    rows = df.withColumn("day", F.to_date("created_at")).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)


def write_counted(df: DataFrame, path: str, **counts: Column) -> dict[str, int]:
    """Writes df and counts, in the same pass, the rows for which each condition is true; `rows` is how many there are."""
    seen = Observation("written")
    df.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]).write.parquet(path)
    return seen.get


def validate_uploads(files: DataFrame) -> DataFrame:
    """files(path, length) with the reason for which an upload is rejected, null if it isn't."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("reason", F.when(~suffix.isin(*IMAGE_SUFFIXES), "unsupported type").when(F.col("length") > MAX_UPLOAD, "too large"))


