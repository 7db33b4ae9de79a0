"""Registered queries of tables that follow their source by batches, and of reports made while writing, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuscope.operators import audit as au
from skuscope.operators import catalog as ca
from skuscope.operators import evaluate as ev
from skuscope.operators import maintained as mt
from skuscope.operators import search as se
from skuscope.operators import sketches as sk
from skuscope.plans import tables as d
from skuscope.plans.catalogue import AU, IV, _r, registered
from skuscope.plans.files import WV, _wide_vectors
from skuscope.sources import catalog as src
from skuscope.sources.buckets import BucketedTable
from skuscope.sources.scratch import shared_path, stored
from skuscope.streaming import jobs

# New vectors only.


def _mirror():
    """A stand-in for an encoder: the vector as it is, or backwards; it fails where the first value is over 0.25."""

    def encode(batch, mirrored):
        m = np.array([np.asarray(x, np.float64) for x in batch])
        if (m[:, 0] > 0.25).any():
            raise ValueError("too bright")
        return m[:, ::-1] if mirrored else m

    return encode


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, list[dict]]:
    """Two runs over images: a third is new in the second, and one in ten has changed."""
    iv = d.image_vectors(spark, sf_dir).select("row_pos", "backend", "remove_bg", F.col("embedding").alias("data"))
    changed = iv.withColumn("data", F.when(F.col("row_pos") % 10 == 0, F.transform("data", lambda x: x / 2).cast("array<float>")).otherwise(F.col("data")))
    path, loaders = shared_path(spark, "embedded"), {"dinov2": _mirror, "openclip": _mirror}
    counts = [mt.embed_into(iv.filter("row_pos % 3 <> 0"), path, loaders, width=8), mt.embed_into(changed, path, loaders, width=8)]
    return changed, path, counts


RUNS = f"{IV}, one AS (SELECT DISTINCT embedding, backend FROM (SELECT row_pos, backend, e AS embedding FROM iv WHERE row_pos % 3 <> 0)), two AS (SELECT DISTINCT embedding, backend FROM (SELECT backend, CASE WHEN row_pos % 10 = 0 THEN list_transform(e, lambda x: CAST(CAST(x AS FLOAT) / 2 AS DOUBLE)) ELSE e END AS embedding FROM iv)), nw AS (SELECT * FROM two ANTI JOIN (SELECT * FROM one WHERE embedding[1] <= 0.25) o USING (embedding, backend))"


@registered(f"WITH {RUNS} SELECT 1 AS run, count(*) FILTER (WHERE embedding[1] <= 0.25) AS encoded, count(*) FILTER (WHERE embedding[1] > 0.25) AS failed FROM one UNION ALL SELECT 2, count(*) FILTER (WHERE embedding[1] <= 0.25), count(*) FILTER (WHERE embedding[1] > 0.25) FROM nw")
def embedded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many inputs each of two runs encoded: the second only what is new, changed or failed before."""
    _, _, counts = _embedded(spark, sf_dir)
    return spark.createDataFrame([(k, x["encoded"], x["failed"]) for k, x in enumerate(counts, 1)], "run int, encoded long, failed long")


@registered(
    f"WITH {IV}, c AS (SELECT row_pos, CASE WHEN row_pos % 10 = 0 THEN list_transform(e, lambda x: CAST(CAST(x AS FLOAT) / 2 AS DOUBLE)) ELSE e END AS e FROM iv), m AS (SELECT row_pos, e, list_transform(list_zip(e, list_reverse(e)), lambda p: (p[1] + p[2]) / 2) AS h FROM c) SELECT row_pos, CASE WHEN e[1] <= 0.25 THEN round(h[1] / sqrt(list_inner_product(h, h)), 4) END AS first FROM m"
)
def embedded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images with the vectors that either run gave their content."""
    images, path, _ = _embedded(spark, sf_dir)
    found = mt.with_vectors(images, spark.read.parquet(path))
    return found.select("row_pos", F.round(F.get("embedding", 0).cast("double"), 4).alias("first"))


# Sums and products by bucket.


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


KEPT = f"{IV}, kp AS (SELECT * FROM iv WHERE row_pos % 7 <> 3 AND row_pos % 50 >= 5), el AS (SELECT category_slug, sku, row_pos, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM kp), su AS (SELECT category_slug, sku, i, sum(x) AS s, count(*) AS n, min(row_pos) AS fp FROM el GROUP BY ALL), ct AS (SELECT category_slug, sku, list(s ORDER BY i) AS total, max(n) AS n, min(fp) AS fp FROM su GROUP BY ALL)"


@registered(f"WITH {KEPT} SELECT category_slug, sku, n AS n_vectors, fp AS first_pos, round(total[1] / sqrt(list_inner_product(total, total)), 5) AS first, round(list_sum(total) / sqrt(list_inner_product(total, total)), 4) AS total FROM ct")
def maintained_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids out of sums that were kept up by three batches of added and removed vectors, one of which came twice."""
    iv = d.image_vectors(spark, sf_dir)
    table = BucketedTable(spark, shared_path(spark, "kept-sums"), [*se.KEY, "sku"], _schema(mt.SUMS), buckets=8)
    none, even, gone, early = iv.limit(0), F.col("row_pos") % 2 == 0, F.col("row_pos") % 7 == 3, F.col("row_pos") % 50 < 5
    batches = [(iv.filter(even), none), (iv.filter(~even), iv.filter(even & gone)), (none, iv.filter((~even & gone) | (early & ~gone)))]
    here = [iv.filter(even), iv.filter(~(even & gone)), iv.filter(~gone & ~early)]
    for k in (0, 1, 1, 2):
        mt.update_sums(table, f"batch-{k}", *batches[k], vectors=here[k])
    c = se.centroids_of(table.read())
    return c.select("category_slug", "sku", "n_vectors", "first_pos", _r(F.get("centroid", 0), 5).alias("first"), _r(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS product_name, CASE WHEN p_partkey % 6 = 1 THEN 'Changed' WHEN p_partkey % 10 = 0 THEN 'New' ELSE p_brand END AS brand FROM part WHERE p_partkey % 6 <> 2 UNION ALL SELECT 'new-' || p_partkey, NULL, 'Made' FROM part WHERE p_partkey % 40 = 0")
def bucketed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products after an import, an upsert that came twice, and a batch of changes."""
    p = d.read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    first = p.select(key.cast("string").alias("sku"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"))
    table = BucketedTable(spark, shared_path(spark, "products"), ["sku"], _schema("sku string, product_name string, brand string"), buckets=16)
    mt.upsert_into(table, "import", first)
    newer = p.filter(key % 10 == 0).select(key.cast("string").alias("sku"), F.upper("p_name").alias("product_name"), F.lit("New").alias("brand"))
    for _ in range(2):
        mt.upsert_into(table, "upsert", newer)
    fields = lambda brand: F.create_map(F.lit("brand"), F.lit(brand))
    edits = p.filter((key % 6).isin(1, 2)).select(key.cast("string").alias("sku"), F.when(key % 6 == 1, "update").otherwise("delete").alias("op"), fields("Changed").alias("fields"))
    made = p.filter(key % 40 == 0).select(F.concat(F.lit("new-"), key.cast("string")).alias("sku"), F.lit("create").alias("op"), fields("Made").alias("fields"))
    mt.change_in(table, "changes", edits.unionByName(made))
    return table.read()


# Audit rows.


def _with_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = d.audit(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")).drop("user_id", "confirmed_sku")
    time = F.when(F.col("id") % 77 != 0, F.col("created_at"))
    category = F.when(F.col("id") % 50 == 0, " ").otherwise(F.col("predicted_category"))
    return a.withColumn("created_at", time).withColumn("predicted_category", category)


@registered(
    "WITH a AS (SELECT event_id AS id, CASE WHEN event_id % 77 = 0 THEN 'no time' WHEN event_id % 50 = 0 THEN 'no category' WHEN value IS NULL THEN 'no confidence' END AS reason, 1 AS n FROM events), r AS (SELECT * FROM a UNION ALL SELECT id, reason, 1 FROM a WHERE reason IS NOT NULL AND id % 10 = 0) SELECT id, reason, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL"
)
def recorded_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows recorded by a stream with bad rows in it, whose second part repeats one row in ten: all recorded once, bad ones aside with a reason."""
    rows = _with_bad_rows(spark, sf_dir)
    source, out, dead, check = (shared_path(spark, f"recorded{x}") for x in ("-source", "", "-dead", "-checkpoint"))
    for part in (rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1 or id % 10 = 0")):
        part.write.mode("append").parquet(source)
        jobs.record_audit(spark.readStream.schema(rows.schema).parquet(source), out, dead, check).awaitTermination()
    good = spark.read.parquet(out).select("id", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(spark.read.parquet(dead).select("id", "reason")).groupBy("id", "reason").agg(F.count("*").alias("n"))


@registered(f"WITH {AU} SELECT id, created_at, CAST((row_number() OVER (ORDER BY created_at DESC, id DESC) - 1) // 40 AS INT) AS page FROM au QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) <= 120")
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of the history, each from the cursor of the one before, out of a table by day."""
    path = shared_path(spark, "audit-days")
    src.append_audit(d.audit(spark, sf_dir).select("id", "created_at"), path, "all")
    table, cursor, pages = spark.read.parquet(path), None, []
    for k in range(3):
        page = stored(au.history_after(table, cursor, 40), "page")
        last = page.orderBy("created_at", "id").first()
        cursor = (last["created_at"], last["id"]) if last else cursor
        pages.append(page.select("id", "created_at", F.lit(k).alias("page")))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


# Sketches.

G = (1 + sk.ACCURACY) / (1 - sk.ACCURACY)
OFFSET = 1 - math.ceil(math.log(sk.TINY) / math.log(G))
SLOT = f"CASE WHEN abs(confidence) < {sk.TINY!r} THEN 0 ELSE sign(confidence) * (ceil(ln(abs(confidence)) / {math.log(G)!r}::DOUBLE) + {OFFSET}) END"


def _estimate_sql(slot: str) -> str:
    return f"CASE WHEN {slot} = 0 THEN 0 ELSE sign({slot}) * pow({G!r}::DOUBLE, abs({slot}) - {OFFSET}) * {2 / (G + 1)!r}::DOUBLE END"


def _quality_sql(span: str) -> str:
    at = ", ".join(f"list_sort(list(slot))[CAST(floor({p} * (count(slot) - 1)) AS INT) + 1] AS s{k}" for k, p in enumerate((0.05, 0.5, 0.95)))
    shown = ", ".join(f"round({_estimate_sql(f's{k}')}, 4) AS {n}" for k, n in enumerate(("p5", "median", "p95")))
    return f"""WITH {AU}, s AS (SELECT *, CAST(date_trunc('{span}', created_at) AS TIMESTAMP) AS w, {SLOT} AS slot FROM au), g AS (SELECT w, count(*) AS n, avg(CASE WHEN top_sku IS NULL THEN 1.0 ELSE 0 END) AS refused, count(*) FILTER (WHERE confirmed_sku IS DISTINCT FROM top_sku AND confirmed_sku IS NOT NULL) / nullif(count(confirmed_sku), 0) AS corrected, avg(confidence) AS mean, {at} FROM s GROUP BY w)
SELECT w AS window_start, n, round(refused, 4) AS refusal_rate, round(corrected, 4) AS correction_rate, round(mean, 6) AS mean_confidence, {shown} FROM g"""


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of the audit rows through the stream of partial quality, started anew for the second."""
    a = d.audit(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")).drop("user_id")
    source, out, check = (shared_path(spark, f"quality{x}") for x in ("-source", "", "-checkpoint"))
    for part in (a.filter("id % 3 <> 0"), a.filter("id % 3 = 0")):
        part.write.mode("append").parquet(source)
        jobs.stream_quality(spark.readStream.schema(a.schema).parquet(source), out, check).awaitTermination()
    return spark.read.parquet(out)


def _shown(found: DataFrame) -> DataFrame:
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", _r("mean_confidence", 6).alias("mean_confidence"), *[_r(c).alias(c) for c in ("refusal_rate", "correction_rate", "p5", "median", "p95")])


@registered(_quality_sql("day"))
def quality_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by day out of a stream of audit rows, whose partial counts and sketches add up in files."""
    return _shown(jobs.quality_of(_partials(spark, sf_dir)))


@registered(_quality_sql("week"))
def weekly_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by week, merged from the days' sketches."""
    return _shown(jobs.quality_of(_partials(spark, sf_dir), F.date_trunc("week", "window_start")))


@registered(
    f"""WITH {AU}, s AS (SELECT embedding_backend AS backend, confirmed_sku = top_sku AS ok, {SLOT.replace("confidence", "(confidence / 100)")} AS slot FROM au WHERE confirmed_sku IS NOT NULL AND date_trunc('day', created_at) < (SELECT min(date_trunc('day', created_at)) + INTERVAL 14 DAY FROM au)), v AS (SELECT backend, coalesce(ok, false) AS ok, {_estimate_sql("slot")} AS score FROM s),
g AS (SELECT backend, x / 100.0::DOUBLE AS threshold FROM (SELECT DISTINCT backend FROM v) b, range(5, 96, 5) r(x)), w AS (SELECT backend, threshold, (SELECT avg(CASE WHEN score < threshold THEN 100.0 ELSE 0 END) FROM v WHERE ok AND v.backend = g.backend) AS rejected, (SELECT avg(CASE WHEN score < threshold THEN 100.0 ELSE 0 END) FROM v WHERE NOT ok AND v.backend = g.backend) AS caught FROM g)
SELECT backend, threshold, round(rejected, 4) AS rejected, round(caught, 4) AS caught FROM w"""
)
def live_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over two weeks of confirmed traffic, out of sketches by day: validated scores against corrected ones."""
    a = d.audit(spark, sf_dir).filter("confirmed_sku is not null").select(F.date_trunc("day", "created_at").alias("day"), F.col("embedding_backend").alias("backend"), F.coalesce(F.col("confirmed_sku") == F.col("top_sku"), F.lit(False)).alias("ok"), (F.col("confidence") / 100).alias("score"))
    days = stored(sk.sketch(a, ["day", "backend", "ok"], "score"), "score-sketches")
    first = d.audit(spark, sf_dir).agg(F.date_trunc("day", F.min("created_at")).alias("first"))
    span = days.join(F.broadcast(first), F.col("day") < F.col("first") + F.expr("INTERVAL 14 DAYS"))
    side = lambda ok: sk.scores_of(span.filter(F.col("ok") == ok), ["backend"])
    found = ev.threshold_sweep(side(True), side(False), 5, 95, 5, stop_above=100.0)
    return found.select("backend", "threshold", _r("rejected").alias("rejected"), _r("caught").alias("caught"))


# Reports counted while writing.


@registered(
    f"WITH {WV} SELECT 'repointed rows' AS name, count(*) AS n FROM part UNION ALL SELECT 'repointed updated', count(*) FROM part WHERE p_partkey % 6 = 3 UNION ALL SELECT 'attached rows', count(*) FROM part UNION ALL SELECT 'attached with_vector', count(*) FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT sku FROM wv WHERE backend <> 'unknown' AND dim <> 64) UNION ALL SELECT 'vectors rows', count(*) FROM wv UNION ALL SELECT 'vectors unknown_backend', count(*) FROM wv WHERE backend = 'unknown' UNION ALL SELECT 'vectors other_dimension', count(*) FROM wv WHERE dim = 64"
)
def counted_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was updated, attached and left out, counted in the passes that write the tables."""
    p = d.products(spark, sf_dir)
    urls = p.filter(F.col("sku").cast("int") % 3 == 0).select("sku", F.array(F.concat(F.lit("https://cdn/"), "sku")).alias("image_paths"))
    vectors = _wide_vectors(spark, sf_dir)
    path = shared_path(spark, "counted")
    counts = {
        "repointed": src.write_counted(ca.repoint_image_paths(p, urls), f"{path}/repointed", updated=F.col("updated")),
        "attached": src.write_counted(ca.attach_embeddings(p, vectors), f"{path}/attached", with_vector=F.coalesce("embedding_768", "embedding_512").isNotNull()),
        "vectors": src.write_counted(vectors, f"{path}/vectors", unknown_backend=F.col("backend") == "unknown", other_dimension=~F.size("embedding").isin(768, 512)),
    }
    return spark.createDataFrame([(f"{job} {name}", n) for job, x in counts.items() for name, n in x.items()], "name string, n long")


# The second grid, and centroids as products' vectors.


@registered(
    f"WITH {WV}, u AS (SELECT sku, backend, dim, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM wv WHERE backend <> 'unknown' AND dim <> 64), m AS (SELECT sku, backend, dim, i, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT sku, dim, list(x ORDER BY i) AS v FROM m GROUP BY sku, backend, dim), f AS (SELECT sku, dim, v[1] / (sqrt(list_inner_product(v, v)) * sqrt(CASE dim WHEN 768 THEN 12 ELSE 8 END)) AS x FROM c) SELECT CAST(p_partkey AS VARCHAR) AS sku, round(max(CASE WHEN dim = 768 THEN x END), 5) AS first_768, round(max(CASE WHEN dim = 512 THEN x END), 5) AS first_512 FROM part LEFT JOIN f ON f.sku = CAST(p_partkey AS VARCHAR) GROUP BY p_partkey"
)
def attached_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ca.attach_embeddings(d.products(spark, sf_dir), _wide_vectors(spark, sf_dir), mode="centroid")
    first = lambda c: F.round(F.get(c, 0).cast("double"), 5)
    return found.select("sku", first("embedding_768").alias("first_768"), first("embedding_512").alias("first_512"))
