"""The registered queries over the catalog tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuscope.functions import images
from skuscope.functions import text as t
from skuscope.functions import vectors as v
from skuscope.operators import audit as au
from skuscope.operators import catalog as ca
from skuscope.operators import evaluate as ev
from skuscope.operators import fitment as fi
from skuscope.operators import identify as ident
from skuscope.operators import pruned as pr
from skuscope.operators import questions as qu
from skuscope.operators import search as se
from skuscope.plans import tables as d
from skuscope.sources.scratch import shared_path, stored
from skuscope.streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Tables of the derived kind, as SQL.
IV = """iv AS (SELECT 'C' || label AS category_slug, CASE WHEN label % 2 = 0 THEN 'dinov2' ELSE 'openclip' END AS backend, CAST(label * 5 + vec_id % 5 AS VARCHAR) AS sku, vec_id AS row_pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
SUMS = f"""{IV}, el AS (SELECT category_slug, backend, sku, row_pos, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM iv),
se AS (SELECT category_slug, backend, sku, i, sum(x) AS s, count(*) AS n, min(row_pos) AS fp FROM el GROUP BY ALL),
sums AS (SELECT category_slug, backend, sku, list(s ORDER BY i) AS total, max(n) AS n, min(fp) AS fp FROM se GROUP BY ALL),
cent AS (SELECT *, list_transform(total, lambda x: x / sqrt(list_inner_product(total, total))) AS c FROM sums)"""
TOP = f"""{SUMS}, sc AS (SELECT q.row_pos AS query_id, q.category_slug, c.backend, c.sku, list_inner_product(q.e, c.c) AS s FROM iv q JOIN cent c USING (category_slug)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, sku) AS rank FROM sc)"""
LOO = f"""{SUMS}, qs AS (SELECT iv.*, u.total, u.fp FROM iv JOIN sums u USING (category_slug, sku) WHERE u.n >= 2),
own0 AS (SELECT *, list_transform(list_zip(total, e), lambda p: p[1] - p[2]) AS r FROM qs),
own AS (SELECT *, list_inner_product(e, r) / sqrt(list_inner_product(r, r)) AS own_score FROM own0),
ot AS (SELECT o.row_pos, o.category_slug, o.backend, o.sku, o.own_score, c.sku AS osku, c.fp AS ofp, o.fp AS fp, list_inner_product(o.e, c.c) AS s FROM own o LEFT JOIN cent c ON o.category_slug = c.category_slug AND o.sku <> c.sku),
loo AS (SELECT row_pos, category_slug, backend, sku, 1 + count(*) FILTER (WHERE s > own_score OR (s = own_score AND ofp < fp)) AS rank, arg_max(osku, s) AS rival, max(s) AS rival_score, max(own_score) AS own_score FROM ot GROUP BY row_pos, category_slug, backend, sku)"""
IMP = f"""{SUMS}, imp AS (SELECT q.row_pos, q.backend, c.category_slug AS target_slug, max(list_inner_product(q.e, c.c)) AS score FROM iv q JOIN cent c ON q.backend = c.backend AND q.category_slug <> c.category_slug GROUP BY ALL)"""
SWEEP = f"""{LOO}, cor AS (SELECT backend, own_score AS score FROM loo), imq AS (SELECT q.backend, max(list_inner_product(q.e, c.c)) AS score FROM iv q JOIN cent c ON q.backend = c.backend AND q.category_slug <> c.category_slug GROUP BY q.backend, q.row_pos, c.category_slug),
g AS (SELECT b.backend, x / 100.0::DOUBLE AS threshold FROM (SELECT DISTINCT backend FROM iv) b, range(30, 99) r(x)),
sw0 AS (SELECT backend, threshold, (SELECT avg(CASE WHEN score < threshold THEN 100.0 ELSE 0 END) FROM cor WHERE cor.backend = g.backend) AS rejected, (SELECT avg(CASE WHEN score < threshold THEN 100.0 ELSE 0 END) FROM imq WHERE imq.backend = g.backend) AS caught FROM g),
sw AS (SELECT backend, threshold, rejected, caught FROM (SELECT *, coalesce(max(CASE WHEN rejected > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY backend ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sw0) WHERE o = 0)"""
PR = """pr AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_brand AS brand, p_type AS category, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) END AS replacement_sku,
[CAST(p_partkey + 1 AS VARCHAR), CAST(p_partkey + 2 AS VARCHAR), CAST(p_partkey AS VARCHAR)] AS alts, [CAST(p_partkey * 2 AS VARCHAR), CAST(p_partkey * 2 AS VARCHAR)] AS accs, p_partkey, p_size FROM part)"""
FY = """fy AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS sku, n_name AS make, c_mktsegment AS model, CAST(year(o_orderdate) AS INT) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fr AS (SELECT sku, make, model, CAST(min(year) AS INT) AS year_start, CAST(max(year) AS INT) AS year_end FROM (SELECT *, year - row_number() OVER (PARTITION BY sku, make, model ORDER BY year) AS isl FROM fy) GROUP BY sku, make, model, isl)"""
CA = """cand AS (SELECT CAST(p_size AS VARCHAR) || '-' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS VARCHAR) AS session_id, CAST(p_partkey AS VARCHAR) AS sku, p_brand AS brand, ((p_partkey * 7919) % 1000) / 1000.0::DOUBLE AS similarity, CASE WHEN p_partkey % 4 <> 0 THEN 'M' || p_partkey % 5 END AS mpn FROM part),
a0 AS (SELECT session_id, arg_min(mpn, sku) AS label FROM cand WHERE mpn IS NOT NULL GROUP BY session_id),
ans AS (SELECT c.session_id, list(DISTINCT c.sku) AS skus FROM cand c JOIN a0 ON c.session_id = a0.session_id AND c.mpn = a0.label GROUP BY c.session_id),
rem AS (SELECT c.* FROM cand c LEFT JOIN ans a ON c.session_id = a.session_id WHERE a.skus IS NULL OR list_contains(a.skus, c.sku))"""
OPT = f"""{FY}, {CA}, rows AS (SELECT r.session_id, f.* FROM rem r JOIN fr f USING (sku)),
yy AS (SELECT session_id, y AS year, list_sort(list(DISTINCT sku)) AS skus FROM (SELECT session_id, sku, unnest(range(year_start, year_end + 1)) AS y FROM rows) GROUP BY session_id, y),
yf AS (SELECT *, CASE WHEN coalesce(lag(year) OVER w, -1) <> year - 1 OR lag(skus) OVER w <> skus THEN 1 ELSE 0 END AS fresh FROM yy WINDOW w AS (PARTITION BY session_id ORDER BY year)),
yr AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY year) AS run FROM yf),
yo AS (SELECT session_id, CAST(min(year) AS INT) AS a, CAST(max(year) AS INT) AS b, any_value(skus) AS skus FROM yr GROUP BY session_id, run),
opt AS (SELECT session_id, 'make' AS facet, make AS label, list_sort(list(DISTINCT sku)) AS skus FROM rows GROUP BY session_id, make
 UNION ALL SELECT session_id, 'model', model, list_sort(list(DISTINCT sku)) FROM rows GROUP BY session_id, model
 UNION ALL SELECT session_id, 'mpn', mpn, list_sort(list(DISTINCT sku)) FROM rem WHERE mpn IS NOT NULL GROUP BY session_id, mpn
 UNION ALL SELECT session_id, 'brand', brand, list_sort(list(DISTINCT sku)) FROM rem GROUP BY session_id, brand
 UNION ALL SELECT session_id, 'year', CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, skus FROM yo),
siz AS (SELECT session_id, count(*) AS n, bool_and(sku IN (SELECT sku FROM fr)) AS all_fit FROM rem GROUP BY session_id),
fac AS (SELECT session_id, facet, count(*) AS n_options, max(len(skus)) AS worst, min(len(skus)) AS least FROM opt GROUP BY session_id, facet),
use AS (SELECT f.*, CASE facet WHEN 'make' THEN 1 WHEN 'model' THEN 2 WHEN 'year' THEN 3 WHEN 'mpn' THEN 4 ELSE 5 END AS ease FROM fac f JOIN siz s USING (session_id) WHERE s.n >= 2 AND n_options > 1 AND least < s.n AND (all_fit OR facet NOT IN ('make', 'model', 'year')) AND facet <> 'mpn'),
nxt AS (SELECT session_id, facet, CAST(n_options AS BIGINT) AS n_options, CAST(worst AS INT) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ease, worst, n_options) AS r FROM use) WHERE r = 1)"""
AU = """au AS (SELECT event_id AS id, ts AS created_at, event_type AS predicted_category, value AS confidence, CASE WHEN k % 4 <> 0 THEN CAST(k AS VARCHAR) END AS top_sku, CASE WHEN user_id % 2 = 0 THEN 'dinov2' ELSE 'openclip' END AS embedding_backend, CASE WHEN k % 3 = 0 THEN CAST(k - k % 2 AS VARCHAR) END AS confirmed_sku, user_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _sums(spark, sf_dir):
    """Sums of the vectors by SKU as a table: all that reads them, or how many there are of each group, sums no vectors again."""
    return stored(se.sku_sums(d.image_vectors(spark, sf_dir)), "sums")


def _centroids(spark, sf_dir):
    return se.centroids_of(_sums(spark, sf_dir))


def _ranges(spark, sf_dir):
    return fi.collapse_fitment_years(d.fitment_years(spark, sf_dir))


@registered(f"WITH {SUMS} SELECT category_slug, sku, CAST(n AS BIGINT) AS n_vectors, round(c[1], 5) AS first, round(list_sum(c), 4) AS total FROM cent")
def sku_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("centroid")
    return _centroids(spark, sf_dir).select("category_slug", "sku", "n_vectors", _r(c[0], 5).alias("first"), _r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@registered(f"WITH {TOP} SELECT query_id, sku, CAST(rank AS INT) AS rank, round(s, 4) AS score FROM top WHERE rank <= 5")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_topk(d.queries(spark, sf_dir), _centroids(spark, sf_dir), 5).select("query_id", "sku", "rank", _r("similarity_score").alias("score"))


@registered(f"WITH {IV}, m AS (SELECT q.row_pos AS query_id, c.sku, max(list_inner_product(q.e, c.e)) AS s FROM iv q JOIN iv c USING (category_slug) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, sku) AS rank FROM m) SELECT query_id, sku, CAST(rank AS INT) AS rank, round(s, 4) AS score FROM r WHERE rank <= 3")
def search_image_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_topk(d.queries(spark, sf_dir), d.image_vectors(spark, sf_dir), 3, scoring="image_max").select("query_id", "sku", "rank", _r("similarity_score").alias("score"))


@registered(ORACLE["search_image_max"])
def search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index in blocks, of which those whose bound is too low are left out."""
    cut = pr.cut_index(d.image_vectors(spark, sf_dir), rows_a_block=64)
    return pr.search_pruned(d.queries(spark, sf_dir), cut, 3)[0].select("query_id", "sku", "rank", _r("similarity_score").alias("score"))


@registered(
    f"WITH {IV}, s AS (SELECT category_slug, count(*) AS n_vectors, count(DISTINCT sku) AS n_skus, CAST(max(len(e)) AS INT) AS dim, max(backend) AS backend, CASE WHEN count(*) <> count(DISTINCT sku) THEN 'per_image' ELSE 'per_sku' END AS vectors, count(*) = count(DISTINCT sku) AS one_each, 32 || '=' || count(*) FILTER (WHERE row_pos % 6 = 0) || ',' || 64 || '=' || count(*) FILTER (WHERE row_pos % 6 <> 0) AS n_by_dim, count(*) FILTER (WHERE category_slug <> 'C3' OR row_pos % 20 <> 3) AS n_ids FROM iv GROUP BY category_slug) SELECT *, n_ids <> n_vectors AS mismatch FROM s"
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of an index in which one vector in six is shorter and a category lacks some ids."""
    iv = d.image_vectors(spark, sf_dir)
    vectors = iv.withColumn("embedding", F.when(F.col("row_pos") % 6 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    found = se.index_stats(vectors, iv.filter((F.col("category_slug") != "C3") | (F.col("row_pos") % 20 != 3)))
    shown = F.array_join(F.transform(F.map_entries("n_by_dim"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.withColumn("n_by_dim", shown)


@registered("WITH p AS (SELECT lower(p_type) AS category, CASE WHEN p_size % 3 = 0 THEN 'dinov2' ELSE 'openclip' END AS backend, count(*) AS n_products FROM part GROUP BY ALL) SELECT category, backend, n_products FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_products DESC, backend) AS r FROM p) WHERE r = 1")
def dominant_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part")
    return se.dominant_backend(p.select(F.col("p_type").alias("category"), F.when(F.col("p_size") % 3 == 0, "dinov2").otherwise("openclip").alias("embedding_backend")))


@registered(f"WITH {LOO} SELECT row_pos, category_slug, sku, CAST(rank AS BIGINT) AS rank, CASE WHEN rank > 1 THEN rival ELSE sku END AS top_sku, round(CASE WHEN rank > 1 THEN rival_score ELSE own_score END, 4) AS top_score FROM loo")
def loo_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.loo_ranks(d.image_vectors(spark, sf_dir)).select("row_pos", "category_slug", "sku", "rank", "top_sku", _r("top_score").alias("top_score"))


@registered(f"WITH {LOO} SELECT coalesce(category_slug, 'OVERALL') AS category, count(*) AS n, count(DISTINCT sku) AS products, round(avg(CASE WHEN rank <= 1 THEN 100.0 ELSE 0 END), 4) AS top1, round(avg(CASE WHEN rank <= 3 THEN 100.0 ELSE 0 END), 4) AS top3, round(avg(1.0 / rank), 4) AS mrr FROM loo GROUP BY ROLLUP (category_slug)")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.retrieval_metrics(se.loo_ranks(d.image_vectors(spark, sf_dir)))
    return m.select("category", "n", "products", _r("top1").alias("top1"), _r("top3").alias("top3"), _r("mrr").alias("mrr"))


@registered(f"WITH {IV} SELECT a.row_pos, round(max(list_inner_product(a.e, b.e)), 4) AS score FROM iv a JOIN iv b ON a.category_slug = b.category_slug AND a.sku = b.sku AND a.row_pos <> b.row_pos GROUP BY a.row_pos")
def loo_image_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.loo_image_max(d.image_vectors(spark, sf_dir)).select("row_pos", _r("score").alias("score"))


@registered(f"WITH {IMP} SELECT row_pos, target_slug, round(score, 4) AS score FROM imp")
def impostor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.impostor_scores(d.image_vectors(spark, sf_dir), _centroids(spark, sf_dir)).select("row_pos", "target_slug", _r("score").alias("score"))


@registered(ORACLE["impostor_scores"])
def impostors_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _centroids(spark, sf_dir).withColumn("row_pos", F.col("first_pos")).withColumnRenamed("centroid", "embedding")
    found = pr.impostors_pruned(d.image_vectors(spark, sf_dir), pr.cut_index(centroids, rows_a_block=2))
    return found.select("row_pos", "target_slug", _r("score").alias("score"))


@registered(f"WITH {IMP} SELECT backend, count(*) AS n, round(min(score), 4) AS min, round(quantile_cont(score, 0.05), 4) AS p5, round(quantile_cont(score, 0.5), 4) AS median, round(quantile_cont(score, 0.95), 4) AS p95, round(max(score), 4) AS max FROM imp GROUP BY backend")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.score_distribution(se.impostor_scores(d.image_vectors(spark, sf_dir), _centroids(spark, sf_dir)))
    return found.select("backend", "n", *[_r(c).alias(c) for c in ("min", "p5", "median", "p95", "max")])


def _sweep(spark, sf_dir):
    iv, sums = d.image_vectors(spark, sf_dir), _sums(spark, sf_dir)
    correct = se.loo_ranks(iv, sums).select("backend", F.col("own_score").alias("score"))
    return ev.threshold_sweep(correct, se.impostor_scores(iv, se.centroids_of(sums)))


@registered(f"WITH {SWEEP} SELECT backend, threshold, round(rejected, 4) AS rejected, round(caught, 4) AS caught FROM sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select("backend", "threshold", _r("rejected").alias("rejected"), _r("caught").alias("caught"))


@registered(f"WITH {SWEEP.replace('range(30, 99) r(x)', 'range(30, 96, 5) r(x)')} SELECT backend, threshold, round(rejected, 4) AS rejected, round(caught, 4) AS caught FROM sw")
def calibration_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration's grid, in steps of five hundredths."""
    lo, hi, _ = ev.CALIBRATION_GRID
    iv, sums = d.image_vectors(spark, sf_dir), _sums(spark, sf_dir)
    correct = se.loo_ranks(iv, sums).select("backend", F.col("own_score").alias("score"))
    found = ev.threshold_sweep(correct, se.impostor_scores(iv, se.centroids_of(sums)), lo, hi, 5)
    return found.select("backend", "threshold", _r("rejected").alias("rejected"), _r("caught").alias("caught"))


@registered(f"WITH {SWEEP} SELECT backend, round(max(CASE WHEN rejected <= 1.5 THEN threshold END), 2) AS threshold, round(max(CASE WHEN rejected <= 1.5 THEN caught END), 4) AS caught FROM sw GROUP BY backend")
def recommend_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recommend_threshold(_sweep(spark, sf_dir), 1.5).select("backend", "threshold", _r("caught").alias("caught"))


ROUTES = "p AS (SELECT vec_id AS query_id, label, ((vec_id * 37) % 100) / 100.0::DOUBLE AS c FROM embeddings), rt AS (SELECT query_id, 0 AS place, 'C' || label AS category, c AS confidence, c < 0.5 AS uncertain FROM p UNION ALL SELECT query_id, 1, 'C' || (label + 1) % 10, (1 - c) / 2, true FROM p WHERE c < 0.5)"


def _available(spark, sf_dir):
    return d.image_vectors(spark, sf_dir).select(F.lower("category_slug").alias("category_slug")).distinct()


@registered(f"WITH {ROUTES} SELECT query_id, CAST(place AS INT) AS place, category, round(confidence, 4) AS confidence, uncertain FROM rt")
def route_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ident.route_categories(d.predictions(spark, sf_dir), _available(spark, sf_dir))
    return found.select("query_id", "place", "category", _r("confidence").alias("confidence"), "uncertain")


IDENT = f"""{SUMS}, {ROUTES}, ts AS (SELECT r.*, c.backend, c.sku, list_inner_product(q.e, c.c) AS s FROM rt r JOIN iv q ON q.row_pos = r.query_id JOIN cent c ON c.category_slug = r.category),
t1 AS (SELECT query_id, place, category, confidence, uncertain, backend, max(s) AS top_score, arg_min(sku, (-s, sku)) AS top_sku FROM ts GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY top_score - CASE backend WHEN 'openclip' THEN 0.86 ELSE 0.48 END DESC, place) AS r, CASE backend WHEN 'openclip' THEN 0.86::DOUBLE ELSE 0.48::DOUBLE END + CASE WHEN uncertain THEN 0.04::DOUBLE ELSE 0 END AS lim FROM t1)"""


@registered(f"WITH {IDENT} SELECT query_id, category AS predicted_category, round(confidence, 4) AS confidence, backend AS embedding_backend, round(top_score, 4) AS top_score, round(lim, 4) AS no_match_threshold, top_score < lim AS no_match, CASE WHEN top_score >= lim THEN top_sku END AS top_sku FROM pk WHERE r = 1")
def identify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _centroids(spark, sf_dir).withColumn("category_slug", F.lower("category_slug"))
    found = ident.identify_batch(d.predictions(spark, sf_dir), d.query_vectors(spark, sf_dir), centroids, d.products(spark, sf_dir))
    return found.select("query_id", "predicted_category", _r("confidence").alias("confidence"), "embedding_backend", _r("top_score").alias("top_score"), _r("no_match_threshold").alias("no_match_threshold"), "no_match", "top_sku")


@registered(f"WITH {PR} SELECT sku, product_name, brand FROM pr WHERE category = 'ECONOMY' ORDER BY sku LIMIT 50")
def list_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.list_products(d.products(spark, sf_dir), category="ECONOMY").select("sku", "product_name", "brand")


@registered(f"WITH {PR} SELECT sku, product_name, brand FROM pr WHERE (lower(product_name) LIKE '%bolt%' OR lower(sku) LIKE '%bolt%' OR lower(brand) LIKE '%bolt%') AND category = 'SMALL'")
def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.search_products(d.products(spark, sf_dir), " Bolt ", category="SMALL").select("sku", "product_name", "brand")


@registered(f"WITH {PR} SELECT 'category' AS kind, category AS value FROM pr GROUP BY ALL UNION ALL SELECT 'brand', brand FROM pr GROUP BY ALL")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.filter_options(d.products(spark, sf_dir))


@registered(f"WITH {PR} SELECT category, brand, count(*) AS n FROM pr GROUP BY GROUPING SETS ((category), (brand), ())")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.catalog_stats(d.products(spark, sf_dir))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_size % 7 = 0 THEN 'brand is blank' ELSE '' END || CASE WHEN p_size % 7 = 0 AND p_size > 40 THEN ';' ELSE '' END || CASE WHEN p_size > 40 THEN 'vehicle year out of range' ELSE '' END AS reasons FROM part")
def validate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part")
    vehicle = F.struct(F.lit("A").alias("make"), F.lit("B").alias("model"), F.when(F.col("p_size") > 40, 2200).otherwise(2000).alias("year"))
    rows = p.select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"), F.when(F.col("p_size") % 7 == 0, "   ").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("category"), F.array(vehicle).alias("compatible_vehicles"))
    return ca.validate_products(rows).select("sku", F.array_join("reasons", ";").alias("reasons"))


@registered("WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_brand AS brand, p_size FROM part), i AS (SELECT CAST(p_partkey + 500 AS VARCHAR) AS sku, upper(p_name) AS product_name, 'New' AS brand FROM part) SELECT coalesce(e.sku, i.sku) AS sku, coalesce(i.product_name, e.product_name) AS product_name, coalesce(i.brand, e.brand) AS brand, e.p_size FROM e FULL JOIN i ON e.sku = i.sku")
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part")
    existing = p.select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), "p_size")
    incoming = p.select((F.col("p_partkey") + 500).cast("string").alias("sku"), F.upper("p_name").alias("product_name"), F.lit("New").alias("brand"))
    return ca.upsert_products(existing, incoming)


@registered("WITH b AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_brand AS brand FROM part), n AS (SELECT count(*) AS n FROM part) SELECT sku, product_name, CASE WHEN k % 3 = 1 THEN 'Changed' ELSE brand END AS brand FROM b WHERE k % 3 <> 2")
def product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part")
    products = p.select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"))
    op = F.element_at(F.array(F.lit("create"), F.lit("update"), F.lit("delete")), (F.col("p_partkey") % 3 + 1).cast("int"))
    changes = p.select(F.col("p_partkey").cast("string").alias("sku"), op.alias("op"), F.create_map(F.lit("brand"), F.lit("Changed")).alias("fields"))
    return ca.apply_product_changes(products, changes)[0]


@registered(f"WITH {PR} SELECT sku, category, CASE WHEN count(*) OVER (PARTITION BY category) >= 2 THEN coalesce(lead(sku) OVER (PARTITION BY category ORDER BY sku), first_value(sku) OVER (PARTITION BY category ORDER BY sku)) END AS alternative_sku FROM pr")
def ring_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.ring_alternatives(d.products(spark, sf_dir).select("sku", "category"))


LABELS = ["brake_pad", " Brake Pads", "OIL-FILTER", "throttle body", "Wheel  Hub Assembly", "Timing Belt", ""]


@registered(
    f"WITH l AS (SELECT p_partkey, p_name, ({LABELS!r})[p_partkey % {len(LABELS)} + 1] AS label FROM part), s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM l) SELECT p_partkey, slug, CASE slug {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in t.CATEGORY_ALIASES.items())} ELSE label END AS resolved, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM s"
)
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are aliases of a category, written in several ways, and others."""
    p = d.read(spark, sf_dir, "part").withColumn("raw", F.get(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % len(LABELS)).cast("int")))
    return p.select("p_partkey", t.category_slug(F.col("raw")).alias("slug"), t.resolve_category(F.col("raw")).alias("resolved"), t.format_category(F.col("p_name")).alias("label"))


@registered("WITH x AS (SELECT p_partkey, 1990 + p_size % 20 AS a, 1995 + p_size % 13 AS b, p_name FROM part) SELECT p_partkey, string_split(p_name, ' ')[1] AS make, array_to_string(string_split(p_name, ' ')[2:], ' ') AS model, CAST(y AS INT) AS year FROM (SELECT *, unnest(range(a, b + 1)) AS y FROM x) UNION ALL SELECT p_partkey, 'Solo', 'Solo', 2001 FROM x")
def parse_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part")
    cell = F.concat("p_name", F.lit(" ("), (1990 + F.col("p_size") % 20).cast("string"), F.lit("–"), (1995 + F.col("p_size") % 13).cast("string"), F.lit(") 2.5L | Solo (2001)||Universal Fitment"))
    return p.select("p_partkey", F.explode(t.parse_vehicles(cell)).alias("v")).select("p_partkey", "v.*")


@registered(f"WITH {FY} SELECT * FROM fr")
def fitment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


@registered(f"WITH {FY}, rq AS (SELECT c_custkey AS request_id, n_name AS make, c_mktsegment AS model, CAST(1995 + c_custkey % 7 AS INT) AS year FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT DISTINCT request_id, sku FROM rq JOIN fr USING (make, model) WHERE year BETWEEN year_start AND year_end")
def products_for_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = d.read(spark, sf_dir, "customer"), d.read(spark, sf_dir, "nation")
    requests = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("request_id"), F.col("n_name").alias("make"), F.col("c_mktsegment").alias("model"), (1995 + F.col("c_custkey") % 7).cast("int").alias("year"))
    return fi.products_for_vehicle(_ranges(spark, sf_dir), requests)


def _session_fitment(spark, sf_dir):
    return stored(d.candidates(spark, sf_dir).select("session_id", "sku").join(_ranges(spark, sf_dir), "sku"), "session-fitment")


@registered(f"WITH {OPT} SELECT session_id, a AS year_start, b AS year_end, array_to_string(skus, ',') AS skus FROM yo")
def year_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = qu.apply_answers(d.candidates(spark, sf_dir), d.answers(spark, sf_dir)).select("session_id", "sku")
    return fi.year_options(left.join(_ranges(spark, sf_dir), "sku")).select("session_id", "year_start", "year_end", F.array_join("skus", ",").alias("skus"))


@registered(f"WITH {OPT} SELECT session_id, facet, label, array_to_string(skus, ',') AS skus FROM opt")
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = qu.apply_answers(d.candidates(spark, sf_dir), d.answers(spark, sf_dir))
    rows = stored(left.select("session_id", "sku").join(_ranges(spark, sf_dir), "sku"), "session-fitment")
    return qu.facet_options(left, rows).select("session_id", "facet", "label", F.array_join("skus", ",").alias("skus"))


def _prompt_sql(k: int) -> str:
    quoted = {facet: x[k].replace("'", "''") for facet, x in t.PROMPTS.items()}
    return f"CASE facet {' '.join(f'WHEN {facet!r} THEN ' + chr(39) + x + chr(39) for facet, x in quoted.items())} END"


@registered(f"WITH {OPT} SELECT session_id, facet, {_prompt_sql(0)} AS prompt, {_prompt_sql(1)} AS hint, n_options, worst FROM nxt")
def next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = d.answers(spark, sf_dir)
    found = qu.next_question(d.candidates(spark, sf_dir), _session_fitment(spark, sf_dir), a, a.filter("skipped"))
    return found.select("session_id", "facet", "prompt", "hint", "n_options", "worst")


@registered(f"WITH {CA} SELECT session_id, sku FROM rem")
def apply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.apply_answers(d.candidates(spark, sf_dir), d.answers(spark, sf_dir)).select("session_id", "sku")


@registered(f"""WITH {OPT}, w AS (SELECT session_id, sku, similarity, row_number() OVER o AS r, similarity - lead(similarity) OVER o AS gap FROM cand WINDOW o AS (PARTITION BY session_id ORDER BY similarity DESC, sku)),
b AS (SELECT session_id, array_to_string(list(sku ORDER BY similarity DESC, sku), ',') AS remaining, count(*) AS n, arg_min(sku, (-similarity, sku)) AS best FROM rem GROUP BY session_id),
mm AS (SELECT w.session_id, w.sku AS leader_sku, b.best AS best_survivor_sku FROM w JOIN b USING (session_id) WHERE r = 1 AND gap >= 0.08 AND w.sku NOT IN (SELECT sku FROM rem))
SELECT s.session_id, CASE WHEN coalesce(b.n, 0) = 1 THEN 'resolved' WHEN nxt.facet IS NOT NULL THEN 'asking' ELSE 'exhausted' END AS status, CAST(coalesce(b.n, 0) AS INT) AS n_remaining, coalesce(b.remaining, '') AS remaining, CASE WHEN b.n = 1 THEN b.remaining END AS resolved_sku, nxt.facet, mm.leader_sku, mm.best_survivor_sku
FROM (SELECT DISTINCT session_id FROM cand) s LEFT JOIN b USING (session_id) LEFT JOIN nxt USING (session_id) LEFT JOIN mm USING (session_id)""")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.session_state(d.candidates(spark, sf_dir), _session_fitment(spark, sf_dir), d.answers(spark, sf_dir))


@registered(f"""WITH {PR}, a AS (SELECT sku, 'alternative' AS kind, x.v AS related_sku, CAST(x.i - 1 AS INT) AS position FROM (SELECT sku, list_filter(list_distinct_ordered, lambda y: y <> sku) AS l FROM (SELECT sku, CASE WHEN replacement_sku IS NULL THEN alts ELSE list_prepend(replacement_sku, alts[2:]) END AS list_distinct_ordered FROM pr)) , LATERAL (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i) x),
c AS (SELECT sku, 'accessory' AS kind, x.v AS related_sku, CAST(x.i - 1 AS INT) AS position FROM pr, LATERAL (SELECT unnest(accs) AS v, generate_subscripts(accs, 1) AS i) x)
SELECT sku, kind, position, related_sku FROM (SELECT * FROM a UNION ALL SELECT * FROM c) WHERE related_sku IN (SELECT sku FROM pr)""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.recommend(d.products(spark, sf_dir))


@registered(f"WITH {PR} SELECT a.sku, a.replacement_sku, b.product_name AS replacement_name FROM pr a LEFT JOIN pr b ON a.replacement_sku = b.sku")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.relationships(d.products(spark, sf_dir))


@registered(f"WITH {PR}, {IV} SELECT DISTINCT sku, 'no product' AS reason FROM iv WHERE sku NOT IN (SELECT sku FROM pr) UNION ALL SELECT sku, 'no vectors' FROM pr WHERE sku NOT IN (SELECT sku FROM iv)")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.drift_report(d.image_vectors(spark, sf_dir), d.products(spark, sf_dir))


@registered(f"WITH {TOP}, {PR} SELECT query_id, CAST(rank AS INT) AS rank, sku, round(s, 4) AS score, coalesce(product_name, sku) AS product_name, coalesce(brand, 'Unknown') AS brand, coalesce(category, category_slug) AS category FROM top LEFT JOIN pr USING (sku) WHERE rank <= 3")
def enriched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.search_topk(d.queries(spark, sf_dir), _centroids(spark, sf_dir), 5).withColumn("category", F.col("category_slug"))
    return ca.enrich_candidates(found, d.products(spark, sf_dir)).withColumn("score", _r("similarity_score")).drop("similarity_score")


@registered(
    f"WITH {TOP}, t AS (SELECT *, s - lead(s) OVER (PARTITION BY query_id ORDER BY rank) AS gap, query_id % 5 <> 0 AS m, ((query_id * 37) % 100) / 100.0::DOUBLE AS c FROM top QUALIFY rank = 1), u AS (SELECT *, m AND gap < 0.05 AS rc FROM t) SELECT query_id, sku AS leader, round(gap, 4) AS gap, gap >= 0.08 AS decisive, CASE WHEN gap >= 0.08 THEN 'strong' ELSE 'close' END AS label, rc AS requires_confirmation, CASE WHEN m AND NOT rc THEN sku END AS selected_sku, m AND NOT rc AND c >= 0.9 AS high_confidence FROM u"
)
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the first two are apart, and what follows, for results of which one in five was refused."""
    found = se.search_topk(d.queries(spark, sf_dir), _centroids(spark, sf_dir), 5)
    found = found.withColumn("refused", F.col("query_id") % 5 == 0).withColumn("confidence", F.col("query_id") * 37 % 100 / 100)
    shown = qu.separation(found, confidence="confidence", no_match="refused")
    return shown.select("query_id", "leader", _r("gap").alias("gap"), "decisive", "label", "requires_confirmation", "selected_sku", "high_confidence")


@registered(f"WITH {AU} SELECT id, predicted_category, top_sku, confirmed_sku, CASE WHEN confirmed_sku IS NOT NULL AND id % 2 = 0 THEN '[{{\"facet\":\"brand\",\"label\":\"' || confirmed_sku || '\"}}]' END AS disambiguation, coalesce(confirmed_sku IS DISTINCT FROM top_sku AND confirmed_sku IS NOT NULL, false) AS corrected FROM au")
def apply_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations, of each id an early and a late one, with the questions that led to every second."""
    a = d.audit(spark, sf_dir)
    confirmed = a.filter("confirmed_sku is not null")
    asked = F.when(F.col("id") % 2 == 0, F.to_json(F.array(F.struct(F.lit("brand").alias("facet"), F.col("confirmed_sku").alias("label")))))
    early = confirmed.select("id", F.lit("early").alias("confirmed_sku"), F.col("created_at").alias("confirmed_at"), F.lit("[]").alias("disambiguation"))
    late = confirmed.select("id", "confirmed_sku", (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("confirmed_at"), asked.alias("disambiguation"))
    found, _ = au.apply_confirmations(a.drop("confirmed_sku"), early.unionByName(late))
    return found.select("id", "predicted_category", "top_sku", "confirmed_sku", "disambiguation", "corrected")


@registered(f"WITH {AU} SELECT id, created_at, predicted_category FROM au ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.history(d.audit(spark, sf_dir), 50, 20).select("id", "created_at", "predicted_category")


@registered(f"""WITH {AU}, s AS (SELECT *, CASE WHEN confirmed_sku IS NULL AND top_sku IS NULL THEN 'no-match' WHEN confirmed_sku IS NULL THEN 'unconfirmed' WHEN confirmed_sku = top_sku THEN 'validated' ELSE 'corrected' END AS st FROM au)
SELECT predicted_category, embedding_backend, count(*) AS n, count(*) FILTER (WHERE st = 'validated') AS validated, count(*) FILTER (WHERE st = 'corrected') AS corrected, count(*) FILTER (WHERE st = 'unconfirmed') AS unconfirmed, count(*) FILTER (WHERE st = 'no-match') AS no_match,
round(count(*) FILTER (WHERE st = 'corrected') / nullif(count(*) FILTER (WHERE st IN ('validated', 'corrected')), 0), 4) AS correction_rate FROM s GROUP BY CUBE (predicted_category, embedding_backend)""")
def confirmation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.confirmation_summary(d.audit(spark, sf_dir)).withColumn("correction_rate", _r("correction_rate"))


CLS = "c AS (SELECT 'C' || label AS actual, CASE WHEN vec_id % 7 = 0 THEN 'C' || (label + 1) % 10 ELSE 'C' || label END AS predicted FROM embeddings)"


@registered(f"WITH {CLS}, l AS (SELECT actual AS label FROM c GROUP BY ALL) SELECT label, (SELECT count(*) FROM c WHERE actual = label) AS support, (SELECT count(*) FROM c WHERE predicted = label) AS n_predicted, (SELECT count(*) FROM c WHERE actual = label AND predicted = label) AS correct, round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM c WHERE predicted = label), 4) AS precision, round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM c WHERE actual = label), 4) AS recall FROM l")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.read(spark, sf_dir, "embeddings")
    name = lambda c: F.concat(F.lit("C"), c)
    preds = e.select(name(F.col("label")).alias("actual"), F.when(F.col("vec_id") % 7 == 0, name((F.col("label") + 1) % 10)).otherwise(name(F.col("label"))).alias("predicted"))
    return ev.classification_report(preds).select("label", "support", "n_predicted", "correct", _r("precision").alias("precision"), _r("recall").alias("recall"))


@registered("WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_turns FROM y GROUP BY user_id, s")
def sessions_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(d.read(spark, sf_dir, "events").select("user_id", "ts"))


@registered(f"WITH {AU} SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS window_start, count(*) AS n, round(avg(CASE WHEN top_sku IS NULL THEN 1.0 ELSE 0 END), 4) AS refusal_rate, round(count(*) FILTER (WHERE confirmed_sku <> top_sku) / nullif(count(confirmed_sku), 0), 4) AS correction_rate FROM au GROUP BY 1")
def windowed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.windowed_quality(d.audit(spark, sf_dir))
    return found.select("window_start", "n", _r("refusal_rate").alias("refusal_rate"), _r("correction_rate").alias("correction_rate"))


@registered(r"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7f\P{L}]|[^\x00-\x7f\P{M}]|[^\x00-\x7f\P{N}]', '_', 'g'), '[^\x00-\x7f]', ',', 'g') AS x FROM documents),
w AS (SELECT doc_id, x, string_split_regex(x, '\bidiot\b') AS a, string_split_regex(x, '\bclown\b') AS b FROM x),
h AS (SELECT doc_id, list_bool_or(list_transform(range(1, len(a)), lambda i: NOT regexp_matches(array_to_string(a[1:i], 'idiot'), '\b(and|of|the)\b[^.]{0,40}$'))) AS idiot, len(a) > 1 AS ai, list_bool_or(list_transform(range(1, len(b)), lambda i: NOT regexp_matches(array_to_string(b[1:i], 'clown'), '\b(and|of|the)\b[^.]{0,40}$'))) AS clown, len(b) > 1 AS bi FROM w)
SELECT doc_id, CASE WHEN idiot THEN 'one' WHEN clown THEN 'two' END AS kind, CASE WHEN idiot THEN 'yes' WHEN ai THEN 'no' END AS named FROM h""")
def extract_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.read(spark, sf_dir, "documents")
    found = t.extract_attributes(
        F.lit(""), F.col("text"), F.lit("x"), rules={"kind": [(None, [("one", r"\bidiot\b"), ("two", r"\bclown\b")])]}, presence={"named": (r"\bidiot\b", None)}, colours={}, negators=("and", "of", "the")
    )
    return docs.select("doc_id", found.alias("m")).select("doc_id", F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("named")).alias("named"))


@registered("""WITH a AS (SELECT p_type AS category, 'size' AS key, CAST(p_size % 4 AS VARCHAR) AS value FROM part UNION ALL SELECT p_type, 'word', string_split(p_name, ' ')[1] FROM part), vc AS (SELECT category, key, value, count(*) AS c FROM a GROUP BY ALL), k AS (SELECT category, key, max(c) AS worst, count(*) AS dv FROM vc GROUP BY ALL), n AS (SELECT p_type AS category, count(*) AS n FROM part GROUP BY ALL)
SELECT category, n, key AS splitter, dv AS distinct_values, worst FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY worst, key) AS r FROM k WHERE dv > 1) JOIN n USING (category) WHERE r = 1 AND n >= 2""")
def best_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.best_splitter(d.products(spark, sf_dir))


@registered(f"""WITH {IDENT}, {PR}, l AS (SELECT query_id, place, sku, s, row_number() OVER (PARTITION BY query_id, place ORDER BY s DESC, sku) AS k FROM ts), sh AS (SELECT query_id, place, string_agg('  - ' || sku || ' (similarity: ' || CAST(CAST(round_even(s * 100, 0) AS BIGINT) AS VARCHAR) || '%)', chr(10) ORDER BY k) AS shown FROM l WHERE k <= 5 GROUP BY ALL),
pc AS (SELECT *, CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS pct, top_score < lim AS nm FROM pk WHERE r = 1)
SELECT query_id, CASE WHEN NOT nm THEN 'Predicted category: ' || pc.category || ' (confidence: ' || pct || ')' WHEN confidence >= 0.75 THEN 'Category (unconfirmed - nothing in the catalog matched): ' || pc.category || ' at ' || pct || ' confidence' ELSE 'Category: NOT RECOGNISED. The classifier''s best guess reached only ' || pct || ' confidence, which is too low to state. Do not name a category in your reply.' END
|| chr(10) || 'Top matched SKUs (by visual similarity):' || chr(10) || shown || chr(10) || CASE WHEN NOT nm THEN chr(10) || 'Matched catalog product: ' || p.sku || ' — ' || p.product_name || ' (' || p.brand || ')' || chr(10) || 'Compatible vehicles: not specified in the catalog.' ELSE chr(10) || 'No confident catalog match was found for the top SKU.' END AS prompt
FROM pc JOIN sh USING (query_id, place) LEFT JOIN pr p ON p.sku = pc.top_sku""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _centroids(spark, sf_dir).withColumn("category_slug", F.lower("category_slug"))
    found = ident.identify_batch(d.predictions(spark, sf_dir), d.query_vectors(spark, sf_dir), centroids, d.products(spark, sf_dir)).drop("product_name")
    info = d.products(spark, sf_dir).select(F.col("sku").alias("top_sku"), F.struct("sku", "product_name", "brand", F.lit("").alias("fitment")).alias("product"))
    none = F.array().cast("array<string>")
    return ident.build_prompts(found.join(info, "top_sku", "left").withColumn("alternatives", none).withColumn("accessories", none))


@registered(f"""WITH {AU}, g AS (SELECT id, predicted_category, confidence / 100 AS score, (id % 20) / 100.0::DOUBLE AS gap, top_sku IS NULL AS nm FROM au)
SELECT id AS query_id, CASE WHEN nm THEN 'The image was not recognized as a catalog part|No catalog entry cleared the 48% match threshold; the closest scored ' || CAST(floor(score * 100 + 0.5) AS BIGINT) || '%'
ELSE 'Predicted category: ' || upper(predicted_category[1]) || predicted_category[2:] || '|Highest visual similarity among catalog candidates (' || CAST(floor(score * 100 + 0.5) AS BIGINT) || '%)|' || CASE WHEN gap >= 0.08 THEN 'Strong score separation from lower-ranked candidates (+' || CAST(floor(gap * 100 + 0.5) AS BIGINT) || '%)' ELSE 'Close score separation from the next candidate (' || CAST(floor(gap * 100 + 0.5) AS BIGINT) || '% apart), so confirmation is recommended' END END AS lines FROM g""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = d.audit(spark, sf_dir)
    rows = a.select(F.col("id").alias("query_id"), "predicted_category", F.col("top_sku").isNull().alias("no_match"), F.lit(0.48).alias("no_match_threshold"), (F.col("confidence") / 100).alias("top_score"), ((F.col("id") % 20) / 100).alias("gap"))
    return ident.summary_lines(rows).select("query_id", F.array_join("lines", "|").alias("lines"))


@registered("""WITH c AS (SELECT c_custkey, 'pick ' || c_custkey % 5 || '.' AS reply, c_custkey FROM customer), p AS (SELECT c_custkey % 4 AS truth, 0 AS retrieved, CASE WHEN c_custkey % 5 BETWEEN 1 AND 3 THEN c_custkey % 5 - 1 END AS choice FROM c), f AS (SELECT truth = retrieved AS b, truth = coalesce(choice, retrieved) AS a, choice FROM p), g AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT b AND a) AS fixes, count(*) FILTER (WHERE b AND NOT a) AS breaks, count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong, count(*) FILTER (WHERE choice IS NULL) AS unparsed, avg(CASE WHEN b THEN 100.0 ELSE 0 END) AS before, avg(CASE WHEN a THEN 100.0 ELSE 0 END) AS after FROM f)
SELECT n, fixes, breaks, both_right, both_wrong, unparsed, round(before, 4) AS before, round(after, 4) AS after, CASE WHEN after - before > 2 THEN 'worth it' WHEN after > before THEN 'marginal' ELSE 'no gain' END AS verdict FROM g""")
def rerank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.read(spark, sf_dir, "customer")
    reply = F.concat(F.lit("pick "), F.col("c_custkey") % 5, F.lit("."))
    rows = c.select("c_custkey", F.lit(0).alias("retrieved"), t.parse_choice(reply, F.lit(3)).alias("choice"), (F.col("c_custkey") % 4).cast("int").alias("truth"))
    found = ev.rerank_report(rows)
    return found.select("n", "fixes", "breaks", "both_right", "both_wrong", "unparsed", _r("before").alias("before"), _r("after").alias("after"), "verdict")


@registered(f"WITH {IV}, m AS (SELECT row_pos, e, list_reverse(e) AS r FROM iv), a AS (SELECT row_pos, e, r, list_transform(list_zip(e, r), lambda p: (p[1] + p[2]) / 2) AS h FROM m) SELECT row_pos, round(list_inner_product(e, h) / sqrt(list_inner_product(h, h)), 4) AS tta, round((1 + list_inner_product(e, r) / sqrt(list_inner_product(e, e) * list_inner_product(r, r))) / 2, 4) AS combined FROM a")
def composite_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = F.col("embedding"), F.reverse("embedding")
    both, twice = v.combine_backends([e, r]), v.combine_backends([e, e])
    return d.image_vectors(spark, sf_dir).select("row_pos", _r(v.dot(e, v.tta_average(e, r))).alias("tta"), _r(v.dot(both, twice)).alias("combined"))


def _event_stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = d.read(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    if not d.read(spark, sf_dir, "events").inputFiles()[0].rstrip("/").endswith("/events.parquet"):
        return spark.readStream.schema(schema).parquet(path)  # a folder of files
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@registered(f"WITH {AU} SELECT id, created_at, predicted_category, top_sku, embedding_backend FROM au")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows appended by a stream, each id once."""
    out, check = (shared_path(spark, n) for n in ("audit", "audit-checkpoint"))
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone
    rows = d.audit_rows(events).drop("confirmed_sku", "user_id")
    jobs.stream_audit(rows, out, check, "40 days").awaitTermination()
    return spark.read.parquet(out).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "predicted_category", "top_sku", "embedding_backend")


@registered(f"WITH {IDENT} SELECT query_id, category AS predicted_category, embedding_backend_ AS embedding_backend, round(top_score, 4) AS top_score, no_match FROM (SELECT *, backend AS embedding_backend_, top_score < lim AS no_match FROM pk WHERE r = 1)")
def stream_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identification of micro-batches of query vectors against static centroids."""
    out, check, source = (shared_path(spark, n) for n in ("identified", "identified-checkpoint", "queries"))
    d.predictions(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(d.predictions(spark, sf_dir).schema).parquet(source)
    centroids, vectors = _centroids(spark, sf_dir).withColumn("category_slug", F.lower("category_slug")), d.query_vectors(spark, sf_dir)
    jobs.stream_identify(stream, lambda batch: ident.identify_batch(batch, vectors, centroids), out, check).awaitTermination()
    return spark.read.parquet(out).select("query_id", "predicted_category", "embedding_backend", _r("top_score").alias("top_score"), "no_match")


@registered(f"WITH {IV}, m AS (SELECT row_pos, e, list_transform(list_zip(e, list_reverse(e)), lambda p: (p[1] + p[2]) / 2) AS h FROM iv) SELECT row_pos, 'mirror' AS backend, round(h[1] / sqrt(list_inner_product(h, h)), 4) AS first, round(list_inner_product(e, h) / sqrt(list_inner_product(h, h)), 3) AS likeness FROM m")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable encoder over stored vectors (its mirror reads them backwards), averaged with the mirror."""

    def load():
        import numpy as np

        return lambda batch, mirrored: np.array([x[::-1] if mirrored else x for x in batch])

    iv = d.image_vectors(spark, sf_dir)
    found = images.embed(iv.select("row_pos", "embedding"), load, "mirror", id_column="row_pos", column="embedding").withColumnRenamed("embedding", "made")
    joined = found.join(iv.select("row_pos", "embedding"), "row_pos")
    return joined.select("row_pos", "backend", _r(F.col("made")[0].cast("double")).alias("first"), _r(v.dot(F.col("embedding"), F.col("made")), 3).alias("likeness"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_batch(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
