"""Registered queries of guided sessions, prompts, streams of confirmations and model hooks, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuscope.functions import images as im
from skuscope.operators import fitment as fi
from skuscope.operators import identify as ident
from skuscope.operators import questions as qu
from skuscope.operators import search as se
from skuscope.plans import tables as d
from skuscope.plans.catalogue import AU, CA, FY, IV, OPT, TOP, registered
from skuscope.sources.scratch import shared_path, stored
from skuscope.streaming import jobs


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.collapse_fitment_years(d.fitment_years(spark, sf_dir))


SEEDS = "sd AS (SELECT session_id, CASE WHEN CAST(sku AS INT) % 9 = 0 OR session_id LIKE '50-%' THEN 'GHOST-' || sku ELSE sku END AS sku, similarity FROM cand)"


@registered(
    f"WITH {CA}, {SEEDS}, f AS (SELECT sd.*, CAST(row_number() OVER (PARTITION BY session_id ORDER BY similarity DESC, sku) AS INT) AS rank FROM sd WHERE sku IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)) SELECT session_id, sku, rank FROM f UNION ALL SELECT DISTINCT session_id, 'none', 0 FROM sd WHERE session_id NOT IN (SELECT session_id FROM f)"
)
def seeded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, some of no product; sessions without any known one are reported."""
    ghost = (F.col("sku").cast("int") % 9 == 0) | F.col("session_id").startswith("50-")
    seeds = d.candidates(spark, sf_dir).select("session_id", F.when(ghost, F.concat(F.lit("GHOST-"), "sku")).otherwise(F.col("sku")).alias("sku"), "similarity")
    known, errors = qu.seed_candidates(seeds, d.products(spark, sf_dir))
    return known.select("session_id", "sku", "rank").unionByName(errors.select("session_id", F.lit("none").alias("sku"), F.lit(0).alias("rank")))


def _fitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(d.candidates(spark, sf_dir).select("session_id", "sku").join(_ranges(spark, sf_dir), "sku"), "session-fitment")


VEHICLE = f"{FY}, {CA}, sf AS (SELECT c.session_id, f.* FROM cand c JOIN fr f USING (sku)), mk AS (SELECT session_id, min(make) AS make, min(model) AS model FROM sf GROUP BY session_id)"


def _vehicle_answers(rows: DataFrame) -> DataFrame:
    """Two answers a session: its first make, and the years 1994 to 1996 (of odd sessions also the first model)."""
    first = rows.groupBy("session_id").agg(F.min("make").alias("make"), F.min("model").alias("model"))
    odd = F.col("session_id").endswith("1")
    none, year = F.lit(None).cast("string"), F.lit(None).cast("int")
    makes = first.select("session_id", "make", F.when(odd, F.col("model")).alias("model"), year.alias("year_start"), year.alias("year_end"))
    return makes.unionByName(first.select("session_id", none.alias("make"), none.alias("model"), F.lit(1994).alias("year_start"), F.lit(1996).alias("year_end")))


@registered(f"WITH {VEHICLE} SELECT session_id, sku, sf.make, sf.model, year_start, year_end FROM sf JOIN mk USING (session_id) WHERE sf.make = mk.make AND (session_id NOT LIKE '%1' OR sf.model = mk.model) AND year_start <= 1996 AND year_end >= 1994")
def fitment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fitment(spark, sf_dir)
    return fi.filter_fitment_rows(rows, _vehicle_answers(rows)).select("session_id", "sku", "make", "model", "year_start", "year_end")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns a session: the brand of its smallest SKU, a skipped question, and the brand again."""
    c = d.candidates(spark, sf_dir)
    first = c.groupBy("session_id").agg(F.min_by("brand", "sku").alias("brand"))
    chosen = c.join(first, ["session_id", "brand"]).groupBy("session_id", "brand").agg(F.array_sort(F.collect_set("sku")).alias("skus"))
    turn = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("turn_no")
    rows = chosen.select("session_id", "brand", "skus", turn).withColumn("skipped", F.col("turn_no") == 1)
    shown = lambda c: F.when(~F.col("skipped"), F.col(c)).alias(c)
    return rows.select("session_id", "turn_no", F.when(F.col("skipped"), "mpn").otherwise("brand").alias("facet"), F.lit("?").alias("prompt"), F.when(~F.col("skipped"), F.col("brand")).alias("label"), shown("skus"), "skipped")


TURNS = f"{CA}, fb AS (SELECT session_id, arg_min(brand, sku) AS brand FROM cand GROUP BY session_id), ch AS (SELECT session_id, brand, list_sort(list(DISTINCT sku)) AS skus FROM cand JOIN fb USING (session_id, brand) GROUP BY ALL)"


@registered(f"WITH {TURNS} SELECT session_id, CAST(k AS INT) AS turn_no, CASE WHEN k = 1 THEN 'mpn' ELSE 'brand' END AS facet, CASE WHEN k = 1 THEN 'Not sure' ELSE brand END AS label, array_to_string(skus, ',') AS skus FROM ch, range(3) t(k)")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qu.transcript(d.candidates(spark, sf_dir), _turns(spark, sf_dir))
    return found.select("session_id", "turn_no", "facet", "label", F.array_join("skus", ",").alias("skus"))


KEEP = "CAST(string_split(session_id, '-')[1] AS INT) % 5"


@registered(f"WITH {TURNS}, k AS (SELECT session_id, {KEEP} AS keep FROM fb) SELECT session_id, CAST(t.n AS INT) AS turn_no, 'kept' AS kind FROM k, range(3) t(n) WHERE keep < 4 AND t.n < CASE WHEN keep = 0 THEN 3 ELSE keep END UNION ALL SELECT session_id, 4, 'too many' FROM k WHERE keep = 4")
def undone_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions cut to their first turns; one in five has no request, another asks for more than there are."""
    turns = _turns(spark, sf_dir)
    asked = (F.split("session_id", "-")[0].cast("int") % 5).alias("keep")
    kept, bad = qu.undo(turns, turns.select("session_id", asked).distinct().filter("keep > 0"))
    return kept.filter(F.split("session_id", "-")[0].cast("int") % 5 != 4).select("session_id", "turn_no", F.lit("kept").alias("kind")).unionByName(bad.select("session_id", F.col("keep").alias("turn_no"), F.lit("too many").alias("kind")))


PICK = "CAST(string_split(session_id, '-')[1] AS INT) % 4"


@registered(
    f"WITH {CA}, o AS (SELECT session_id, list(brand ORDER BY brand) AS labels FROM (SELECT DISTINCT session_id, brand FROM cand) GROUP BY session_id) SELECT session_id, CASE {PICK} WHEN 0 THEN labels[1] WHEN 2 THEN 'skipped' END AS answer, CASE {PICK} WHEN 1 THEN 'no such option' WHEN 3 THEN 'exactly one of option and skip' END AS reason FROM o UNION ALL SELECT 'ghost', NULL, 'no open question'"
)
def applied_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pick for each session's brand question: the first option, one that isn't there, a skip, or both."""
    c = d.candidates(spark, sf_dir)
    labels = c.groupBy("session_id", F.col("brand").alias("label")).agg(F.array_sort(F.collect_set("sku")).alias("skus"))
    options = labels.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("label", "skus"))).alias("options")).select("session_id", F.lit("brand").alias("facet"), F.lit("?").alias("prompt"), "options")
    kind = F.split("session_id", "-")[0].cast("int") % 4
    picks = options.select("session_id", F.when(kind == 1, 999).when(kind != 2, 0).alias("option"), (kind >= 2).alias("skip"))
    ghost = spark.range(1).select(F.lit("ghost").alias("session_id"), F.lit(0).alias("option"), F.lit(False).alias("skip"))
    good, bad = qu.apply_turns(options, picks.unionByName(ghost))
    none = F.lit(None).cast("string")
    return good.select("session_id", F.when(F.col("skipped"), "skipped").otherwise(F.col("label")).alias("answer"), none.alias("reason")).unionByName(bad.select("session_id", none.alias("answer"), "reason"))


@registered(
    f"WITH {OPT}, one AS (SELECT session_id, min(sku) AS sku FROM rem GROUP BY session_id HAVING count(*) = 1), pk AS (SELECT session_id, min(sku) AS sku FROM cand GROUP BY session_id) SELECT s.session_id, nxt.session_id IS NOT NULL AS can, coalesce(pk.sku = one.sku AND ans.session_id IS NOT NULL, false) AS confirmed FROM (SELECT DISTINCT session_id FROM cand) s LEFT JOIN nxt USING (session_id) LEFT JOIN pk USING (session_id) LEFT JOIN one USING (session_id) LEFT JOIN ans USING (session_id)"
)
def disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each session has a question left, and whether picking its smallest SKU is what the answers say."""
    c, turns, fitment = d.candidates(spark, sf_dir), d.answers(spark, sf_dir), _fitment(spark, sf_dir)
    picks = c.groupBy("session_id").agg(F.min("sku").alias("sku"))
    return qu.can_disambiguate(c, fitment, turns).join(qu.confirmed_by_answers(qu.session_state(c, fitment, turns), picks, turns), "session_id")


@registered(
    """WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, ((p_partkey * 37) % 100) / 100.0::DOUBLE AS c FROM part), f AS (SELECT *, CAST(CAST(round_even(c * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS pct FROM p)
SELECT k AS query_id, CASE WHEN k % 3 > 0 THEN 'Predicted category: ' || p_type || ' (confidence: ' || pct || ')' WHEN c >= 0.75 THEN 'Category (unconfirmed - nothing in the catalog matched): ' || p_type || ' at ' || pct || ' confidence' ELSE 'Category: NOT RECOGNISED. The classifier''s best guess reached only ' || pct || ' confidence, which is too low to state. Do not name a category in your reply.' END
|| chr(10) || 'Top matched SKUs (by visual similarity):' || chr(10) || '  - ' || k || ' (similarity: 88%)' || chr(10) || '  - ' || (k + 1) || ' (similarity: 71%)' || chr(10) || CASE WHEN k % 3 = 0 THEN chr(10) || 'No confident catalog match was found for the top SKU.' ELSE chr(10) || 'Matched catalog product: ' || k || ' — ' || p_name || ' (' || p_brand || ')' || chr(10) || 'Compatible vehicles: ' || CASE WHEN p_size % 2 = 0 THEN 'Ford F-150 2015-' || (2015 + p_size) ELSE 'not specified in the catalog.' END END
|| CASE WHEN k % 2 = 0 THEN chr(10) || 'Alternative/replacement SKUs: ' || (k + 1) || ', ' || (k + 2) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Related accessory SKUs: ' || (k * 2) ELSE '' END AS prompt FROM f"""
)
def full_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with every part that one can have: fitment, alternatives and accessories, matched or not."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    result = lambda sku, score: F.struct(text(sku).alias("sku"), F.lit(score).alias("similarity_score"))
    fitment = F.when(size % 2 == 0, F.concat(F.lit("Ford F-150 2015-"), text(2015 + size))).otherwise("")
    product = F.struct(text(k).alias("sku"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), fitment.alias("fitment"))
    none = F.array().cast("array<string>")
    rows = d.read(spark, sf_dir, "part").select(
        k.alias("query_id"), F.col("p_type").alias("predicted_category"), (k * 37 % 100 / 100).alias("confidence"), (k % 3 == 0).alias("no_match"), F.array(result(k, 0.88), result(k + 1, 0.71)).alias("results"), F.when(k % 3 > 0, product).alias("product"),
        F.when(k % 2 == 0, F.array(text(k + 1), text(k + 2))).otherwise(none).alias("alternatives"), F.when(size % 3 == 0, F.array(text(k * 2))).otherwise(none).alias("accessories"),
    )
    return ident.build_prompts(rows)


def _stream(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files."""
    source = shared_path(spark, name)
    rows.write.parquet(source)
    return spark.readStream.schema(rows.schema).parquet(source)


def _appended(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out, check = (shared_path(spark, f"{name}{x}") for x in ("", "-checkpoint"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@registered(
    f"WITH {AU}, c AS (SELECT id, confirmed_sku, created_at + to_hours(CAST(id % 30 AS INT)) AS confirmed_at FROM au WHERE confirmed_sku IS NOT NULL), e AS (SELECT max(created_at) - INTERVAL 4 DAY AS till FROM au) SELECT au.id, c.confirmed_sku FROM au LEFT JOIN c ON au.id = c.id AND c.confirmed_at <= au.created_at + INTERVAL 1 DAY WHERE created_at < (SELECT till FROM e)"
)
def confirmed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined with their confirmations, both as streams; of the last days, which the watermark hasn't passed, nothing is shown."""
    a = d.audit(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    predictions = a.select("id", "created_at", "top_sku")
    confirmations = a.filter("confirmed_sku is not null").select("id", (F.col("created_at") + F.make_interval(hours=(F.col("id") % 30).cast("int"))).alias("confirmed_at"), "confirmed_sku")
    joined = jobs.join_confirmations(_stream(spark, predictions, "predictions"), _stream(spark, confirmations, "confirmations"))
    found = _appended(spark, joined, "confirmed")
    till = predictions.agg((F.max("created_at") - F.expr("INTERVAL 4 DAYS")).alias("till"))
    return found.join(F.broadcast(till), F.col("created_at") < F.col("till")).select("id", "confirmed_sku")


@registered(
    "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x), z AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_turns FROM y GROUP BY user_id, s) SELECT * FROM z WHERE session_end < (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions out of a stream of turns, once the watermark has passed their end."""
    turns = d.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = _appended(spark, jobs.sessions(_stream(spark, turns, "turns")), "sessions")
    till = turns.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("till"))
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.join(F.broadcast(till), F.col("session_end") < F.col("till")).select("user_id", plain("session_start"), plain("session_end"), "n_turns")


def _soft(batch):
    """A stand-in for a classifier: shares of the squares of the first ten values."""
    m = np.array([np.asarray(x[:10], np.float64) ** 2 for x in batch])
    return m / m.sum(axis=1, keepdims=True)


@registered(f"WITH {IV}, s AS (SELECT row_pos, list_transform(e[1:10], lambda x: x * x) AS q FROM iv), n AS (SELECT row_pos, list_transform(q, lambda x: x / list_sum(q)) AS p FROM s) SELECT row_pos AS query_id, round(p[1], 4) AS first, CAST(list_position(p, list_max(p)) - 1 AS INT) AS best FROM n")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable classifier over stored vectors."""
    rows = d.image_vectors(spark, sf_dir).select(F.col("row_pos").alias("query_id"), F.col("embedding").alias("data"))
    p = F.col("probabilities")
    return im.classify(rows, lambda: _soft).select("query_id", F.round(p[0], 4).alias("first"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("best"))


def _reply(shortlists: list) -> list[str]:
    """A stand-in for a model that picks: the SKU that ends in 3 or 7, in words; else it can't tell."""
    picks = [next((k for k, sku in enumerate(x, 1) if sku[-1] in "37"), None) for x in shortlists]
    return ["Hard to tell." if k is None else f"I'd say #{k}, of {len(x)}." for k, x in zip(picks, shortlists)]


@registered(f"WITH {TOP}, l AS (SELECT query_id, list(sku ORDER BY rank) AS skus FROM top WHERE rank <= 3 GROUP BY query_id) SELECT query_id, array_to_string(skus, ',') AS skus, list_filter(skus, lambda s: s[-1] IN ('3', '7'))[1] AS choice FROM l")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable chooser over the first three of each search."""
    found = se.search_topk(d.queries(spark, sf_dir), se.sku_centroids(d.image_vectors(spark, sf_dir)), 3)
    lists = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sku"))), lambda e: e["sku"]).alias("skus"))
    return im.rerank(lists, lambda: _reply).select("query_id", F.array_join("skus", ",").alias("skus"), "choice")


@registered(f"WITH {IV}, m AS (SELECT row_pos, list_avg(list_transform(e, lambda x: CASE WHEN floor(abs(x) * 60) >= 10 THEN 1.0 ELSE 0 END)) AS share FROM iv) SELECT row_pos, share >= 0.3 AS usable FROM m")
def usable_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 60).cast("int"))
    return im.masks_ok(d.image_vectors(spark, sf_dir).select("row_pos", alpha.alias("alpha")), least=0.3).select("row_pos", "usable")
