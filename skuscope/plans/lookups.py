"""Registered queries of lookups, checks, text functions, history and evaluation tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuscope.functions import text as t
from skuscope.functions import vectors as v
from skuscope.operators import audit as au
from skuscope.operators import catalog as ca
from skuscope.operators import evaluate as ev
from skuscope.operators import identify as ident
from skuscope.operators import search as se
from skuscope.plans import tables as d
from skuscope.plans.catalogue import AU, CA, CLS, FY, IDENT, IV, LOO, PR, ROUTES, registered
from skuscope.sources import catalog as src


def _text(c: str):
    return F.col(c).cast("string")


def _of(values: list, place):
    """The value at a place, as a column."""
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def _sql_of(values: list, place: str) -> str:
    return f"([{', '.join(repr(x) for x in values)}])[CAST({place} AS INT) + 1]"


@registered(f"WITH {PR} SELECT sku, product_name, true AS known, false AS ghost, (SELECT count(*) FROM pr) AS n FROM pr WHERE sku = '77'")
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.products(spark, sf_dir)
    return ca.get_product(p, "77").select("sku", "product_name", F.lit(ca.exists(p, "77")).alias("known"), F.lit(ca.exists(p, "ghost")).alias("ghost"), F.lit(p.count()).alias("n"))


@registered(f"WITH {FY} SELECT sku, CAST(count(*) FILTER (WHERE contains(lower(make || ' ' || model), 'n household')) AS INT) AS n FROM fy GROUP BY sku")
def fitment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = d.fitment_years(spark, sf_dir).groupBy("sku").agg(F.collect_set(F.struct("make", "model", "year")).alias("compatible_vehicles"))
    return ca.filter_fitment(vehicles, " N Household ").select("sku", F.size("compatible_vehicles").alias("n"))


ENDINGS = [".JPG", ".png", ".gif", "", ".webp"]


@registered(f"WITH f AS (SELECT doc_id, {_sql_of(ENDINGS, 'doc_id % 5')} AS e, length(coalesce(text, '')) * 9000 AS n FROM documents) SELECT doc_id, CASE WHEN e IN ('.gif', '') THEN 'unsupported type' WHEN n > 10485760 THEN 'too large' END AS reason FROM f")
def validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.read(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.lit("/up.load/"), F.col("doc_id"), _of(ENDINGS, F.col("doc_id") % 5)).alias("path"), (F.char_length(F.coalesce("text", F.lit(""))) * 9000).alias("length"))
    return src.validate_uploads(files).select("doc_id", "reason")


@registered(f"WITH {CA}, s AS (SELECT session_id, sku, CAST(sku AS INT) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM cand) SELECT session_id, sku, array_to_string(list_filter([CASE WHEN n > 8 THEN 'too many candidates' END, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'similarity out of range' END, CASE WHEN k % 23 = 0 THEN 'sku is blank' END], lambda x: x IS NOT NULL), ';') AS reasons FROM s")
def validate_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sku").cast("int")
    seeds = d.candidates(spark, sf_dir).withColumn("name", F.col("sku")).withColumn("similarity", F.when(k % 17 == 0, 1.5).when(k % 19 != 0, F.col("similarity"))).withColumn("sku", F.when(k % 23 == 0, " ").otherwise(F.col("sku")))
    return ca.validate_seeds(seeds, most=8).select("session_id", F.col("name").alias("sku"), F.array_join("reasons", ";").alias("reasons"))


@registered(f"WITH {AU} SELECT id, 'left' AS kind FROM au WHERE id % 7 <> 0 UNION ALL SELECT id + 10000000, 'unknown' FROM au WHERE id % 1000 = 0")
def deleted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = d.audit(spark, sf_dir)
    gone = a.filter("id % 7 = 0").select("id").unionByName(a.filter("id % 1000 = 0").select((F.col("id") + 10000000).alias("id")))
    left, unknown = au.delete_audit(a, gone)
    return left.select("id", F.lit("left").alias("kind")).unionByName(unknown.select("id", F.lit("unknown").alias("kind")))


@registered(f"WITH {AU}, {PR} SELECT id, top_sku, CASE WHEN CAST(sku AS INT) % 2 = 0 THEN 'https://img/' || sku END AS image FROM au LEFT JOIN pr ON sku = top_sku")
def history_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.history_with_images(d.audit(spark, sf_dir), d.products(spark, sf_dir)).select("id", "top_sku", "image")


@registered(f"WITH {AU} SELECT top_sku, confirmed_sku, count(*) AS n FROM au WHERE confirmed_sku IS NOT NULL AND confirmed_sku IS DISTINCT FROM top_sku GROUP BY ALL")
def correction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.correction_pairs(d.audit(spark, sf_dir))


NAMES = ["Air Filter", " wheel hub assembly ", "SHOCK ABSORBER", "Brake Pads", "Oil Filter"]


@registered(f"WITH p AS (SELECT p_partkey, {_sql_of(NAMES, 'p_partkey % 5')} AS category FROM part) SELECT p_partkey, category, CASE WHEN p_partkey % 5 < 3 THEN 'openclip' ELSE 'dinov2' END AS backend, CASE WHEN p_partkey % 5 < 3 THEN 0.86::DOUBLE ELSE 0.48::DOUBLE END AS threshold FROM p")
def backend_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part").select("p_partkey", _of(NAMES, F.col("p_partkey") % 5).alias("category"))
    return p.withColumn("backend", t.backend_for_category(F.col("category"))).withColumn("threshold", t.no_match_threshold(F.upper("backend")))


CELLS = ['{"lug_count": "5", "abs_sensor": "yes", "note": "  "}', '{"b": "x", "a": null}', "[1]", "{bad", ""]
CLEANED = ["abs_sensor=yes;lug_count=5", "b=x", "", "", ""]


@registered(f"SELECT p_partkey, {_sql_of(CLEANED, 'p_partkey % 5')} AS attributes, p_partkey % 5 IN (2, 3) AS malformed FROM part")
def parsed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part").select("p_partkey", _of(CELLS, F.col("p_partkey") % 5).alias("cell"))
    shown = F.transform(F.sort_array(F.map_entries(t.clean_attributes(t.parse_attributes(F.col("cell"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return p.select("p_partkey", F.array_join(shown, ";").alias("attributes"), t.attributes_malformed(F.col("cell")).alias("malformed"))


FACETS = ["make", "mpn", "attr:material", "attr:tooth_count", "attr:lug_count", "attr:abs_sensor"]
ASKED = [*(t.PROMPTS[f] if f in t.PROMPTS else ("What's the tooth count?", "Compare against the part in your photo.") for f in FACETS)]
KEYS, KEYS_SHOWN = ["lug_count", "sold_as", "tooth-count", "mpn"], ["Wheel studs", "Sold as", "Tooth count", "Part number"]
VALUES, VALUES_SHOWN = ["air-strut", "yes", "semi-metallic", "5"], ["Air strut", "Yes", "Semi-metallic", "5"]


def _quoted(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


@registered(
    f"SELECT p_partkey, ({_quoted(a for a, _ in ASKED)})[p_partkey % 6 + 1] AS prompt, ({_quoted(b for _, b in ASKED)})[p_partkey % 6 + 1] AS hint, ({_quoted(KEYS_SHOWN)})[p_partkey % 4 + 1] AS key, ({_quoted(VALUES_SHOWN)})[p_size % 4 + 1] AS value, "
    "CASE WHEN p_size % 3 > 0 THEN p_brand || ' X (' || (1990 + p_size) || '–' || (1991 + p_size) || ')' || CASE WHEN p_size % 3 = 2 THEN ' +1 more' ELSE '' END END AS fitment, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 19 AS VARCHAR) || ' ms' ELSE CAST(p_size AS VARCHAR) || '.5 s' END AS took FROM part"
)
def labels_and_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.read(spark, sf_dir, "part")
    asked = t.facet_prompt(_of(FACETS, F.col("p_partkey") % 6))
    one = lambda model: F.struct(F.col("p_brand").alias("make"), F.lit(model).alias("model"), (1990 + F.col("p_size")).alias("year_start"), (1991 + F.col("p_size")).alias("year_end"))
    ranges = F.slice(F.array(one("X"), one("Y")), 1, (F.col("p_size") % 3).cast("int"))
    took = F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 19.0).otherwise(F.col("p_size") * 1000.0 + 500)
    return p.select(
        "p_partkey", asked["prompt"].alias("prompt"), asked["hint"].alias("hint"), t.format_attribute_key(_of(KEYS, F.col("p_partkey") % 4)).alias("key"), t.format_attribute_value(_of(VALUES, F.col("p_size") % 4)).alias("value"), t.fitment_summary(ranges).alias("fitment"),
        t.format_search_time(took).alias("took"),
    )


@registered(f"WITH {IV} SELECT row_pos, '[' || printf('%.8f', e[1]) || ',' || printf('%.8f', e[2]) || ',' || printf('%.8f', e[64]) || ']' AS written, round(e[1] + e[2] + e[64], 5) AS total FROM iv")
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    rows = d.image_vectors(spark, sf_dir).select("row_pos", v.format_vector(F.array(e[0], e[1], e[63])).alias("written"))
    return rows.withColumn("total", F.round(F.aggregate(v.parse_vector(F.col("written")), F.lit(0.0), lambda a, x: a + x), 5))


@registered(f"WITH {IV}, c AS (SELECT row_pos, list_cosine_similarity(e, list_reverse(e)) AS s FROM iv) SELECT row_pos, round(s, 4) AS similarity, round(1 - s, 4) AS distance FROM c")
def mirror_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = F.col("embedding"), F.reverse("embedding")
    return d.image_vectors(spark, sf_dir).select("row_pos", F.round(v.cosine_similarity(e, r), 4).alias("similarity"), F.round(v.cosine_distance(e, r), 4).alias("distance"))


@registered(
    f"WITH {IV}, q AS (SELECT row_pos AS query_id, category_slug, e, row_pos % 2 AS wide FROM iv), s AS (SELECT q.query_id, CAST(p.row_pos AS VARCHAR) AS sku, list_inner_product(q.e, p.e) * CASE WHEN wide = 1 THEN 12 ELSE 8 END AS score FROM q JOIN iv p ON q.category_slug = p.category_slug AND q.wide = p.row_pos % 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sku) AS rank FROM s) SELECT query_id, sku, CAST(rank AS INT) AS rank, round(score, 3) AS score FROM r WHERE rank <= 4"
)
def search_products_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products' own vectors of two dimensions, searched by queries of both."""
    iv = d.image_vectors(spark, sf_dir)
    wide = F.col("row_pos") % 2 == 1
    repeated = lambda n: F.flatten(F.array_repeat("embedding", n))
    products = iv.select(F.col("row_pos").cast("string").alias("sku"), F.upper("category_slug").alias("category"), F.when(wide, repeated(12)).alias("embedding_768"), F.when(~wide, repeated(8)).alias("embedding_512"))
    queries = iv.select(F.col("row_pos").alias("query_id"), F.lower("category_slug").alias("category"), F.when(wide, repeated(12)).otherwise(repeated(8)).alias("embedding"))
    return se.search_products_table(queries, products, 4).select("query_id", "sku", "rank", F.round("similarity_score", 3).alias("score"))


@registered(f"WITH {PR} SELECT sku FROM pr WHERE p_size % 5 = 0")
def empty_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.products(spark, sf_dir).join(d.read(spark, sf_dir, "part").select(_text("p_partkey").alias("sku"), "p_size"), "sku")
    return ca.empty_attributes(p.withColumn("attributes", F.when(F.col("p_size") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.col("attributes"))))


@registered(
    f"WITH {IV}, x AS (SELECT row_pos, unnest(e[1:10]) AS p, unnest(range(10)) AS i FROM iv), r AS (SELECT *, CASE WHEN i < 8 THEN 'L' || i ELSE 'class_' || i END AS label, row_number() OVER (PARTITION BY row_pos ORDER BY p DESC, i) AS k FROM x) SELECT row_pos AS query_id, string_agg(label, ',' ORDER BY k) AS labels, round(max(p), 4) AS confidence, arg_min(label, k) AS best FROM r GROUP BY row_pos"
)
def ranked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.image_vectors(spark, sf_dir).select(F.col("row_pos").alias("query_id"), F.slice("embedding", 1, 10).alias("probabilities"))
    ranked = ident.rank_categories(rows, [f"L{i}" for i in range(8)])
    first = F.get("ranking", 0)
    return ranked.select("query_id", F.array_join(F.transform("ranking", lambda e: e["label"]), ",").alias("labels"), F.round(first["probability"], 4).alias("confidence"), first["label"].alias("best"))


@registered(f"WITH {LOO} SELECT row_pos, sku, CAST(rank AS BIGINT) AS rank, rival AS top_sku FROM loo WHERE rank > 1 ORDER BY row_pos LIMIT 25")
def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.misses(se.loo_ranks(d.image_vectors(spark, sf_dir))).select("row_pos", "sku", "rank", "top_sku")


@registered(f"WITH {LOO}, m AS (SELECT category_slug AS category, avg(CASE WHEN rank <= 1 THEN 100.0 ELSE 0 END) AS top1 FROM loo GROUP BY category_slug) SELECT category, round(top1, 4) AS top1 FROM m")
def worst_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.worst_categories(ev.retrieval_metrics(se.loo_ranks(d.image_vectors(spark, sf_dir)))).select("category", F.round("top1", 4).alias("top1"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.read(spark, sf_dir, "embeddings")
    name = lambda c: F.concat(F.lit("C"), c)
    return e.select(name(F.col("label")).alias("actual"), F.when(F.col("vec_id") % 7 == 0, name((F.col("label") + 1) % 10)).otherwise(name(F.col("label"))).alias("predicted"))


@registered(f"WITH {CLS} SELECT actual, " + ", ".join(f"count(*) FILTER (WHERE predicted = 'C{k}') AS C{k}" for k in range(10)) + " FROM c GROUP BY actual")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(_labelled(spark, sf_dir), [f"C{k}" for k in range(10)])


@registered(f"WITH {CLS}, r AS (SELECT actual AS label, count(*) AS support, count(*) FILTER (WHERE actual = predicted) AS correct FROM c GROUP BY ALL), g AS (SELECT predicted AS label, count(*) AS n FROM c GROUP BY ALL) SELECT label, round(2 * correct / (support + n), 4) AS f1, round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) FROM c), 4) AS accuracy FROM r JOIN g USING (label)")
def classification_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return ev.classification_report(rows).crossJoin(F.broadcast(ev.accuracy(rows))).select("label", F.round("f1", 4).alias("f1"), F.round("accuracy", 4).alias("accuracy"))


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = se.sku_centroids(d.image_vectors(spark, sf_dir)).withColumn("category_slug", F.lower("category_slug"))
    return ident.identify_batch(d.predictions(spark, sf_dir), d.query_vectors(spark, sf_dir), centroids)


@registered(f"WITH {IDENT}, l AS (SELECT query_id, place, count(*) AS n FROM ts GROUP BY ALL) SELECT query_id AS id, category AS predicted_category, round(confidence, 4) AS confidence, CASE WHEN top_score >= lim THEN top_sku END AS top_sku, top_sku AS first_candidate, CAST(least(n, 5) AS INT) AS n_candidates, backend AS embedding_backend FROM pk JOIN l USING (query_id, place) WHERE r = 1")
def audit_of_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ident.to_audit(_identified(spark, sf_dir))
    return rows.select("id", "predicted_category", F.round("confidence", 4).alias("confidence"), "top_sku", F.get("candidates", 0)["sku"].alias("first_candidate"), F.size("candidates").alias("n_candidates"), "embedding_backend")


@registered(f"WITH {ROUTES} SELECT query_id, string_agg(category, ',' ORDER BY place) AS searched FROM rt GROUP BY query_id")
def searched_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).select("query_id", F.array_join("searched_categories", ",").alias("searched"))


@registered(f"WITH {ROUTES} SELECT DISTINCT query_id, 'no index for any category' AS error FROM rt WHERE query_id NOT IN (SELECT query_id FROM rt WHERE category IN ('C0', 'C1', 'C2'))")
def unroutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of categories that have no index when only three have one."""
    p = d.predictions(spark, sf_dir)
    few = d.image_vectors(spark, sf_dir).filter("category_slug in ('C0', 'C1', 'C2')").select(F.lower("category_slug").alias("category_slug"))
    return ident.unroutable(p, ident.route_categories(p, few))


#: Pieces of descriptions, one of each group for each part; so all rules, negations and categories meet.
GROUPS = [
    ["A front unit.", "Fits the rear axle.", "Does not fit the rear.", "No front. For the front axle.", "A part."],
    ["Sold as a pair.", "Single piece.", "Not a set.", "", "Complete set of two."],
    ["Cast iron body.", "Cast-iron and rubber.", "Without polyurethane, stainless parts only.", "Forged steel.", "Aluminum housing.", "Not made of any kind of rubber, of course, but of steel."],
    ["Spin-on canister.", "Cartridge insert.", "Cabin panel.", "Conical shape.", "Ceramic compound.", "Semi-metallic, not ceramic.", "Long tube header.", "OEM manifold.", "Direct injection, GDI.", "LPG port.", "Electric motor driven.", "Hydraulic, no reservoir.", "Air spring strut.", "Piggyback.", "Drive-by-wire.", "Throttle cable."],
    ["With ABS sensor.", "Without an ABS sensor.", "Has a wear sensor.", "Lacks a wear indicator.", "Pulley fitted.", "No pulley.", "Catalytic converter included.", "Reservoir on top."],
    ["Black then silver.", "Silver, not black.", "Engineered finish.", "Duralast Gold line.", "Golden or graphite.", "Chrome-plated, red."],
    ["5-lug flange.", "A 15-lug joke, 6-lug.", "Many lugs."],
]
KINDS = ["Wheel Hub Assembly", "Brake Pads", "Oil Filter", "Air Filter", "Exhaust Manifold", "Fuel Injector", "Power Steering Pump", "Shock Absorber", "Throttle Body", "Suspension Bushing"]
STEPS = [1, 5, 7, 3, 11, 13, 17]
NEGATED = rf"\b({'|'.join(t.NEGATORS)})\b[^.]{{0,40}}$"


def _unnegated_sql(pattern: str) -> str:
    """Whether a mention of the pattern in x has no negator within 40 characters before it: each mention is marked, and what stands before it looked at."""
    parts = f"string_split(regexp_replace(x, '({pattern})', chr(1) || '\\1', 'g'), chr(1))"
    return f"coalesce(list_bool_or(list_transform(range(1, len({parts})), lambda i: NOT regexp_matches(array_to_string({parts}[1:i], ''), '{NEGATED}'))), false)"


def _rules_sql() -> str:
    columns = []
    for attribute, cases in t.RULES.items():
        whens = [f"WHEN {'' if only is None else f'kind = {only!r} AND '}{_unnegated_sql(pattern)} THEN '{label}'" for only, values in cases for label, pattern in values]
        columns.append(f"CASE {' '.join(whens)} END AS {attribute}")
    for attribute, (pattern, only) in t.PRESENCE.items():
        columns.append(f"CASE WHEN kind <> '{only}' THEN NULL WHEN {_unnegated_sql(pattern)} THEN 'yes' WHEN regexp_matches(x, '{pattern}') THEN 'no' END AS {attribute}")
    spots = ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN struct_pack(spot := length(regexp_extract(x, '^(.*?)({p})', 1)), colour := '{c}') END" for c, p in t.COLOURS.items())
    columns.append(f"list_min(list_filter([{spots}], lambda s: s IS NOT NULL)).colour AS primary_colour")
    columns.append(r"CASE WHEN kind = 'Wheel Hub Assembly' THEN nullif(regexp_extract(x, '\b(\d)-lug\b', 1), '') END AS lug_count")
    return ", ".join(columns)


ATTRIBUTES = [*t.RULES, *t.PRESENCE, "primary_colour", "lug_count"]


def _attributes(found, key: str) -> DataFrame:
    return found.select(key, *[F.try_element_at("m", F.lit(a)).alias(a) for a in ATTRIBUTES])


@registered(
    f"WITH g AS (SELECT p_partkey, {_sql_of(KINDS, 'p_partkey % 10')} AS kind, regexp_replace(lower('Part ' || {' || chr(32) || '.join(f'({_quoted(g)})[(p_partkey // {s}) % {len(g)} + 1]' for g, s in zip(GROUPS, STEPS))}), '{t.BRAND_PHRASES}', ' ', 'g') AS x FROM part) SELECT p_partkey, {_rules_sql()} FROM g"
)
def attributes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's own rules over made-up descriptions of all parts."""
    k = F.col("p_partkey")
    description = F.concat_ws(" ", *[_of(g, F.floor(k / s) % len(g)) for g, s in zip(GROUPS, STEPS)])
    rows = d.read(spark, sf_dir, "part").select("p_partkey", t.extract_attributes(F.lit("Part"), description, _of(KINDS, k % 10)).alias("m"))
    return _attributes(rows, "p_partkey")


#: The SQL's regular expressions know letters of ASCII only: other letters, marks and digits become underscores there, all other characters commas.
PLAIN = r"regexp_replace(regexp_replace({x}, '[^\x00-\x7f\P{{L}}]|[^\x00-\x7f\P{{M}}]|[^\x00-\x7f\P{{N}}]', '_', 'g'), '[^\x00-\x7f]', ',', 'g')"


@registered(f"WITH g AS (SELECT doc_id, {_sql_of(KINDS, 'doc_id % 10')} AS kind, regexp_replace(' ' || {PLAIN.format(x="lower(coalesce(text, ''))")}, '{t.BRAND_PHRASES}', ' ', 'g') AS x FROM documents) SELECT doc_id, {_rules_sql()} FROM g".replace("'^(.*?)(", "'(?s)^(.*?)("))
def attributes_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's own rules over all documents as they are."""
    rows = d.read(spark, sf_dir, "documents").select("doc_id", t.extract_attributes(F.lit(""), F.col("text"), _of(KINDS, F.col("doc_id") % 10)).alias("m"))
    return _attributes(rows, "doc_id")
