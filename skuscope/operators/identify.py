"""Batch identification: rank, route, search, gate, enrich, record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.functions import text as t
from skuscope.operators.catalog import recommend
from skuscope.operators.search import search_topk


# The sentences of prompts and summaries, with %s where a value stands.
STATED = "Predicted category: %s (confidence: %s)"
UNCONFIRMED = "Category (unconfirmed - nothing in the catalog matched): %s at %s confidence"
NOT_RECOGNISED = "Category: NOT RECOGNISED. The classifier's best guess reached only %s confidence, which is too low to state. Do not name a category in your reply."
TOP_MATCHES = "Top matched SKUs (by visual similarity):"
MATCH = "  - %s (similarity: %s)"
MATCHED = "Matched catalog product: %s — %s (%s)"
NO_MATCHED = "No confident catalog match was found for the top SKU."
FITS = "Compatible vehicles: %s"
FITS_NOTHING = "Compatible vehicles: not specified in the catalog."
ALTERNATIVES = "Alternative/replacement SKUs: %s"
ACCESSORIES = "Related accessory SKUs: %s"
REFUSED = "The image was not recognized as a catalog part"
CLOSEST = "No catalog entry cleared the %s match threshold; the closest scored %s"
NOTHING_FOUND = "The visual search returned no catalog entries for this part"
CATEGORY = "Predicted category: %s"
HIGHEST = "Highest visual similarity among catalog candidates (%s)"
STRONG = "Strong score separation from lower-ranked candidates (+%s)"
CLOSE = "Close score separation from the next candidate (%s apart), so confirmation is recommended"
# End of the fixed values.


def _sentence(template: str, *values) -> Column:
    """A sentence with its values; null if one of them is."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(known, F.format_string(template, *columns))


def rank_categories(df: DataFrame, labels: list[str], strict: bool = False, column: str = "probabilities") -> DataFrame:
    """Adds ranking: (probability, label) by descending probability, ties by place; a place without a label is class_<i>, or the row goes (strict)."""
    names = F.array(*map(F.lit, labels))
    entry = lambda p, i: F.struct(p.cast("double").alias("probability"), (-i).alias("place"), F.coalesce(F.get(names, i), F.concat(F.lit("class_"), i.cast("string"))).alias("label"))
    ranked = df.filter(F.size(column) <= len(labels)) if strict else df
    found = F.sort_array(F.transform(column, entry), asc=False)
    return ranked.withColumn("ranking", F.transform(found, lambda e: F.struct(e["label"].alias("label"), e["probability"].alias("probability"))))


def route_categories(predictions: DataFrame, available: DataFrame) -> DataFrame:
    """predictions(query_id, ranking) -> a row for each category to search: query_id, place, category,
    confidence, uncertain. Under 0.5 the runner-up is searched too, unless it is the same category;
    categories without an index (available: category_slug) are left out."""
    first, second = F.get("ranking", 0), F.get("ranking", 1)
    resolved = F.transform("ranking", lambda r: F.struct(t.resolve_category(r["label"]).alias("category"), r["probability"].alias("confidence")))
    uncertain = first["probability"] < t.UNCERTAIN_BELOW
    two = uncertain & second.isNotNull()
    chosen = F.slice(resolved, 1, F.when(two, 2).otherwise(1))
    primary = t.category_slug(F.get(resolved, 0)["category"])
    rows = predictions.filter(F.size("ranking") > 0).select("query_id", uncertain.alias("uncertain"), primary.alias("primary"), F.posexplode(chosen).alias("place", "c"))
    rows = rows.select("query_id", "place", "c.category", "c.confidence", "uncertain", "primary", t.category_slug(F.col("c.category")).alias("category_slug"))
    rows = rows.filter((F.col("place") == 0) | (F.col("category_slug") != F.col("primary"))).drop("primary")
    return rows.join(F.broadcast(available.select("category_slug").distinct()) if _few(available) else available.select("category_slug").distinct(), "category_slug", "left_semi")


def _few(df: DataFrame, limit: int = 100_000) -> bool:
    return df.select("category_slug").distinct().limit(limit + 1).count() <= limit


def searched_categories(routes: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("place", "category")))
    return routes.groupBy("query_id").agg(F.transform(listed, lambda e: e["category"]).alias("searched_categories"))


def unroutable(predictions: DataFrame, routes: DataFrame) -> DataFrame:
    return predictions.select("query_id").join(routes.select("query_id").distinct(), "query_id", "left_anti").withColumn("error", F.lit("no index for any category"))


def pick_category(searches: DataFrame) -> DataFrame:
    """searches(query_id, place, category, confidence, backend, top_score): the one whose top score is
    farthest over its backend's threshold, ties to the primary."""
    margin = F.coalesce(F.col("top_score") - t.no_match_threshold(F.col("backend")), F.lit(float("-inf")))
    w = W.partitionBy("query_id").orderBy(F.desc("margin"), "place")
    return searches.withColumn("margin", margin).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "margin")


def no_match_verdict(df: DataFrame) -> DataFrame:
    """Adds no_match_threshold (0.04 more if the classifier was unsure) and no_match."""
    limit = t.no_match_threshold(F.col("backend")) + F.when(F.col("uncertain"), t.UNCERTAIN_MARGIN).otherwise(0.0)
    return df.withColumn("no_match_threshold", limit).withColumn("no_match", F.col("top_score").isNull() | (F.col("top_score") < limit))


def identify_batch(predictions: DataFrame, query_vectors: DataFrame, centroids: DataFrame, products: DataFrame | None = None, k: int = 5) -> DataFrame:
    """predictions(query_id, ranking) and query_vectors(query_id, backend, remove_bg, embedding) -> a row a
    query: predicted_category, confidence, backend, results, searched_categories, threshold, no_match,
    and of matched ones the product's name and the number of recommendations."""
    routes = route_categories(predictions, centroids)
    wanted = routes.join(query_vectors, "query_id").withColumn("query_key", F.concat_ws("/", F.col("query_id").cast("string"), "place"))
    found = search_topk(wanted.select("category_slug", "backend", "remove_bg", F.col("query_key").alias("query_id"), "embedding"), centroids, k)
    lists = found.groupBy(F.col("query_id").alias("query_key"), "backend").agg(F.sort_array(F.collect_list(F.struct("rank", "sku", "similarity_score"))).alias("results"))
    searched = routes.withColumn("query_key", F.concat_ws("/", F.col("query_id").cast("string"), "place")).join(lists, "query_key", "left")
    searched = searched.withColumn("top_score", F.get("results", 0)["similarity_score"])
    chosen = no_match_verdict(pick_category(searched)).join(searched_categories(routes), "query_id")
    out = chosen.select("query_id", F.col("category").alias("predicted_category"), "confidence", F.col("backend").alias("embedding_backend"), "results", "top_score", "uncertain", "no_match_threshold", "no_match", "searched_categories")
    if products is None:
        return out
    top = F.when(~F.col("no_match"), F.get("results", 0)["sku"])
    related = recommend(products).groupBy("sku").agg(F.count("*").alias("n_related"))
    info = products.select("sku", "product_name").join(related, "sku", "left").withColumnRenamed("sku", "top_sku")
    return out.withColumn("top_sku", top).join(info, "top_sku", "left").fillna(0, ["n_related"])


def to_audit(results: DataFrame) -> DataFrame:
    """Audit rows of finished predictions; the top SKU is null without a match."""
    candidates = F.transform("results", lambda r: F.struct(r["sku"].alias("sku"), r["similarity_score"].alias("similarity_score"), r["rank"].cast("int").alias("rank")))
    return results.select(F.col("query_id").alias("id"), F.current_timestamp().alias("created_at"), "predicted_category", "confidence", F.when(~F.col("no_match"), F.get("results", 0)["sku"]).alias("top_sku"), candidates.alias("candidates"), "embedding_backend")


def build_prompts(df: DataFrame) -> DataFrame:
    """df(query_id, predicted_category, confidence, no_match, results, product struct or null (sku, product_name,
    brand, fitment text), alternatives, accessories) -> query_id and the prompt for an offline language model."""
    percent = lambda c: F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))
    confidence = percent(F.col("confidence"))
    claim = t.category_claim(F.col("no_match"), F.col("confidence"))
    line = F.when(claim == "stated", _sentence(STATED, F.col("predicted_category"), confidence)).when(claim == "unconfirmed", _sentence(UNCONFIRMED, F.col("predicted_category"), confidence)).otherwise(_sentence(NOT_RECOGNISED, confidence))
    shown = F.transform(F.slice("results", 1, 5), lambda r: _sentence(MATCH, r["sku"], percent(r["similarity_score"])))
    matched = _sentence(MATCHED, "product.sku", "product.product_name", "product.brand")
    fits = F.when(F.coalesce(F.col("product.fitment"), F.lit("")) != "", _sentence(FITS, "product.fitment")).otherwise(FITS_NOTHING)
    body = F.when(F.col("product").isNotNull(), F.array(F.lit(""), matched, fits)).otherwise(F.array(F.lit(""), F.lit(NO_MATCHED)))
    listed = lambda c, label: F.when(F.size(c) > 0, _sentence(label, F.array_join(c, ", ")))
    tail = F.array_compact(F.array(listed("alternatives", ALTERNATIVES), listed("accessories", ACCESSORIES)))
    return df.select("query_id", F.array_join(F.concat(F.array(line, F.lit(TOP_MATCHES)), shown, body, tail), "\n").alias("prompt"))


def summary_lines(df: DataFrame) -> DataFrame:
    """df(query_id, predicted_category, no_match, no_match_threshold, top_score, gap) -> the lines that sum a result up."""
    score, gap = F.col("top_score"), F.col("gap")
    refused = F.array(F.lit(REFUSED), F.when(score.isNotNull(), _sentence(CLOSEST, t.format_percent(F.col("no_match_threshold")), t.format_percent(score))).otherwise(NOTHING_FOUND))
    apart = F.when(gap >= 0.08, _sentence(STRONG, t.format_gap(gap))).when(gap.isNotNull(), _sentence(CLOSE, t.format_gap(gap)))
    matched = F.array_compact(F.array(_sentence(CATEGORY, t.format_category(F.col("predicted_category"))), F.when(score.isNotNull(), _sentence(HIGHEST, t.format_percent(score))), apart))
    return df.select("query_id", F.when(F.col("no_match"), refused).otherwise(matched).alias("lines"))
