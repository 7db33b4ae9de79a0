"""Retrieval metrics, score distributions, threshold sweeps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Per category and OVERALL: queries, products, top-1 and top-3 per cent, mean reciprocal rank."""
    found = ranks.rollup("category_slug").agg(
        F.count("*").alias("n"), F.countDistinct("sku").alias("products"), (F.avg((F.col("rank") <= 1).cast("int")) * 100).alias("top1"), (F.avg((F.col("rank") <= 3).cast("int")) * 100).alias("top3"), F.avg(1 / F.col("rank")).alias("mrr"), F.grouping("category_slug").alias("g")
    )
    return found.withColumn("category", F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("category_slug"))).select("category", "n", "products", "top1", "top3", "mrr")


def misses(ranks: DataFrame, n: int = 25) -> DataFrame:
    """Queries whose true SKU is not first, the first n by row."""
    return ranks.filter("rank > 1").orderBy("row_pos").limit(n)


def worst_categories(metrics: DataFrame) -> DataFrame:
    return metrics.filter("category <> 'OVERALL'").orderBy("top1", "category")


def quantiles(scores: DataFrame, by: str, points: tuple[float, ...], slots: int = 4096) -> DataFrame:
    """by, n, min, max and q (the interpolated quantile at each point), exact, without holding a group's scores in one place.

    Counts of equally wide slots say which slots hold the wanted ranks; only
    their scores are ordered, as counts of equal ones.
    """
    scores = scores.select(by, "score").filter(F.col("score").isNotNull())
    whole = scores.groupBy(by).agg(F.count("*").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"))
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col("score") - F.col("min"), F.col("max") - F.col("min")) * slots), F.lit(slots - 1)), F.lit(0)).cast("int")
    placed = scores.join(whole, by).select(by, "score", place.alias("slot"))
    before = lambda *keys: W.partitionBy(by, *keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    counted = placed.groupBy(by, "slot").agg(F.count("*").alias("c"))
    counted = counted.withColumn("ahead", F.coalesce(F.sum("c").over(before("slot")), F.lit(0)))
    ranks = F.array(*[f(F.lit(p) * (F.col("n") - 1)).cast("long") for p in points for f in (F.floor, F.ceil)])
    wanted = whole.select(by, F.explode(F.array_distinct(ranks)).alias("rank"))
    held = counted.join(wanted, by).filter((F.col("rank") >= F.col("ahead")) & (F.col("rank") < F.col("ahead") + F.col("c"))).select(by, "slot", "ahead", "rank")
    near = placed.join(held.select(by, "slot").distinct(), [by, "slot"]).groupBy(by, "slot", "score").agg(F.count("*").alias("c"))
    near = near.withColumn("earlier", F.coalesce(F.sum("c").over(before("slot", "score")), F.lit(0)))
    inside = F.col("rank") - F.col("ahead")
    at_rank = near.join(held, [by, "slot"]).filter((inside >= F.col("earlier")) & (inside < F.col("earlier") + F.col("c")))
    values = at_rank.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("at"))

    def value(p: float):
        spot = F.lit(p) * (F.col("n") - 1)
        low, high = (F.try_element_at("at", f(spot).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (spot - F.floor(spot))

    return whole.join(values, by).select(by, "n", "min", "max", F.array(*map(value, points)).alias("q"))


def score_distribution(scores: DataFrame, by: str = "backend", approximate: bool = False) -> DataFrame:
    """n, min, p5, median, p95, max of score per group; exact percentiles interpolate."""
    points = (0.05, 0.5, 0.95)
    if approximate:
        found = scores.groupBy(by).agg(F.count("score").alias("n"), F.min("score").alias("min"), F.percentile_approx("score", list(points), 10_000).alias("q"), F.max("score").alias("max"))
    else:
        found = quantiles(scores, by, points)
    return found.select(by, "n", "min", F.col("q")[0].alias("p5"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "max")


#: lo, hi and step of the grids, in hundredths: of stored vectors, and of the calibration over images.
STORED_GRID, CALIBRATION_GRID = (30, 98, 1), (30, 95, 1)


def threshold_sweep(correct: DataFrame, impostor: DataFrame, lo: int = 30, hi: int = 98, step: int = 1, *, stop_above: float = 5.0) -> DataFrame:
    """For each threshold of lo, lo + step, ... hi hundredths and each backend: per cent of correct and of impostor
    scores below it, up to and including the first that rejects over stop_above per cent.

    One pass over both buckets each score by the first threshold above it; running
    sums over the few buckets give the counts. No impostors give null. Scores
    may have a column n, how often they count (`sketches.scores_of`).
    """
    points = [t / 100 for t in range(lo, hi + 1, step)]
    n = len(points)
    grid = F.array(*map(F.lit, points))

    first = F.size(F.filter(grid, lambda t: t <= F.col("score")))  # the threshold at this place is above the score
    side = lambda df, c, i: df.select("backend", "score", c(df).alias("c"), i(df).alias("i"))
    times, none = (lambda df: F.col("n") if "n" in df.columns else F.lit(1)), lambda _: F.lit(0)
    both = side(correct, times, none).unionByName(side(impostor, none, times)).filter("score is not null")
    counted = both.groupBy("backend", first.alias("k")).agg(F.sum("c").alias("c"), F.sum("i").alias("i"))
    # Every place has a row, with nothing where no score is.
    places = counted.groupBy("backend").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("c", "i")))).alias("m")).select("backend", "m", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    at = F.try_element_at("m", F.col("k"))
    counted = places.select("backend", "k", F.coalesce(at["c"], F.lit(0)).alias("c"), F.coalesce(at["i"], F.lit(0)).alias("i"))
    upto, whole = W.partitionBy("backend").orderBy("k"), W.partitionBy("backend")
    sums = counted.select("backend", "k", F.sum("c").over(upto).alias("c"), F.sum("i").over(upto).alias("i"), F.sum("c").over(whole).alias("nc"), F.sum("i").over(whole).alias("ni"))
    rows = sums.filter(F.col("k") < n).select("backend", F.get(grid, F.col("k")).alias("threshold"), F.try_divide(F.col("c") * 100.0, F.col("nc")).alias("rejected"), F.try_divide(F.col("i") * 100.0, F.col("ni")).alias("caught"))
    earlier = W.partitionBy("backend").orderBy("threshold").rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.max((F.col("rejected") > stop_above).cast("int")).over(earlier), F.lit(0))
    return rows.withColumn("over", over).filter("over = 0").drop("over")


def recommend_threshold(sweep: DataFrame, budget: float = 0.0) -> DataFrame:
    """The highest threshold that rejects at most `budget` per cent, and what it catches; null if none."""
    ok = F.when(F.col("rejected") <= budget, F.struct("threshold", "caught"))
    found = sweep.groupBy("backend").agg(F.max(ok).alias("m"))
    return found.select("backend", F.round("m.threshold", 2).alias("threshold"), F.col("m.caught").alias("caught"))


def rerank_report(rows: DataFrame) -> DataFrame:
    """rows(query_id, retrieved, choice, truth): how re-ranking changed the first place; a null choice keeps the retrieved one."""
    final = F.coalesce("choice", "retrieved")
    before, after = F.col("retrieved") == F.col("truth"), final == F.col("truth")
    found = rows.agg(
        F.count("*").alias("n"), F.count_if(~before & after).alias("fixes"), F.count_if(before & ~after).alias("breaks"), F.count_if(before & after).alias("both_right"), F.count_if(~before & ~after).alias("both_wrong"), F.count_if(F.col("choice").isNull()).alias("unparsed"),
        (F.avg(before.cast("int")) * 100).alias("before"), (F.avg(after.cast("int")) * 100).alias("after"),
    )
    change = F.col("after") - F.col("before")
    return found.withColumn("change", change).withColumn("verdict", F.when(change > 2, "worth it").when(change > 0, "marginal").otherwise("no gain"))


def classification_report(preds: DataFrame) -> DataFrame:
    """preds(actual, predicted) -> per label: support, predicted, correct, precision, recall, f1."""
    actual = preds.groupBy(F.col("actual").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("actual") == F.col("predicted")).alias("correct"))
    guessed = preds.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("n_predicted"))
    both = actual.join(guessed, "label", "full").fillna(0, ["support", "correct", "n_predicted"])
    p, r = F.try_divide("correct", "n_predicted"), F.try_divide("correct", "support")
    return both.select("label", "support", "n_predicted", "correct", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("correct"), F.col("support") + F.col("n_predicted")).alias("f1"))


def confusion_matrix(preds: DataFrame, labels: list[str]) -> DataFrame:
    return preds.groupBy("actual").pivot("predicted", labels).count().fillna(0)


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("accuracy"))
