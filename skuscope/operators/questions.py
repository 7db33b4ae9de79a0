"""Guided questions over many sessions at once.

candidates(session_id, sku, brand, similarity, mpn), fitment(session_id, sku,
make, model, year_start, year_end), answers(session_id, facet, skus, make,
model, year_start, year_end), turns(session_id, turn_no, facet, prompt, label,
skus, skipped). All joins and groups go by session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuscope.functions.text import facet_prompt
from skuscope.operators.fitment import filter_fitment_rows, year_options
from skuscope.sources.scratch import stored

SEPARATION = 0.08


def seed_candidates(seeds: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds with a product, ranked by similarity; and sessions that have none left."""
    found = seeds.join(products.select("sku", "product_name", "brand", F.col("manufacturer_part_number").alias("mpn")), "sku")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("similarity"), "sku")))
    return ranked, seeds.select("session_id").distinct().join(found.select("session_id").distinct(), "session_id", "left_anti")


def apply_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates that every answer of their session allows."""
    ruled_out = (F.col("c.session_id") == F.col("a.session_id")) & ~F.array_contains(F.col("a.skus"), F.col("c.sku"))
    return candidates.alias("c").join(answers.alias("a"), ruled_out, "left_anti")


def facet_options(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """session_id, facet, label, skus, year_start, year_end for make, model, year, mpn and brand; candidates without a number have no mpn option."""
    sides = F.array(F.struct(F.lit("make").alias("facet"), F.col("make").alias("label")), F.struct(F.lit("model").alias("facet"), F.col("model").alias("label")))
    vehicle = rows.select("session_id", "sku", F.explode(sides).alias("o")).select("session_id", "sku", "o.*")
    marks = F.array(F.struct(F.lit("mpn").alias("facet"), F.nullif("mpn", F.lit("")).alias("label")), F.struct(F.lit("brand").alias("facet"), F.col("brand").alias("label")))
    own = candidates.select("session_id", "sku", F.explode(marks).alias("o")).select("session_id", "sku", "o.*").filter("label is not null")
    plain = vehicle.unionByName(own).groupBy("session_id", "facet", "label").agg(F.array_sort(F.collect_set("sku")).alias("skus"))
    none = F.lit(None).cast("int")
    years = year_options(rows).select("session_id", F.lit("year").alias("facet"), "label", "skus", "year_start", "year_end")
    return plain.withColumn("year_start", none).withColumn("year_end", none).unionByName(years)


def next_question(candidates: DataFrame, fitment: DataFrame, answers: DataFrame, skipped: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """The next question of each session that has one: session_id, facet, prompt, hint, n_options, worst.

    Vehicle questions only if all remaining candidates have fitment; none that
    was asked or skipped (skipped: session_id, facet); only those where some
    answer rules something out; the easiest to answer first, then by the
    largest option, then by the number of options. left: what the answers leave, where that is known.
    """
    left = apply_answers(candidates, answers) if left is None else left
    rows = filter_fitment_rows(fitment.join(left.select("session_id", "sku"), ["session_id", "sku"], "left_semi"), answers)
    has_fitment = fitment.select("session_id", "sku").distinct().withColumn("fits", F.lit(1))
    sizes = left.join(has_fitment, ["session_id", "sku"], "left").groupBy("session_id").agg(F.count("*").alias("n"), (F.count("fits") == F.count("*")).alias("all_fit"))
    asked = answers.select("session_id", "facet").unionByName(skipped.select("session_id", "facet"))
    facets = facet_options(left, rows).groupBy("session_id", "facet").agg(F.count("*").alias("n_options"), F.max(F.size("skus")).alias("worst"), F.min(F.size("skus")).alias("least"))
    facets = facets.join(asked, ["session_id", "facet"], "left_anti").join(sizes.filter("n >= 2"), "session_id")
    vehicle = F.col("facet").isin("make", "model", "year")
    usable = facets.filter((F.col("n_options") > 1) & (F.col("least") < F.col("n")) & (F.col("all_fit") | ~vehicle))
    ease = F.array_position(F.array(*map(F.lit, ("make", "model", "year", "mpn", "brand"))), F.col("facet"))
    best = usable.groupBy("session_id").agg(F.min(F.struct(ease.alias("ease"), "worst", "n_options", "facet")).alias("q"))
    prompt = facet_prompt(F.col("q.facet"))
    return best.select("session_id", F.col("q.facet").alias("facet"), prompt["prompt"].alias("prompt"), prompt["hint"].alias("hint"), F.col("q.n_options").alias("n_options"), F.col("q.worst").alias("worst"))


CONFIRM_WITHIN, HIGH_CONFIDENCE = 0.05, 0.9


def separation(results: DataFrame, by: str = "query_id", score: str = "similarity_score", confidence: str | None = None, no_match: str | None = None) -> DataFrame:
    """Of each query's first two ranks: gap, whether the leader is decisive, whether to ask for confirmation, and the SKU that is
    taken without asking (the leader, unless confirmation is needed). With confidence and no_match (columns of results, the
    same in a query's rows) a refused query takes no SKU and needs no confirmation, and high_confidence says whether a match
    without confirmation has a confidence of 0.9 or more."""
    w = W.partitionBy(by).orderBy(F.desc(score), "sku")
    top = results.withColumn("r", F.row_number().over(w)).withColumn("next_score", F.lead(score).over(w)).filter("r = 1")
    gap = F.col(score) - F.col("next_score")
    matched = ~F.coalesce(F.col(no_match), F.lit(False)) if no_match else F.lit(True)
    confirm = matched & F.coalesce(gap < CONFIRM_WITHIN, F.lit(False))
    found = [by, F.col("sku").alias("leader"), F.col(score).alias("leader_score"), gap.alias("gap"), F.coalesce(gap >= SEPARATION, F.lit(False)).alias("decisive"), F.when(gap >= SEPARATION, "strong").when(gap.isNotNull(), "close").alias("label"), confirm.alias("requires_confirmation"), F.when(matched & ~confirm, F.col("sku")).alias("selected_sku")]
    if confidence:
        found.append((matched & ~confirm & F.coalesce(F.col(confidence) >= HIGH_CONFIDENCE, F.lit(False))).alias("high_confidence"))
    return top.select(*found)


def visual_mismatch(candidates: DataFrame, answers: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """Sessions whose decisive leader the answers ruled out while others are left: leader_sku and best_survivor_sku."""
    lead = separation(candidates, "session_id", "similarity").filter("decisive")
    left = apply_answers(candidates, answers) if left is None else left
    best = left.groupBy("session_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "sku"))["sku"].alias("best_survivor_sku"), F.collect_set("sku").alias("all"))
    return lead.join(best, "session_id").filter(~F.array_contains("all", F.col("leader"))).select("session_id", F.col("leader").alias("leader_sku"), "best_survivor_sku")


def session_state(candidates: DataFrame, fitment: DataFrame, turns: DataFrame) -> DataFrame:
    """session_id, status, n_remaining, remaining, resolved_sku, facet (of the question), leader_sku and best_survivor_sku of a mismatch."""
    answers, skipped = turns.filter("not skipped"), turns.filter("skipped")
    left = stored(apply_answers(candidates, answers), "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "sku"))), lambda e: e["sku"])
    remaining = left.groupBy("session_id").agg(ordered.alias("remaining"))
    state = candidates.select("session_id").distinct().join(remaining, "session_id", "left").join(next_question(candidates, fitment, answers, skipped, left).select("session_id", "facet"), "session_id", "left").join(visual_mismatch(candidates, answers, left), "session_id", "left")
    n = F.coalesce(F.size("remaining"), F.lit(0))
    n = F.when(F.col("remaining").isNull(), 0).otherwise(n)
    status = F.when(n == 1, "resolved").when(F.col("facet").isNotNull(), "asking").otherwise("exhausted")
    return state.select("session_id", status.alias("status"), n.alias("n_remaining"), F.coalesce(F.array_join("remaining", ","), F.lit("")).alias("remaining"), F.when(n == 1, F.col("remaining")[0]).alias("resolved_sku"), "facet", "leader_sku", "best_survivor_sku")


def transcript(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns with the SKUs they stand for: a skip is "Not sure" and lists what remains now."""
    left = apply_answers(candidates, turns.filter("not skipped"))
    now = left.groupBy("session_id").agg(F.array_sort(F.collect_set("sku")).alias("now"))
    shown = turns.join(now, "session_id", "left")
    return shown.select("session_id", "turn_no", "facet", "prompt", F.when(F.col("skipped"), "Not sure").otherwise(F.col("label")).alias("label"), F.when(F.col("skipped"), F.col("now")).otherwise(F.col("skus")).alias("skus"), "skipped")


def undo(turns: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keep(session_id, keep): the first turns of each session; and the requests to keep more than there are."""
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    checked = keep.join(sizes, "session_id", "left").fillna(0, ["n"])
    bad = checked.filter(F.col("keep") > F.col("n")).select("session_id", "keep")
    good = checked.filter(F.col("keep") <= F.col("n")).select("session_id", "keep")
    kept = turns.join(good, "session_id", "left").filter(F.col("keep").isNull() | (F.col("turn_no") < F.col("keep"))).drop("keep")
    return kept, bad


def apply_turns(options: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pick (option from 0, or skip) for each session's open question; options(session_id, facet, prompt,
    options array of label and skus). Returns the turns, and the picks that aren't valid with a reason."""
    joined = picks.join(options, "session_id", "left")
    both = (F.col("option").isNotNull().cast("int") + F.coalesce(F.col("skip"), F.lit(False)).cast("int")) != 1
    reason = F.when(F.col("options").isNull(), "no open question").when(both, "exactly one of option and skip").when(F.col("option").isNotNull() & ((F.col("option") < 0) | (F.col("option") >= F.size("options"))), "no such option")
    joined = joined.withColumn("reason", reason)
    chosen = F.get(F.col("options"), F.col("option"))
    good = joined.filter("reason is null").select("session_id", "facet", "prompt", chosen["label"].alias("label"), chosen["skus"].alias("skus"), F.coalesce("skip", F.lit(False)).alias("skipped"))
    return good, joined.filter("reason is not null").select("session_id", "reason")


def can_disambiguate(candidates: DataFrame, fitment: DataFrame, turns: DataFrame) -> DataFrame:
    """Whether a question exists for each session."""
    questions = next_question(candidates, fitment, turns.filter("not skipped"), turns.filter("skipped")).select("session_id", F.lit(True).alias("can"))
    return candidates.select("session_id").distinct().join(questions, "session_id", "left").fillna(False, ["can"])


def confirmed_by_answers(state: DataFrame, picks: DataFrame, turns: DataFrame) -> DataFrame:
    """Whether each session's pick is the single SKU that at least one answer left."""
    answered = turns.filter("not skipped").select("session_id").distinct().withColumn("answered", F.lit(True))
    joined = picks.join(state.select("session_id", "resolved_sku"), "session_id", "left").join(answered, "session_id", "left")
    return joined.select("session_id", F.coalesce((F.col("sku") == F.col("resolved_sku")) & F.col("answered"), F.lit(False)).alias("confirmed"))
