"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: A word is a run of anything but these six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def cyclic_weights(rank: Column, weights: tuple[float, ...] = (5, 2, 1)) -> Column:
    """The weight of the source with this 0-based rank; the weights repeat."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Water-filling over sizes(source_key, source, source_size), one row a source.

    Sources in code-point order (null last) get the repeating weights and share
    `share` times all words. A source's target stops at max_epochs times its
    size; the excess goes to the others by weight until none is above. In the
    order of cap/weight the capped sources come first, so one pass of running
    sums finds the level: the first source whose cap is at or over its part of
    what the ones before it leave. If even the caps can't hold the share, all
    are at their caps. The windows run over one row a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", cyclic_weights(F.col("rank"), weights)).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    ranked = ranked.withColumn("level", found["level"])
    return ranked.select("source_key", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words the mix takes of each document.

    A source with target t and size s is taken t/s times: floor(t/s) whole
    repetitions of every document and, for the rest, one more repetition of
    documents in a seeded order (md5 of seed and id) until the words are used
    up; the last of these gives only some of its words, so that the sum is the
    rounded target. Running sums go by (source, first three digits of the
    md5), with the sums of the digits before added: no window holds more than
    1/4096 of a source, and reruns agree.

    Null or empty texts have size 0 and are taken 0 words; null sources are one
    source, the last; repeated rows count each; an empty table gives an empty
    result; columns other than the three named (and those in `keep`) are not
    read.

    Returns id, [keep], source, size, source_size, target, whole (repetitions),
    extra (words beyond these) and taken = whole * size + extra.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    sized = written(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
            key.alias("order_key"),
            F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("kept"),
        ),
        "sized",
    )
    sized = sized.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("bucket", F.substring("order_key", 1, 3))
    per_bucket = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    targets = source_targets(per_bucket.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    earlier = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("source", "bucket_size")
    # One row for each source and bucket, so this table is small beside the documents.
    per_bucket = per_bucket.join(targets, "source_key")
    within = W.partitionBy("source_key", "bucket").orderBy("order_key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(per_bucket, ["source_key", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("before") - F.col("in_bucket")))
    placed = placed.withColumn("extra", F.when(F.col("quota") > 0, extra).otherwise(F.lit(0)).cast("long"))
    names = [] if source_column in keep else [F.col("source").alias(source_column)]
    taken = (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    return placed.select(F.col("id").alias(id_column), *[F.col(f"kept.{c}").alias(c) for c in keep], *names, "size", "source_size", "target", "whole", "extra", taken)


def repeated_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: the rows of docs, each as often as the mix takes it.

    A partial repetition counts as a whole one from half of the document's
    words on, for texts stay whole. All columns of docs are kept.
    """
    columns = list(docs.columns)
    packed = docs.select(F.col("doc_id").alias("id"), F.col("text"), F.col("source"), F.struct(*columns).alias("row"))
    taken = mix_sources(packed.withColumnRenamed("id", "doc_id"), keep=("row",), **settings)
    times = (F.col("whole") + F.when((F.col("size") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


ORACLE_OP1 = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM sources),
weighted AS (SELECT *, CAST(CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS l
  FROM weighted WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(l, (cap / w, r)) AS l FROM levels WHERE l * w <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT l FROM level) * w, cap)) AS target FROM weighted),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
