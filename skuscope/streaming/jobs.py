"""The online parts as Structured Streaming jobs; what has a batch form shares its code with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skuscope.operators import sketches


def stream_identify(queries: DataFrame, identify: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Identifies each micro-batch of queries into a folder of its own (batch_id=...), which a batch that is
    run again after a failure replaces; identify is a batch job over static tables."""

    def each(batch: DataFrame, batch_id: int) -> None:
        identify(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_audit(rows: DataFrame, path: str, checkpoint: str, delay: str = "1 hour"):
    """Appends finished predictions once each, by id within the watermark."""
    once = rows.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_problem() -> Column:
    """Why a row can't be recorded; null if it can."""
    blank = F.coalesce(F.trim("predicted_category"), F.lit("")) == ""
    return F.when(F.col("id").isNull(), "no id").when(F.col("created_at").isNull(), "no time").when(blank, "no category").when(F.col("confidence").isNull() | F.isnan("confidence"), "no confidence")


def record_audit(rows: DataFrame, path: str, dead: str, checkpoint: str):
    """Records finished predictions once each, by id and day; rows that can't be recorded go to `dead` with a reason and don't stop the others.

    Each micro-batch has folders of its own (batch_id=...), which it replaces if it
    is run again. A row whose id was recorded for its day before, or stands there
    twice, is recorded once.
    """
    spark = rows.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("problem", audit_problem()).withColumn("day", F.to_date("created_at")).persist()
        try:
            bad = checked.filter("problem is not null").drop("day").withColumnRenamed("problem", "reason")
            bad.write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}")
            good = checked.filter("problem is null").drop("problem").dropDuplicates(["id", "day"])
            if batch_id:
                days = [r[0] for r in good.select("day").distinct().collect()]  # of one batch
                before = spark.read.schema(StructType([*good.schema.fields, StructField("batch_id", LongType())])).parquet(path).filter((F.col("batch_id") < batch_id) & F.col("day").isin(days)).select("id", "day")
                good = good.join(before, ["id", "day"], "left_anti")
            good.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def join_confirmations(predictions: DataFrame, confirmations: DataFrame, within: str = "1 day") -> DataFrame:
    """Predictions (id, created_at, ...) with their confirmation (id, confirmed_at, confirmed_sku) of at most
    `within` later; those without come out once the watermark has passed. Batch tables join the same way."""
    p = predictions.withWatermark("created_at", "1 hour").alias("p") if predictions.isStreaming else predictions.alias("p")
    c = confirmations.withWatermark("confirmed_at", "1 hour").alias("c") if confirmations.isStreaming else confirmations.alias("c")
    on = (F.col("p.id") == F.col("c.id")) & (F.col("c.confirmed_at") >= F.col("p.created_at")) & (F.col("c.confirmed_at") <= F.col("p.created_at") + F.expr(f"INTERVAL {within}"))
    return p.join(c, on, "left").select("p.*", F.col("c.confirmed_sku").alias("confirmed_sku"), F.col("c.confirmed_at").alias("confirmed_at"))


def sessions(turns: DataFrame, gap: str = "6 hours", key: str = "user_id") -> DataFrame:
    """Turns (key, ts) grouped to sessions that end after `gap` without one."""
    turns = turns.withWatermark("ts", "1 hour") if turns.isStreaming else turns
    found = turns.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_turns"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_turns")


def windowed_quality(audit: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Per window: predictions, share refused, share of the confirmed that was corrected, mean confidence, and
    its 5th, 50th and 95th percentile (approximate beyond 10,000 values, each a value that occurs)."""
    audit = audit.withWatermark("created_at", "1 hour") if audit.isStreaming else audit
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    confirmed = F.col("confirmed_sku").isNotNull()
    found = audit.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("top_sku").isNull()).alias("refused"), F.count_if(confirmed & (F.col("confirmed_sku") != F.col("top_sku"))).alias("corrected"), F.count_if(confirmed).alias("confirmed"), F.avg("confidence").alias("mean_confidence"), F.percentile_approx("confidence", [0.05, 0.5, 0.95], 10_000).alias("q"))
    return found.select(F.col("w.start").alias("window_start"), "n", (F.col("refused") / F.col("n")).alias("refusal_rate"), F.try_divide("corrected", "confirmed").alias("correction_rate"), "mean_confidence", F.col("q")[0].alias("p5"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"))


def partial_quality(audit: DataFrame, window: str = "1 day") -> DataFrame:
    """Counts by window and slot of the confidence (null without one), which add up over any batches: what
    `quality_of` needs, with quantiles as a sketch."""
    confirmed = F.col("confirmed_sku").isNotNull()
    found = audit.filter("created_at is not null").groupBy(F.window("created_at", window)["start"].alias("window_start"), sketches.slot_of(F.col("confidence")).alias("slot"))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("top_sku").isNull()).alias("refused"), F.count_if(confirmed & ~F.col("confirmed_sku").eqNullSafe(F.col("top_sku"))).alias("corrected"), F.count_if(confirmed).alias("confirmed"), F.sum("confidence").alias("total"))


def quality_of(partials: DataFrame, by: Column | None = None) -> DataFrame:
    """Quality by window out of `partial_quality` rows of any batches; by: a coarser span of window_start (as date_trunc gives it).

    p5, median and p95 are within the sketch's accuracy of values at these ranks."""
    spans = partials.withColumn("window_start", F.col("window_start") if by is None else by)
    sums = spans.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in ("n", "refused", "corrected", "confirmed", "total")], F.sum(F.when(F.col("slot").isNotNull(), F.col("n"))).alias("valued"))
    q = sketches.quantiles(spans.filter("slot is not null").select("window_start", "slot", "n"), ["window_start"], (0.05, 0.5, 0.95)).select("window_start", "q")
    at = lambda k, name: F.get("q", k).alias(name)
    return sums.join(q, "window_start", "left").select("window_start", "n", (F.col("refused") / F.col("n")).alias("refusal_rate"), F.try_divide("corrected", "confirmed").alias("correction_rate"), F.try_divide("total", "valued").alias("mean_confidence"), at(0, "p5"), at(1, "median"), at(2, "p95"))


def stream_quality(audit: DataFrame, path: str, checkpoint: str, window: str = "1 day"):
    """Writes each micro-batch's `partial_quality` to a folder of its own (batch_id=...), which it replaces if it is run again.

    `quality_of` over the folder is the state; nothing of it is held in memory,
    and rows count however late they come.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        partial_quality(batch, window).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return audit.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
