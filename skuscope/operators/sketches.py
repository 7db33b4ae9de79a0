"""Quantile sketches that add up: counts of values by slots of equal relative width.

A slot's estimate is within `accuracy` of each of its values, relatively, so
quantiles of a sketch are too. Sketches are rows (keys, slot, n); those of any
windows, batches or tasks merge by adding up n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 0.005
TINY = 1e-9  # values nearer to zero count as zero


def _gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def _offset(accuracy: float) -> int:
    """What slots of positive values are shifted by, so that they are above zero."""
    return 1 - math.ceil(math.log(TINY) / math.log(_gamma(accuracy)))


def slot_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Slots are in the order of values: negative ones below zero, zero, positive ones above; null for null and not a number."""
    size = F.abs(value.cast("double"))
    place = (F.ceil(F.log(size) / F.lit(math.log(_gamma(accuracy)))) + _offset(accuracy)).cast("int")
    return F.when(F.isnan(size) | size.isNull(), F.lit(None)).when(size < TINY, 0).otherwise(F.when(value < 0, -place).otherwise(place))


def estimate(slot: Column, accuracy: float = ACCURACY) -> Column:
    g = _gamma(accuracy)
    size = F.pow(F.lit(g), F.abs(slot) - _offset(accuracy)) * F.lit(2 / (g + 1))
    return F.when(slot == 0, 0.0).otherwise(F.signum(slot) * size)


def sketch(df: DataFrame, by: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """by, slot, n; values that are null or not a number are left out."""
    return df.select(*by, slot_of(F.col(value), accuracy).alias("slot")).filter("slot is not null").groupBy(*by, "slot").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer keys, or of several batches, as those of by."""
    return sketches.groupBy(*by, "slot").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], points: tuple[float, ...], accuracy: float = ACCURACY) -> DataFrame:
    """by, n and q: an estimate of the value at rank floor(p * (n - 1)) for each point p."""
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("slot"))
    total = F.sum("n").over(W.partitionBy(*by))
    ranked = merge(sketches, by).select(*by, "slot", "n", upto.alias("upto"), total.alias("total"))
    at = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("slot"))) for p in points]
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), F.array(*at).alias("slots")).select(*by, "n", F.transform("slots", lambda s: estimate(s, accuracy)).alias("q"))


def scores_of(sketches: DataFrame, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """by, score and n, as `threshold_sweep` takes them."""
    return merge(sketches, by).select(*by, estimate(F.col("slot"), accuracy).alias("score"), "n")
