"""The prediction history: pages, confirmations, summaries, deletion."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history(audit: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, the larger id first among equals."""
    return audit.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(max(limit, 1), 200))


def history_with_images(audit: DataFrame, products: DataFrame) -> DataFrame:
    from skuscope.functions.text import displayable_image

    images = products.select(F.col("sku").alias("top_sku"), displayable_image(F.col("image_paths")).alias("image"))
    return audit.join(images, "top_sku", "left")


CONFIRMED = ("confirmed_sku", "confirmed_at", "disambiguation")


def apply_confirmations(audit: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets confirmed_sku, confirmed_at, disambiguation (the transcript of the questions that led to it, a string or null) and
    corrected by the last confirmation of each id; and the confirmations of unknown ids."""
    if "disambiguation" not in confirmations.columns:
        confirmations = confirmations.withColumn("disambiguation", F.lit(None).cast("string"))
    last = confirmations.groupBy("id").agg(F.max(F.struct("confirmed_at", "confirmed_sku", "disambiguation")).alias("c"))
    unknown = confirmations.join(audit.select("id"), "id", "left_anti")
    joined = audit.drop(*CONFIRMED).join(last, "id", "left")
    corrected = F.coalesce(F.col("c.confirmed_sku") != F.col("top_sku"), F.col("c.confirmed_sku").isNotNull(), F.lit(False))
    return joined.select(*[c for c in audit.columns if c not in CONFIRMED], *[F.col(f"c.{c}").alias(c) for c in CONFIRMED], corrected.alias("corrected")), unknown


def history_after(audit: DataFrame, cursor: tuple | None = None, limit: int = 50) -> DataFrame:
    """The page of `history` after cursor (created_at and id of the last row seen; None: the first page), out of a table by day.

    Only rows of the cursor's day and before are looked at, newest days first: the last day, then two, four and so on
    until they have a page, so that days that aren't needed are never read. Rows without a time are on no page.
    """
    limit = min(max(limit, 1), 200)
    found = {dt.date.fromisoformat(x) for path in audit.inputFiles() for x in re.findall(r"/day=(\d{4}-\d\d-\d\d)/", path)}  # of the folders, no file is opened
    days = sorted((d for d in found if cursor is None or d <= cursor[0].date()), reverse=True)
    wide = 1
    while True:
        page = audit.filter(F.col("day").isin(days[:wide])) if days else audit.limit(0)
        if cursor is not None:
            at = F.lit(cursor[0]).cast(audit.schema["created_at"].dataType)
            page = page.filter((F.col("created_at") < at) | (F.col("created_at") == at) & (F.col("id") < cursor[1]))
        page = page.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
        if wide >= len(days) or page.count() == limit:
            return page
        wide *= 2


def delete_audit(audit: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """audit without the ids; and the ids it doesn't have."""
    return audit.join(ids, "id", "left_anti"), ids.join(audit.select("id"), "id", "left_anti")


def status(top_sku="top_sku", confirmed_sku="confirmed_sku"):
    """validated, corrected, unconfirmed or no-match; a confirmation after no match is a correction."""
    top, confirmed = F.col(top_sku), F.col(confirmed_sku)
    return F.when(confirmed.isNull() & top.isNull(), "no-match").when(confirmed.isNull(), "unconfirmed").when(confirmed == top, "validated").otherwise("corrected")


def confirmation_summary(audit: DataFrame) -> DataFrame:
    """Counts by status and the correction rate per category, per backend, both and in all."""
    rows = audit.withColumn("status", status())
    counts = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("validated", "corrected", "unconfirmed", "no-match")]
    found = rows.cube("predicted_category", "embedding_backend").agg(F.count("*").alias("n"), *counts)
    return found.withColumn("correction_rate", F.try_divide("corrected", F.col("validated") + F.col("corrected")))


def correction_pairs(audit: DataFrame) -> DataFrame:
    return audit.filter(status() == "corrected").groupBy("top_sku", "confirmed_sku").agg(F.count("*").alias("n"))
