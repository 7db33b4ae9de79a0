"""A corpus pipeline of five stages over documents; each stage's rows are written and read again as the next one's.

The first four return the columns of documents, the last the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuscope.llm import dedup, mixing, nearcopies, packing, toxicity
from skuscope.llm.entry import vocabulary
from skuscope.llm.shared import delete, table, temporary_tables, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labels, calls toxic.

    Null texts are scored as empty ones and, like rows without an id, stay
    unless the score says otherwise; repeated rows stay or go together; texts of
    any length are scored whole; columns of documents named score or predicted
    keep their values; an empty table gives an empty table.
    """
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return toxicity.score_toxicity(rows, model).filter("predicted = 0").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    A link is a Jaccard similarity of 0.8 or more of five-word shingles, verified
    on the texts. Rows without an id stay. Of rows with equal ids and texts one
    stays; null and empty texts are copies of each other; texts of any length are
    compared whole; all columns stay as they are; an empty table gives an empty
    table.
    """
    groups = nearcopies.near_copies(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi")
    again = written(kept.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= 1_000_000 else again
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out 50-byte strings that a document with a smaller id has.

    Null texts become empty ones; texts under 50 bytes and rows without an id
    stay whole; rows with equal ids don't count against each other; n_chars is
    counted anew; all other columns stay; an empty table gives an empty table.
    """
    left = dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources come to their target weights.

    Null and empty texts have no words and come as often as their source is
    taken whole; a null source is a source of its own; repeated rows count
    one by one; all columns stay; an empty table gives an empty table.
    """
    return mixing.repeated_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens: one row a piece, with its ids.

    Null and empty texts are the end token alone; repeated rows are packed each;
    longer texts are cut into pieces; an empty table gives an empty table.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Toxicity and suffix sorting can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. Tables that only a stage itself needs, and its input once its result is
    written, are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary_tables(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            result = made.pop()
        if before:
            delete(spark, before)
        before = result
    return docs
