"""Tables in hash buckets, of which a batch of changes rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKET = "bucket"


class BucketedTable:
    """A Parquet table in folders bucket=..., by the hash of its key.

    `merge` computes the new rows of the buckets that a batch touches, writes
    them to a staging folder, replaces those buckets from there, and notes the
    batch as done. A batch that was done before changes nothing; one that broke
    off after staging goes on from what is staged, so that it counts once. Files of
    other buckets stay as they are. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.rows_path = f"{self.path}/rows"

    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, *parts: str) -> bool:
        store, place = self._place(*parts)
        return store.exists(place)

    def _delete(self, *parts: str) -> None:
        store, place = self._place(*parts)
        store.delete(place, True)

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or only some of its buckets."""
        whole = StructType([*self.schema.fields]).add(BUCKET, IntegerType())
        store, place = self._place("rows")
        if not store.exists(place):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(whole).parquet(self.rows_path)
        return (found if buckets is None else found.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def merge(self, batch_id: str, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replaces the touched buckets' rows by merged(their rows, changes), a table like this one; changes has the key columns.
        Returns whether the batch is new."""
        if self._exists("done", batch_id):
            return False
        if not self._exists("staged", batch_id, "touched", "_SUCCESS"):
            self._delete("staged", batch_id)
            touched = self._touched(changes)
            new = merged(self.read(touched), changes).select(*self.schema.names)
            self.bucketed(new).repartition(BUCKET).write.parquet(f"{self.path}/staged/{batch_id}/rows")
            self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").coalesce(1).write.parquet(f"{self.path}/staged/{batch_id}/touched")
        touched = [r[0] for r in self.spark.read.parquet(f"{self.path}/staged/{batch_id}/touched").collect()]
        staged = self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(f"{self.path}/staged/{batch_id}/rows")
        staged.repartition(BUCKET).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.rows_path)
        for bucket in set(touched) - {r[0] for r in staged.select(BUCKET).distinct().collect()}:
            self._delete("rows", f"{BUCKET}={bucket}")  # nothing is left in it
        store, place = self._place("done", batch_id)
        store.create(place, True).close()
        self._delete("staged", batch_id)
        return True

    def _touched(self, changes: DataFrame) -> list[int]:
        """At most as many as there are buckets."""
        return sorted(r[0] for r in self.bucketed(changes.select(*self.key)).select(BUCKET).distinct().collect())

    def files(self) -> set[str]:
        return set(self.read().inputFiles())
