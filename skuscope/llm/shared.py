"""Tables in the shared folder, and small helpers that the operators have in common."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach: spark.checkpoint.dir.

    Where it is unset, a local session (tests) takes a temporary folder, any
    other session its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith(("local[", "local-cluster")) or spark.sparkContext.master == "local":
            found = f"file://{tempfile.mkdtemp(prefix='skuscope-')}"
        else:
            found = spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/skuscope/{name}-{uuid.uuid4().hex}"


#: The lists of the temporary_tables that are open in this thread, so that jobs of other threads keep theirs.
_OPEN: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open_tables", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: what reads it
    no longer depends on df's shuffles, and reads only the columns it needs."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    for made in _OPEN.get():
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths of what is `written` within; those that are still listed at the end are deleted."""
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield made
    finally:
        _OPEN.reset(before)
        for path in made:
            delete(spark, path)


def give_back() -> None:
    """Hands memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run):
    """A mapInArrow function whose worker hands freed memory back at the end of the task, so that idle
    workers of earlier stages don't hold it beside the next one."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that Spark must not broadcast: of what comes out of an explode, an aggregate or a compressed
    table it expects the bytes of the files below, which can be a small part of what goes to the driver."""
    return df.hint("merge")


def broadcast_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A side of a join with narrow rows, broadcast if it has at most so many of them and shuffled otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else shuffled(df)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
