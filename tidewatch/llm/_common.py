"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contract: runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Words of letters and digits; every non-ASCII character counts as a letter.
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: UTF-8 bytes: lower-cases A-Z and turns whatever is no word character into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would change other alphabets too."""
    return F.translate(col, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of white-space separated words, 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS, -1))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark.sparkContext, "_tidewatch_shared", None)
    if made is None:
        made = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.sparkContext._tidewatch_shared = made
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewatch-{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage.

    A lost executor costs nothing that was settled, and non-deterministic columns keep their values.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing reads any more."""
    path = getattr(df, "_settled", None)
    if path:
        remove(df.sparkSession, path)


def filesystem(uri: str):
    """(file system, path) of a folder all executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Workspace:
    """Settled tables of one run of an operator; ``close`` removes those that are left."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        return self.keep(settle(df, label))

    def keep(self, df: DataFrame) -> DataFrame:
        """Takes over a table that is settled already."""
        self.tables.append(df)
        return df

    def close(self) -> None:
        for df in self.tables:
            drop_settled(df)
        self.tables.clear()


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """A workspace whose tables go when the block ends; what outlives it must be settled outside of it."""
    work = Workspace(spark)
    try:
        yield work
    finally:
        work.close()


def free_unused(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and broadcasts that nothing names any more; it follows garbage collection.

    Executors collect theirs too: a heap that one stage has grown is given back before the next one's Python workers need the memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    everywhere = spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done"))
    everywhere.write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Texts are wide columns; batches of a few MB bound what a Python worker holds."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def trimmed(run):
    """A function for ``mapInArrow`` whose worker gives freed memory back in the end, as later stages use the same processes."""

    def and_trim(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return and_trim


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with some of its columns replaced; the others are passed on as they are."""
    names = batch.schema.names
    arrays = [
        pa.array(columns[name], type=batch.schema.field(name).type) if name in columns else batch.column(i) for i, name in enumerate(names)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)
