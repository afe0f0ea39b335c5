"""What the operators share: inputs, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session has none (single-machine tests) a temporary
    folder is made and set for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenfold/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    A lost executor costs nothing that is already written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.settled_in = path
    if _WITHIN.folders:
        _WITHIN.folders[-1].append(path)
    return written


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes what settle() wrote, once nothing that is still to run reads it: the turns of a loop before the last."""
    _delete(df.sparkSession, df.settled_in)


class _Within(threading.local):
    """What settle() writes inside passing(), for each thread on its own."""

    def __init__(self):
        self.folders: list[list[str]] = []


_WITHIN = _Within()


@contextmanager
def passing(spark: SparkSession):
    """Deletes at its end what settle() writes inside, but for what is kept().

    For work whose result is written before the end.
    """
    _WITHIN.folders.append([])
    try:
        yield
    finally:
        for path in _WITHIN.folders.pop():
            _delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """df, which settle() wrote, not to be deleted by the passing() around it."""
    _WITHIN.folders[-1].remove(df.settled_in)
    return df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row, in column row; written, so that the numbers stay."""
    return settle(df.withColumn("row", F.monotonically_increasing_id()), name)


def map_arrow(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df through each, in tasks that give back the memory they have freed: their processes stay for the tasks of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, of rows that have a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def finite(vector: str) -> Column:
    """Not null, and no component is null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))
