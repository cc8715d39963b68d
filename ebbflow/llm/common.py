"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.session import settle

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def give_back() -> None:
    """Return what a finished task has freed to the machine; else a worker that waits for its next task keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settle_and_free(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``settle``; then delete the settled tables ``done`` and the shuffle files that only these results needed.

    Spark deletes shuffle files once the driver's collector finds their plans unused, which in a quiet driver takes long.
    """
    out = settle(df)
    spark = out.sparkSession
    for folder in {name.rpartition("/")[0] for old in done for name in old.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def table(spark, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
