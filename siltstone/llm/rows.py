"""Decisions about rows that survive repeated ids, null ids and extra columns."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"


def _lean_memory() -> None:
    """Lets workers, which Spark uses again and again, return what large arrays took."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library; memory is kept for later tasks


if TaskContext.get() is not None:  # in workers only
    _lean_memory()


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python at most 2000 rows at once where the default of 10000 hasn't been changed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key, "10000")) == 10000:
        df.sparkSession.conf.set(key, "2000")
    return df


def row_key(df: DataFrame, id_col: str = ID, text_col: str = TEXT) -> list[Column]:
    """A row's identity: its id and a hash of its text, so that equal ids with other texts stay apart."""
    return [df[id_col].alias("rk_id"), F.xxhash64(df[text_col]).alias("rk_hash")]


def keep_rows(docs: DataFrame, drop: DataFrame, once: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """docs without the rows keyed in drop, and one row only of each key in once.

    drop and once have the columns of row_key. Columns of docs, whatever their
    names, come back as they were.
    """
    names = docs.columns
    inner = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], *row_key(docs, id_col, text_col))
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]

    def against(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("rk_id").alias("k_id"), F.col("rk_hash").alias("k_hash"))
        return df.join(k, df["rk_id"].eqNullSafe(k["k_id"]) & (df["rk_hash"] == k["k_hash"]), how)

    kept = against(inner, drop, "left_anti")
    if once.isEmpty():
        return kept.select(*cols)
    repeated = against(kept, once, "left_semi").dropDuplicates(["rk_id", "rk_hash"])
    return against(kept, once, "left_anti").unionByName(repeated).select(*cols)
