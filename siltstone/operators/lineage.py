"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Parquet options for rows that are large: a page and a row group hold few of them.
PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 16 << 20}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a folder that lasts as long as this process, but in
    local mode only: executors of a cluster would each write to a disk of
    their own, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    The result no longer depends on df's lineage, and losing an executor
    loses none of it. The options are the Parquet writer's.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_batches(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df; its session sends Python at most so many bytes at once, for rows that are large, unless less is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = df.sparkSession.conf.get(key, str(most))
    if not was.isdigit() or int(was) <= 0 or int(was) > most:
        df.sparkSession.conf.set(key, str(most))
    return df


def release(spark: SparkSession) -> int:
    """Deletes the tables that materialise has written so far, and tells how many; results that still read them must be written before."""
    n = 0
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
