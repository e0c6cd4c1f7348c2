"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in a local session that names
    none. A cluster without one is refused."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file://{tempfile.gettempdir()}/larkspur-shared"


def durable(df: DataFrame) -> DataFrame:
    """`df`, written by checkpoint() to the shared folder and read from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB for this session, so that long texts don't
    fill the memory beside the heap; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or ""
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are no longer
    used; it learns of them only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the system, where the
    C library can: workers are used again, and would keep their largest size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
