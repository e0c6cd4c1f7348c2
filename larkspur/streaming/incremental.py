"""New and changed files as a stream, against the same state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources.shared import read_current, replace_current

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES)
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)


def process_new(spark: SparkSession, root: str, state_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Runs `process` over files that are new or whose content changed, and keeps
    the state. The stream remembers paths; contents are compared with the state,
    so a batch that is delivered again does nothing."""

    def one(batch: DataFrame, number: int) -> None:
        files = batch.withColumn("hash", state.file_hash(F.col("content")))
        known = read_current(spark, state_path, state.SCHEMA)
        todo = state.pending(files, known)
        if todo.isEmpty():
            return
        changes = state.from_results(process(todo))
        replace_current(spark, state_path, state.upsert(known, changes))

    query = stream_files(spark, root).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time_col: str = "ts", late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Counts and sums by kind and tumbling window, for a batch or a stream."""
    w = F.window(F.col(time_col), size)
    # Watermarks need an instant, which a time without a zone is not.
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
