"""Which files are done: a table by relative path, not a process's memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_retryable

SCHEMA = "path string, timestamp timestamp, output_path string, status string, hash string, error string, is_retryable boolean, retries_attempted int"


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def pending(files: DataFrame, state: DataFrame, hashes: bool = True) -> DataFrame:
    """Files not completed before, or changed since. A file without a recorded
    hash counts as unchanged only if hashes are not compared."""
    done = state.where("status = 'completed'").select("path", *(["hash"] if hashes else []))
    return files.join(done, ["path", "hash"] if hashes else ["path"], "left_anti")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """`state` with the latest row of `changes` for each of their paths."""
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    latest = changes.groupBy("path").agg(F.max_by(F.struct(*cols), "timestamp").alias("x")).select("x.*")
    return state.join(latest.select("path"), "path", "left_anti").select(cols).unionByName(latest)


def from_results(results: DataFrame) -> DataFrame:
    """State rows of results (input_path, output_path, success, error, hash,
    retries_attempted)."""
    return results.select(
        F.col("input_path").alias("path"), F.current_timestamp().alias("timestamp"), F.when(F.col("success"), F.col("output_path")).alias("output_path"),
        F.when(F.col("success"), "completed").otherwise("failed").alias("status"), "hash", "error", F.coalesce(~F.col("success") & is_retryable(F.col("error")), F.lit(False)).alias("is_retryable"), "retries_attempted",
    )


def failed(state: DataFrame, only_retryable: bool = False) -> DataFrame:
    f = state.where("status = 'failed'")
    return f.where("is_retryable") if only_retryable else f


def cleared(state: DataFrame, paths: DataFrame | None = None, only_retryable: bool = True) -> DataFrame:
    """`state` without the given paths, or without failures that can be retried."""
    gone = failed(state, only_retryable).select("path") if paths is None else paths.select("path")
    return state.join(gone, "path", "left_anti")


def stats(state: DataFrame) -> DataFrame:
    count = lambda c, n: F.count_if(c).alias(n)
    s = F.col("status")
    return state.agg(F.count("*").alias("total"), count(s == "completed", "completed"), count(s == "failed", "failed"), count((s == "failed") & F.col("is_retryable"), "retryable"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("success").agg(F.count("*").alias("n"), F.avg("processing_time").alias("avg_time"))


def first_failed(results: DataFrame, most: int = 10) -> DataFrame:
    """The first failures by path, for a report."""
    return results.where(~F.col("success")).select("input_path", "error").orderBy("input_path").limit(most)


def rounds(todo: DataFrame, process: Callable[[DataFrame], DataFrame], most: int = 3, wait: Callable[[int], None] = lambda n: None) -> DataFrame:
    """Results of `process` (input_path, success, error, ...); what failed in a
    way that can pass is tried again, up to `most` times."""
    results = process(todo)
    for n in range(1, most + 1):
        again = results.where(~F.col("success") & F.coalesce(is_retryable(F.col("error")), F.lit(False))).select(F.col("input_path").alias("path"))
        if again.isEmpty():
            break
        wait(n)
        new = process(todo.join(again, "path", "left_semi"))
        if "retries_attempted" in new.columns:
            new = new.withColumn("retries_attempted", F.lit(n))
        results = results.join(new.select("input_path"), "input_path", "left_anti").select(results.columns).unionByName(new.select(results.columns))
    return results
