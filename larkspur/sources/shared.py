"""The folder that all executors share, lineage cuts in it, and versioned tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in a local session that
    names none. A cluster without one is refused."""
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


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over all cores by its keys, for rows that cost more than they weigh:
    a scan is split by bytes, which may put all of them into one task."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


class Versions:
    """Tables that change together. A version is a folder of its own and counts
    once its last table is written, so a writer that is lost leaves the old one."""

    def __init__(self, spark: SparkSession, root: str, last: str) -> None:
        self.spark, self.root, self.last = spark, root, last

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        p, fs = self._fs(f"{self.root}/v*/{self.last}/_SUCCESS")
        return sorted(int(s.getPath().getParent().getParent().getName()[1:]) for s in fs.globStatus(p) or [])

    def read(self, name: str, schema: str) -> DataFrame:
        """A table of the newest version, empty where there is none; files of it
        that are no tables are passed over."""
        known = self.numbers()
        if not known:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        return reader.parquet(f"{self.root}/v{known[-1]}/{name}")

    def write(self, tables: dict[str, DataFrame], keep: int = 2) -> None:
        """A new version; all but the `keep` newest are deleted."""
        known = self.numbers()
        to = f"{self.root}/v{known[-1] + 1 if known else 1}"
        for name in sorted(tables, key=lambda n: n == self.last):
            tables[name].write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{to}/{name}")
        for n in self.numbers()[:-keep]:
            p, fs = self._fs(f"{self.root}/v{n}")
            fs.delete(p, True)


def _moves(spark: SparkSession, root: str):
    conf = spark._jsc.hadoopConfiguration()
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return at, at("current").getFileSystem(conf)


def read_current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table `root`/current; where a writer was lost between its two renames,
    the finished next one, else the one before; empty where there is none."""
    at, fs = _moves(spark, root)
    for name in ("current", "next", "before"):
        if fs.exists(at(f"{name}/_SUCCESS")):
            return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{root}/{name}")
    return spark.createDataFrame([], schema)


def replace_current(spark: SparkSession, root: str, table: DataFrame) -> None:
    """Puts `table`, which may read the old one, in the place of `root`/current by
    renames; at any moment one whole table is there."""
    at, fs = _moves(spark, root)
    if not fs.exists(at("current")) and fs.exists(at("next/_SUCCESS")):
        table = durable(table)  # it reads what is about to be moved
        fs.rename(at("next"), at("current"))
    table.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{root}/next")
    fs.delete(at("before"), True)
    if fs.exists(at("current")):
        fs.rename(at("current"), at("before"))
    fs.rename(at("next"), at("current"))
