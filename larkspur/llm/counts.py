"""Token counts as delta-maintained rollups.

The totals by source, language and tokenizer version are sums of committed
batches of signed deltas: an insert adds a document's count, a delete takes it
back, a revision does both. A batch is reduced to one row a group before it is
written, under its own name, with the marker file that a finished write leaves;
a batch whose marker is there is not applied again, one without it (its writer
was lost) counts for nothing and is written anew. Compaction unites batches and
remembers their names.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable, shared_path, small_batches
from .mixing import WORD

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens"]
TOKENIZERS = "/opt/tokenizers"


def inserted(counts: DataFrame) -> DataFrame:
    """Deltas that add documents, from source, lang, tokenizer, tokens."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Deltas that take documents back."""
    return inserted(counts).withColumns({c: -F.col(c) for c in SUMS})


def revised(counts: DataFrame, old: str, new: str) -> DataFrame:
    """Deltas that replace each document's count `old` by `new`; no document more."""
    change = F.coalesce(F.col(new).cast("long"), F.lit(0)) - F.coalesce(F.col(old).cast("long"), F.lit(0))
    return counts.select(*GROUP, F.lit(0).cast("long").alias("docs"), change.alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _done(self, pattern: str) -> list[str]:
        """Names of the folders of that pattern whose write was finished."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def _base(self) -> str | None:
        """The last compaction, which holds sums and the names of its batches."""
        return max(self._done("_base-*"), default=None)

    def _named(self) -> DataFrame:
        """Names of the batches in the last compaction."""
        base = self._base()
        if base is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.parquet(f"{self.path}/{base}").where("batch is not null").select("batch")

    def batches(self) -> list[str]:
        """The names of the committed batches that are not compacted yet."""
        names = self._done("[!_]*")
        if not names or self._base() is None:
            return names
        gone = {r.batch for r in self._named().where(F.col("batch").isin(names)).collect()}  # of those in the folder
        return [n for n in names if n not in gone]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if not batch or "/" in batch or batch[0] in "._" or set(batch) & set("*?[]{}\\"):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._done(batch) or not self._named().where(F.col("batch") == batch).isEmpty():
            return False
        sums = deltas.groupBy(*GROUP).agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in SUMS])
        sums.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{batch}")
        return True

    def _sums(self) -> DataFrame | None:
        base = self._base()
        rows = [self.spark.read.parquet(f"{self.path}/{base}").where("batch is null").select(*GROUP, *SUMS)] if base else []
        if names := self.batches():
            rows.append(self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]).select(*GROUP, *SUMS))
        if not rows:
            return None
        both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        return both.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])

    def compact(self) -> None:
        """All committed batches as one table: their sums and their names. It
        counts from its finished write on; only then the folders it replaces are
        deleted, and if that is cut short they are passed over."""
        names, base, sums = self.batches(), self._base(), self._sums()
        if not names:
            return
        known = self._named().unionByName(self.spark.createDataFrame([(n,) for n in names], "batch string"))
        to = f"_base-{int(base[6:]) + 1 if base else 0:012d}"
        both = sums.unionByName(known, allowMissingColumns=True)
        both.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{to}")
        jvm = self.spark._jvm
        for n in [*names, *([base] if base else [])]:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups without a document are gone.
        A null source or language is a group of its own."""
        sums = self._sums()
        if sums is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        return sums.where("docs <> 0 or tokens <> 0")


@lru_cache(4)
def encoder(path: str):
    """A tokenizer from a file of base64 ranks; made once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(name: str, n_columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(n_columns).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_columns], pa.array(n, pa.int64())], [*b.schema.names[:n_columns], "bpe"])

    return run


def token_counts(docs: DataFrame, ranks: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars") -> DataFrame:
    """Per row: source, lang, estimate (a quarter of its characters, from the
    table's own column), words, bpe (tokens by the ranks in that file, which is
    sent to the executors). A null text has null counts, which add nothing; an
    empty one 0; an empty table gives no rows. Other columns, whatever their
    names, are not read."""
    small_batches(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(ranks)
    t = F.col(text_col)
    base = docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), (F.col(chars_col) / 4).cast("long").alias("estimate"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"), t.alias("t"),
    )
    return base.mapInArrow(_count(os.path.basename(ranks), 4), "source string, lang string, estimate long, words long, bpe long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """`documents` loaded with estimates, then revised to exact counts of words
    and of a public tokenizer's tokens; a replay of the load changes nothing."""
    folder = spark.conf.get("spark.larkspur.tokenizers", TOKENIZERS)
    counts = durable(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{folder}/byte_bpe_50k.tiktoken"))
    roll = Rollup(spark, shared_path(spark, "token-counts"))
    one = lambda name, col: counts.select("source", "lang", F.lit(name).alias("tokenizer"), F.col("estimate"), F.col(col).alias("exact"))
    both = one("words-1", "words").unionByName(one("byte_bpe_50k-1", "bpe"))
    load = inserted(both.withColumnRenamed("estimate", "tokens"))
    roll.commit("load", load)
    roll.commit("exact", revised(both, "estimate", "exact"))
    roll.commit("load", load)
    return roll.totals()


def op6_word_totals(spark, sf_dir: str) -> DataFrame:
    """The totals of words alone, which SQL can count as well, after a
    compaction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = durable(docs.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens")))
    roll = Rollup(spark, shared_path(spark, "word-totals"))
    roll.commit("load", inserted(counts))
    roll.commit("again", inserted(counts))
    roll.compact()
    roll.commit("back", deleted(counts))
    roll.commit("load", inserted(counts))
    return roll.totals()


QUERIES = {"op6_token_counts": op6_token_counts, "op6_word_totals": op6_word_totals}
SQL = {
    "op6_word_totals": r"""
select source, lang, 'words-1' as tokenizer, count(*) as docs, cast(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) as bigint) as tokens from documents group by 1, 2"""
}
