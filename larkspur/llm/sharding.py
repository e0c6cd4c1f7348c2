"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then by id, so that equal texts
lie together. A size-weighted sample of keys gives quantile boundaries; every
range between two of them is measured exactly, and ranges that turn out
overfull are subdivided by new splitters inside them, and again until none is,
down to single records of a large group of equal texts. Ranges are small parts
of a shard, so no task holds more than that of the order. Large groups go whole
into a shard with room; shards are cut from the running total of the others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Ranges a shard, and how many samples a range.
RANGES, SAMPLES = 16, 8
#: Groups of equal texts over this share of a shard are placed one by one.
WHOLE = 0.05
LEAST = -(2**63)


def _u01(*cols) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(2**52)) + 0.5) / 2.0**52


def _range_of(splitters: list[tuple[int, int]]):
    """The number of splitters at or below (key, id); ties by id within a key."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ids = np.array([i for _, i in splitters], np.int64)

    @F.arrow_udf("int")
    def place(key: pa.Array, tie: pa.Array) -> pa.Array:
        k, t = key.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = hi.copy()
        split = np.flatnonzero(hi > lo)
        for a in np.unique(lo[split]):  # one step a divided key, not a row
            own = split[lo[split] == a]
            z = hi[own[0]]
            out[own] = a + np.searchsorted(ids[a:z], t[own], "right")
        return pa.array(out.astype(np.int32))

    return place


def _sample(rows: DataFrame, count: int, seed: int, total: int) -> list[tuple[int, int]]:
    """About `count` distinct (key, tie), weighted by size: all whose race value
    -log(u) / size lies under count / total. So tasks send `count` in all."""
    race = -F.log(_u01(F.lit(seed), "tie", "key")) / F.col("size")
    return sorted((r.key, r.tie) for r in rows.where(race * total < count).select("key", "tie").distinct().collect())


def _keyed(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> dict[str, Column]:
    t = F.col(text_col)
    crc = F.crc32(t.cast("binary"))
    # The crc orders; the other hash's bits part texts that share it.
    key = F.when(t.isNotNull(), F.shiftleft(crc, 31).bitwiseOR(F.xxhash64(t).bitwiseAND(F.lit(2**31 - 1)))).otherwise(F.lit(-1).cast("long"))
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + overhead
    return {"size": size, "text_crc32": crc, "key": key, "tie": F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))}


class Layout:
    """Where records lie: splitters, what comes before each range, and homes.

    Groups of equal texts of over WHOLE of a shard, of which there are few, are
    placed first, the largest into the emptiest shard; one that fits into none
    is divided. All else fills what is left of the shards in the order of keys.
    """

    def __init__(self, rows: DataFrame, n_shards: int, seed: int) -> None:
        """`rows`: size, key and tie of all records, read several times."""
        self.spark, self.n_shards = rows.sparkSession, n_shards
        self.total = rows.agg(F.sum("size")).first()[0] or 0
        mean = self.total / n_shards
        groups = rows.where("key >= 0").groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > WHOLE * mean)
        big = {r.key: r.size for r in groups.collect()}  # at most n_shards / WHOLE rows
        self._homes, loads = _packed(big, n_shards, mean)
        self._ends = np.cumsum(mean - loads)
        rows = self._homed(rows)
        n_ranges = n_shards * RANGES
        drawn = _sample(rows, n_ranges * SAMPLES, seed, self.total)
        self.splitters = sorted({(k, LEAST) for k, _ in drawn[SAMPLES::SAMPLES]})
        limit, again = 4 * self.total / n_ranges, 0
        while True:
            placed = rows.withColumn("range", _range_of(self.splitters)("key", "tie"))
            place = F.struct("key", "tie")
            sizes = placed.groupBy("range").agg(F.sum("size").alias("size"), F.sum("rest").alias("rest"), F.min(place).alias("lo"), F.max(place).alias("hi")).collect()  # at most one row a range
            full = [r for r in sizes if r.size > limit and r.lo != r.hi]
            if not full:
                break
            again += 1
            inside = _sample(placed.where(F.col("range").isin([r.range for r in full])), SAMPLES * n_ranges, seed + again, sum(r.size for r in full))
            # By key where a range has several, by id inside a group that is no small one; the last of each full range, so that it gets smaller for sure.
            cut = {(k, i if k in big or k < 0 else LEAST) for k, i in inside[:: SAMPLES // 2]}
            cut |= {(r.hi.key, r.hi.tie if r.lo.key == r.hi.key else LEAST) for r in full if r.lo.key != r.hi.key or r.hi.key in big or r.hi.key < 0}
            if cut <= set(self.splitters):
                break
            self.splitters = sorted(set(self.splitters) | cut)
        self._before, n = [], 0
        for r in sorted(sizes, key=lambda r: r.range):
            self._before.append((r.range, n))
            n += r.rest
        parts = self._sharded(rows).groupBy("shard", "range").count().collect()
        self._first, last, n = [], None, 0
        for s, r, c in sorted(tuple(p) for p in parts):
            n = n if s == last else 0
            self._first.append((s, r, n))
            last, n = s, n + c

    def _homed(self, rows: DataFrame) -> DataFrame:
        """`rows` with `home` (a large group's shard, -1 for a divided one, null
        for a small group) and `rest`, their size in the stream of the others."""
        homes = self.spark.createDataFrame(list(self._homes.items()), "key long, home int")  # at most n_shards / WHOLE rows
        rows = rows.join(F.broadcast(homes), "key", "left").withColumn("home", F.when(F.col("key") < 0, F.lit(-1)).otherwise(F.col("home")))
        return rows.withColumn("rest", F.when(F.col("home") >= 0, F.lit(0).cast("long")).otherwise(F.col("size")))

    def _sharded(self, rows: DataFrame) -> DataFrame:
        start = self.spark.createDataFrame(self._before, "range int, before long")  # one row a range
        rows = rows.withColumn("range", _range_of(self.splitters)("key", "tie")).join(F.broadcast(start), "range")
        w = Window.partitionBy("range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("at", F.col("before") + F.sum("rest").over(w) - F.col("rest"))
        g = Window.partitionBy("range", "key")
        middle = F.when(F.col("home").isNull(), F.min("at").over(g) + F.sum("rest").over(g) / 2).otherwise(F.col("at") + F.col("rest") / 2)
        ends, last = self._ends, self.n_shards - 1

        @F.arrow_udf("int")
        def stream(m: pa.Array) -> pa.Array:
            return pa.array(np.minimum(np.searchsorted(ends, m.to_numpy(zero_copy_only=False), "right"), last).astype(np.int32))

        return rows.withColumn("middle", middle).withColumn("shard", F.when(F.col("home") >= 0, F.col("home")).otherwise(stream("middle"))).drop("middle")

    def place(self, rows: DataFrame) -> DataFrame:
        """`rows` (size, key and tie among their columns) with shard and slot."""
        if not self._first:
            return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        first = self.spark.createDataFrame(self._first, "shard int, range int, first long")  # a few rows a range
        nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "tie"))
        rows = self._sharded(self._homed(rows)).withColumn("nth", nth).join(F.broadcast(first), ["shard", "range"])
        return rows.withColumn("slot", F.col("first") + F.col("nth") - 1)


def _packed(groups: dict[int, int], n_shards: int, mean: float) -> tuple[dict[int, int], np.ndarray]:
    """A shard for every group that fits, -1 for others; the shards' loads."""
    loads, homes = [(0, s) for s in range(n_shards)], {}
    for k, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        load, s = loads[0]
        homes[k] = s if load + size <= mean else -1
        if homes[k] >= 0:
            heapq.heapreplace(loads, (load + size, s))
    out = np.zeros(n_shards)
    for load, s in loads:
        out[s] = load
    return homes, out


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, seed: int = 1) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and `overhead`), text_crc32, shard
    (0 to n_shards - 1), slot (gapless from 0 within the shard).

    Shards get nearly equal total sizes, and a group of equal texts stays in one
    shard wherever it fits: over a twentieth of a shard it is placed by itself,
    smaller ones are cut between; only a group for which no shard has room is
    divided, by id. A null
    text has size `overhead` and a null text_crc32 and is ordered by id alone,
    like a text of its own; null ids come first. Rows that share id and text
    are told apart by chance, with the same totals. Fewer rows than shards
    leave shards empty; an empty table gives no rows. Other columns are not
    read.
    """
    rows = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in _keyed(docs, id_col, text_col, overhead).items()]))
    return Layout(rows, n_shards, seed).place(rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, seed: int = 1) -> DataFrame:
    """The rows of `docs`, all columns, with shard and slot as in shard()."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    cols = _keyed(plain, f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}", overhead)
    rows = plain.withColumns({k: c for k, c in cols.items() if k != "text_crc32"})
    placed = Layout(durable(rows.select("size", "key", "tie")), n_shards, seed).place(rows)
    return placed.select(*plain.columns, "shard", "slot").toDF(*docs.columns, "shard", "slot")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """`documents` in 40 shards of near-equal bytes."""
    s = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_shard_balance(spark, sf_dir: str) -> DataFrame:
    """What holds of every layout by bytes: rows and sizes in all, slots without
    gaps, groups of equal texts that stayed whole, and no shard a twentieth off."""
    rows = durable(op7_sharding(spark, sf_dir))
    per = rows.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    even = F.max("size") - F.min("size") <= F.greatest(F.avg("size") * 0.1, 2 * F.lit(rows.agg(F.max("size")).first()[0] or 0))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("size").alias("n_bytes"), F.bool_and((F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), even.alias("even"))


QUERIES = {"op7_sharding": op7_sharding, "op7_shard_balance": op7_shard_balance}
SQL = {"op7_shard_balance": "select count(*) n_rows, cast(sum(coalesce(strlen(text), 0) + 16) as bigint) n_bytes, true gapless, true even from documents"}
