"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents, in a seeded order, are one stream of words, cut into
blocks of equal length. The mix is a number of blocks; each goes to the source
with the highest quotient target / (2 * seats + 1). The rule is house-monotone,
so the same sequence of seats, cut into equal parts, gives integer quotas for
every output shard. A source's seats are filled from its blocks in a seeded
permutation, round after round, shard by shard: all blocks the same number of
times, and some once more. Which ones, and for which shard, is arithmetic on the
block's number, so blocks are never rows; only a document's id, source and size
are shuffled, by source and a slice of the seeded order, of which a large source
has as many as keep one small.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .durable import durable, small_batches

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The most often that a word may be taken.
MOST = 3
BLOCK = 64
#: Output shards of a mix; words of a slice, about, and 4096 slices at least.
SHARDS, SLICE = 40, 1 << 24


def targets(sizes: list[int], weights: list[int], total: int | None = None, most: int = MOST) -> list[float]:
    """Shares of `total` (all sizes) by weight; a share stops at `most` times
    its source's size and the excess is shared by weight among the others."""
    total = sum(sizes) if total is None else total
    out: list[float] = [0.0] * len(sizes)
    left, weight = total, sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i)):
        if most * sizes[i] * weight <= weights[i] * left:
            out[i] = float(most * sizes[i])
            left, weight = left - most * sizes[i], weight - weights[i]
        else:
            out[i] = weights[i] * left / weight
    return out


def quotas(target: list[float], seats: int) -> list[int]:
    """Sainte-Lague: each seat to the highest target / (2 * seats so far + 1),
    ties to the earlier source. Rounding by the common divisor comes within half
    a seat a source of the result, so few seats are left to move."""
    total = sum(target)
    if seats <= 0 or total <= 0:
        return [0] * len(target)
    q = [math.floor(t * seats / total + 0.5) for t in target]
    up = [(-t / (2 * k + 1), i) for i, (t, k) in enumerate(zip(target, q))]
    down = [(t / (2 * k - 1), -i) for i, (t, k) in enumerate(zip(target, q)) if k]
    heapq.heapify(up)
    heapq.heapify(down)

    def move(i: int, by: int) -> None:
        q[i] += by
        heapq.heappush(up, (-target[i] / (2 * q[i] + 1), i))
        if q[i]:
            heapq.heappush(down, (target[i] / (2 * q[i] - 1), -i))

    def top(heap: list, sign: int) -> tuple[float, int]:
        while True:  # entries made before a move are out of date
            v, i = heap[0]
            k = q[abs(i)]
            if k * 2 + sign > 0 and v == (-1 if sign > 0 else 1) * target[abs(i)] / (2 * k + sign):
                return v, abs(i)
            heapq.heappop(heap)

    have = sum(q)
    while have != seats or (sum(q) and _swaps(top(up, 1), top(down, -1))):
        if have < seats:
            move(top(up, 1)[1], 1)
            have += 1
        elif have > seats:
            move(top(down, -1)[1], -1)
            have -= 1
        else:
            gain, loss = top(up, 1)[1], top(down, -1)[1]
            move(loss, -1)
            move(gain, 1)
    return q


def _swaps(gain: tuple[float, int], loss: tuple[float, int]) -> bool:
    return (-gain[0], -gain[1]) > (loss[0], -loss[1]) and gain[1] != loss[1]


def shard_quotas(target: list[float], seats: int, n_shards: int) -> list[list[int]]:
    """Blocks of each source for each output shard, which are whole numbers."""
    ends = [quotas(target, seats * j // n_shards) for j in range(n_shards + 1)]
    return [[b - a for a, b in zip(x, y)] for x, y in zip(ends, ends[1:])]


@dataclass
class Plan:
    sources: list[str | None]  # by code point, null last
    sizes: list[int]
    targets: list[float]
    quotas: list[int]  # blocks
    blocks: list[int]
    block: int
    seed: int
    shards: list[list[int]]  # blocks of each source, by shard

    def table(self, spark) -> DataFrame:
        rows = []
        for i, (s, size, t, q, n) in enumerate(zip(self.sources, self.sizes, self.targets, self.quotas, self.blocks)):
            q, m = min(q, MOST * n), max(n, 1)
            ends = list(accumulate(x[i] for x in self.shards))
            rows.append((s, i, size, t, q, m, multiplier(m, self.seed, i), (self.seed * 7919 + i * 104729) % m, q // m, q % m, ends))
        return spark.createDataFrame(rows, "source string, s int, source_size long, target double, quota long, m long, a long, b long, base long, extra long, ends array<long>")

    def slice_digits(self) -> int:
        """Hexadecimal digits that keep slices of the largest source near SLICE words."""
        return max(3, math.ceil(math.log(max([*self.sizes, 1]) / SLICE, 16)))


def multiplier(m: int, seed: int, i: int) -> int:
    """The factor of a source's permutation of `m` blocks: seeded, prime to `m`,
    and far from 0 and m, so that neighbours part."""
    x = max(1, m * 382 // 1000 + (seed * 31 + i * 17) % max(m // 8, 1))
    while math.gcd(x, m) != 1:
        x += 1
    return x % m


def plan(docs: DataFrame, source_col: str, size: Column, weights=WEIGHTS, block: int = BLOCK, seed: int = 1, max_sources: int = 1_000_000, n_shards: int = 1) -> Plan:
    """Targets and quotas of all sources. The list of sources, with its weights,
    is a setting of the mix rather than data: more than `max_sources` raise."""
    got = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size).alias("size")).limit(max_sources + 1).collect()
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    got = sorted(got, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.size or 0 for r in got]
    t = targets(sizes, [weights[i % len(weights)] for i in range(len(got))])
    seats = (sum(sizes) + block // 2) // block
    return Plan([r.source for r in got], sizes, t, quotas(t, seats), [-(-n // block) for n in sizes], block, seed, shard_quotas(t, seats, n_shards))


def size_of(text_col: str) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _placed(rows: DataFrame, p: Plan) -> DataFrame:
    """`rows` (with doc_id, source, size) with the place `lo` of each document's
    first word in its source's stream, and the columns of the plan."""
    known = F.broadcast(p.table(rows.sparkSession)).withColumnRenamed("source", "_source")  # at most max_sources rows
    rows = rows.join(known, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    order = F.md5(F.concat(F.lit(f"{p.seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("ord", order).withColumn("slice", F.substring("ord", 1, p.slice_digits()))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("slice")) - F.col("n")
    slices = rows.groupBy("s", "slice").agg(F.sum("size").alias("n")).select("s", "slice", before.alias("before"))
    own = Window.partitionBy("s", "slice").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(own))
    return rows.join(slices, ["s", "slice"]).withColumn("lo", F.col("before") + F.col("upto") - F.col("size"))


def _perm(j: str) -> str:
    # 128 bits, as a source may have more than 2**31 blocks.
    return f"(cast(a as decimal(19,0)) * cast({j} as decimal(19,0)) + b) % cast(m as decimal(19,0))"


def _blocks(block: int) -> str:
    return f"sequence(lo div {block}, (lo + size - 1) div {block})"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, block: int = BLOCK, seed: int = 1, n_shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target (the source's), taken
    (words the mix takes, repeats counted), quota (the source's blocks),
    first_shard (the first of the mix's shards that takes words of it, or null).

    Sources by code point, null last and a source of its own, weigh `weights`,
    repeating. A null or empty text has size 0 and is never taken; a source of
    only such texts has target 0. Ids may be null or repeat; of rows that share
    id and size either may come first. An empty table gives no rows. Other
    columns are not read.
    """
    rows = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size")))
    p = plan(rows, "source", F.col("size"), weights, block, seed, n_shards=n_shards)
    taken = f"""if(size = 0, 0L, aggregate({_blocks(block)}, 0L, (x, j) ->
        x + (least(lo + size, (j + 1) * {block}) - greatest(lo, j * {block})) * (base + if({_perm("j")} < extra, 1, 0))))"""
    # A source's seats in turn: the shard's number is that of the shards filled before.
    seat = f"if(size = 0, null, array_min(filter(transform({_blocks(block)}, j -> {_perm('j')}), x -> base > 0 or x < extra)))"
    first = "if(seat is null, null, size(filter(ends, e -> e <= seat)))"
    return _placed(rows, p).withColumn("seat", F.expr(seat)).select("doc_id", "size", "source_size", "target", F.expr(taken).alias("taken"), "quota", F.expr(first).alias("first_shard"))


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights=WEIGHTS, block: int = BLOCK, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The mix itself, with the columns of `docs` (n_chars, if it is among
    them, is counted anew): every document as often as all its blocks are taken, and once more,
    with the words of just those blocks, if some are taken once more. What is
    not taken goes; see mix()."""
    small_batches(docs.sparkSession)
    p = plan(docs, source_col, size_of(text_col), weights, block, seed)
    # Names could clash with the plan's, so the columns are numbered in between.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values()).withColumns({"doc_id": F.col(at[id_col]), "source": F.col(at[source_col]).cast("string")})
    rows = _placed(plain.withColumn("size", size_of(at[text_col])), p).where("size > 0").select(*at.values(), "lo", "size", "a", "b", "m", "base", "extra")
    schema = StructType([*rows.schema.fields, StructField("part", StringType())])
    rows = rows.mapInArrow(_cut(block, docs.columns.index(text_col), len(docs.columns)), schema)
    t = F.col(at[text_col])
    texts = F.concat(F.array_repeat(t, F.col("base").cast("int")), F.when(F.col("part").isNotNull(), F.array("part")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(at[text_col], F.explode(texts))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(at[text_col]).cast("long"))
    return rows.select(*at.values()).toDF(*at)


def _cut(block: int, text: int, n: int):
    """Adds the words of the blocks that are taken once more, or null for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            parts = []
            for t, lo, size, a, b, m, extra in zip(x.column(text), *(x.column(n + k).to_pylist() for k in (0, 1, 2, 3, 4, 6))):
                js = [j for j in range(lo // block, (lo + size - 1) // block + 1) if (a * j + b) % m < extra] if extra else ()
                if not js:
                    parts.append(None)
                    continue
                w, own = t.as_buffer().to_pybytes().split(), []
                for j in js:
                    own += w[max(lo, j * block) - lo : (j + 1) * block - lo]
                parts.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(parts, pa.binary()).cast(pa.string())], [*x.schema.names, "part"])

    return run


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All `documents`, by weights 5, 2, 1."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_mixing": op4_mixing}
SQL = {
    "op4_mixing": r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size, md5('1-' || coalesce(cast(doc_id as varchar), '')) ord from documents),
s0 as (select source, cast(sum(size) as bigint) ss, row_number() over (order by source nulls last) - 1 i from d group by source),
s as (select *, case i % 3 when 0 then 5 when 1 then 2 else 1 end w from s0),
o as (select *, sum(3 * ss) over r - 3 * ss cap_before, sum(w) over (order by 3 * ss / w desc, i desc) w_left, (select sum(ss) from s) total from s window r as (order by 3 * ss / w, i)),
c as (select *, 3 * ss * w_left <= w * (total - cap_before) capped from o),
t as (select *, case when capped then cast(3 * ss as double) else cast(w * (total - coalesce((select sum(3 * ss) from c where capped), 0)) as double) / (select sum(w) from c where not capped) end target from c),
n as (select cast((sum(ss) + 32) // 64 as bigint) n from s),
seat as (select i, k, row_number() over (order by v desc, i, k) - 1 nth from (select target / (2 * k + 1) v, i, k from t, range((select n from n)) r(k) where target > 0 order by v desc, i, k limit (select n from n))),
q as (select i, count(*) q from seat group by i),
p0 as (select t.source, t.i, ss, target, least(coalesce(q.q, 0), 3 * ((ss + 63) // 64)) q, cast(greatest((ss + 63) // 64, 1) as bigint) m from t left join q using (i)),
p as (select *, list_filter(range(a0, a0 + 400), lambda z: gcd(z, m) = 1)[1] % m a from (select *, greatest(1, m * 382 // 1000 + (31 + i * 17) % greatest(m // 8, 1)) a0 from p0)),
x as (select d.doc_id, d.size, p.*, sum(d.size) over (partition by p.i order by d.ord, d.doc_id, d.size rows unbounded preceding) - d.size lo, row_number() over () r from d join p on d.source is not distinct from p.source),
j as (select *, (a * cast(j as hugeint) + (7919 + i * 104729) % m) % m k from (select *, unnest(range(cast(lo // 64 as bigint), cast((lo + size - 1) // 64 as bigint) + 1)) j from x where size > 0)),
b as (select r, sum((least(lo + size, (j + 1) * 64) - greatest(lo, j * 64)) * (q // m + case when k < q % m then 1 else 0 end)) taken from j group by r),
f as (select r, min(len(list_filter(range(1, 41), lambda z: n * z // 40 <= nth))) first_shard from j join seat using (i, k), n where q >= m or k < q % m group by r)
select doc_id, size, ss source_size, target, cast(coalesce(taken, 0) as bigint) taken, cast(q as bigint) quota, cast(first_shard as int) first_shard from x left join b using (r) left join f using (r)"""
}
