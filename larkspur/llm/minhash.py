"""Near-duplicates by BagMinHash.

A text is the multiset of its word pairs. For every pair and every dyadic range
(2^(k-1), 2^k] of weights there is one Poisson process, the same in all texts,
whose points carry a signature slot and a unit of weight; a text sees the points
whose unit is within the pair's count. The first point of each slot is its
signature: two texts agree in a slot with the probability of their weighted
Jaccard similarity. A text's points are made in the order of time and only up to
a horizon at which all slots are filled, about m log m of them however long the
text is.

Texts with equal multisets are one class first. Signatures are cut into bands;
every two texts that share a band are compared once, and the exact multiset
overlap decides. Texts have a home, a block of bounded size of those with the
same least neighbour; a text is sent once to every pair of homes in which it
shares a band with another, and all comparisons of two homes are made there. So
a group of k near copies costs k^2 / 2 comparisons in units of at most
2 * HOME texts, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .durable import durable, release, small_batches, trim
from .sieve import Sieve, unplaced

BANDS, ROWS = 32, 4
#: Texts of a home, about; members of a band by salt.
HOME, SALT = 128, 4096
_U = np.uint64


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word pair's hash, count), sorted by document and hash. Words
    are lower-cased and parted by blanks and ASCII punctuation; a text of one
    word has that word."""
    low = tk.LOWER[buf]
    s, e, first = tk.words(low, offs, tk.NOT_ALNUM)
    word = tk.spans_hash(tk.byte_prefix(low), s, e)
    doc = tk.doc_of(first)
    at = tk.window_starts(first, 2)
    one = first[:-1][np.diff(first) == 1]
    h = np.concatenate([tk.mix(word[at] * _U(3) + tk.mix(word[at + 1], 5)) if len(at) else word[:0], word[one]])
    d = np.concatenate([doc[at], doc[one]])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    return d[head], h[head], np.diff(np.concatenate([head, [len(h)]]))


def signatures(doc: np.ndarray, feat: np.ndarray, count: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """An (n_docs, m) array of first arrival times; infinite without features."""
    total = np.bincount(doc, count, minlength=n_docs)
    sig = np.full(n_docs * m, np.inf)
    horizon = m * (np.log(m) + 2) / np.maximum(total, 1)
    tops = np.ceil(np.log2(count)).astype(np.int64)  # the last level reached
    e_doc, e_key, e_low, e_count = [], [], [], []
    for k in range(int(tops.max()) + 1 if len(tops) else 0):
        has = np.flatnonzero(tops >= k)
        e_doc.append(doc[has])
        e_key.append(tk.mix(feat[has], 101 + k))
        e_low.append(np.full(len(has), 0 if k == 0 else 1 << (k - 1)))
        e_count.append(count[has])
    if not e_doc:
        return sig.reshape(n_docs, m)
    d, key, low, w = (np.concatenate(x) for x in (e_doc, e_key, e_low, e_count))
    rate = np.maximum(low, 1).astype(float)  # the range's width
    step = np.zeros(len(d), np.int64)

    def gap(i: np.ndarray) -> np.ndarray:
        u = tk.mix(key[i] + step[i].astype(_U) * _U(0x9E3779B97F4A7C15))
        return -np.log(((u >> _U(11)).astype(float) + 0.5) / 2.0**53) / rate[i]

    time = gap(np.arange(len(d)))
    live = np.flatnonzero(time <= horizon[d])
    while True:
        while len(live):
            v = tk.mix(key[live] + step[live].astype(_U) * _U(0x9E3779B97F4A7C15), 9)
            slot = (v & _U(0xFFFFFFFF)).astype(np.int64) * m >> 32
            unit = low[live] + ((v >> _U(32)).astype(float) / 2.0**32 * rate[live]).astype(np.int64) + 1
            seen = unit <= w[live]
            np.minimum.at(sig, d[live][seen] * m + slot[seen], time[live][seen])
            step[live] += 1
            time[live] += gap(live)
            live = live[time[live] <= horizon[d[live]]]
        short = np.flatnonzero(np.isinf(sig.reshape(n_docs, m)).any(1) & (total > 0))
        if not len(short):
            return sig.reshape(n_docs, m)
        horizon[short] *= 1.5
        live = np.flatnonzero(time <= horizon[d])


def _sign(bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tk.chunks(b.column(1)):
                doc, feat, count = features(buf, offs)
                n = hi - lo
                sig = signatures(doc, feat, count, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
                h = np.broadcast_to(np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15), (n, bands)).copy()
                for r in range(rows):
                    h = tk.mix(h + sig[:, :, r], 21)
                some = np.bincount(doc, minlength=n) > 0
                # An order-free hash of the multiset, in two parts.
                e = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
                parts = []
                for seed in (31, 32):
                    c = np.zeros(len(feat) + 1, _U)
                    np.cumsum(tk.mix(tk.mix(feat, seed) + count.astype(_U)), out=c[1:])
                    parts.append(pa.array(tk.signed(tk.mix(c[e[1:]] - c[e[:-1]])), mask=~some))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(tk.signed(np.ascontiguousarray(h)).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), *parts, keys], ["i", "x", "y", "bands"])
        trim()

    return run


def overlap(a: str, b: str) -> float:
    """The exact weighted Jaccard similarity of two texts."""
    return float(_overlaps(pa.array([a, b]), np.array([0]), np.array([1]))[0])


def _overlaps(texts: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of the pairs (a, b) of `texts`, by index; a is sorted."""
    ds, hs, cs = [], [], []
    for lo, _, buf, offs in tk.chunks(texts):
        d, h, c = features(buf, offs)
        ds.append(d + lo)
        hs.append(h)
        cs.append(c)
    d, c = np.concatenate(ds), np.concatenate(cs)
    names, f = np.unique(np.concatenate(hs), return_inverse=True)
    at = np.searchsorted(d, np.arange(len(texts) + 1))
    total = np.bincount(d, c, minlength=len(texts))
    shared = np.zeros(len(a))
    held = np.zeros(len(names), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    for lo, hi in zip(heads, [*heads[1:], len(a)]):
        own = slice(at[a[lo]], at[a[lo] + 1])
        held[f[own]] = c[own]
        for m in range(lo, hi, 32):  # so many texts' word pairs are looked up at once
            two = b[m : min(m + 32, hi)]
            n = at[two + 1] - at[two]
            k = np.arange(n.sum()) + np.repeat(at[two] - (np.cumsum(n) - n), n)
            shared[m : m + len(two)] = np.bincount(np.repeat(np.arange(len(two)), n), np.minimum(held[f[k]], c[k]), minlength=len(two))
        held[f[own]] = 0
    return shared / np.maximum(total[a] + total[b] - shared, 1)


def _candidates(key: np.ndarray, at: np.ndarray, ids: np.ndarray, home: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one unit's texts, ids a < b, that share one of their keys
    key[at[k] : at[k + 1]]; of different homes, unless the unit is `one` home."""
    n = len(ids)
    names, k = np.unique(key, return_inverse=True)
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, len(names), 4096):
        held = np.zeros((n, min(4096, len(names) - lo)), np.float32)
        now = (k >= lo) & (k < lo + 4096)
        held[np.repeat(np.arange(n), np.diff(at))[now], k[now] - lo] = 1
        shared += held @ held.T
    ok = (shared > 0) & (ids[:, None] < ids[None, :])
    if not one:
        ok &= home[:, None] != home[None, :]
    return np.nonzero(ok)


def _star(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of n vertices each is connected to by the edges (a, b)."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, a, low[b])
        np.minimum.at(now, b, low[a])
        now = now[now]
        if (now == low).all():
            return low
        low = now


_UNIT = ["g1", "g2", "g", "r", "keys", "t"]
_LINK = "a long, b long, similarity double"


def _compare(least: float) -> Callable:
    """Links of every unit (g1, g2), whose rows come one after the other; and,
    without a similarity, each linked text with the least one it hangs on there."""

    def unit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        col = [rows.column(c).combine_chunks() for c in _UNIT]
        home, ids = col[2].to_numpy(), col[3].to_numpy()
        order = np.argsort(ids, kind="stable")
        at = np.concatenate([[0], np.cumsum(col[4].value_lengths().to_numpy(zero_copy_only=False))])
        a, b = _candidates(col[4].flatten().to_numpy(), at, ids, home, col[0][0] == col[1][0])
        if not len(a):
            return
        s = _overlaps(col[5], a, b)
        keep = s >= least
        x, y, s = ids[a[keep]], ids[b[keep]], s[keep]
        if len(order) != len(np.unique(ids)):  # rows that share an id: the best of their texts
            way = np.lexsort((-s, y, x))
            x, y, s = x[way], y[way], s[way]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            x, y, s = x[new], y[new], s[new]
        if not len(x):
            return
        names = np.unique(ids)
        low = _star(np.searchsorted(names, x), np.searchsorted(names, y), len(names))
        moved = np.flatnonzero(low != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(s)], ["a", "b", "similarity"])
        yield pa.RecordBatch.from_arrays([pa.array(names[low[moved]]), pa.array(names[moved]), pa.nulls(len(moved), pa.float64())], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            g1, g2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if rest and last != (g1[lo], g2[lo]):
                    yield from unit(pa.Table.from_batches(rest))
                    rest = []
                last = g1[lo], g2[lo]
                rest.append(batch.slice(lo, hi - lo))
        if rest:
            yield from unit(pa.Table.from_batches(rest))
        trim()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each vertex of `edges` (a, b) with the least one it is connected
    to; by alternating large and small stars until nothing moves. Minima are
    taken by partial aggregation and joined back with an exchange on both sides,
    where adaptive execution splits a hub's edges."""
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(unplaced(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unplaced(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(e.select(F.col("v"), F.col("v").alias("c")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, links). members, per row of `docs`: doc_id, class_id (the least
    id of its connected component), copies (rows whose text has the same
    multiset, itself included), n_links (links of its text). links: a < b, the
    least ids of two texts, and their similarity, at least `least`.

    A text without words, null or empty ones among them, is a class of its own:
    its class_id is its id. Rows with a null id are left out of all comparisons
    and get a null class_id. Rows that share an id are one document for links
    and classes, by any of its texts. An empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    signed = durable(base.mapInArrow(_sign(bands, rows), "i long, x long, y long, bands array<long>"))
    named = signed.where("i is not null and x is not null")
    reps = named.groupBy("x", "y").agg(F.min(F.struct("i", "bands")).alias("r"), F.count("*").alias("copies")).select("x", "y", F.col("r.i").alias("r"), "copies", F.col("r.bands").alias("bands"))
    reps = durable(reps)
    keyed = reps.select(F.explode("bands").alias("key"), "r")
    shared = keyed.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    # Members of bands that several texts share.
    active = durable(keyed.join(shared, "key").distinct())
    member = active.groupBy("r").agg(F.min("lo").alias("h"), F.collect_set("key").alias("keys"))
    size = member.groupBy("h").agg(F.ceil(F.count("*") / HOME).alias("blocks"))
    homes = durable(member.join(size, "h").select("r", F.xxhash64("h", F.pmod(F.xxhash64("r"), F.col("blocks"))).alias("g"), "keys"))
    placed = active.join(homes.select("r", "g"), "r").select("key", "r", "g", F.ceil(F.col("n") / SALT).alias("salts"))
    # A band's homes, once for each of its salts, and whether it joins two texts there.
    seats = placed.groupBy("key", "g", "salts").agg((F.count("*") > 1).alias("several"))
    seats = seats.select("key", F.col("g").alias("other"), "several", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    sent = placed.withColumn("salt", F.pmod(F.xxhash64("r"), F.col("salts"))).join(seats, ["key", "salt"]).where("g <> other or several")
    sent = durable(sent.select(F.least("g", "other").alias("g1"), F.greatest("g", "other").alias("g2"), "g", "r").distinct())
    wanted = Sieve(homes.select("r")).split(base, "i")[0]
    full = wanted.join(homes.select("r", "keys"), F.col("i") == F.col("r")).select("r", "keys", "t").join(sent, "r").select(*_UNIT)
    found = durable(full.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_compare(least), _LINK))
    links = found.where("similarity is not null")
    del shared, active, member, size, homes, placed, seats, sent, wanted, full
    release(spark)
    comp = components(found.where("similarity is null").select("a", "b"))
    ends = links.select(F.col("a").alias("r")).unionByName(links.select(F.col("b").alias("r"))).groupBy("r").agg(F.count("*").alias("n_links"))
    classes = reps.select("x", "y", "r", "copies").join(comp, F.col("r") == F.col("v"), "left").join(ends, "r", "left")
    classes = classes.select("x", "y", F.coalesce("c", "r").alias("c"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("i", "x", "y").join(classes, ["x", "y"], "left")
    alone = F.col("x").isNull() | F.col("i").isNull()
    return (
        out.select(
            F.col("i").alias("doc_id"), F.when(alone, F.col("i")).otherwise(F.col("c")).alias("class_id"),
            F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        ),
        links,
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs`, all columns, that are the least of their class. Rows
    are judged by id and text: different texts under one id are documents of
    their own; of rows equal in both one stays, the same on every run. Null ids
    and wordless texts stay. Only rows that a bitmap of what goes, or of
    repeated ids, lets through are shuffled."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    i, t = F.col(f"c{docs.columns.index(id_col)}").cast("long"), F.col(f"c{docs.columns.index(text_col)}")
    ids = plain.select(i.alias("i")).where("i is not null").groupBy("i").agg(F.count("*").alias("n")).where("n > 1").select("i")
    repeated = Sieve(durable(ids))
    # Such an id and its text make an id of their own, above all others.
    own = F.lit(2**62) + F.xxhash64(i, t).bitwiseAND(F.lit(2**62 - 1))
    rows = repeated.mark(plain.withColumn("v", i), "v", "again").withColumn("v", F.when(F.col("again"), own).otherwise(i))
    members, _ = near_duplicates(rows.select("v", t.alias("t")), "v", "t", **settings)
    gone = durable(members.where("doc_id <> class_id").select(F.col("doc_id").alias("v")).distinct())
    maybe, rest = Sieve(gone).split(rows, "v")
    kept = rest.unionByName(maybe.join(unplaced(gone, "v"), "v", "left_anti").select(rows.columns))
    row = F.struct(*plain.columns)
    once = kept.where("again").groupBy("v").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("r")).select("r.*")
    return kept.where("not again").select(plain.columns).unionByName(once).toDF(*docs.columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """without_near_copies(), and of rows that share an id only one: for tables
    in which an id is a document."""
    kept = without_near_copies(docs, id_col, text_col, **settings)
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """`documents`: every document's class, copies and links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


QUERIES = {"op3_minhash": op3_minhash}
SQL: dict[str, str] = {}
