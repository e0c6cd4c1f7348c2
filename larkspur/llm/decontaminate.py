"""Benchmark decontamination through a distributed positional inverted index.

One pass over the documents stores postings: for every block of whole documents
and every term of the benchmark that stands in it, the sorted list of its word
positions. The stored lists say how often each term occurs; every window of the
benchmark is then routed, by its rarest terms, to the blocks that hold one, and
only lists of those blocks move. In a block the lists of a window's terms are
intersected from the rarest on, each shifted by the term's place in the window:
exactly for phrases, within some words for proximity matches.

Nothing of the benchmark is held by the driver; what is broadcast is a bitmap of
its terms, of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .durable import durable, shared_path, small_batches, trim
from .sieve import Sieve, bitmap, held_in, unplaced

#: Text bytes of a block, about; windows of a segment of an item.
BLOCK, SEGMENT = 1 << 20, 64
_INDEX = "block long, term long, n int, at binary, ids array<long>, marks array<long>, first array<int>"
_MATCH = "doc_id long, mark long, n_words long, hits array<struct<start:int,stop:int>>, items array<string>, near_items array<string>"


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each document's first word."""
    low = tk.LOWER[buf]
    s, e, first = tk.words(low, offs, tk.NOT_ALNUM)
    return tk.spans_hash(tk.byte_prefix(low), s, e), first


def postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, where each one's list begins, and all lists of positions."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else order
    return s[heads], np.concatenate([heads, [len(s)]]), order


def _build(terms, block_bytes: int) -> Callable:
    """Rows of a block: its header (documents and their first words), then a row
    a term. Blocks are numbered by the task, so a repeated task numbers alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = np.frombuffer(terms.value, np.uint8), TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in _INDEX.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for b in batches:
            for lo, hi, buf, offs in tk.chunks(b.column(1), block_bytes):
                h, first = _words(buf, offs)
                at = np.flatnonzero(held_in(known, h))
                term, begin, order = postings(h[at])
                head = [[block], [None], [len(h)], [None], [b.column(0).slice(lo, hi - lo).to_pylist()], [b.column(2).slice(lo, hi - lo).to_pylist()], [first.astype(np.int32)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(head, kinds)], names)
                n = len(term)
                lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(at[order].astype("<i4"))])
                rows = [pa.array(np.full(n, block)), pa.array(tk.signed(term)), pa.array(np.diff(begin).astype(np.int32)), lists, *(pa.nulls(n, k) for k in kinds[4:])]
                yield pa.RecordBatch.from_arrays(rows, names)
                block += 1
        trim()

    return run


def _cut(size: int) -> Callable:
    """Segments of items: so many words that each window lies whole in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, buf, offs in tk.chunks(b.column(1)):
                h, first = _words(buf, offs)
                h = tk.signed(h)
                rows = []
                for d in range(hi - lo):
                    own = h[first[d] : first[d + 1]]
                    for a in range(0, max(1, len(own) - size + 1), SEGMENT) if len(own) else ():
                        rows.append((seg, b.column(0)[lo + d].as_py(), own[a : a + SEGMENT + size - 1]))
                        seg += 1
                kinds = pa.int64(), pa.string(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["seg", "item", "terms"])

    return run


def _needed(length: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(share * length - 1e-9).astype(np.int64)


def _rows_of(values: np.ndarray, size: int) -> np.ndarray:
    """The windows of one segment; a shorter one is a window, padded with -2."""
    if len(values) < size:
        return np.concatenate([values, np.full(size - len(values), -2)])[None]
    return np.lib.stride_tricks.sliding_window_view(values, size)


def _anchors(size: int, share: float) -> Callable:
    """(seg, term): so many of each window's rarest terms that no match can do
    without all of them. Windows whose terms cannot suffice have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs, out = b.column(0).to_pylist(), []
            for k, seg in enumerate(segs):
                terms, df = (np.asarray(b.column(c)[k].values) for c in (1, 2))
                w = _rows_of(df, size)
                here = w > 0
                allowed = (w > -2).sum(1) - _needed((w > -2).sum(1), share) - (w == 0).sum(1)
                by = np.where(here, w, np.iinfo(np.int64).max)
                rank = np.argsort(np.argsort(by, axis=1, kind="stable"), axis=1, kind="stable")
                win, place = np.nonzero(here & (rank <= allowed[:, None]))
                out += [(seg, t) for t in np.unique(terms[win + place])]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["seg", "term"])

    return run


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of every element of the ranges [lo, lo + n)."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Lists:
    """The lists of one block as sorted keys: term's number * width + position."""

    def __init__(self, term: np.ndarray, begin: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
        self.term, self.begin, self.at, self.first = term, begin, at.astype(np.int64), first.astype(np.int64)
        self.count, self.width = np.diff(begin), int(first[-1]) + 1
        self.keys = np.repeat(np.arange(len(term)), self.count) * self.width + self.at

    def windows(self, segments: list[np.ndarray], size: int) -> np.ndarray:
        """Terms' numbers of all windows, -1 for those the block lacks."""
        rows = []
        for s in segments:
            k = np.minimum(np.searchsorted(self.term, s), max(len(self.term) - 1, 0))
            rows.append(_rows_of(np.where(self.term[k] == s, k, -1) if len(self.term) else np.full(len(s), -1), size))
        return np.concatenate(rows)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def _by(self, w: np.ndarray) -> np.ndarray:
        """Lengths of the lists; a term without one comes last."""
        return np.where(w >= 0, self.count[np.maximum(w, 0)], np.iinfo(np.int64).max)

    def phrases(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all exact occurrences."""
        live = np.flatnonzero((w != -1).all(1) & (w[:, 0] >= 0)) if len(self.term) else np.zeros(0, np.int64)
        w = w[live]
        places = np.argsort(self._by(w), axis=1, kind="stable")  # the rarest first
        t = w[np.arange(len(w)), places[:, 0]]
        owner, k = _spread(self.begin[t], self.count[t])
        start = self.at[k] - places[owner, 0]
        last = start + (w >= 0).sum(1)[owner] - 1
        ok = (start >= 0) & (last < self.width - 1)
        ok[ok] = self.doc(start[ok]) == self.doc(last[ok])
        owner, start = owner[ok], start[ok]
        for r in range(1, w.shape[1]):  # intersect with the next list, shifted by its place
            place = places[owner, r]
            t = w[owner, place]
            key = t * self.width + start + place
            ok = (t < 0) | (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)
            owner, start = owner[ok], start[ok]
        return live[owner], start

    def near(self, w: np.ndarray, slack: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, document) where at some start `share` of a window's terms
        stand within `slack` words of their places, in one document. The start
        may lie before the document's."""
        length = (w > -2).sum(1)
        need, have = _needed(length, share), (w >= 0).sum(1)
        live = np.flatnonzero((have >= need) & (need > 0)) if len(self.term) else np.zeros(0, np.int64)
        w, need, spare = w[live], need[live], (have - need)[live]
        places = np.argsort(self._by(w), axis=1, kind="stable")
        # A match lacks `spare` of the present terms at most, so it has two of the spare + 2 rarest.
        pair = need > 1
        n = np.minimum(spare + 1 + pair, w.shape[1])
        owner, r = _spread(np.zeros(len(n), np.int64), n)
        place = places[owner, r]
        t = w[owner, place]
        one, k = _spread(self.begin[t], self.count[t])
        owner, place, at = owner[one], place[one], self.at[k]
        doc, shifted = self.doc(at), at - place
        order = np.lexsort((shifted, doc, owner))
        owner, place, doc, shifted = owner[order], place[order], doc[order], shifted[order]
        two = (owner[1:] == owner[:-1]) & (place[1:] != place[:-1]) & (shifted[1:] - shifted[:-1] <= 2 * slack)
        a = np.flatnonzero(two & (doc[1:] == doc[:-1]))
        one = np.flatnonzero(~pair[owner])
        o, d = (np.concatenate([x[a], x[one]]) for x in (owner, doc))
        low, high = np.concatenate([shifted[a + 1], shifted[one]]) - slack, np.concatenate([shifted[a], shifted[one]]) + slack
        if not len(o):
            return live[:0], live[:0]
        one, start = _spread(low, high - low + 1)
        o, d = o[one], d[one]
        o, start, d = np.unique(np.stack([o, start, d]), axis=1)
        seen = np.zeros(len(o), np.int64)
        for r in range(w.shape[1]):
            t = w[o, places[o, r]]
            lo = np.maximum(start + places[o, r] - slack, self.first[d])
            hi = np.minimum(start + places[o, r] + slack, self.first[d + 1] - 1)
            k = np.searchsorted(self.keys, t * self.width + lo)
            seen += (t >= 0) & (lo <= hi) & (self.keys[np.minimum(k, len(self.keys) - 1)] <= t * self.width + hi) & (k < len(self.keys))
            ok = seen + w.shape[1] - 1 - r >= need[o]
            o, start, d, seen = o[ok], start[ok], d[ok], seen[ok]
        return live[o], d


def _intersect(size: int, slack: int | None, share: float) -> Callable:
    """Matches of the documents of every block, whose rows come one after the
    other: header, lists by term, segments."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        col = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        kind = col["kind"].to_numpy()
        k1, k2 = np.searchsorted(kind, [1, 2])
        n = len(col["ids"][0])
        first = col["first"][0].values.to_numpy().astype(np.int64)
        at = np.frombuffer(b"".join(x.as_buffer() for x in col["at"].slice(k1, k2 - k1)), "<i4")
        lists = Lists(col["term"].slice(k1, k2 - k1).to_numpy(), np.concatenate([[0], np.cumsum(col["n"].slice(k1, k2 - k1).to_numpy(zero_copy_only=False))]).astype(np.int64), at, first)
        segs = [x.values.to_numpy() for x in col["terms"].slice(k2)]
        w = lists.windows(segs, size)
        item = np.repeat(np.arange(len(segs)), [max(1, len(s) - size + 1) for s in segs])
        names = np.array(col["item"].slice(k2).to_pylist(), object)

        win, start = lists.phrases(w)
        doc = tk.doc_of(first)
        flags = tk.covered(len(doc), start, (w >= 0).sum(1)[win])
        turn = np.ones(len(doc) + 1, bool)
        turn[1:-1] = doc[1:] != doc[:-1]
        runs = np.flatnonzero(flags & (turn[:-1] | ~np.concatenate([[False], flags[:-1]])))
        stops = np.flatnonzero(flags & (turn[1:] | ~np.concatenate([flags[1:], [False]]))) + 1
        base = first[doc[runs]]
        spans = pa.StructArray.from_arrays([pa.array((runs - base).astype(np.int32)), pa.array((stops - base).astype(np.int32))], ["start", "stop"])

        def by_doc(d: np.ndarray, win: np.ndarray) -> list[list[str]]:
            out: list[set[str]] = [set() for _ in range(n)]
            for k, i in set(zip(d.tolist(), item[win].tolist())):
                if names[i] is not None:
                    out[k].add(names[i])
            return [sorted(x) for x in out]

        named = by_doc(doc[start], win)
        near = by_doc(*lists.near(w, slack, share)[::-1]) if slack is not None else [[]] * n
        return pa.RecordBatch.from_arrays(
            [
                col["ids"][0].values, col["marks"][0].values, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(np.searchsorted(runs, first).astype(np.int32)), spans),
                pa.array(named, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string())),
            ],
            [c.split()[0] for c in _MATCH.replace("start:int,stop", "").split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [], None
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)] if len(g) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if rest and last != g[lo]:
                    yield block(rest)
                    rest = []
                last = g[lo]
                rest.append(b.slice(lo, hi - lo))
        if rest:
            yield block(rest)
        trim()

    return run


class Index:
    """Postings of the benchmark's terms in documents (i, t, k), stored as a
    table in the shared folder: one row a term and block."""

    def __init__(self, base: DataFrame, segments: DataFrame, block_bytes: int = BLOCK) -> None:
        spark = base.sparkSession
        terms = bitmap(segments.select(F.explode("terms").alias("term")))
        sent = spark.sparkContext.broadcast(terms.tobytes())
        path = shared_path(spark, "postings")
        base.mapInArrow(_build(sent, block_bytes), _INDEX).write.parquet(path)
        self.rows = spark.read.parquet(path)
        self.headers = self.rows.where("term is null").select("block", "ids", "marks", "first")
        self.lists = self.rows.where("term is not null").select("block", "term", "n", "at")


def _matches(base: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, size: int, slack: int | None, share: float, block_bytes: int) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t"))
    segments = durable(items.mapInArrow(_cut(size), "seg long, item string, terms array<long>"))
    index = Index(base, segments, block_bytes)
    often = index.lists.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
    placed = segments.select("seg", F.posexplode("terms").alias("place", "term")).join(unplaced(often, "term"), "term", "left")
    ranked = placed.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("place", "term", F.coalesce("df", F.lit(0).cast("long")).alias("df")))).alias("x"))
    ranked = ranked.select("seg", F.col("x.term").alias("terms"), F.col("x.df").alias("df"))
    anchors = ranked.mapInArrow(_anchors(size, 1.0 if slack is None else share), "seg long, term long")
    routes = durable(anchors.join(index.lists.select("term", "block"), "term").select("block", "seg").distinct())
    routed = unplaced(routes.select("block").distinct(), "block")
    sieve = Sieve(routed.select("block"))
    kind = lambda df, k, *cols: df.select("block", F.lit(k).alias("kind"), *cols)
    rows = kind(sieve.split(index.headers, "block")[0], 0, "ids", "marks", "first")
    rows = rows.unionByName(kind(sieve.split(index.lists, "block")[0], 1, "term", "n", "at"), allowMissingColumns=True)
    rows = rows.unionByName(kind(routes.join(segments, "seg"), 2, "item", "terms"), allowMissingColumns=True)
    # The bitmap may let a block through that no segment goes to; it has no matches.
    found = rows.repartition("block").sortWithinPartitions("block", "kind", "term").mapInArrow(_skip_unrouted(_intersect(size, slack, share)), _MATCH)
    rest = index.headers.join(routed, "block", "left_anti")
    rest = rest.select(F.explode(F.expr("transform(sequence(0, size(ids) - 1), k -> struct(ids[k] as i, marks[k] as m, first[k + 1] - first[k] as n))")).alias("x"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return found.unionByName(
        rest.select(
            F.col("x.i").alias("doc_id"), F.col("x.m").alias("mark"), F.col("x.n").cast("long").alias("n_words"), none("struct<start:int,stop:int>").alias("hits"),
            none("string").alias("items"), none("string").alias("near_items"),
        )
    )


def _skip_unrouted(run: Callable) -> Callable:
    """Leaves out blocks without a segment; their rows come from the headers."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            g, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)] if len(g) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if last != g[lo]:
                    held, last = [], g[lo]
                held.append(b.slice(lo, hi - lo))
                if kind[hi - 1] == 2:
                    yield from held
                    held = []

    return lambda batches: run(only(batches))


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 10, slack: int | None = 2, share: float = 0.8, block_bytes: int = BLOCK,
) -> DataFrame:
    """Per document: n_words, hits (word spans in an exact occurrence of a
    `size`-word window), items (ids with one) and near_items (ids of items of
    which, counted from some place in the text, `share` of a window's terms
    stand within `slack` words of their places, exact ones included;
    `slack=None` leaves this search out).

    Words are runs of letters, digits and non-ASCII, A-Z lower-cased, compared
    by 64-bit hashes. A null or wordless text has no words and no hits; an item
    of null or wordless text has no window; ids may repeat or be null, each row
    is judged alone. An item id of several rows is listed once, a null one not
    at all; its text counts. An empty documents table gives no rows, an empty
    benchmark no hits. Other columns are not read. `block_bytes` sets how much
    text shares a posting list and changes no result.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.lit(0).cast("long").alias("k"))
    return _matches(base, benchmark, item_col, item_text_col, size, slack, share, block_bytes).drop("mark")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of `benchmark`. What
    a text holds is its own matter, so rows go by their text (two 64-bit
    hashes); null texts and null ids stay. Only rows that a bitmap of the
    contaminated texts lets through are shuffled. As benchmark_matches()
    otherwise."""
    small_batches(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    t = F.col(f"c{docs.columns.index(text_col)}")
    keyed = {"i": F.xxhash64(t), "k": F.xxhash64(F.lit(8), t)}
    base = plain.select(keyed["i"].alias("i"), t.alias("t"), keyed["k"].alias("k"))
    found = _matches(base, benchmark, item_col, item_text_col, size, None, 1.0, block_bytes)
    gone = durable(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("i"), F.col("mark").alias("k")).distinct())
    rows = plain.withColumns(keyed)
    maybe, rest = Sieve(gone.select("i")).split(rows, "i")
    left = maybe.join(unplaced(gone, "i", "k"), ["i", "k"], "left_anti").select(plain.columns)
    return rest.select(plain.columns).unionByName(left).toDF(*docs.columns)


def _digest(col: str):
    return F.sha2(F.array_join(F.array_sort(col), ","), 256)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """`documents` against every item of `benchmark` that has an id: phrases, and
    by the near columns proximity matches."""
    named = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null")
    m = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), named)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return m.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _digest("items").alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"), _digest("near_items").alias("near_items_sha256"),
    )


def op8_near_matches(spark, sf_dir: str) -> DataFrame:
    """`documents` against every item of `benchmark`, proximity matches included."""
    m = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return m.select(
        "doc_id", "n_words", F.size("items").cast("long").alias("n_items"), F.size("near_items").cast("long").alias("n_near_items"),
        _digest("near_items").alias("near_items_sha256"), ((F.size("hits") > 0) | (F.size("near_items") > 0)).alias("contaminated"),
    )


QUERIES = {"op8_decontaminate": op8_decontaminate, "op8_near_matches": op8_near_matches}
_W = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NEAR = """wk as (select item_id, win, n, unnest(range(n)) k, unnest(w[win + 1 : win + n]) term from (select item_id, w, least(len(w), 10) n, unnest(range(greatest(len(w) - 10, 0) + 1)) win from i where len(w) > 0)),
dp as (select r, unnest(range(len(w))) pos, unnest(w) term from d),
few as (select r, item_id, win, n from (select r, item_id, win, n, count(distinct k) c from (select distinct r, term from dp) join wk using (term) group by all) where c >= ceil(0.8 * n - 1e-9)),
near as (select distinct r, cast(item_id as varchar) s from (
  select r, item_id, win, p, n, count(distinct k) c from (select r, item_id, win, n, k, unnest(range(pos - k - 2, pos - k + 3)) p from few join wk using (item_id, win, n) join dp using (r, term)) group by all)
  where c >= ceil(0.8 * n - 1e-9)),
nits as (select r, count(*) n_near, string_agg(s, ',' order by s) nears from near group by r)"""
SQL: dict[str, str] = {
    "op8_decontaminate": f"""
with i as (select item_id, {_W.format("text")} w from benchmark where item_id is not null),
iw as (select item_id, least(len(w), 10) n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda k: array_to_string(w[k : k + 9], ' '))) win from i where len(w) > 0),
d as (select row_number() over () r, doc_id, coalesce({_W.format("text")}, []) w from documents),
dw as (select r, n, unnest(range(1, len(w) - n + 2)) p, w from d, (select distinct n from iw) where len(w) >= n),
m as (select r, dw.n, p, item_id from (select r, n, p, array_to_string(w[p : p + n - 1], ' ') win from dw) dw join iw using (n, win)),
hit as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from (select distinct r, n, p from m)) group by r),
its as (select r, count(*) n_items, string_agg(s, ',' order by s) items from (select distinct r, cast(item_id as varchar) s from m) group by r),
{_NEAR}
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0) n_near_items, sha256(coalesce(nears, '')) near_items_sha256
from d left join hit using (r) left join its using (r) left join nits using (r)"""
}
