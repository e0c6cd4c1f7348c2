"""Substring deduplication by level-wise doubling.

Word windows that occur in more than one document at one length are the only
ones extended to twice that length. At the first length a document sends just
the least-hashed short window of every long window (equal long windows hold
equal least ones, so none is lost), about one in thirteen; every further length
sends only windows that are still candidates, so what is shuffled follows the
repeated text, not the corpus; of the texts only those with candidates move.
Groups are reduced to their least document by map-side aggregation; the join
back has an exchange on both sides, so adaptive execution splits its hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .durable import durable, small_batches
from .sieve import Sieve, unplaced

START = 25


def levels(window: int, start: int = START) -> list[int]:
    """Window lengths, each at most twice the one before, the last `window`."""
    out = [window]
    while out[0] > start:
        out.insert(0, (out[0] + 1) // 2)
    if len(out) == 1:
        out.insert(0, (window + 1) // 2)
    return out


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of h[i : i + width]; shorter by width - 1."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class _Run:
    """One chunk of documents: its words and window hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        s, e, self.first = tk.words(buf, offs, tk.SPACE)
        self.word = tk.spans_hash(tk.byte_prefix(buf), s, e)
        self.n = len(self.word)
        self.doc = tk.doc_of(self.first)
        self._pre: dict[int, np.ndarray] = {}

    def hashes(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        if seed not in self._pre:
            self._pre[seed] = tk.prefix(self.word if not seed else tk.mix(self.word, seed))
        return tk.spans_hash(self._pre[seed], at, at + length)

    def least(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all long windows, and the least hash of a short window in each."""
        at = tk.window_starts(self.first, long)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        every = self.hashes(np.arange(self.n - short + 1), short)
        return at, _sliding_min(every, long - short + 1)[at]


def _first_level(short: int, long: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in tk.chunks(b.column(1)):
                r = _Run(buf, offs)
                at, h = r.least(short, long)
                if not len(at):
                    continue
                doc = r.doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h[new])), pa.array(ids[lo + doc[new]])], ["h", "i"])

    return run


def _next_level(prev: int, length: int, first: bool) -> Callable:
    """Candidates of `length`, from (id, text, candidate hashes, of which later)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            named = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in tk.chunks(b.column(1)):
                pairs = b.column(2).slice(lo, hi - lo)
                if pairs.null_count == hi - lo:
                    continue
                flat = pairs.flatten()
                known = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
                later = known[flat.field(1).to_numpy(zero_copy_only=False)]
                known, later = np.unique(known), np.unique(later)
                r = _Run(buf, offs)
                if first:
                    at, h = r.least(prev, length)
                    keep = np.isin(h, known) & named[lo + r.doc[at]]
                    at, h = at[keep], h[keep]
                    movable = np.isin(h, later)
                else:
                    at = tk.window_starts(r.first, length)
                    at = at[named[lo + r.doc[at]]]
                    head, tail = r.hashes(at, prev), r.hashes(at + length - prev, prev)
                    keep = np.isin(head, known) & np.isin(tail, known)
                    at = at[keep]
                    movable = np.isin(head[keep], later) & np.isin(tail[keep], later)
                if not len(at):
                    continue
                # The place carries a check of the text, as rows may share an id.
                raw = buf.tobytes()
                check = np.array([crc32(raw[offs[d] : offs[d + 1]]) for d in range(hi - lo)], np.uint64)
                doc = r.doc[at]
                place = (check[doc] << np.uint64(32)) | (at - r.first[doc]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tk.signed(r.hashes(at, length))), pa.array(tk.signed(r.hashes(at, length, 1)).astype(np.int32)), pa.array(ids[lo + doc]), pa.array(tk.signed(place)), pa.array(movable)],
                    ["h", "g", "i", "p", "later"],
                )

    return run


def _remove(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tk.string_buffers(b.column(1))
            raw, places = buf.tobytes(), b.column(2)
            n, gone, text = [], [], []
            for d in range(len(b)):
                own = raw[offs[d] : offs[d + 1]]
                w = own.split()
                n.append(len(w))
                at = places[d].values
                if at is not None:
                    at = at.to_numpy(zero_copy_only=False).view(np.uint64)
                    at = at[at >> np.uint64(32) == np.uint64(crc32(own))]
                    at = (at & np.uint64(2**32 - 1)).astype(np.int64)
                    keep = ~tk.covered(len(w), at, window)
                    w = list(compress(w, keep))
                gone.append(n[-1] - len(w))
                text.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def doubled(base: DataFrame, lengths: Iterable[int]) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(length, windows, repeated ones' least ids) for one length after the other
    of `base` (i, t), each from what the length before left, until no candidate
    survives or the lengths end. The first length gives none of its own."""
    lengths = iter(lengths)
    prev, length = next(lengths), next(lengths)
    rows = base.where("i is not null").mapInArrow(_first_level(prev, length), "h long, i long")
    least = rows.groupBy("h").agg(F.min("i").alias("m"), F.max("i").alias("x")).where("m < x").select("h", "m")
    found, first = rows.join(unplaced(least, "h"), "h"), True
    while True:
        cand = durable(found.groupBy("i").agg(F.collect_set(F.struct("h", (F.col("m") < F.col("i")).alias("later"))).alias("c")))
        if cand.isEmpty():
            return
        texts = Sieve(cand.select("i")).split(base, "i")[0].join(unplaced(cand, "i"), "i")
        rows = texts.select("i", "t", "c").mapInArrow(_next_level(prev, length, first), "h long, g int, i long, p long, later boolean")
        least = rows.groupBy("h", "g").agg(F.min("i").alias("m"), F.max("i").alias("x")).where("m < x").select("h", "g", "m")
        yield length, rows, least
        prev, length, first = length, next(lengths, None), False
        if length is None:
            return
        found = rows.join(unplaced(least, "h", "g"), ["h", "g"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, start: int = START) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text.

    Words are runs of non-blank bytes. A word goes if a window of `window`
    words over it also starts in a row with a smaller id; windows are judged on
    the input. Repeats within one row, and in rows with the same id, stay. The
    result has one row for every input row: a null or empty text has no words;
    texts shorter than the window, and rows with a null id, are kept whole and
    count for no other. Kept words are joined by one space. Equality is that of
    96-bit hashes of the word sequence. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    shape = "doc_id long, n_words long, n_removed long, kept_text string"
    whole = F.lit(None).cast("array<long>").alias("c")
    for length, rows, least in doubled(base, levels(window, start)):
        if length == window:
            break
    else:  # no candidate came so far
        return base.select("i", "t", whole).mapInArrow(_remove(window), shape)
    again = rows.where("later").join(unplaced(least, "h", "g"), ["h", "g"]).where("m < i")
    places = durable(again.groupBy("i").agg(F.collect_list("p").alias("c")))
    some, rest = Sieve(places.select("i")).split(base, "i")
    some, rest = some.join(unplaced(places, "i"), "i", "left").select("i", "t", "c"), rest.select("i", "t", whole)
    return some.mapInArrow(_remove(window), shape).unionByName(rest.mapInArrow(_remove(window), shape))


def repeat_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, start: int = START) -> DataFrame:
    """(doc_id, longest): for every id that shares a window of `window` words with
    another, the longest of `window`, 2 * `window`, 4 * `window` and so on at which
    it still shares one; lengths double until no candidate survives. Null ids and
    texts, and texts shorter than the window, give no row."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    out = None
    for length, rows, least in doubled(base, chain(levels(window, start), (window << k for k in count(1)))):
        if length >= window:
            one = durable(rows.join(unplaced(least, "h", "g"), ["h", "g"]).select(F.col("i").alias("doc_id"), F.lit(length).cast("long").alias("longest")).distinct())
            out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest long")
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """`documents`, by windows of 50 words."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {
    "op1_substring_dedup": r"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
p as (select r, doc_id, w, unnest(range(1, len(w) - 48)) p from d where len(w) >= 50),
k as (select r, doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) h from p),
f as (select h, min(doc_id) m from k group by h),
gone as (select distinct r, unnest(range(p, p + 50)) q from k join f using (h) where m < doc_id),
g as (select r, list(q) q from gone group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(q), 0) as bigint) n_removed,
  sha256(array_to_string(case when q is null then w else list_filter(w, lambda x, j: not list_contains(q, j)) end, ' ')) kept_sha256
from d left join g using (r)"""
}
