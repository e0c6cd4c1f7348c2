"""Line deduplication behind two Bloom filters.

One pass sets, per task, a bit filter of the line keys seen in one document and
one of those seen in a second. Filters of different tasks are united segment by
segment: a bit set by two tasks counts as seen twice. Only lines that the
second filter suspects are sent on, as 128-bit hashes, to be counted exactly;
of the texts only those that may lose a line.
The filter's size follows the number of documents up to `max_bits`; a fuller
filter suspects more lines and changes no result: at worst all long lines are
sent as hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .durable import durable, small_batches
from .sieve import Sieve, unplaced

SEGMENT = 1 << 15  # bits


class _Lines:
    """The lines of one chunk of documents and the hashes of their keys."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, min_chars: int) -> None:
        n_docs = len(offs) - 1
        nl = np.flatnonzero(buf == 0x0A)
        self.start = np.sort(np.concatenate([offs[:-1], nl + 1]), kind="stable")
        # A document's own start sorts before the next one's, also when it is empty.
        doc_nl = np.searchsorted(offs, nl, "right") - 1
        self.n = np.bincount(doc_nl, minlength=n_docs) + 1
        self.doc = np.repeat(np.arange(n_docs), self.n)
        self.stop = np.concatenate([self.start[1:] - 1, offs[-1:]]) if len(self.start) else self.start
        last = np.cumsum(self.n) - 1
        self.stop[last] = offs[1:]
        solid = np.flatnonzero(~tk.SPACE[buf])
        a = np.searchsorted(solid, self.start)
        z = np.searchsorted(solid, self.stop) - 1
        some = z >= a
        self.lo = np.where(some, solid[np.minimum(a, len(solid) - 1)] if len(solid) else 0, self.start)
        self.hi = np.where(some, solid[np.maximum(z, 0)] + 1 if len(solid) else 0, self.start)
        points = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
        self.long = points[self.hi] - points[self.lo] >= min_chars
        self._buf = buf

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the lines long enough, and their keys' hashes."""
        at = np.flatnonzero(self.long)
        return at, tk.spans_hash(tk.byte_prefix(tk.LOWER[self._buf]), self.lo[at], self.hi[at])


def second_hash(buf: np.ndarray, lines: _Lines, at: np.ndarray) -> np.ndarray:
    pre = tk.prefix(tk.mix(tk.LOWER[buf].astype(np.uint64) + np.uint64(1), 7))
    return tk.spans_hash(pre, lines.lo[at], lines.hi[at])


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit numbers a hash."""
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask]).astype(np.int64)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))


def _have(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0


def _fill(bits: int, min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            named = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in tk.chunks(b.column(1)):
                lines = _Lines(buf, offs, min_chars)
                at, h = lines.hashes()
                keep = named[lo + lines.doc[at]]
                at, h = at[keep], h[keep]
                # One row for each document and key, then each key's first and further documents.
                order = np.lexsort((lines.doc[at], h))
                h, doc = h[order], lines.doc[at][order]
                same = np.zeros(len(h), bool)
                same[1:] = h[1:] == h[:-1]
                repeat = same.copy()
                repeat[1:] &= doc[1:] != doc[:-1]
                _set(twice, _bits(np.unique(h[repeat]), bits).ravel())
                mine = _bits(h[~same], bits)
                _set(twice, mine[:, _have(once, mine[0]) & _have(once, mine[1])].ravel())
                _set(once, mine.ravel())
        step = SEGMENT // 8
        live = [s for s in range(len(once) // step) if once[s * step : (s + 1) * step].any()]
        cut = lambda x, s: zlib.compress(x[s * step : (s + 1) * step].tobytes(), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(live, pa.int32()), pa.array([cut(once, s) for s in live], pa.binary()), pa.array([cut(twice, s) for s in live], pa.binary())], ["seg", "once", "twice"]
        )

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for s, o, t in zip(*(c.to_pylist() for c in b.columns)):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            if s in held:
                h = held[s]
                h[1] |= t | (h[0] & o)
                h[0] |= o
            else:
                held[s] = [o.copy(), t.copy()]
    live = [s for s, (_, t) in held.items() if t.any()]
    yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([zlib.compress(held[s][1].tobytes(), 1) for s in live], pa.binary())], ["seg", "twice"])


def seen_twice(base: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that may be in two documents, packed bits."""
    parts = base.mapInArrow(_fill(bits, min_chars), "seg int, once binary, twice binary")
    united = parts.repartition("seg").mapInArrow(_unite, "seg int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT // 8
    for s, t in united.collect():  # at most bits / 8 bytes
        out[s * step : (s + 1) * step] = np.frombuffer(zlib.decompress(t), np.uint8)
    return out


def _suspects(filter_, bits: int, min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            named = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in tk.chunks(b.column(1)):
                lines = _Lines(buf, offs, min_chars)
                at, h = lines.hashes()
                ok = named[lo + lines.doc[at]]
                for x in _bits(h, bits):
                    ok &= _have(packed, x)
                at, h = at[ok], h[ok]
                if len(at):
                    g = second_hash(buf, lines, at)
                    rows = np.unique(np.stack([tk.signed(h), tk.signed(g), ids[lo + lines.doc[at]]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["h", "g", "i"])

    return run


def _drop(min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tk.chunks(b.column(1)):
                lines = _Lines(buf, offs, min_chars)
                own = b.column(2).slice(lo, hi - lo)
                gone = np.zeros(len(lines.doc), bool)
                if own.null_count < hi - lo:
                    doc = np.repeat(np.arange(hi - lo), np.array([len(x) if x.is_valid else 0 for x in own]))
                    bad = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    bad = tk.mix(bad, 3) + doc.astype(np.uint64)  # per document
                    at, h = lines.hashes()
                    gone[at] = np.isin(tk.mix(h, 3) + lines.doc[at].astype(np.uint64), bad)
                lost = np.bincount(lines.doc[gone], minlength=hi - lo)
                raw, text = buf.tobytes(), []
                first = np.concatenate([[0], np.cumsum(lines.n)])
                for d in range(hi - lo):
                    if lost[d]:
                        keep = range(first[d], first[d + 1])
                        text.append(b"\n".join([raw[lines.start[k] : lines.stop[k]] for k in keep if not gone[k]]))
                    else:
                        text.append(raw[offs[d] : offs[d + 1]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(lines.n.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(text, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept_text"],
                )

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_bits: int = 1 << 28) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys
    of at least `min_chars` code points that `min_docs` ids hold lose all their
    lines, except in the largest of these ids, where all stay. One row results
    for every input row: a null or empty text is one empty line; rows with a
    null id are kept whole and count for no other; rows that share an id count
    as one document. Keys are compared by 128-bit hashes. Other columns are not
    read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    bits = 1 << 20
    while bits < min(128 * docs.count(), max_bits):
        bits *= 2
    filter_ = spark.sparkContext.broadcast(seen_twice(base, bits, min_chars).tobytes())  # at most max_bits / 8 bytes
    # Distinct first, by key and id, so that no key gathers in one task.
    held = durable(base.mapInArrow(_suspects(filter_, bits, min_chars), "h long, g long, i long").distinct())
    keys = held.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("i").alias("m")).where(F.col("n") >= min_docs).select("h", "g", "m")
    gone = held.join(unplaced(keys, "h", "g"), ["h", "g"]).where("i < m").groupBy("i").agg(F.collect_set("h").alias("c"))
    gone = durable(gone)
    some, rest = Sieve(gone.select("i")).split(base, "i")
    shape = "doc_id long, n_lines long, n_dropped long, kept_text string"
    some = some.join(unplaced(gone, "i"), "i", "left").select("i", "t", "c").mapInArrow(_drop(min_chars), shape)
    whole = F.coalesce("t", F.lit(""))
    n = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    rest = rest.select(F.col("i").alias("doc_id"), n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), whole.alias("kept_text"))
    return some.unionByName(rest)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """`documents`, keys of 40 code points in 5 documents."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": r"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, doc_id, unnest(ls) line, unnest(range(len(ls))) p from d),
k as (select r, doc_id, line, p, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
b as (select key, max(doc_id) m from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*) n_lines, count(*) filter (where k.doc_id < m) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (where m is null or k.doc_id >= m), '')) kept_sha256
from k left join b using (key) group by r, k.doc_id"""
}
