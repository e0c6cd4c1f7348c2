"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its bucketed byte n-grams and of itself; a passage is the
mean of its bag's embeddings, classified by a linear softmax. Embeddings and
softmax are trained jointly, in numpy, on a bounded sample. As documents are
labelled whole while a few words decide, a document is scored by its worst
passage: training starts from whole documents and then, in each epoch, takes
every document's worst passage as its example.

The mean of embeddings times the softmax's weights is a mean of one number a
bucket, so a fitted model is one float an n-gram bucket, of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tokens as tk
from .durable import small_batches, trim
from .labelled import in_fit_fold, labelled_sample

#: Everything but digits, letters and non-ASCII bytes parts words here.
EDGE = tk.NOT_ALNUM
PASSAGE = 24
#: Entries of a passage's bag at least.
PAD = 400


def bag(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, grams: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of "<word>" and of the words themselves."""
    size = stop - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    word = np.repeat(np.arange(len(start)), size)
    src = np.arange(at[-1]) - at[word] + start[word] - 1
    inner = (src >= start[word]) & (src < stop[word])
    out[~inner] = 0x3C
    out[at[1:] - 1] = 0x3E
    out[inner] = buf[src[inner]]
    pre = tk.byte_prefix(out)
    mask = np.uint64(buckets - 1)
    words, feats = [np.arange(len(start), dtype=np.int32)], [(tk.spans_hash(pre, at[:-1], at[1:]) & mask).astype(np.int32)]
    for n in grams:
        i = np.arange(max(len(out) - n + 1, 0))
        i = i[i + n <= at[word[i] + 1]]
        words.append(word[i].astype(np.int32))
        feats.append((tk.mix(tk.spans_hash(pre, i, i + n), n) & mask).astype(np.int32))
    return np.concatenate(words), np.concatenate(feats)


class _Bags:
    """The distinct words of a run of documents, and each word's number."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, grams: tuple[int, ...], buckets: int) -> None:
        low = tk.LOWER[buf]
        s, e, self.first = tk.words(low, offs, EDGE)
        h = tk.spans_hash(tk.byte_prefix(low), s, e)
        self.key, one, number = np.unique(h, return_index=True, return_inverse=True)
        self.number = number.astype(np.int32)
        self.owner, self.feat = bag(low, s[one], e[one], grams, buckets)
        # A word said again in its document within half a passage counts for nothing the second time.
        order = np.argsort(self.number, kind="stable")
        doc = tk.doc_of(self.first)[order]
        near = np.zeros(len(h), bool)
        near[order[1:]] = (self.number[order[1:]] == self.number[order[:-1]]) & (doc[1:] == doc[:-1]) & (order[1:] - order[:-1] <= PASSAGE // 2)
        self.counts = ~near
        self._measure()

    def _measure(self) -> None:
        self.size = np.bincount(self.owner, minlength=len(self.key)).astype(np.int32)
        self.entries = np.concatenate([[0], np.cumsum(self.size[self.number] * self.counts, dtype=np.int64)])

    @classmethod
    def joined(cls, parts: list[_Bags]) -> _Bags:
        """One run of several, made apart so that bytes are held for one at a time."""
        self = cls.__new__(cls)
        at = np.cumsum([0, *(len(p.key) for p in parts)])
        self.key, one, place = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
        new = np.zeros(at[-1], bool)
        new[one] = True
        place = place.astype(np.int32)
        own = [(p, lo, new[lo:hi][p.owner]) for p, lo, hi in zip(parts, at, at[1:])]
        self.owner = np.concatenate([place[lo + p.owner[k]] for p, lo, k in own])
        self.feat = np.concatenate([p.feat[k] for p, _, k in own])
        self.number = np.concatenate([place[lo + p.number] for p, lo, _ in own])
        self.counts = np.concatenate([p.counts for p in parts])
        words = np.cumsum([0, *(len(p.number) for p in parts)])
        self.first = np.concatenate([*(p.first[:-1] + w for p, w in zip(parts, words)), words[-1:]])
        self._measure()
        return self

    def word_sums(self, weight: np.ndarray) -> np.ndarray:
        return _sums(self.owner, weight, self.feat, len(self.key))


def _sums(by: np.ndarray, values: np.ndarray, at: np.ndarray, n: int, step: int = 1 << 19) -> np.ndarray:
    """Sums of values[at] by `by`, made piece by piece to hold little at once."""
    out = np.zeros(n)
    for lo in range(0, len(by), step):
        out += np.bincount(by[lo : lo + step], values[at[lo : lo + step]], minlength=n)
    return out


def passages(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and end word of half-overlapping passages of whole documents."""
    n = np.diff(first)
    step = length // 2
    count = np.maximum(1, -(-(n - length) // step) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    lo = first[doc] + k * step
    return doc, lo, np.minimum(lo + length, first[doc + 1])


@dataclass
class Model:
    weight: np.ndarray  # a bucket's embedding times (toxic - clean) softmax weights
    bias: float
    grams: tuple[int, ...] = (3, 4, 5)
    passage: int = PASSAGE

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """P(toxic) of each document's worst passage."""
        b = _Bags(buf, offs, self.grams, len(self.weight))
        doc, lo, hi = passages(b.first, self.passage)
        z = _means(b, b.word_sums(self.weight), lo, hi) + self.bias
        worst = np.full(len(offs) - 1, -np.inf)
        np.maximum.at(worst, doc, z)
        return 1 / (1 + np.exp(-np.clip(worst, -40, 40)))


def _sizes(b: _Bags, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sizes of the bags of [lo, hi); a short one is padded to PAD with zero embeddings."""
    return np.maximum(b.entries[hi] - b.entries[lo], PAD)


def _means(b: _Bags, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(sums[b.number] * b.counts)])
    return (c[hi] - c[lo]) / _sizes(b, lo, hi)


def fit(sample: list[tuple[str, int]], dim: int = 16, buckets: int = 1 << 17, grams: tuple[int, ...] = (3, 4, 5), epochs: int = 80, passage: int = PASSAGE, rate: float = 0.2, decay: float = 1e-6) -> Model:
    """Embeddings and softmax by full-batch Adam. An empty sample, or one of a
    single label, gives a model that scores every text alike, by that share."""
    y = np.array([k for _, k in sample], float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(buckets, np.float32), float(np.log((p + 1e-3) / (1 - p + 1e-3))), grams, passage)
    b = _Bags.joined([_Bags(buf, offs, grams, buckets) for _, _, buf, offs in tk.chunks(pa.array([t for t, _ in sample], pa.large_string()))])
    doc, lo, hi = passages(b.first, passage)
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    rng = np.random.default_rng(5)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, out, bias)]
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    whole = b.first[:-1], b.first[1:]
    for t in range(1, epochs + 1):
        sums = b.word_sums(emb @ (out[:, 1] - out[:, 0]))
        if t <= epochs // 4:
            at, end = whole
        else:
            z = _means(b, sums, lo, hi)
            best = np.flatnonzero(z == np.maximum.reduceat(z, heads)[doc])
            pick = best[np.unique(doc[best], return_index=True)[1]]
            at, end = lo[pick], hi[pick]
        p = 1 / (1 + np.exp(-np.clip(_means(b, sums, at, end) + bias[1] - bias[0], -40, 40)))
        g = (p - y) * cost
        # Every word of an example adds g / (size of the example's bag) to each of its buckets.
        per = g / _sizes(b, at, end)
        d = np.bincount(at, per, minlength=len(b.number) + 1) - np.bincount(end, per, minlength=len(b.number) + 1)
        by_word = np.bincount(b.number, np.cumsum(d)[:-1] * b.counts, minlength=len(b.key))
        by_bucket = _sums(b.feat, by_word, b.owner, buckets).astype(np.float32)
        g_out = (emb * by_bucket[:, None]).sum(0)
        grads = (by_bucket[:, None] * (out[:, 1] - out[:, 0]) + decay * emb, np.stack([-g_out, g_out], 1) + decay * out, np.array([-g.sum(), g.sum()]))
        for x, gx, (m, v) in zip((emb, out, bias), grads, state):
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), grams, passage)


def _score(model, text: int) -> Callable:
    """Every batch with a last column of scores of the texts in column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.value.score(buf, offs) for _, _, buf, offs in tk.chunks(b.column(text))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, "score"])
        trim()

    return run


def _fitted(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, id_col: str, text_col: str, fitting: dict):
    """The model of labelled_sample(), sent to the executors: `buckets` floats."""
    sample = labelled_sample(docs, labels, label, per_class, max_bytes, id_col, text_col)
    trim()
    model = fit(sample, **fitting)
    trim()
    return docs.sparkSession.sparkContext.broadcast(model)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = 3000, max_bytes: int = 8 << 20, **fitting) -> DataFrame:
    """Per row: doc_id, score in 0 to 1, the higher the likelier toxic.

    Fitted on labelled_sample(); only the text makes the score. A null, empty
    or wordless text gets the model's bias as its score; repeated rows get equal
    scores; ids may be null. Without usable labels every score is the same,
    near 0; an empty table gives no rows. Other columns, whatever their names,
    are not read.
    """
    small_batches(docs.sparkSession)
    sent = _fitted(docs, labels, label, per_class, max_bytes, id_col, text_col, fitting)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return base.mapInArrow(_score(sent, 1), "doc_id long, t string, score double").drop("t")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = 3000, max_bytes: int = 8 << 20, **fitting) -> DataFrame:
    """The rows of `docs`, all columns, with a score under `least`; nothing is
    shuffled. Rows with a null id are judged like others. As toxicity_scores()
    otherwise."""
    small_batches(docs.sparkSession)
    sent = _fitted(docs, labels, label, per_class, max_bytes, id_col, text_col, fitting)
    # Names could clash with a column's, so all are numbered in between.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    kept = plain.mapInArrow(_score(sent, docs.columns.index(text_col)), out).where(F.col("score") < least)
    return kept.drop("score").toDF(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """`documents`, by `labels.toxic`."""
    s = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return s.select("doc_id", (~in_fit_fold("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
