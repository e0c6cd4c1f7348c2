"""Quality rules by line sequence labelling.

A document is a sequence of lines, each described by a few bounded numbers. A
linear-chain conditional random field, fitted in numpy on a bounded sample,
labels every line content or boilerplate by Viterbi decoding; a document is
kept if enough of its words stand in content lines. Only whole documents carry
labels, so fitting starts with a document's label on all its lines and then
decodes the lines of poor documents anew, twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .durable import small_batches
from .labelled import labelled_sample

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER, _LOWER_CASE, _DIGIT = (tk._table(x) for x in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39)))
_STOP = np.isin(np.arange(256), np.frombuffer(b".?!:;", np.uint8))
GRAM = 5
N_FEATURES = 18


class Profile:
    """The counts and line features of one chunk of documents."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        n_docs = len(offs) - 1
        s, e, first = tk.words(buf, offs, tk.SPACE)
        self.n_words = np.diff(first)
        sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        inside = ~tk.SPACE[buf]
        chars = sums(inside & ((buf & 0xC0) != 0x80))
        self.word_chars = chars[offs[1:]] - chars[offs[:-1]]
        symbols = sums(_SYMBOL[buf])
        self.n_symbols = symbols[offs[1:]] - symbols[offs[:-1]]

        word = tk.spans_hash(tk.byte_prefix(buf), s, e)
        doc = tk.doc_of(first)
        at = tk.window_starts(first, GRAM)
        pre = tk.prefix(word)
        h = tk.mix(tk.spans_hash(pre, at, at + GRAM)) + doc[at].astype(np.uint64)
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = (h[order][1:] == h[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        again = tk.covered(len(word), at[order[same[:-1] | same[1:]]], GRAM)
        self.n_repeat_words = tk.per_doc(again, first)

        nl = np.flatnonzero(buf == 0x0A)
        lines = np.bincount(np.searchsorted(offs, nl, "right") - 1, minlength=n_docs) + 1
        self.doc = np.repeat(np.arange(n_docs), lines)
        self.head = np.concatenate([[0], np.cumsum(lines)])
        lo = np.sort(np.concatenate([offs[:-1], nl + 1]), kind="stable")
        hi = np.concatenate([lo[1:] - 1, [0]])
        hi[self.head[1:] - 1] = offs[1:]
        self.lo, self.hi = lo, hi
        wlo, whi = np.searchsorted(s, lo), np.searchsorted(s, hi)
        self.line_words = whi - wlo
        raw = tk.spans_hash(tk.byte_prefix(buf), lo, hi) + self.doc.astype(np.uint64)
        full = np.flatnonzero(self.line_words > 0)
        by = full[np.lexsort((full, raw[full], self.doc[full]))]
        dup = np.zeros(len(lo), bool)
        if len(by):
            dup[by[1:]] = (raw[by[1:]] == raw[by[:-1]]) & (self.doc[by[1:]] == self.doc[by[:-1]]) & (hi[by[1:]] - lo[by[1:]] == hi[by[:-1]] - lo[by[:-1]])
        self.n_dup_lines = np.bincount(self.doc[dup], minlength=n_docs)

        between = lambda c: (c[hi] - c[lo]).astype(float)
        n = np.maximum(self.line_words, 1)
        c = np.maximum(between(chars), 1)
        upper, lower = between(sums(_UPPER[buf])), between(sums(_LOWER_CASE[buf]))
        caps = upper / np.maximum(upper + lower, 1)
        sym, bang, pipe = between(symbols) / n, between(sums(buf == 0x21)) / n, between(sums(buf == 0x7C)) / n
        stuck = np.zeros(len(word), bool)
        stuck[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        stuck_share = _between_words(stuck, wlo, whi) / n
        again_share = _between_words(again, wlo, whi) / n
        last = np.zeros(len(lo), bool)
        if len(s):
            tail = np.maximum(whi - 1, 0)
            last = (self.line_words > 0) & _STOP[buf[e[tail] - 1]]
        self.x = np.stack(
            [
                np.ones(len(lo)), np.minimum(np.log1p(self.line_words) / 4, 2), self.line_words == 0, self.line_words <= 3, np.minimum(sym, 3) / 3, sym > 0.2,
                caps, (caps > 0.6) & (upper > 3), between(sums(_DIGIT[buf])) / c, np.minimum(bang, 3) / 3, bang > 0.4, np.minimum(pipe, 1), pipe > 0.2,
                last, np.minimum(c / n / 12, 2), dup, stuck_share, again_share,
            ],
            1,
        ).astype(float)


def _between_words(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags)])
    return (c[hi] - c[lo]).astype(float)


class _Steps:
    """Sequences side by side: which rows stand at each place, longest first."""

    def __init__(self, head: np.ndarray) -> None:
        n = np.diff(head)
        order = np.argsort(-n, kind="stable")
        self.start, n = head[:-1][order], n[order]
        self.alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right") if len(n) else np.zeros(0, int)
        self.n = n

    def rows(self, t: int) -> np.ndarray:
        return self.start[: self.alive[t]] + t

    def __len__(self) -> int:
        return len(self.alive)


@dataclass
class Field:
    """Weights of features by label (0 boilerplate, 1 content) and of moves."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray, head: np.ndarray, bias: float = 0.0) -> np.ndarray:
        """The best labels (Viterbi), ties to content."""
        score = x @ self.emit
        score[:, 1] += bias
        steps = _Steps(head)
        back = np.zeros((len(x), 2), np.int8)
        label = np.zeros(len(x), np.int8)
        v = np.zeros((len(head) - 1, 2))
        for t in range(len(steps)):
            r = steps.rows(t)
            if not t:
                v[: len(r)] = score[r]
                continue
            via = v[: len(r), :, None] + self.move[None]
            back[r] = (via[:, 1] >= via[:, 0]).astype(np.int8)
            v[: len(r)] = via.max(1) + score[r]
        cur = (v[:, 1] >= v[:, 0]).astype(np.int8)
        for t in range(len(steps) - 1, -1, -1):
            r = steps.rows(t)
            label[r] = cur[: len(r)]
            cur[: len(r)] = back[r, cur[: len(r)]]
        return label


def _gradient(f: Field, x: np.ndarray, y: np.ndarray, head: np.ndarray, steps: _Steps) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood, by forward-backward."""
    s = x @ f.emit
    a, b = np.zeros_like(s), np.zeros_like(s)
    for t in range(len(steps)):
        r = steps.rows(t)
        a[r] = s[r] if not t else np.logaddexp(a[r - 1][:, 0, None] + f.move[0], a[r - 1][:, 1, None] + f.move[1]) + s[r]
    for t in range(len(steps) - 2, -1, -1):
        r = steps.rows(t + 1)
        w = s[r] + b[r]
        b[r - 1] = np.logaddexp(f.move[:, 0] + w[:, :1], f.move[:, 1] + w[:, 1:])
    z = np.logaddexp(*(a + b).T)
    p = np.exp(a + b - z[:, None])
    p[np.arange(len(y)), y] -= 1
    inner = np.ones(len(x), bool)
    inner[head[:-1][np.diff(head) > 0]] = False
    k = np.flatnonzero(inner)
    pair = np.exp(a[k - 1][:, :, None] + f.move + (s[k] + b[k])[:, None, :] - z[k][:, None, None]).sum(0)
    np.subtract.at(pair, (y[k - 1], y[k]), 1)
    return x.T @ p / len(y), pair / len(y)


def fit_field(x: np.ndarray, y: np.ndarray, head: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    f = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    steps = _Steps(head)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (f.emit, f.move)]
    for t in range(1, rounds + 1):
        for w, g, (m, v) in zip((f.emit, f.move), _gradient(f, x, y, head, steps), state):
            g = g + ridge * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return f


@dataclass
class Verdict:
    field: Field
    share: float

    def shares(self, p: Profile) -> tuple[np.ndarray, np.ndarray]:
        """Line labels, and each document's share of words in content lines."""
        label = self.field.decode(p.x, p.head)
        words = np.bincount(p.doc, p.line_words * label, minlength=len(p.n_words))
        return label, words / np.maximum(p.n_words, 1)


def fit(sample: list[tuple[str, int]], least: float = 0.5) -> Verdict:
    """A field, and the content share from which documents are kept: the one
    that parts the sample best, but `least` at least. Without both labels in the
    sample every line is content."""
    y_doc = np.array([y for _, y in sample], np.int64)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return Verdict(Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2))), least)
    parts = [Profile(buf, offs) for _, _, buf, offs in tk.chunks(pa.array([t for t, _ in sample], pa.large_string()))]
    x = np.concatenate([p.x for p in parts])
    lines = np.concatenate([np.diff(p.head) for p in parts])
    head = np.concatenate([[0], np.cumsum(lines)])
    y = np.repeat(y_doc, lines)
    poor = y == 0
    for _ in range(3):
        f = fit_field(x, y, head)
        y = np.where(poor, f.decode(x, head), 1)
    share = np.concatenate([Verdict(f, least).shares(p)[1] for p in parts])
    grid = np.linspace(least, 0.95, 10)
    score = [((share >= g)[y_doc == 1].mean() + (share < g)[y_doc == 0].mean()) for g in grid]
    return Verdict(f, float(grid[int(np.argmax(score))]))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_lines array<boolean>, content_share double"


def _judge(verdict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tk.chunks(b.column(1)):
                p = Profile(buf, offs)
                label, share = verdict.value.shares(p)
                ints = [pa.array(v.astype(np.int64)) for v in (p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words)]
                lines = pa.ListArray.from_arrays(pa.array(p.head.astype(np.int32)), pa.array(label == 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *ints, lines, pa.array(share)], [x.split()[0] for x in _OUT.split(", ")])

    return run


def line_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = 1000, max_bytes: int = 6 << 20) -> DataFrame:
    """Per row: doc_id, the five counts, content_lines (one flag a line),
    content_share (of words), base_failed and kept.

    n_words counts runs of non-blank bytes, word_chars their code points,
    n_symbols the characters #*$%&|<>, n_dup_lines lines with a word that equal
    an earlier one, n_repeat_words words in 5-word windows found twice or more.
    base_failed: under 10 words, or over a fifth of them repeated. kept: not
    base_failed, and the content share reaches the fitted threshold. The field
    is fitted on labelled_sample(); without usable labels all lines count as
    content. A null or empty text is one empty line and fails; ids may be null
    or repeat, each row is judged alone. Other columns are not read.
    """
    return _base(docs, id_col, text_col, fit(labelled_sample(docs, labels, label, per_class, max_bytes, id_col, text_col)))


def _base(docs: DataFrame, id_col: str, text_col: str, verdict: Verdict) -> DataFrame:
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(verdict)  # a few numbers
    out = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(_judge(sent), _OUT)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= verdict.share))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """`documents`, by `labels.quality`."""
    q = line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op10_base_counts(spark, sf_dir: str) -> DataFrame:
    """The counts of op10_quality_rules, which need no labels."""
    return _base(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", Verdict(Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2))), 0.5)).drop("content_lines", "content_share", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules, "op10_base_counts": op10_base_counts}
SQL = {
    "op10_base_counts": r"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
g as (select r, p, array_to_string(w[p : p + 4], ' ') k from (select r, w, unnest(range(1, len(w) - 3)) p from w where len(w) >= 5)),
rep as (select r, count(distinct q) n from (select r, unnest(range(p, p + 5)) q from (select r, p, count(*) over (partition by r, k) c from g) where c > 1) group by r),
l as (select r, line, count(*) c from (select r, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
dup as (select r, sum(c - 1) n from l group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols, cast(coalesce(dup.n, 0) as bigint) n_dup_lines, cast(coalesce(rep.n, 0) as bigint) n_repeat_words,
  len(w) < 10 or 100 * coalesce(rep.n, 0) > 20 * len(w) base_failed
from w left join dup using (r) left join rep using (r)"""
}
