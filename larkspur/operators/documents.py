"""De-identifying running text: dates, chunks, replacement maps, checks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .detectors import Detector, RuleDetector, found_in

OVERLAP = 500
#: Nothing but asterisks, as '^[*]+$' has it: a line may end behind them.
_STARS = re.compile("[*]+(?:\r\n|[\n\r\u0085\u2028\u2029])?")
#: Documents whose units are held beside them at once.
BATCH_DOCS = 512


def split_chunks(text: str, most: int, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Overlapping pieces of at most `most` characters, ended at the last blank
    line of their last 500 characters, else the last sentence of their last 200."""
    out, start = [], 0
    if len(text) <= most:
        return [(0, text)] if text else []
    while start < len(text):
        stop = min(start + most, len(text))
        if stop < len(text):
            if (p := text.rfind("\n\n", max(start + most - 500, 0), stop)) > start:
                stop = p
            elif (p := text.rfind(". ", max(start + most - 200, 0), stop)) > start:
                stop = p + 1
        out.append((start, text[start:stop]))
        if stop >= len(text):
            break
        start = max(stop - overlap, start + 1)
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 8000) -> DataFrame:
    """(doc_id, chunk_no, start, chunk) of every text; empty ones give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, s, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (s, c) in enumerate(split_chunks(t or "", most))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "chunk_no", "start", "chunk"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, chunk_no int, start int, chunk string")


def paired_chunks(before: DataFrame, after: DataFrame, most: int = 4000) -> DataFrame:
    """Chunks of originals beside those of results, by their number."""
    b = chunks(before, most=most).select("doc_id", "chunk_no", F.col("chunk").alias("original"))
    a = chunks(after, most=most).select("doc_id", "chunk_no", F.col("chunk").alias("anonymised"))
    return b.join(a, ["doc_id", "chunk_no"])


def redacted(text: str, literals: Iterable[str]) -> str:
    """redact_literals() on one text."""
    for x in sorted({x for x in literals if x.strip(" ")}, key=lambda x: (-len(x), x)):
        text = text.replace(x, "*" * len(x))
    return text


def _checked(ids: list, texts: list, passes: int, steps: Callable[[int], tuple[Detector, int]], **calls) -> tuple[list, list[bool], list[bool]]:
    """Texts with what detectors find starred, whether a call failed for them, and
    whether the last check of them still found something. The first pass and the
    first check read all of them, later ones those in which something was found."""
    # Rows without an id, or with that of an earlier one, are texts of their own.
    first = {i: k for k, i in reversed(list(enumerate(ids)))}
    keys = [i if i is not None and first[i] == k else f"{i or ''}#{k}" for k, i in enumerate(ids)]
    texts, failed, left = list(texts), [False] * len(texts), [False] * len(texts)
    todo = range(len(texts))
    for n in range(passes + 1):
        detector, size = steps(n)
        units = [(f"{keys[k]}/{m}", "text", c) for k in todo for m, (_, c) in enumerate(split_chunks(texts[k] or "", size))]
        found, bad = defaultdict(set), set()
        for f in found_in(pd.DataFrame(units, columns=["unit", "col", "text"]), detector, **calls):
            for u, t, e in zip(f["unit"], f["text"], f["error"]):
                key = u.rpartition("/")[0]
                if e is not None:
                    bad.add(key)
                elif not _STARS.fullmatch(t):
                    found[key].add(t)
        for k in todo:
            left[k] = keys[k] in found
            failed[k] = failed[k] or keys[k] in bad
            if left[k] and texts[k] is not None:
                texts[k] = redacted(texts[k], found[keys[k]])
        todo = todo if n == 0 else [k for k in todo if left[k]]
        if not todo:
            break
    return texts, failed, left


def deidentify(docs: DataFrame, days: Column | int, detector: Detector | None = None, checker: Detector | None = None, passes: int = 3, most: int = 8000, check_most: int = 4000, pattern: str = dates.PATTERN, **calls) -> DataFrame:
    """`docs` (doc_id, text, ...) with dates moved, what detectors find starred in
    the whole document, the longest first, and a `_status` as for tables. All
    passes over a document are made where it lies, so that no text is moved for
    them; nothing is asked before the result is used, and again if it is used twice."""
    detector = detector or RuleDetector()
    steps = lambda n: (detector, most) if n == 0 else (checker or detector, check_most)

    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for lo in range(0, len(texts), BATCH_DOCS):
            part = [[None if pd.isna(x) else x for x in s.iloc[lo : lo + BATCH_DOCS]] for s in (ids, texts)]
            out += zip(*_checked(*part, passes, steps, **calls))
        return pd.DataFrame(out, columns=["text", "failed", "left"])

    checked = F.pandas_udf(run, "text string, failed boolean, left boolean").asNondeterministic()
    out = docs.withColumn("_out", checked(F.col("doc_id").cast("long").cast("string"), dates.shift_text(F.col("text"), days, pattern)))
    status = F.when(F.col("_out.failed"), "failed").when(F.col("_out.left"), "unverified").otherwise("clean")
    return out.withColumns({"text": F.col("_out.text"), "_status": status}).drop("_out")


def merged_map(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pairs): each key's (original, replacement), the last for an original
    by `ord`, the longest original first."""
    last = pairs.groupBy(key, "original").agg(F.max_by("replacement", "ord").alias("replacement"))
    each = F.struct((-F.length("original")).alias("n"), "original", "replacement")
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["original"].alias("original"), x["replacement"].alias("replacement"))).alias("pairs"))
