"""Matching texts to places on images, and hiding boxes in pixels.

Models (text recognition, faces, defacing) are adapters: any callable that takes
an array and returns rows. None comes with the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OCR = ["text", "x", "y", "width", "height", "confidence"]


def ratio(a: str, b: str) -> float:
    """Similarity of two texts, not symmetric: the wanted one comes first."""
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()


def match_score(wanted: str, seen: str, least: float = 0.6) -> float:
    """1 for equal texts, 0.9 where one of at least 3 characters and 30 % of the
    other lies in it, else the ratio if it reaches `least`, else 0."""
    a, b = wanted.lower().strip(), seen.lower().strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and len(short) >= 0.3 * len(long) and short in long:
        return 0.9
    r = SequenceMatcher(None, a, b).ratio()
    return r if r >= least else 0.0


def greedy_match(wanted: list[str], seen: list[str], least: float = 0.6) -> list[int | None]:
    """For each wanted text in turn the best seen one not taken yet; ties to the
    earlier one."""
    taken: set[int] = set()
    out: list[int | None] = []
    for w in wanted:
        best, score = None, 0.0
        for k, s in enumerate(seen):
            if k not in taken and (m := match_score(w, s, least)) > score:
                best, score = k, m
                if m == 1.0:
                    break
        if best is not None:
            taken.add(best)
        out.append(best)
    return out


_MATCHED = "file string, page int, pii_idx int, text string, type string, ocr_idx int, x int, y int, width int, height int, score double"


def match_pages(pii: DataFrame, ocr: DataFrame, least: float = 0.6) -> DataFrame:
    """Greedy one-to-one matches on every page: pii (file, page, pii_idx, text,
    type) with the box of its ocr row (file, page, ocr_idx, text, box), nulls
    where none fits. One page is one group, bounded by what a page holds."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        p = page[page["pii_idx"].notna()].sort_values("pii_idx").astype({"pii_idx": int})
        o = page[page["pii_idx"].isna()].sort_values("ocr_idx").astype({"ocr_idx": int})
        got = greedy_match(list(p["text"]), list(o["text"]), least)
        rows = []
        for (_, w), k in zip(p.iterrows(), got):
            s = o.iloc[k] if k is not None else None
            place = [s[c] for c in ("ocr_idx", "x", "y", "width", "height")] if s is not None else [None] * 5
            rows.append((w["file"], w["page"], w["pii_idx"], w["text"], w["type"], *place, match_score(w["text"], s["text"], least) if s is not None else None))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _MATCHED.split(", ")])
        return out.astype({c: "Int32" for c in ("ocr_idx", "x", "y", "width", "height")})

    # One table of both: the sides of a cogroup may stem from one and lose columns.
    both = pii.select("file", "page", "pii_idx", "text", "type").unionByName(ocr.select("file", "page", "ocr_idx", "text", "x", "y", "width", "height"), allowMissingColumns=True)
    return both.groupBy("file", "page").applyInPandas(run, _MATCHED)


def _first(both: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("file", "page", "pii_idx").orderBy("ocr_idx"))
    return both.withColumn("nth", nth).where("nth = 1").drop("nth")


def first_holding(pii: DataFrame, ocr: DataFrame) -> DataFrame:
    """The first ocr row of the page that equals, holds or lies in each pii text,
    however short; rows may serve more than once."""
    a, b = F.lower(F.trim("text")), F.lower(F.trim("seen"))
    return _first(pii.join(ocr.withColumnRenamed("text", "seen"), ["file", "page"]).where(F.contains(a, b) | F.contains(b, a)))


def first_match(pii: DataFrame, ocr: DataFrame, least: float = 0.6) -> DataFrame:
    """For what a check still found: the first ocr row of its page that fits by
    match_score(); rows may serve more than once."""

    @F.pandas_udf("boolean")
    def fits(wanted: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series([match_score(a or "", b or "", least) > 0 for a, b in zip(wanted, seen)], dtype=bool)

    return _first(pii.join(ocr.withColumnRenamed("text", "seen"), ["file", "page"]).where(fits("text", "seen")))


def worth_reading(boxes: DataFrame, least_width: int = 32, least_height: int = 16) -> DataFrame:
    """Crops large enough for a handwriting reader; 10 x 10 does for regions that
    a detector found."""
    return boxes.where((F.col("width") >= least_width) & (F.col("height") >= least_height))


def readable_whole(images: DataFrame, most_width: int = 800, most_height: int = 200) -> DataFrame:
    """Images small enough to be read in one pass as well."""
    return images.where((F.col("width") <= most_width) & (F.col("height") <= most_height))


def sure_readings(ocr: DataFrame, least_chars: int = 2, least_score: float = 0.3) -> DataFrame:
    """Readings of some length that the reader is sure of."""
    return ocr.where((F.length(F.trim("text")) >= least_chars) & (F.col("confidence") >= least_score))


def match_remaining(pii: DataFrame, ocr: DataFrame, handwriting: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(matched, missed) of what a check still found. matched: pii with the box
    and text (seen) of its first_match() in `ocr`, or of one sure reading in
    `handwriting` for the rest, one to one, 0.1 laxer but 0.45 at least. missed:
    the rest that no text matched there holds, lies in or resembles by 0.4."""
    key = ["file", "page", "pii_idx"]
    box = ["ocr_idx", "x", "y", "width", "height"]
    one = first_match(pii, ocr, least).select(*key, "text", "type", *box, "seen")
    rest = pii.join(one, key, "left_anti")
    hand = sure_readings(handwriting)
    two = match_pages(rest.where("text is not null"), hand, max(0.45, least - 0.1)).where("ocr_idx is not null").select(*key, "text", "type", *box)
    two = two.join(hand.select("file", "page", "ocr_idx", F.col("text").alias("seen")), ["file", "page", "ocr_idx"]).select(one.columns)

    @F.pandas_udf("boolean")
    def alike(wanted: pd.Series, seen: pd.Series) -> pd.Series:
        pairs = [((a or "").lower().strip(), (b or "").lower().strip()) for a, b in zip(wanted, seen)]
        return pd.Series([a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.4 for a, b in pairs], dtype=bool)

    found = rest.join(two.select("file", "page", "seen"), ["file", "page"]).where(alike("text", "seen")).select(key)
    return one.unionByName(two), rest.join(found, key, "left_anti")


def box_iou(a: tuple, b: tuple) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def suppress(rows: pd.DataFrame, overlap: float = 0.3, alike: float = 0.8) -> pd.DataFrame:
    """By falling confidence, rows that don't repeat one kept before: boxes that
    meet, and meet in more than `overlap` or read nearly the same."""
    kept: list = []
    for r in rows.sort_values("confidence", ascending=False, kind="stable").itertuples(index=False):
        box = (r.x, r.y, r.width, r.height)
        if not any((i := box_iou(box, (k.x, k.y, k.width, k.height))) > overlap or i > 0 and ratio(r.text, k.text) > alike for k in kept):
            kept.append(r)
    return pd.DataFrame(kept, columns=rows.columns)


def dedup_readings(ocr: DataFrame, overlap: float = 0.3, alike: float = 0.8) -> DataFrame:
    """suppress() on every page (file, page)."""
    return ocr.groupBy("file", "page").applyInPandas(lambda f: suppress(f, overlap, alike), ocr.schema)


# Pixels


def fill_value(photometric: str, pixels: np.ndarray) -> int:
    """What black is: 0 in colour, the largest value where white is low."""
    if photometric not in ("MONOCHROME1", "MONOCHROME2"):
        return 0
    return int(pixels.max() if photometric == "MONOCHROME1" else pixels.min())


def hide_boxes(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: int = 5, value: int = 0) -> np.ndarray:
    """A copy with boxes, padded and cut at the edges, filled; rows and columns
    are the last two axes, or the two before a colour axis of 3 or 4."""
    out = pixels.copy()
    colour = out.ndim >= 3 and out.shape[-1] in (3, 4)
    h, w = out.shape[-3:-1] if colour else out.shape[-2:]
    for x, y, bw, bh in boxes:
        if bw > 0 and bh > 0:
            ys, xs = slice(max(0, y - pad), min(h, y + bh + pad)), slice(max(0, x - pad), min(w, x + bw + pad))
            out[(..., ys, xs, slice(None)) if colour else (..., ys, xs)] = value
    return out


def display(pixels: np.ndarray, photometric: str = "MONOCHROME2") -> np.ndarray:
    """8-bit pixels for viewing: spread over the whole range, inverted where
    white is low; colour in YBR turned to RGB."""
    p = pixels.astype(np.float64)
    if photometric.startswith("YBR"):
        y, b, r = p[..., 0], p[..., 1] - 128, p[..., 2] - 128
        return np.clip(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], -1) + 0.5, 0, 255).astype(np.uint8)
    if photometric == "RGB" and pixels.dtype == np.uint8:
        return pixels.copy()
    low, high = p.min(), p.max()
    out = (p - low) / (high - low) * 255 if high > low else np.zeros_like(p)
    out = out.astype(np.uint8)
    return 255 - out if photometric == "MONOCHROME1" else out


def apply_mask(pixels: np.ndarray, mask: np.ndarray, value: int = 0) -> np.ndarray:
    """A copy with what a mask of another size covers set to `value`."""
    h, w = pixels.shape[:2]
    rows, cols = np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w
    out = pixels.copy()
    out[mask[rows][:, cols] > 0] = value
    return out


def defacing_mask(channels: np.ndarray, most: float = 0.1) -> np.ndarray:
    """What a defacing model leaves dark: 1 where the mean of its channels is
    under `most`."""
    c = np.asarray(channels, float)
    return ((c.mean(-1) if c.ndim == 3 else c) < most).astype(np.uint8)


def hide_in_files(images: DataFrame, boxes: DataFrame, pad: int = 5) -> DataFrame:
    """images (file, shape, dtype, photometric, pixels) with the boxes of their
    file (file, x, y, width, height) hidden in all their frames."""
    per = boxes.groupBy("file").agg(F.collect_set(F.struct("x", "y", "width", "height")).alias("_boxes"))
    rows = images.join(per, "file", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                p = np.frombuffer(r.pixels, r.dtype).reshape(list(r.shape))
                own = r[f.columns.get_loc("_boxes")]
                todo = [(b["x"], b["y"], b["width"], b["height"]) for b in own] if own is not None else []
                out.append(hide_boxes(p, todo, pad, fill_value(r.photometric, p)).tobytes())
            yield f.drop(columns="_boxes").assign(pixels=out)

    return rows.mapInPandas(run, images.schema)


def faces(detections: DataFrame, least_side: int = 30, least_score: float = 0.5) -> DataFrame:
    """Detections worth hiding: both sides of `least_side` pixels, and sure."""
    return detections.where((F.col("width") >= least_side) & (F.col("height") >= least_side) & (F.col("confidence") >= least_score))


def on_all_frames(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of each file's first frame on every one of its frames."""
    return frames.select("file", "frame_idx").join(boxes.where("frame_idx = 0").drop("frame_idx"), "file")
