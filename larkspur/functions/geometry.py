"""Boxes on images as structs of x, y, width and height, in pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def is_solid(b: Column) -> Column:
    return (b["width"] > 0) & (b["height"] > 0)


def from_points(points: Column) -> Column:
    """The upright box around points (x, y), cut to whole pixels."""
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k].cast("int")))
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k].cast("int")))
    return box(low("x"), low("y"), high("x") - low("x"), high("y") - low("y"))


def pad_clip(b: Column, pad: int, width: Column, height: Column) -> Column:
    """`pad` pixels wider on all sides, inside the image."""
    x0, y0 = F.greatest(F.lit(0), b["x"] - pad), F.greatest(F.lit(0), b["y"] - pad)
    x1, y1 = F.least(width, b["x"] + b["width"] + pad), F.least(height, b["y"] + b["height"] + pad)
    return box(x0, y0, F.greatest(F.lit(0), x1 - x0), F.greatest(F.lit(0), y1 - y0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where they don't meet."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0))
    union = a["width"].cast("double") * a["height"] + b["width"].cast("double") * b["height"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def fit_scale(width: Column, height: Column, most: int = 1024) -> Column:
    """The factor that brings the longer side down to `most`; never above 1."""
    return F.least(F.lit(1.0), F.lit(float(most)) / width, F.lit(float(most)) / height)


def rescale(b: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """A box of a resized image on the original, inside it."""
    x0, y0 = F.greatest(F.lit(0), (b["x"] * sx).cast("int")), F.greatest(F.lit(0), (b["y"] * sy).cast("int"))
    x1, y1 = F.least(width, ((b["x"] + b["width"]) * sx).cast("int")), F.least(height, ((b["y"] + b["height"]) * sy).cast("int"))
    return box(x0, y0, x1 - x0, y1 - y0)


#: Heights and widths.
WINDOWS = ((96, 384), (128, 384), (64, 256))


def window_grid(images: DataFrame, windows=WINDOWS) -> DataFrame:
    """Half-overlapping windows over every image (width, height): one row each,
    cut at the image's edges and large enough to be read (32 by 16)."""
    shapes = F.array(*[F.struct(F.lit(i).alias("size_no"), F.lit(w).alias("ww"), F.lit(h).alias("wh")) for i, (h, w) in enumerate(windows)])
    rows = images.withColumn("win", F.explode(shapes)).select(*images.columns, "win.*")
    rows = rows.withColumn("wx", F.explode(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0)), F.expr("ww div 2"))))
    rows = rows.withColumn("wy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)), F.expr("wh div 2"))))
    rows = rows.withColumn("cw", F.least("ww", F.col("width") - F.col("wx"))).withColumn("ch", F.least("wh", F.col("height") - F.col("wy")))
    return rows.where("cw >= 32 and ch >= 16").drop("ww", "wh")
