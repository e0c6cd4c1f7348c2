"""De-identifying tables: dates, whole columns, single cells, and checks.

A table is a DataFrame of strings with a `_row_index`. Columns are masked by
rewriting the plan; only what detectors must read passes through Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import is_open, mask, redact_literals
from ..sources.shared import durable
from .detectors import Detector, RuleDetector, detect

INDEX = "_row_index"
BATCH = 15


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != INDEX]


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """A gapless index by an explicit order. Positions come from counts a range
    rather than one sorted task: rows are numbered within ranges of the order."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    before = ranged.groupBy("_part").count()
    ahead = F.sum("count").over(Window.orderBy("_part")) - F.col("count")  # one row a partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = ranged.withColumn("_nth", nth).join(F.broadcast(before.select("_part", ahead.alias("_before"))), "_part")
    return rows.withColumn(INDEX, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def batch_no(size: int = BATCH) -> Column:
    return F.floor(F.col(INDEX) / size)


def shift_dates(df: DataFrame, days: Column | int, columns: list[str] | None = None) -> DataFrame:
    cols = columns or data_columns(df)
    return df.withColumns({c: dates.shift_text(F.col(c), days) for c in cols})


def date_log(df: DataFrame, days: Column | int) -> DataFrame:
    """(row_index, column, original, shifted), one row a distinct date of a cell."""
    days = F.lit(days) if isinstance(days, int) else days
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in data_columns(df)])
    cells = df.select(F.col(INDEX).alias("row_index"), days.alias("_d"), F.explode(each).alias("x")).select("row_index", "_d", "x.*")
    found = cells.select("row_index", "column", "_d", F.explode(dates.found(F.col("cell"))).alias("original"))
    return found.select("row_index", "column", "original", dates.shift_token(F.col("original"), F.col("_d")).alias("shifted"))


def rows_touched(log: DataFrame) -> DataFrame:
    """(rows, cells, changes) of a log with row_index and column."""
    return log.agg(F.countDistinct("row_index").alias("n_rows"), F.countDistinct("row_index", "column").alias("n_cells"), F.count("*").alias("n_changes"))


def identifier_columns(df: DataFrame, detector=None, sample: int = 5) -> list[str]:
    """Columns to mask whole, judged by their names and the first few rows: a
    detector's `columns(names, rows)`, by default names that end in an id or
    hold a name or contact."""
    rows = [r.asDict() for r in df.orderBy(INDEX).limit(sample).collect()]
    if detector is not None:
        return [c for c in data_columns(df) if c in set(detector.columns(data_columns(df), rows))]
    import re

    told = re.compile(r"(^|_)(id|mrn|ssn|name|phone|email|address)$|_id$|^(subject|hadm|stay|note|caregiver)_id$", re.I)
    return [c for c in data_columns(df) if told.search(c)]


def mask_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: mask(F.col(c)) for c in columns})


def _units(df: DataFrame, columns: list[str]) -> DataFrame:
    """One unit a cell that still holds something; row batches stay together."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in columns])
    return df.select(F.col(INDEX).cast("string").alias("unit"), F.explode(each).alias("x")).select("unit", "x.col", "x.text").where(is_open(F.col("text")))


def redact_cells(df: DataFrame, found: DataFrame) -> DataFrame:
    """Found texts starred in their own cells; a finding whose row or column is
    not there changes nothing. Cells of units with an error are listed in
    `_failed`."""
    per_row = found.groupBy(F.col("unit").cast("long").alias("_u")).agg(
        F.collect_set(F.when(F.col("text").isNotNull(), F.struct("col", "text"))).alias("_found"), F.collect_set(F.when(F.col("error").isNotNull(), F.col("col"))).alias("_bad")
    )
    own = lambda c: F.transform(F.filter("_found", lambda x: x["col"] == c), lambda x: x["text"])
    out = df.join(per_row, F.col(INDEX) == F.col("_u"), "left")
    changed = {c: F.when(F.size("_found") > 0, redact_literals(F.col(c), own(c))).otherwise(F.col(c)) for c in data_columns(df)}
    before = F.col("_failed") if "_failed" in df.columns else F.array().cast("array<string>")
    changed.pop("_failed", None)
    return out.withColumns(changed).withColumn("_failed", F.array_union(before, F.coalesce("_bad", F.array().cast("array<string>")))).drop("_u", "_found", "_bad")


@dataclass
class Result:
    table: DataFrame
    masked: list[str]
    passes: int
    clean: bool


def deidentify(df: DataFrame, days: Column | int, detector: Detector | None = None, checker: Detector | None = None, column_detector=None, passes: int = 3, **calls) -> Result:
    """Dates, then columns, then cells, then up to `passes` checks that stop when
    one finds nothing. `_status` is clean, unverified (the last check still found
    something) or failed (a detector's call failed for the row)."""
    detector = detector or RuleDetector()
    df = shift_dates(df, days)
    masked = identifier_columns(df, column_detector)
    df = mask_columns(df, masked)
    rest = [c for c in data_columns(df) if c not in masked]
    df = redact_cells(df, detect(_units(df, rest), detector, **calls)) if rest else df.withColumn("_failed", F.array().cast("array<string>"))
    n, left = 0, True
    while rest and left and n < passes:
        n += 1
        df = durable(df)
        found = detect(_units(df, rest), checker or detector, **calls)
        left = not found.where("text is not null").isEmpty()
        df = redact_cells(df, found)
    status = F.when(F.size("_failed") > 0, "failed").when(F.lit(bool(rest) and left), "unverified").otherwise("clean")
    return Result(df.withColumn("_status", status), masked, n, not left)


def rendered(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as text for a model: a heading, then one line a column."""
    cols = columns or data_columns(df)
    return F.concat_ws("\n", F.format_string("=== ROW %d ===", F.col(INDEX).cast("long")), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])


def differences(before: DataFrame, after: DataFrame, most: int = 200) -> DataFrame:
    """(row_index, column, state, original, anonymised) for cells of the same
    row that are not both empty; unchanged ones cut to `most` characters."""
    cols = [c for c in data_columns(before) if c in after.columns]
    b = before.select(F.col(INDEX).alias("row_index"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"b{i}") for i, c in enumerate(cols)])
    a = after.select(F.col(INDEX).alias("row_index"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"a{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("o"), F.col(f"a{i}").alias("n")) for i, c in enumerate(cols)])
    x = b.join(a, "row_index").select("row_index", F.explode(each).alias("x")).select("row_index", "x.*").where("o <> '' or n <> ''")
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
    same = F.col("o") == F.col("n")
    return x.select(
        "row_index", "column", F.when(same, "UNCHANGED").otherwise("CHANGED").alias("state"), F.when(same, cut(F.col("o"))).otherwise(F.col("o")).alias("original"),
        F.when(same, cut(F.col("n"))).otherwise(F.col("n")).alias("anonymised"),
    )
