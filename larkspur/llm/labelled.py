"""Bounded samples of labelled documents for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_fit_fold(id_col):
    """Rows that models may learn from: crc32 of the id as text, mod 3, is not 1.
    A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most `per_class` (text, label) of either label, `max_bytes` in all.

    Ids are taken in the order of a hash, from the fitting fold only; whole
    texts, and no further ones of a label once one would take it over half of
    `max_bytes`; only a text that is longer than that by itself, before any other
    is taken, is passed over. Ids with a null or
    with contradicting labels, and null texts, are left out; a repeated id
    counts once. What reaches the driver is bounded by the two parameters.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label).cast("int").alias("y"))
    lab = lab.where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & in_fit_fold("i"))
    lab = lab.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").withColumn("o", F.xxhash64("i", F.lit(11)))
    picked = None
    for y in (0, 1):
        one = lab.where(F.col("y") == y).orderBy("o", "i").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    picked = picked.select("i", "y", "o")  # at most 2 * per_class rows
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    sizes = base.select("i", F.octet_length("t").alias("n")).join(F.broadcast(picked), "i").groupBy("i").agg(F.max("n").alias("n"), F.max("y").alias("y"), F.max("o").alias("o"))
    ids, spent, over = [], {0: 0, 1: 0}, set()
    for r in sorted(sizes.collect(), key=lambda r: (r.o, r.i)):
        if spent[r.y] + r.n > max_bytes // 2 and spent[r.y]:
            over.add(r.y)
        if r.y not in over and r.n <= max_bytes // 2:
            spent[r.y] += r.n
            ids.append(r.i)
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "i long")
    rows = base.join(F.broadcast(chosen), "i").groupBy("i").agg(F.max("t").alias("t")).join(F.broadcast(picked), "i")
    return [(r.t, r.y) for r in sorted(rows.collect(), key=lambda r: (r.o, r.i))]
