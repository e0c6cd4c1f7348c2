"""Small helpers that keep joins from moving or gathering what they need not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def bitmap(values: DataFrame, bits: int = 1 << 25) -> np.ndarray:
    """Packed bits of the one long column of `values`, each at its value mod
    `bits`: bits / 8 bytes, whatever the table's size."""
    name = values.columns[0]
    at = values.where(F.col(name).isNotNull()).select((F.pmod(F.col(name), F.lit(bits)) + 1).alias("p"))  # Spark counts bits from 1
    maps = at.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    held = np.zeros((bits // 32768, 4096), np.uint8)
    for k, m in maps:
        held[k - 1] = np.frombuffer(m, np.uint8)
    return held.ravel()


def held_in(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit `values` may be in bitmap(); no member is missed."""
    at = values.view(np.int64) & (len(packed) * 8 - 1)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Sieve:
    """The one column of `ids` as a bitmap of a fixed size, which is broadcast to
    part tables into rows that may be of them and rows that are surely not. A
    full bitmap lets more through to the join behind it, which decides. Nothing
    leaves the JVM."""

    def __init__(self, ids: DataFrame, bits: int = 1 << 25) -> None:
        name, self.bits = ids.columns[0], bits
        at = ids.where(F.col(name).isNotNull()).select((F.pmod(F.xxhash64(name), F.lit(bits)) + 1).alias("p"))  # Spark counts bits from 1
        maps = at.groupBy(F.bitmap_bucket_number("p").alias("_sieve_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_sieve_m"))
        self._maps = durable(maps)  # bits / 32768 rows of 4096 bytes at most

    def mark(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """`df` with a boolean `name`; false for null."""
        at = f"pmod(xxhash64(`{col}`), {self.bits}L)"
        maps = F.broadcast(self._maps)
        out = df.join(maps, F.expr(f"{at} div 32768 + 1") == F.col("_sieve_k"), "left")
        byte = f"cast(conv(hex(substring(_sieve_m, cast(({at} % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
        held = F.expr(f"coalesce(`{col}` is not null and shiftright({byte}, cast({at} % 8 as int)) & 1 = 1, false)")
        return out.withColumn(name, held).drop("_sieve_k", "_sieve_m")

    def split(self, df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
        """(rows that may be held, the others)."""
        marked = self.mark(df, col, "_sieve_held")
        return marked.where("_sieve_held").drop("_sieve_held"), marked.where("not _sieve_held").drop("_sieve_held")


def unplaced(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with whole-number `keys` that Spark takes for new ones. An aggregate
    is placed by its keys already; joined as it is, its side gets no exchange,
    and adaptive execution divides a hot key only between two exchanges."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast(dict(df.dtypes)[k])) for k in keys})
