"""Ranks, hash-ordered picks and bounded top-k, all safe on hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH_SLICES_HEX = 3  # 16**3 = 4096 slices per group


def avg_rank(df: DataFrame, keys, value: str, out: str, descending=False) -> DataFrame:
    """Rank from 1 inside ``keys``; equal values share the mean of their places.

    One window with two frames, so one shuffle and one sort. Meant for
    meta-level tables (a row per corpus, method or descriptor).
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys).orderBy(order)
    ties = w.rangeBetween(Window.currentRow, Window.currentRow)
    return df.withColumn(
        out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - F.lit(1)) / F.lit(2.0)
    )


def pick_key(seed, *cols) -> Column:
    """Reproducible pseudo-random order: md5 of ``seed:col:col``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def spread_row_number(df: DataFrame, keys, order_hash: str, out: str) -> DataFrame:
    """``row_number()`` inside ``keys`` by an md5 column, without one task per group.

    Rows are cut into 4096 hash slices per group. Slice sizes are counted with
    map-side combine, their running sum (at most 4096 rows per group) gives each
    slice its offset, and only a slice is ever sorted in one task. The number is
    exactly the plain window's, because the hash order is the slice order.
    """
    keys = list(keys)
    cut = df.withColumn("_slice", F.substring(order_hash, 1, HASH_SLICES_HEX))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order_hash)
    return (
        cut.join(offsets, keys + ["_slice"])
        .withColumn(out, F.row_number().over(inside) + F.col("_off"))
        .drop("_slice", "_off")
    )


def top_k(df: DataFrame, keys, order, k: int, salt: Column, out="_rn", salts=64) -> DataFrame:
    """Best ``k`` rows per group in two steps: per salt, then over the survivors.

    A task sorts one salt of a group or the ``salts * k`` rows that survived,
    never a whole group.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
        .drop("_r1", "_salt")
        .withColumn(out, F.row_number().over(w2)).filter(F.col(out) <= k)
    )
