"""A Bloom filter as a DataFrame of at most SLOTS rows (64 bits each), so that what is broadcast has a bound whatever the number of keys.

It lets a large table keep back rows that surely have no partner before an exchange. With more keys than some ten millions nearly every
row passes, which costs an exchange that would have been needed without it, and changes no result: who uses it joins exactly after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 18


def place(*columns: Column | str) -> tuple[Column, Column]:
    """Slot and bit of a key; null is a key like others."""
    h = F.xxhash64(*columns)
    return F.pmod(h, F.lit(SLOTS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))


def of(keys: DataFrame, *columns: str) -> DataFrame:
    slot, bit = place(*columns)
    return keys.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))


def flagged(df: DataFrame, filter_: DataFrame, *columns: str, name: str = "__maybe") -> DataFrame:
    """``df`` with a column that is false where the key surely is not among the filter's."""
    slot, bit = place(*[df[c] for c in columns])
    out = df.withColumn("__slot", slot).join(F.broadcast(filter_), "__slot", "left")
    return out.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__slot", "__bits")


def sifted(df: DataFrame, filter_: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``df`` that may have a partner."""
    return flagged(df, filter_, *columns).filter("__maybe").drop("__maybe")
