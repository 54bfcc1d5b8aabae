"""Histogram sort: shards of nearly equal bytes, found by counting exactly what lies below candidate boundaries.

Rows are ordered by (hash of the text, hash of doc_id, row number), so equal texts lie together and are cut apart only where a
whole group would break the tolerance. Each round counts bytes below ``probes`` boundaries in the open interval of each
splitter, by one partial aggregation that returns at most shards * probes rows; an interval shrinks ``probes``-fold each round.

Defined results: a null text has no bytes (size 1, crc of the empty text); rows are never lost, whatever repeats; a null
doc_id is a row like others; an empty table gives no rows; columns other than doc_id and text are ignored by ``assign``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alluvia.storage import Scratch

LEVELS, TOP = ("h", "t", "m"), 1 << 62


@dataclass
class Splitter:
    """Rows before (prefix, lo) are below. base: bytes below lo."""

    target: float
    base: int = 0
    prefix: tuple[int, ...] = ()
    lo: int = 0
    hi: int = TOP
    done: bool = False
    rounds: list[int] = field(default_factory=list)

    def step(self, probes: int) -> int:
        return max(1, -(-(self.hi - self.lo) // probes))

    def inside(self) -> Column:
        c = F.lit(True)
        for name, v in zip(LEVELS, self.prefix):
            c = c & (F.col(name) == v)
        key = F.col(LEVELS[len(self.prefix)])
        return c & (key >= self.lo) & (key < self.hi)

    def reached(self) -> Column:
        """Whether a row is at or above this splitter."""
        key = F.col(LEVELS[len(self.prefix)]) >= self.lo
        for name, v in reversed(list(zip(LEVELS, self.prefix))):
            key = (F.col(name) > v) | ((F.col(name) == v) & key)
        return key

    def narrow(self, bins: dict[int, tuple[int, int]], probes: int, tolerance: float) -> None:
        step, below = self.step(probes), self.base
        for j in sorted(bins):
            bytes_, rows = bins[j]
            if below + bytes_ < self.target - tolerance:
                below += bytes_
                continue
            low, high = abs(below - self.target), abs(below + bytes_ - self.target)
            start = self.lo + j * step
            if min(low, high) <= tolerance or rows == 1 or (step == 1 and len(self.prefix) == 2):
                self.done = True
                self.base, self.lo = (below, start) if low <= high else (below + bytes_, start + step)
            elif step == 1:
                self.base, self.prefix, self.lo, self.hi = below, (*self.prefix, start), 0, TOP
            else:
                self.base, self.lo, self.hi = below, start, min(self.hi, start + step)
            return
        self.done, self.base, self.lo = True, below, self.hi


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("t"), F.monotonically_increasing_id().alias("m"),
    )


def splitters(keys: DataFrame, shards: int, tolerance: float, probes: int) -> list[Splitter]:
    total = keys.agg(F.sum("size")).first()[0] or 0
    found = [Splitter(total * i / shards) for i in range(1, shards)]
    while (open_ := [(i, s) for i, s in enumerate(found) if not s.done]) and total:
        at = []
        for i, s in open_:
            bin_ = F.expr(f"cast(({LEVELS[len(s.prefix)]} - {s.lo}) div {s.step(probes)} as int)")
            at.append(F.when(s.inside(), F.struct(F.lit(i).alias("i"), bin_.alias("j"))))
        bins: dict[int, dict[int, tuple[int, int]]] = {i: {} for i, _ in open_}
        for r in keys.select("size", F.explode(F.array_compact(F.array(*at))).alias("b")).groupBy("b.i", "b.j").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect():
            bins[r["i"]][r["j"]] = (r["n"], r["rows"])
        for i, s in open_:
            s.narrow(bins[i], probes, tolerance * total / shards)
    return found


def assign(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, probes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the row's place in its shard, in key order) of every row.

    The exchange carries these few columns once, to ranges of the key; a slot is the row's place in its range plus the
    rows of the shard in earlier ranges, a table of at most one row for each range and shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    keys = scratch.save(keyed(docs), "keys")
    cuts = splitters(keys, shards, tolerance, probes)
    shard = sum((s.reached().cast("int") for s in cuts), F.lit(0))
    ranged = keys.withColumn("shard", shard.cast("int")).repartitionByRange("h", "t", "m").sortWithinPartitions("h", "t", "m")
    ranged = scratch.save(ranged.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranged")
    scratch.drop("keys")
    parts = sorted(tuple(r) for r in ranged.groupBy("shard", "part").agg(F.min("at"), F.count("*")).collect())
    offsets, seen = [], {}
    for k, part, least, n in parts:
        offsets.append((k, part, seen.get(k, 0) - least))
        seen[k] = seen.get(k, 0) + n
    table = F.broadcast(spark.createDataFrame(offsets, "shard int, part int, shift long"))
    return ranged.join(table, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001, probes: int = 64) -> None:
    """Write every column of the documents below ``path/shard=k``, exchanged once, straight to the ranges between splitters."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    cuts = splitters(scratch.save(keyed(docs), "keys"), shards, tolerance, probes)
    scratch.drop("keys")
    shard = sum((s.reached().cast("int") for s in cuts), F.lit(0)).cast("int")
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumns({"h": F.shiftrightunsigned(F.xxhash64(text), 2), "t": F.shiftrightunsigned(F.xxhash64("doc_id"), 2), "m": F.monotonically_increasing_id()}).withColumn("shard", shard)
    named.repartitionByRange("h", "t", "m").drop("h", "t", "m").write.mode("overwrite").partitionBy("shard").parquet(path)
