"""Compaction, clustering along a Z-order curve, and removal of files that no kept version needs."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.operators.merge import listed
from alluvia.sources.table import DATA, VersionedTable

FILE_BYTES, BITS, SAFE_HOURS = 256 << 20, 8, 168


def with_zorder(df: DataFrame, columns: Sequence[str], name: str = "__z") -> DataFrame:
    """Adds the interleaved bits of each column's quantile (256 of them, from one approximate pass); null sorts first."""
    values = []
    for c in columns:
        kind, col = df.schema[c].dataType, F.col(c)
        if isinstance(kind, T.NumericType):
            values.append(col.cast("double"))
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            values.append(col.cast("timestamp").cast("double"))
        else:  # the first six bytes, as a number
            values.append(F.conv(F.rpad(F.substring(F.hex(col.cast("string")), 1, 12), 12, "0"), 16, 10).cast("double"))
    probes = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = df.agg(*[F.percentile_approx(v, probes, 10_000).alias(f"q{i}") for i, v in enumerate(values)]).first()
    places = [f"{name}{i}" for i in range(len(columns))]
    out = bucketed(df, {p: (v, sorted(set(q or []))) for p, v, q in zip(places, values, found)})
    key = F.lit(0).cast("long")
    for i, p in enumerate(places):
        for b in range(BITS):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + i))
    return out.withColumn(name, key).drop(*places)


def bucketed(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """Adds, under each name, how many bounds (fewer than 256) lie at or below the value; 0 for null. A place is found bit by bit, each in a projection of its own:
    as one tree of conditions they make a method of more than 8000 bytes, which the JVM never compiles."""
    arrays = {p: F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>") for p, (_, bounds) in wanted.items()}
    out = df.withColumns({f"{p}v": v for p, (v, _) in wanted.items()} | {p: F.lit(0) for p in wanted})
    for bit in (1 << b for b in reversed(range(BITS))):  # there is no bound, but null, past the last; null is not at or below anything
        found = {p: F.col(f"{p}v") >= F.get(arrays[p], F.col(p).bitwiseOR(F.lit(bit - 1))) for p in wanted}
        out = out.withColumns({p: F.col(p).bitwiseOR(F.when(f, bit).otherwise(0)) for p, f in found.items()})
    return out.drop(*[f"{p}v" for p in wanted])


def compact(table: VersionedTable, file_bytes: int = FILE_BYTES) -> int | None:
    """Merge small files, partition by partition, into files of about ``file_bytes``; None if nothing is small."""
    state = table.state()
    groups: dict[tuple, list[tuple[str, int]]] = {}
    for p, x in state.files.items():
        if x["bytes"] < file_bytes // 2:
            groups.setdefault(tuple(sorted((k, v or "") for k, v in x["part"].items())), []).append((f"{table.path}/{p}", x["bytes"]))
    small = [f for g in groups.values() if len(g) > 1 for f in g]
    if not small:
        return None
    n = max(1, math.ceil(sum(b for _, b in small) / file_bytes))
    df = table.read_files([p for p, _ in small])
    if not state.partition_by:
        df = df.coalesce(n)
    elif any(sum(b for _, b in g) > file_bytes for g in groups.values()):  # a value may fill several files: adaptive execution splits what is large
        df = df.hint("rebalance", *state.partition_by)
    else:
        df = df.repartition(len([g for g in groups.values() if len(g) > 1]), *state.partition_by)
    return table.replace_files("compact", df, [p for p, _ in small])


def zorder(table: VersionedTable, columns: str | Sequence[str], file_bytes: int = FILE_BYTES) -> int | None:
    """Rewrite every file in the order of the curve, so that row groups cover small ranges of all the columns."""
    state = table.state()
    if not state.files:
        return None
    df = table.scan()
    n = max(1, math.ceil(sum(x["bytes"] for x in state.files.values()) / file_bytes))
    keyed = with_zorder(df, listed(columns))
    ordered = keyed.repartitionByRange(n, *state.partition_by, "__z").sortWithinPartitions(*state.partition_by, "__z").drop("__z")
    return table.replace_files("zorder", ordered, table.files())


def vacuum(table: VersionedTable, retention_hours: float = SAFE_HOURS) -> int:
    """Delete data files that the newest version does not use and that are older than the retention. Ledgers below the table (names
    that begin with a dot) are not data and stay."""
    keep, cutoff, gone = {p for p in table.state().files}, (time.time() - retention_hours * 3600) * 1000, 0
    root = table.fs.qualify(f"{table.path}/{DATA}")
    for p, _, changed in table.fs.list(f"{table.path}/{DATA}", recursive=True):
        if f"{DATA}{p.removeprefix(root)}" not in keep and changed <= cutoff:
            table.fs.delete(p)
            gone += 1
    return gone


def maintain(target: str | VersionedTable, compact_files: bool = True, z_order_by: str | Sequence[str] | None = None, vacuum_files: bool = True, retention_hours: float = SAFE_HOURS, spark: SparkSession | None = None, **names: bool) -> None:
    """Z-order (in place of compaction) or compaction, then vacuum; ``compact`` and ``vacuum`` are accepted as names too. Raises for a missing table."""
    compact_files, vacuum_files = names.pop("compact", compact_files), names.pop("vacuum", vacuum_files)
    if names:
        raise TypeError(f"unknown arguments: {', '.join(names)}")
    table = target if isinstance(target, VersionedTable) else VersionedTable(spark or SparkSession.getActiveSession(), target)
    table.version()
    if z_order_by:
        zorder(table, z_order_by)
    elif compact_files:
        compact(table)
    if vacuum_files:
        vacuum(table, retention_hours)
