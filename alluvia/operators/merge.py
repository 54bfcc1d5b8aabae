"""Upserts and slowly changing dimensions: pure functions of DataFrames, and commits that rewrite only touched files.

Null keys match nothing, as in any equi-join. A batch is not freed of duplicates unless asked to be.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.sources.table import VersionedTable, union_by_name

SMALL = 100_000  # keys; fewer are broadcast
LITERAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType)


MOST_VALUES = 10_000  # partition values that narrow a merge; with more, only the keys do


def listed(x: str | Sequence[str] | None) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def sql_literal(value, kind: T.DataType) -> str:
    """A value of a partition column as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(kind, T.BooleanType):
        return "true" if value else "false"
    if isinstance(kind, T.DateType):
        return f"DATE '{value}'" if not isinstance(value, str) else f"CAST('{value}' AS DATE)"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({int(value)} AS {kind.simpleString().upper()})"
    quote = "'"
    return f"{quote}{str(value).replace(quote, 2 * quote)}{quote}"


def partition_values(batch: DataFrame, columns: Sequence[str]) -> dict[str, list] | None:
    """The distinct values of each partition column, or None where one is null or of a type without a sure literal, or they are more than MOST_VALUES."""
    if not columns or not all(isinstance(batch.schema[c].dataType, LITERAL_TYPES) for c in columns):
        return None
    out = {}
    for c in columns:
        out[c] = sorted((r[0] for r in batch.select(c).distinct().limit(MOST_VALUES + 1).collect()), key=lambda v: (v is not None, v))
        if None in out[c] or len(out[c]) > MOST_VALUES:
            return None
    return out


def partition_predicate(batch: DataFrame, columns: Sequence[str]) -> str | None:
    """``c1 IN (...) AND c2 IN (...)`` over the batch's values: a superset of the partitions that it touches."""
    values = partition_values(batch, columns)
    if values is None:
        return None
    return " AND ".join(f"{c} IN ({', '.join(sql_literal(v, batch.schema[c].dataType) for v in vs)})" for c, vs in values.items())


def within(values: dict[str, list] | None) -> Column:
    c = F.lit(True)
    for name, vs in (values or {}).items():
        c = c & F.col(name).isin(vs)
    return c


def upsert(target: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """The target without the keys of the batch, and the batch."""
    return union_by_name(target.join(batch.select(*on), list(on), "left_anti"), batch)


def keep_last(batch: DataFrame, keys: Sequence[str], order_by: str | Column | None = None) -> DataFrame:
    """One row for each key (null is a key like others): the last by ``order_by``, or else any one (that read last, while the batch is not shuffled)."""
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    numbered = batch.withColumn("__row", F.monotonically_increasing_id())
    w = Window.partitionBy(*keys).orderBy(*([order.desc_nulls_last()] if order is not None else []), F.desc("__row"))
    return numbered.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__row")


def opened(batch: DataFrame, now: datetime) -> DataFrame:
    """The batch as current versions from ``now`` on."""
    return batch.withColumns({"valid_from": F.lit(now).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})


def close(target: DataFrame, batch: DataFrame, keys: Sequence[str], now: datetime, scope: Column | None = None) -> DataFrame:
    """The target with open rows of the batch's keys closed at ``now``."""
    flags = batch.select(*keys).distinct().withColumn("__match", F.lit(True))
    hit = F.coalesce(F.col("__match"), F.lit(False)) & F.col("is_current") & (scope if scope is not None else F.lit(True))
    closed = target.join(flags, list(keys), "left").withColumns({"valid_to": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("valid_to")), "is_current": F.when(hit, False).otherwise(F.col("is_current"))})
    return closed.select(*target.columns)


def scd2(target: DataFrame, batch: DataFrame, keys: Sequence[str], now: datetime, partition_by: Sequence[str] = ()) -> DataFrame:
    """Close what the batch replaces, add the batch as current versions unless (keys, valid_from) is there already."""
    new = opened(batch, now)
    fresh = new.join(target.select(*keys, "valid_from"), [*keys, "valid_from"], "left_anti")
    values = partition_values(batch, listed(partition_by))
    return union_by_name(close(target, batch, keys, now, within(values)), fresh.select(*new.columns))


def scd4(target: DataFrame, batch: DataFrame, keys: Sequence[str], now: datetime, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new main table, rows to add to the history)."""
    last = keep_last(batch, keys, order_by)
    archived = target.join(last.select(*keys), list(keys), "left_semi").withColumn("superseded_at", F.lit(now).cast("timestamp"))
    return upsert(target, last, keys), archived


def latest_change(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of several versions of a key in one change feed, the newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_commit_version"))
    return changes.withColumn("__n", F.rank().over(w)).filter("__n = 1").drop("__n")


def _keys(batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys, broadcast when counted to be few."""
    keys = batch.select(*on).distinct()
    return F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys


def write_append(table: VersionedTable, batch: DataFrame, partition_by: Sequence[str] = ()) -> int:
    return table.append(batch) if table.exists() else table.create(batch, listed(partition_by))


def write_upsert(table: VersionedTable, batch: DataFrame, on: str | Sequence[str], partition_by: str | Sequence[str] | None = None, dedup: str | None = None, order_by: str | None = None) -> int:
    """SCD-1. With partitions, only those that the batch touches are looked at, so a key that moves leaves its old row behind."""
    on, parts = listed(on), listed(partition_by)
    batch = (keep_last(batch, on, order_by) if dedup == "last" else batch).persist()
    try:
        if not table.exists():
            return table.create(batch, parts)
        values = partition_values(batch, parts)
        join_on = on
        keys = _keys(batch, join_on)
        touched = table.holding(keys, join_on, partitions=values)
        kept = table.read_files(touched)
        kept = kept.join(keys, join_on, "left_anti") if values is None else kept.filter(~within(values)).unionByName(kept.filter(within(values)).join(keys, join_on, "left_anti"))
        return table.rewrite("upsert", touched, kept if touched else None, batch)
    finally:
        batch.unpersist()


def write_scd2(table: VersionedTable, batch: DataFrame, on: str | Sequence[str], partition_by: str | Sequence[str] | None = None, now: datetime | None = None) -> int:
    """One commit: the touched files with their open rows closed, and the new versions."""
    keys_, parts, now = listed(on), listed(partition_by), now or datetime.now(timezone.utc)
    batch = batch.persist()
    try:
        new = opened(batch, now)
        if not table.exists():
            return table.create(new, parts)
        values = partition_values(batch, parts)
        keys = _keys(batch, keys_)
        touched = table.holding(keys, keys_, where=F.col("is_current"), partitions=values)
        fresh = new.join(table.scan().select(*keys_, "valid_from").filter(F.col("valid_from") == F.lit(now).cast("timestamp")), [*keys_, "valid_from"], "left_anti").select(*new.columns)
        closed = close(table.read_files(touched), batch, keys_, now, within(values)) if touched else None
        return table.rewrite("scd2", touched, closed, fresh, "insert")
    finally:
        batch.unpersist()


def write_scd4(table: VersionedTable, history: VersionedTable, batch: DataFrame, on: str | Sequence[str], partition_by: str | Sequence[str] | None = None, now: datetime | None = None, order_by: str | None = None) -> int:
    """History first, then the main table, so that a crash between them repeats an archived row rather than losing one."""
    keys_, parts, now = listed(on), listed(partition_by), now or datetime.now(timezone.utc)
    batch = keep_last(batch, keys_, order_by).persist()
    try:
        if not table.exists():
            return table.create(batch, parts)
        archived = table.scan().join(_keys(batch, keys_), keys_, "left_semi").withColumn("superseded_at", F.lit(now).cast("timestamp")).persist()
        if archived.limit(1).count():
            write_append(history, archived)
        archived.unpersist()
        return write_upsert(table, batch, keys_, parts)
    finally:
        batch.unpersist()
