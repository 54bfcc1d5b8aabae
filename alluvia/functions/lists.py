"""Operators on array columns, built of Spark's higher-order functions: they stay in the JVM and need no exchange.

``list_ext(col)`` groups the combinators; the functions below it work on one or more columns. Arguments that can never be right raise at
once; values that a row gets wrong fail the query. Division follows IEEE 754, where Spark's own would raise or give null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.storage import Scratch

WIDE = 64  # positions above which an element-wise aggregate is better taken over exploded rows
ARITHMETIC, COMPARISONS, AGGREGATES = tuple("add sub mul div".split()), tuple("eq ne gt ge lt le".split()), tuple("mean median sum count max min".split())


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(value: str, allowed: Sequence[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def positive(n: int, what: str) -> int:
    if n < 1:
        raise ValueError(f"{what} must be at least 1, not {n}")
    return n


def ieee_div(a: Column, b: Column) -> Column:
    """a / b of doubles: x/0 is an infinity by the signs of both (zeros have signs too), 0/0 is NaN."""
    minus_zero = (b == 0) & (b.cast("string") == "-0.0")
    over_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when((a > 0) != minus_zero, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, over_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def arithmetic(a: Column, b: Column, op: str) -> Column:
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: ieee_div(a, b)}[one_of(op, ARITHMETIC, "the operation")]()


def doubles(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def cut(a: Column, n: Column) -> Column:
    """The first n elements, n not negative."""
    return F.slice(a, 1, n)


class ListExt:
    """Combinators of one array column."""

    def __init__(self, column: str | Column):
        self.c = col(column)

    def zip(self, other: str | Column) -> Column:
        """Pairs (first, second), as many as the shorter has; null if either is."""
        o = col(other)
        n = F.least(F.size(self.c), F.size(o))
        pairs = F.zip_with(cut(self.c, n), cut(o, n), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
        return F.when(self.c.isNotNull() & o.isNotNull(), pairs)

    def unzip(self, fields: Sequence[str] = ("first", "second")) -> Column:
        """A struct with a list of each field; a null list gives a struct of nulls."""
        of = lambda f: F.transform(self.c, lambda e: e[f]).alias(f)
        return F.struct(*[of(f) for f in fields])

    def enumerate(self) -> Column:
        return F.transform(self.c, lambda v, i: F.struct(i.alias("index"), v.alias("value")))

    def dedup(self) -> Column:
        """Without elements that equal the one before; as text, null being equal to null."""
        same = lambda v, i: v.cast("string").eqNullSafe(F.get(self.c, i - 1).cast("string"))
        return F.filter(self.c, lambda v, i: (i == 0) | ~same(v, i))

    def rotate(self, n: int) -> Column:
        """To the right by n, to the left if negative."""
        size = F.size(self.c)
        k = F.pmod(F.lit(n), size)
        turned = F.concat(F.slice(self.c, size - k + 1, k), F.slice(self.c, F.lit(1), size - k))
        return F.when(size > 0, turned).otherwise(self.c)

    def windows(self, size: int, step: int | None = None) -> Column:
        """Full windows only."""
        step = 1 if step is None else step
        positive(size, "size"), positive(step, "step")
        starts = F.sequence(F.lit(0), F.size(self.c) - size, F.lit(step))
        return self._parts(F.size(self.c) >= size, starts, size)

    def chunks(self, size: int) -> Column:
        """Consecutive parts; the last may be short."""
        positive(size, "size")
        return self._parts(F.size(self.c) > 0, F.sequence(F.lit(0), F.size(self.c) - 1, F.lit(size)), size)

    def _parts(self, some: Column, starts: Column, size: int) -> Column:
        return F.when(some, F.transform(starts, lambda i: F.slice(self.c, i + 1, F.lit(size)))).when(self.c.isNotNull(), F.slice(F.array(self.c), F.lit(1), F.lit(0)))

    def position(self, op: str, value: float | int) -> Column:
        """The first index whose element, as a double, compares so; null if there is none."""
        one_of(op, COMPARISONS, "the comparison")
        v = F.lit(float(value))
        either_nan = (lambda x: F.isnan(x)) if not math.isnan(value) else (lambda x: F.lit(True))

        def holds(x: Column) -> Column:
            plain = {"eq": x == v, "ne": x != v, "gt": x > v, "ge": x >= v, "lt": x < v, "le": x <= v}[op]
            return x.isNotNull() & F.when(either_nan(x), F.lit(op == "ne")).otherwise(plain)

        found = F.filter(F.transform(doubles(self.c), lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())
        return F.get(found, F.lit(0))

    def flat_map(self, op: str, value: float | int) -> Column:
        """Arithmetic of each element with a number, as doubles; nulls stay."""
        one_of(op, ARITHMETIC, "the operation")
        return F.transform(doubles(self.c), lambda x: arithmetic(x, F.lit(float(value)), op))

    def join(self, other: str | Column, on, how="inner", suffix="_right", fields: Sequence[str] | None = None, other_fields: Sequence[str] | None = None, schema: T.StructType | None = None) -> Column:
        """Join two lists of structs on a field, row by row: equality as text, nulls match nothing, of equal keys at the right the last wins.

        The output needs the fields of both lists: give them, or a frame's schema that holds both columns by name."""
        o = col(other)
        if schema is not None:
            fields, other_fields = struct_fields(schema, self.c), struct_fields(schema, o)
        if fields is None or other_fields is None:
            raise ValueError("the fields of both lists are needed: give fields and other_fields, or schema")
        for have in (fields, other_fields):
            if on not in have:
                raise ValueError(f"no field {on!r} in {', '.join(have)}")
        key = lambda e: e[on].cast("string")
        matching = lambda e: F.filter(o, lambda r: key(r) == key(e))
        if how == "anti":
            out = F.filter(self.c, lambda e: F.coalesce(F.size(matching(e)) == 0, F.lit(True)))
        elif how in ("inner", "left"):
            right = [(f, f + suffix if f in fields else f) for f in other_fields if f != on]
            pair = lambda e, r: F.struct(*[e[f].alias(f) for f in fields], *[r[f].alias(n) for f, n in right])
            last = F.transform(self.c, lambda e: F.struct(e.alias("e"), F.try_element_at(matching(e), F.lit(-1)).alias("r")))
            if how == "inner":
                last = F.filter(last, lambda x: x["r"].isNotNull())
            out = F.transform(last, lambda x: pair(x["e"], x["r"]))
        else:
            out = F.slice(self.c, F.lit(1), F.lit(0))
        return F.when(self.c.isNotNull() & o.isNotNull(), out)


def list_ext(column: str | Column) -> ListExt:
    return ListExt(column)


def struct_fields(schema: T.StructType, column: Column) -> list[str]:
    """The fields of an array-of-struct column of a schema."""
    name = column._jc.toString() if hasattr(column, "_jc") else str(column).split("'")[1]
    return list(schema[name].dataType.elementType.fieldNames())


def list_join_exploded(df: DataFrame, left: str, right: str, on, how="inner", suffix="_right", name: str = "joined") -> DataFrame:
    """The same join for long lists: both sides are exploded and joined by (row, key) instead of compared element by element.

    Rows are numbered and written first, since three branches must see the same numbers."""
    lf, rf = struct_fields(df.schema, F.col(left)), struct_fields(df.schema, F.col(right))
    rows = Scratch(df.sparkSession, "listjoin").save(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    l = rows.select("__row", F.posexplode(left).alias("__i", "__l")).withColumn("__k", F.col("__l")[on].cast("string"))
    r = rows.select("__row", F.posexplode(right).alias("__j", "__r")).withColumn("__k", F.col("__r")[on].cast("string")).filter(F.col("__k").isNotNull())
    r = r.groupBy("__row", "__k").agg(F.max_by("__r", "__j").alias("__r"))
    if how == "anti":
        value, met = F.col("__l"), l.join(r, ["__row", "__k"], "left_anti")
    else:
        one_of(how, ("inner", "left"), "how")
        value = F.struct(*[F.col("__l")[f].alias(f) for f in lf], *[F.col("__r")[f].alias(f + suffix if f in lf else f) for f in rf if f != on])
        met = l.join(r, ["__row", "__k"], how)
    packed = met.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", value.alias("v")))), lambda x: x["v"]).alias(name))
    empty = F.slice(F.array(F.lit(None).cast(packed.schema[name].dataType.elementType)), 1, 0)
    out = rows.join(packed, "__row", "left").withColumn(name, F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), F.coalesce(F.col(name), empty)))
    return out.drop("__row")


def operate_scalar_on_list(list_column: str | Column, scalar_column: str | Column, operation: str) -> Column:
    """Each element with the row's scalar, as doubles; null if list or scalar is."""
    one_of(operation, ARITHMETIC, "the operation")
    s = col(scalar_column).cast("double")
    return F.when(s.isNotNull(), F.transform(doubles(list_column), lambda x: arithmetic(x, s, operation)))


def agg_of_range(list_column_y: str | Column, list_column_x: str | Column, aggregation: str, x_min: float, x_max: float, x_range_excluded: tuple[float, float] | None = None, x_min_idx_offset: int | None = None, x_max_idx_offset: int | None = None) -> Column:
    """An aggregate of the y whose x lies in [x_min, x_max] but not in the excluded range (both ends included), nulls and NaN left out, less
    the first and last few of what is left. Nothing left: null, also for count."""
    one_of(aggregation, AGGREGATES, "the aggregation")
    if x_range_excluded is not None and any(math.isnan(v) for v in x_range_excluded):
        raise ValueError("x_range_excluded must not be NaN")
    y, x = doubles(list_column_y), doubles(list_column_x)
    n = F.least(F.size(y), F.size(x))
    pairs = F.zip_with(cut(y, n), cut(x, n), lambda a, b: F.struct(a.alias("y"), b.alias("x")))

    def kept(p: Column) -> Column:
        c = p["y"].isNotNull() & p["x"].isNotNull() & ~F.isnan(p["y"]) & ~F.isnan(p["x"]) & (p["x"] >= float(x_min)) & (p["x"] <= float(x_max))
        if x_range_excluded is not None:
            lo, hi = map(float, x_range_excluded)
            c = c & ~((p["x"] >= lo) & (p["x"] <= hi))
        return c

    values = F.transform(F.filter(pairs, kept), lambda p: p["y"])
    low, high = x_min_idx_offset or 0, x_max_idx_offset or 0
    if low < 0 or high < 0:
        raise ValueError("offsets must not be negative")
    if low or high:
        values = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda e: e["i"] >= low)
        values = F.transform(F.slice(values, F.lit(1), F.greatest(F.size(values) - high, F.lit(0))), lambda e: e["v"])
    # one-element array, so that what follows reads the values from a variable and they are computed once
    held = F.array(values)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)

    def result(v: Column) -> Column:
        if aggregation == "median":
            s = F.array_sort(v)
            mid = F.floor(F.size(v) / 2).cast("int")
            return F.when(F.size(v) % 2 == 0, (F.get(s, mid - 1) + F.get(s, mid)) / 2).otherwise(F.get(s, mid))
        return {"mean": lambda: total(v) / F.size(v), "sum": lambda: total(v), "count": lambda: F.size(v).cast("double"), "max": lambda: F.array_max(v), "min": lambda: F.array_min(v)}[aggregation]()

    return F.get(F.transform(held, lambda v: F.when(F.size(v) > 0, result(v))), F.lit(0))


def mean_of_range(list_column_y: str | Column, list_column_x: str | Column, x_min: float, x_max: float, x_range_excluded: tuple[float, float] | None = None, x_min_idx_offset: int | None = None, x_max_idx_offset: int | None = None) -> Column:
    return agg_of_range(list_column_y, list_column_x, "mean", x_min, x_max, x_range_excluded, x_min_idx_offset, x_max_idx_offset)


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def aggregate_list_col_elementwise(list_column: str | Column, list_size: int, aggregation: str = "mean") -> Column:
    """An aggregate for ``groupBy().agg()``: position by position over the group's lists, null, NaN and infinities left out.

    Longer lists are cut, a shorter one fails the query, null lists count for nothing. Without a value mean and sum are null, count is 0.
    One partial aggregate a position; above WIDE positions ``aggregate_elementwise`` of a frame is better."""
    one_of(aggregation, ("mean", "sum", "count"), "the aggregation")
    positive(list_size, "list_size")
    c = doubles(list_column)
    checked = F.when(F.size(c) < list_size, F.raise_error(F.lit(f"a list is shorter than {list_size}")).cast("array<double>")).otherwise(c)
    agg = {"mean": F.avg, "sum": F.sum, "count": lambda x: F.count(x).cast("double")}[aggregation]
    every = F.array(*[agg(_finite(F.get(checked, F.lit(i)))) for i in range(list_size)])
    return F.when(F.count("*") > 0, every).otherwise(every)


def aggregate_elementwise(df: DataFrame, keys: Sequence[str], list_column: str, list_size: int, aggregation: str = "mean", name: str = "value") -> DataFrame:
    """The same for long lists: elements are exploded with their positions, aggregated by (keys, position) with partial sums, and put together."""
    one_of(aggregation, ("mean", "sum", "count"), "the aggregation")
    positive(list_size, "list_size")
    keys = list(keys)
    if list_size <= WIDE:
        return df.groupBy(*keys).agg(aggregate_list_col_elementwise(list_column, list_size, aggregation).alias(name))
    c = doubles(list_column)
    short = F.raise_error(F.lit(f"a list is shorter than {list_size}")).cast("array<double>")
    own = df.select(*keys, F.when(F.size(c) < list_size, short).otherwise(F.slice(c, 1, list_size)).alias("__l"))
    agg = {"mean": F.avg, "sum": F.sum, "count": lambda x: F.count(x).cast("double")}[aggregation]
    each = own.select(*keys, F.posexplode("__l").alias("__i", "__x")).groupBy(*keys, "__i").agg(agg(_finite(F.col("__x"))).alias("__x"))
    out = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda e: e["__x"]).alias(name))
    none = F.transform(F.sequence(F.lit(1), F.lit(list_size)), lambda i: F.lit(0.0 if aggregation == "count" else None).cast("double"))
    if not keys:
        return out.select(F.coalesce(name, none).alias(name))
    return df.select(*keys).distinct().alias("k").join(out.alias("o"), [F.col(f"k.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left").select(*[F.col(f"k.{k}") for k in keys], F.coalesce(F.col(f"o.{name}"), none).alias(name))
