"""Scalar and windowed expressions that have no single Spark function with the wanted semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD"}


def pattern(fmt: str) -> str:
    """A strftime format in Spark's letters."""
    for a, b in PATTERNS.items():
        fmt = fmt.replace(a, b)
    if "%" in fmt:
        raise ValueError(f"unknown letter in {fmt!r}")
    return fmt


def to_date(c: str | Column, fmt: str, strict: bool = False) -> Column:
    """A date by a strftime format; what does not parse is null unless strict. A format without a day gives the first of the month."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c, pattern(fmt)) if strict else F.to_date(F.try_to_timestamp(c, F.lit(pattern(fmt))))


def first_date(c: str | Column, fmts: Sequence[str]) -> Column:
    """The first of several formats that parses."""
    return F.coalesce(*[to_date(c, f) for f in fmts])


def strftime(c: str | Column, fmt: str) -> Column:
    return F.date_format(c, pattern(fmt))


def zfill(c: str | Column, n: int) -> Column:
    """Text filled with zeros at the left, never cut."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def replace_values(c: str | Column, mapping: dict) -> Column:
    """Mapped values; others unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for k, v in mapping.items():
        hit = c.isNull() if k is None else c == F.lit(k)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return c if out is None else out.otherwise(c)


def rolling_mean(c: str | Column, n: int, order_by: str | Sequence[str], over: str | Sequence[str] = ()) -> Column:
    """Mean of a row and the n - 1 before it, null until there are n. Without ``over`` all rows are one sequence, in one task."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    over = [over] if isinstance(over, str) else list(over)
    c = F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(*over).orderBy(*order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))
