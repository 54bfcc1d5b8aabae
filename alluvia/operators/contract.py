"""Schema contracts: a decorator that holds a frame's schema against what a transform expects, before any row is read."""

from __future__ import annotations

import functools
import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.sources.table import VersionedTable

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SchemaViolation:
    """issue: missing, type_mismatch or extra."""

    column: str
    issue: str
    expected: str | None = None
    actual: str | None = None

    def to_dict(self) -> dict[str, str | None]:
        return asdict(self)

    def __str__(self) -> str:
        what = {"missing": f"is missing, {self.expected} is expected", "type_mismatch": f"is {self.actual}, {self.expected} is expected", "extra": "is not expected"}
        return f"{self.column!r} {what[self.issue]}"


class SchemaError(Exception):
    """Holds the violations of the kind that failed."""

    def __init__(self, found: Iterable[SchemaViolation]):
        violations = self.violations = list(found)
        super().__init__("the schema breaks its contract: " + "; ".join(map(str, violations)))


class Skip:
    """What a contract returns in place of a frame when a batch is not to be written."""

    def __init__(self, why: Iterable[SchemaViolation]):
        self.violations = list(why)


def data_type(t: T.DataType | str) -> T.DataType:
    return T.DataType.fromDDL(t) if isinstance(t, str) else t


def plain(t: T.DataType) -> T.DataType:
    """The type with everything nullable, since nullability is not part of a contract."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(plain(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(plain(t.keyType), plain(t.valueType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in t.fields])
    return t


def check(df: DataFrame, expect: dict[str, T.DataType | str], extras: bool = True) -> list[SchemaViolation]:
    """Every violation; columns that begin with an underscore are the library's and never extra."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {c: data_type(t) for c, t in expect.items()}
    out = [SchemaViolation(c, "missing", t.simpleString()) for c, t in want.items() if c not in have]
    out += [SchemaViolation(c, "type_mismatch", t.simpleString(), have[c].simpleString()) for c, t in want.items() if c in have and plain(have[c]) != plain(t)]
    if extras:
        out += [SchemaViolation(c, "extra") for c in have if c not in want and not c.startswith("_")]
    return out


def write_quarantine(df: DataFrame, violations: list[SchemaViolation], store: str | None, now: datetime | None = None) -> None:
    """Append a rejected batch, with what is wrong with it and when; a failure to do so is only logged."""
    if store is None:
        return
    try:
        table = VersionedTable(df.sparkSession or SparkSession.getActiveSession(), store)
        marked = df.withColumns({"_violations": F.lit(json.dumps(list(map(SchemaViolation.to_dict, violations)))), "_quarantined_at": F.lit(now or datetime.now(timezone.utc)).cast("timestamp")})
        table.append(marked) if table.exists() else table.create(marked)
    except Exception as e:
        log.warning("a rejected batch was not written to %s: %s", store, e)


def schema(expect: dict[str, T.DataType | str], on_missing: str = "raise", on_extra: str = "ignore", evolution: str = "strict", quarantine: str | None = None) -> Callable:
    """Decorate a transform of one frame.

    on_missing: raise, drop (skip the batch) or quarantine (write it aside, then skip). on_extra: ignore, raise or drop (the columns).
    evolution: strict (raise), or cast and merge, which both cast; a value that cannot be cast fails the query that meets it."""
    for value, allowed in ((on_missing, ("raise", "drop", "quarantine")), (on_extra, ("ignore", "raise", "drop")), (evolution, ("strict", "cast", "merge"))):
        if value not in allowed:
            raise ValueError(f"{value!r} is none of {', '.join(allowed)}")

    def decorate(fn: Callable[[DataFrame], DataFrame]) -> Callable[..., DataFrame | Skip]:
        @functools.wraps(fn)
        def checked(*frames: DataFrame) -> DataFrame | Skip:
            if len(frames) != 1:
                raise TypeError(f"a contract holds for a transform of one frame, not of {len(frames)}")
            df = frames[0]
            found = check(df, expect, on_extra != "ignore")
            of = {issue: [v for v in found if v.issue == issue] for issue in ("missing", "type_mismatch", "extra")}
            if of["missing"]:
                if on_missing == "raise":
                    raise SchemaError(of["missing"])
                if on_missing == "quarantine":
                    write_quarantine(df, of["missing"], quarantine)
                return Skip(of["missing"])
            if of["extra"]:
                if on_extra == "raise":
                    raise SchemaError(of["extra"])
                df = df.drop(*[v.column for v in of["extra"]])
            if of["type_mismatch"]:
                if evolution == "strict":
                    raise SchemaError(of["type_mismatch"])
                df = df.withColumns({v.column: F.col(v.column).cast(data_type(expect[v.column])) for v in of["type_mismatch"]})
            return fn(df)

        return checked

    return decorate
