"""Sources of incremental pipelines: each is polled with its last cursor and gives a frame and the next one, or nothing.

A cursor is any JSON value. It is the pipeline's ledger of what has been ingested; it has nothing to do with event time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.sources.table import CHANGE_COLUMNS, TableMissing, VersionedTable, union_by_name
from alluvia.storage import Fs

SUFFIXES = {"parquet": (".parquet",), "csv": (".csv",), "ndjson": (".ndjson",)}
OPTION_NAMES = {"separator": "sep", "null_values": "nullValue", "quote_char": "quote", "has_header": "header", "skip_rows": "skipRows", "infer_schema": "inferSchema", "try_parse_dates": None, "ignore_errors": None}
Options = dict[str, Any] | None
LOOKING = 16  # files whose schemas are read at a time


@dataclass(frozen=True)
class Batch:
    """What a poll found: a lazy frame, and the cursor to save once it has been written."""

    frame: DataFrame
    cursor: Any = None


@runtime_checkable
class Source(Protocol):
    def poll(self, since: Any) -> Batch | None:
        """What is new since a cursor (None: everything), or None."""
        ...


@dataclass
class QuerySource:
    """Calls ``fn(since)``; the next cursor is the greatest value of ``cursor_on``."""

    fn: Callable[[Any], DataFrame | None]
    cursor_on: str

    def poll(self, since: Any) -> Batch | None:
        df = self.fn(since)
        if df is None:
            return None
        greatest = df.agg(F.max(self.cursor_on)).first()[0]
        return None if greatest is None else Batch(df, greatest)


@dataclass
class FrameSource:
    """Gives the whole frame at every poll."""

    fn: Callable[[], DataFrame]

    def poll(self, since: Any) -> Batch | None:
        return Batch(self.fn(), None)


from_query, from_frame = QuerySource, FrameSource


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> list[str]:
    """All files below a folder with one of the suffixes, sorted; local ones as plain paths. Ledgers and files of tables
    (a part of the path begins with a dot or an underscore) are not data."""
    fs = Fs(spark)
    base = fs.qualify(root.rstrip("/"))
    found = [p for p, _, _ in fs.list(root, recursive=True) if p.endswith(tuple(suffixes)) and not any(x[:1] in "._" for x in p.removeprefix(base).strip("/").split("/"))]
    return sorted(p.removeprefix("file:").replace("//", "/", 1) if p.startswith("file:") else p for p in found)


def options_of(kwargs: dict[str, Any]) -> tuple[dict[str, Any], T.StructType | str | None, dict[str, str]]:
    """Spark's reader options, a schema, and types to give to some columns."""
    rest, schema, casts = dict(kwargs), None, {}
    schema = rest.pop("schema", None)
    casts = rest.pop("schema_overrides", {}) or {}
    out = {}
    for name, value in rest.items():
        name = OPTION_NAMES.get(name, name)
        if name is None:
            continue
        if name == "nullValue" and isinstance(value, (list, tuple)):
            if len(value) != 1:
                raise ValueError("one null value can be given")
            value = value[0]
        out[name] = value
    return out, schema, {c: t if isinstance(t, str) else t.simpleString() for c, t in casts.items()}


def _read(spark: SparkSession, paths: Sequence[str], fmt: str, kwargs: dict[str, Any]) -> DataFrame:
    options, schema, casts = options_of(kwargs)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "parquet":
        df = reader.parquet(*paths)
    elif fmt == "csv":
        defaults = {"header": True, "inferSchema": schema is None, "enforceSchema": False}
        df = reader.options(**{k: v for k, v in defaults.items() if k not in options}).csv(list(paths))
    elif fmt == "ndjson":
        df = reader.json(list(paths))
        if schema is None:
            df = df.select(*_json_order(spark, paths[0], df.columns))
    else:
        raise ValueError(f"unknown file format {fmt!r}")
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns})


def _json_order(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """Inferred columns in the order in which the first file's first line has them (Spark sorts them)."""
    import json

    first = next((r[0] for r in spark.read.text(path).limit(20).collect() if r[0].strip()), "{}")
    seen = [k for k in json.loads(first) if k in columns]
    return [f"`{c}`" for c in [*seen, *[c for c in columns if c not in seen]]]


def scan_files(spark: SparkSession, paths: Sequence[str], fmt: str, reader_kwargs: Options = None, concat_options: Options = None, now: datetime | None = None) -> DataFrame:
    """One lazy frame of all files, with ``_source_file`` and ``_ingested_at``.

    Schemas must be equal, however many files there are, unless ``concat_options`` has ``how`` as ``diagonal`` (missing columns are null) or one
    that ends in ``relaxed`` (types are widened). Each file's schema is looked at, LOOKING at a time; files of one schema are read as one."""
    kwargs, how = reader_kwargs or {}, (concat_options or {}).get("how", "vertical")
    if not paths:
        raise ValueError("no files to read")
    if len(paths) == 1:
        return _tagged(_read(spark, paths, fmt, kwargs), now)
    with ThreadPoolExecutor(LOOKING) as pool:
        found = list(pool.map(lambda p: _read(spark, [p], fmt, kwargs).schema, paths))
    alike: dict[tuple, list[int]] = {}
    for i, schema in enumerate(found):
        alike.setdefault(tuple((x.name, x.dataType.json()) for x in schema.fields), []).append(i)
    if how == "vertical" and len(alike) > 1:
        other = list(alike.values())[1][0]
        raise ValueError(f"{paths[other]} and {paths[0]} have different schemas: {found[other].simpleString()}, {found[0].simpleString()}")
    frames = [_read(spark, [paths[i] for i in some], fmt, kwargs if fmt == "parquet" else kwargs | {"schema": found[some[0]]}) for some in alike.values()]
    return _tagged(frames[0], now) if len(frames) == 1 else union_by_name(*[_tagged(f, now) for f in frames])


def _tagged(df: DataFrame, now: datetime | None) -> DataFrame:
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.withColumns({"_source_file": F.regexp_replace(path, "^file:/+", "/"), "_ingested_at": F.lit(now or datetime.now(timezone.utc)).cast("timestamp")})


class DirSource:
    """Files below a folder; the cursor is the sorted list of all paths seen so far, also of files that have since gone."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", reader_kwargs: Options = None, concat_options: Options = None):
        self.spark, self.root, self.fmt, self.reader_kwargs, self.concat_options = spark, root, fmt, reader_kwargs, concat_options

    def poll(self, since: Any) -> Batch | None:
        seen = {*since} if isinstance(since, list) else set()
        new = [p for p in list_files(self.spark, self.root, SUFFIXES[self.fmt]) if p not in seen]
        if not new:
            return None
        return Batch(scan_files(self.spark, new, self.fmt, self.reader_kwargs, self.concat_options), sorted(seen | set(new)))


class TableSource:
    """A versioned table: all of it at first, then its change feed (inserted rows and new images of updated ones).

    With ``keys``, of several versions of a key in one batch only the newest is given."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ()):
        self.table, self.keys = VersionedTable(spark, path), list(keys)

    def poll(self, since: Any) -> Batch | None:
        if not self.table.exists():
            raise TableMissing(self.table.path)
        current = self.table.version()
        if not isinstance(since, int) or isinstance(since, bool):
            return Batch(self.table.scan(), current)
        if since >= current:
            return None
        from alluvia.operators.merge import latest_change

        changes = self.table.changes(since + 1, current).filter(F.col("_change_type").isin("insert", "update_postimage"))
        if self.keys and current > since + 1:
            changes = latest_change(changes, self.keys)
        return Batch(changes.drop(*CHANGE_COLUMNS), current)
