"""Versioned tables: Parquet files and a log of commits, each one JSON file that only one writer can create.

A commit adds files and removes files; a table's state is what its commits leave, read from the newest checkpoint on. Readers name
their files explicitly, so a rewrite never disturbs them. Rewrites touch only files that hold affected rows, found by a narrow
scan of the key columns; everything stays distributed but for the lists of files.

Every added file says what its rows are to a change feed: ``insert``, ``update_postimage``, or nothing when a rewrite only moved
them. Partition values are kept in the log and, under the column's own name, in the files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alluvia.storage import Fs

LOG, DATA, CHECKPOINT_EVERY = "_log", "_data", 10
PART, CHANGE = "__part_", "__change"
CHANGE_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")


class ConcurrentWriteError(RuntimeError):
    """Another writer's commit came first and touches what this one has read."""


class TableMissing(FileNotFoundError):
    """There is no table at this path."""


@dataclass
class State:
    version: int = -1
    schema: T.StructType | None = None
    partition_by: list[str] = field(default_factory=list)
    files: dict[str, dict] = field(default_factory=dict)  # path below the table: {"part": {...}, "bytes": n}

    def apply(self, commit: dict) -> None:
        self.version = commit["version"]
        if "schema" in commit:
            self.schema = T.StructType.fromJson(commit["schema"])
        self.partition_by = commit.get("partition_by", self.partition_by)
        for path in commit.get("remove", []):
            self.files.pop(path, None)
        for x in commit.get("add", []):
            self.files[x["path"]] = {"part": x["part"], "bytes": x["bytes"]}


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds values of both; text where numbers and text meet."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    if type(a) in order and type(b) in order:
        if T.LongType in (type(a), type(b)) and T.FloatType in (type(a), type(b)):
            return T.DoubleType()
        return max(a, b, key=lambda t: order.index(type(t)))
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, in the old order, types widened; everything nullable."""
    fields = {f.name: f.dataType for f in old.fields} if old else {}
    for f in new.fields:
        fields[f.name] = widened(fields[f.name], f.dataType) if f.name in fields else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


def union_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name: missing columns are null, differing types are widened."""
    schema = None
    for f in frames:
        schema = merged_schema(schema, f.schema)
    out = None
    for f in frames:
        part = conformed(f, schema)
        out = part if out is None else out.unionByName(part)
    return out


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        columns.append((c if have.get(f.name) == f.dataType else c.cast(f.dataType)).alias(f.name))
    return df.select(*columns)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Fs(spark)
        self._known: tuple[int, State] | None = None
        self.stream: list | None = None  # [name, batch] of a stream, which its commits carry

    # state

    def _log(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[-1] for p, _, _ in self.fs.list(f"{self.path}/{LOG}"))

    def exists(self) -> bool:
        return self.fs.exists(f"{self.path}/{LOG}/{0:020d}.json")

    def version(self) -> int:
        names = [n for n in self._log() if n.endswith(".json") and ".checkpoint" not in n]
        if not names:
            raise TableMissing(self.path)
        return int(names[-1][:20])

    def commit_at(self, version: int) -> dict:
        return json.loads(self.fs.read(f"{self.path}/{LOG}/{version:020d}.json"))

    def state(self, version: int | None = None) -> State:
        newest = self.version()
        version = newest if version is None else version
        if not 0 <= version <= newest:
            raise ValueError(f"{self.path} has versions 0 to {newest}, not {version}")
        if self._known and self._known[0] == version:
            return self._known[1]
        marks = [int(n[:20]) for n in self._log() if ".checkpoint" in n and int(n[:20]) <= version]
        s, start = State(), 0
        if marks:
            kept = json.loads(self.fs.read(f"{self.path}/{LOG}/{max(marks):020d}.checkpoint.json"))
            s = State(kept["version"], T.StructType.fromJson(kept["schema"]), kept["partition_by"], kept["files"])
            start = kept["version"] + 1
        for v in range(start, version + 1):
            s.apply(self.commit_at(v))
        self._known = (version, s)
        return s

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that is in the table, -1 if there is none."""
        for v in range(self.version() if self.exists() else -1, -1, -1):
            if (mark := self.commit_at(v).get("stream")) and mark[0] == stream:
                return mark[1]
        return -1

    def history(self) -> list[dict]:
        """Version, time, operation and numbers of files of each commit, oldest first."""
        found = [self.commit_at(v) for v in range(self.version() + 1)]
        return [{"version": c["version"], "timestamp": c["timestamp"], "operation": c["operation"], "added": len(c["add"]), "removed": len(c["remove"])} for c in found]

    @property
    def schema(self) -> T.StructType:
        return self.state().schema

    @property
    def partition_by(self) -> list[str]:
        return self.state().partition_by

    def files(self, version: int | None = None) -> list[str]:
        return [f"{self.path}/{p}" for p in self.state(version).files]

    # reads

    def _read(self, paths: Sequence[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def scan(self, version: int | None = None, partitions: dict[str, Sequence] | None = None) -> DataFrame:
        """The rows of a version. ``partitions``: values wanted of partition columns; other files are not opened."""
        s = self.state(version)
        df = self._read([f"{self.path}/{p}" for p, x in s.files.items() if wanted(x["part"], partitions)], s.schema)
        for name, values in (partitions or {}).items():
            df = df.filter(F.col(name).isin([v for v in values if v is not None]) | (F.col(name).isNull() if None in values else F.lit(False)))
        return df

    def changes(self, first: int, last: int | None = None) -> DataFrame:
        """The rows that versions first to last brought, with CHANGE_COLUMNS: ``insert``, ``update_postimage`` and, of a delete, ``delete``."""
        last = self.version() if last is None else last
        schema, out = self.state(last).schema, None
        for v in range(first, last + 1):
            c = self.commit_at(v)
            found = [("delete", [p for p in c["remove"]])] if c["operation"] == "delete" else []
            for kind in ("insert", "update_postimage"):
                found.append((kind, [x["path"] for x in c["add"] if x.get("change") == kind]))
            for kind, paths in found:
                if paths:
                    stamp = F.lit(datetime.fromtimestamp(c["timestamp"] / 1000, timezone.utc)).cast("timestamp")
                    part = self._read([f"{self.path}/{p}" for p in paths], schema).withColumns(dict(zip(CHANGE_COLUMNS, (F.lit(kind), F.lit(v).cast("long"), stamp))))
                    out = part if out is None else out.unionByName(part)
        if out is None:
            extra = T.StructType([T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType())])
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *extra.fields]))
        return out

    # writes

    def _write(self, df: DataFrame, partition_by: list[str], sort_by: Sequence[str] = ()) -> list[dict]:
        """Write files into a folder of their own; what to add to the log. A column CHANGE divides the rows by kind of change."""
        folder = f"{DATA}/{uuid.uuid4().hex}"
        keys = ([CHANGE] if CHANGE in df.columns else []) + [PART + c for c in partition_by]
        df = df.withColumns({PART + c: F.col(f"`{c}`").cast("string") for c in partition_by})
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*keys) if keys else w).parquet(f"{self.path}/{folder}")
        out, root = [], self.fs.qualify(f"{self.path}/{folder}")
        for p, size, _ in self.fs.list(f"{self.path}/{folder}", recursive=True):
            if not p.endswith(".parquet"):
                continue
            below = p.removeprefix(root).strip("/")
            values = dict(x.split("=", 1) for x in below.split("/")[:-1])
            values = {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in values.items()}
            change = values.pop(CHANGE, None)
            out.append({"path": f"{folder}/{below}", "bytes": size, "part": {k.removeprefix(PART): v for k, v in values.items()}, "change": change or None})
        return out

    def _commit(self, version: int, operation: str, add: list[dict], remove: list[str], schema: T.StructType | None = None, partition_by: list[str] | None = None, rebase: bool | Callable[[T.StructType], T.StructType] = False) -> int:
        entry = {"timestamp": int(time.time() * 1000), "operation": operation, "add": add, "remove": remove} | ({"stream": self.stream} if self.stream else {})
        if schema is not None:
            entry["schema"] = schema.jsonValue()
        if partition_by is not None:
            entry["partition_by"] = partition_by
        while not self.fs.create(f"{self.path}/{LOG}/{version:020d}.json", json.dumps({"version": version} | entry)):
            if not rebase:
                raise ConcurrentWriteError(f"version {version} of {self.path} was written by another commit")
            s = self.state()  # with what the other commit has made of the schema
            version = max(version, s.version) + 1
            if callable(rebase):
                entry.pop("schema", None)
                if (schema := rebase(s.schema)) != s.schema:
                    entry["schema"] = schema.jsonValue()
        if version and version % CHECKPOINT_EVERY == 0:
            s = self.state(version)
            self.fs.create(f"{self.path}/{LOG}/{version:020d}.checkpoint.json", json.dumps({"version": version, "schema": s.schema.jsonValue(), "partition_by": s.partition_by, "files": s.files}))
        return version

    def create(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        schema = merged_schema(None, df.schema)
        add = self._write(df.withColumn(CHANGE, F.lit("insert")), list(partition_by))
        return self._commit(0, "create", add, [], schema, list(partition_by))

    def append(self, df: DataFrame) -> int:
        """Add rows; of columns that the table lacks, the schema grows. Appends of several writers all succeed."""
        s = self.state()
        schema = merged_schema(s.schema, df.schema)
        add = self._write(conformed(df, schema).withColumn(CHANGE, F.lit("insert")), s.partition_by)
        return self._commit(s.version + 1, "append", add, [], schema if schema != s.schema else None, rebase=lambda now: merged_schema(now, df.schema))

    def rewrite(self, operation: str, touched: Sequence[str], rows: DataFrame | None, new: DataFrame | None = None, kind: str = "update_postimage") -> int:
        """One commit that removes the touched files, adds ``rows`` (what they keep) and ``new`` (rows of which a change feed tells)."""
        s = self.state()
        parts = [(rows, None), (new, kind)] if rows is not None else [(new, kind)]
        schema = s.schema
        for df, _ in parts:
            if df is not None:
                schema = merged_schema(schema, df.drop(CHANGE).schema)
        marked = None
        for df, what in parts:
            if df is not None:
                change = F.col(CHANGE) if CHANGE in df.columns else F.lit(what or "none")
                part = conformed(df, schema).withColumn(CHANGE, change) if CHANGE not in df.columns else conformed(df, T.StructType([*schema.fields, T.StructField(CHANGE, T.StringType())]))
                marked = part if marked is None else marked.unionByName(part)
        add = self._write(marked, s.partition_by) if marked is not None else []
        for x in add:
            x["change"] = None if x["change"] == "none" else x["change"]
        return self._commit(s.version + 1, operation, add, [self._below(p) for p in touched], schema if schema != s.schema else None)

    def overwrite(self, df: DataFrame) -> int:
        s = self.state()
        schema = merged_schema(None, df.schema)
        add = self._write(df.withColumn(CHANGE, F.lit("insert")), s.partition_by)
        return self._commit(s.version + 1, "overwrite", add, list(s.files), schema)

    def delete_all(self) -> int:
        s = self.state()
        return self._commit(s.version + 1, "delete", [], list(s.files))

    def replace_files(self, operation: str, df: DataFrame, touched: Sequence[str]) -> int:
        """Rewrite files without a change of content."""
        s = self.state()
        return self._commit(s.version + 1, operation, self._write(df, s.partition_by), [self._below(p) for p in touched])

    def _below(self, path: str) -> str:
        return f"{DATA}/" + path.rsplit(f"/{DATA}/", 1)[-1]

    def holding(self, keys: DataFrame, on: Sequence[str], where=None, partitions: dict[str, Sequence] | None = None) -> list[str]:
        """The files with rows whose key is among ``keys``: a semi-join of the key columns alone."""
        if not any(wanted(x["part"], partitions) for x in self.state().files.values()):
            return []
        df = self.scan(partitions=partitions)
        df = df.filter(where) if where is not None else df
        found = df.select(*on, F.col("_metadata.file_path").alias("__file")).join(keys.select(*on), list(on), "left_semi").select("__file").distinct()
        names = {f"{self.path}/{p}".rsplit(f"/{DATA}/", 1)[-1]: f"{self.path}/{p}" for p in self.state().files}
        return sorted(names[unquote(r[0]).rsplit(f"/{DATA}/", 1)[-1]] if unquote(r[0]).rsplit(f"/{DATA}/", 1)[-1] in names else names[r[0].rsplit(f"/{DATA}/", 1)[-1]] for r in found.toLocalIterator())

    def read_files(self, paths: Sequence[str]) -> DataFrame:
        return self._read(list(paths), self.state().schema)


def wanted(part: dict[str, str | None], partitions: dict[str, Sequence] | None) -> bool:
    """Whether a file's partition values are among those asked for; only values whose text is certain are used."""
    for name, values in (partitions or {}).items():
        if name in part and all(v is None or isinstance(v, (str, bool, int)) or hasattr(v, "isoformat") for v in values):
            texts = {None if v is None or v == "" else str(v).lower() if isinstance(v, bool) else v.isoformat() if hasattr(v, "isoformat") and not hasattr(v, "hour") else str(v) for v in values}
            if any(hasattr(v, "hour") for v in values):
                continue
            if (part[name] or None) not in texts:
                return False
    return True
