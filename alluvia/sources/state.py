"""A pipeline's ledger: cursors by source, number of runs, hash of the transform. Small JSON files that the driver writes."""

from __future__ import annotations

import hashlib
import json
import types
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from alluvia.storage import Fs


class Ledger:
    """Each save is a new file, so that a crash while writing leaves the one before; the newest that can be read counts."""

    KEPT = 5

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Fs(spark)

    def _versions(self, name: str) -> list[str]:
        return sorted(p for p, _, _ in self.fs.list(f"{self.path}/{name}") if p.endswith(".json"))

    def _load(self, name: str) -> Any:
        for p in reversed(self._versions(name)):
            try:
                return json.loads(self.fs.read(p))
            except ValueError:
                continue
        return None

    def _save(self, name: str, value: Any) -> None:
        old = self._versions(name)
        n = int(old[-1].rsplit("/", 1)[-1][:12]) + 1 if old else 0
        while not self.fs.create(f"{self.path}/{name}/{n:012d}.json", json.dumps(value, default=str)):
            n += 1
        for p in old[: -self.KEPT]:
            self.fs.delete(p)

    def cursors(self) -> dict[int, Any]:
        """Cursor of each slot; nothing, and so a full load, if there is no ledger or none that can be read."""
        found = self._load("cursors") or {"slots": []}
        return {s["slot"]: json.loads(s["cursor_json"]) for s in found["slots"]}

    def save_cursors(self, cursors: dict[int, Any], now: datetime | None = None) -> None:
        at = (now or datetime.now(timezone.utc)).isoformat()
        self._save("cursors", {"slots": [{"slot": k, "cursor_json": json.dumps(v, default=str), "saved_at": at} for k, v in sorted(cursors.items())]})

    def frame(self) -> DataFrame:
        found = self._load("cursors")
        if found is None:
            raise FileNotFoundError(f"no ledger at {self.path}")
        rows = [(s["slot"], s["cursor_json"], datetime.fromisoformat(s["saved_at"])) for s in found["slots"]]
        return self.spark.createDataFrame(rows, "slot int, cursor_json string, saved_at timestamp")

    def clear(self) -> bool:
        if not self._versions("cursors"):
            return False
        self._save("cursors", {"slots": []})
        return True

    def runs(self) -> int:
        return self._load("_runs") or 0

    def save_runs(self, n: int) -> None:
        self._save("_runs", n)

    def code(self) -> str | None:
        return self._load(".pipeline_version")

    def save_code(self, code: str) -> None:
        self._save(".pipeline_version", code)


def code_hash(fn: Any, seen: frozenset[int] = frozenset()) -> str:
    """A hash of what a function does: bytecode, constants, names, defaults and closed-over values; not of where it stands."""
    h = hashlib.sha256()

    def add(x: Any) -> None:
        if isinstance(x, types.CodeType):
            for part in (x.co_code, x.co_names, x.co_varnames[: x.co_argcount]):
                h.update(repr(part).encode())
            for c in x.co_consts:
                add(c)
        elif isinstance(x, types.FunctionType):
            h.update(code_hash(x, seen | {id(fn)}).encode() if id(x) not in seen else b"again")
        elif isinstance(x, (list, tuple)):
            h.update(str(len(x)).encode())
            for y in x:
                add(y)
        elif isinstance(x, dict):
            add(sorted(x.items(), key=repr))
        elif isinstance(x, (str, int, float, bool, bytes, type(None), frozenset)):
            h.update(repr(sorted(x, key=repr) if isinstance(x, frozenset) else x).encode())
        else:
            h.update(type(x).__name__.encode())

    target = getattr(fn, "__wrapped__", None)
    if target is not None:
        add(target)
    if isinstance(fn, types.FunctionType):
        add(fn.__code__)
        add(fn.__defaults__ or ())
        add(tuple(c.cell_contents for c in fn.__closure__ or () if not isinstance(c.cell_contents, SparkSession)))
    else:
        add(getattr(type(fn), "__call__", None) if not isinstance(fn, type) else fn.__name__)
    return h.hexdigest()
