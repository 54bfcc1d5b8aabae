"""Incremental pipelines: a decorator that makes an ordinary transform ingest only what is new.

A run polls every source with its cursor, gives the frames of those that have something to the transform, writes the result and
only then saves the cursors: a crash between the two repeats a batch (at least once), and never loses one.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from alluvia.operators import merge
from alluvia.operators.contract import Skip
from alluvia.operators.maintenance import maintain as maintain_table
from alluvia.sources.core import SUFFIXES, Batch, DirSource, Source, TableSource
from alluvia.sources.state import Ledger, code_hash
from alluvia.sources.table import VersionedTable

log = logging.getLogger(__name__)
Names = str | Sequence[str] | None
Options = dict | None
Where, Every, Session = str | None, int | None, SparkSession | None
Clock = Callable[[], datetime] | None


class IncrementalPipeline:
    def __init__(self, fn: Callable[..., DataFrame], source, target: str, merge_on: Names = None, partition_by: Names = None, scd_type: int = 1, history_target: Where = None, file_format: str = "parquet", watermark_store: Where = None, compact_every: Every = None, fail_on_version_mismatch: bool = False, compute_context: Session = None, reader_kwargs: Options = None, concat_options: Options = None, order_by: str | None = None, now: Clock = None):
        if merge_on is not None and not merge.listed(merge_on):
            raise ValueError("merge_on names no column; leave it out to append")
        if scd_type not in (1, 2, 4):
            raise ValueError(f"scd_type is 1, 2 or 4, not {scd_type!r}")
        if scd_type == 4 and not history_target:
            raise ValueError("scd_type=4 needs a history_target")
        if scd_type in (2, 4) and merge_on is None:
            raise ValueError(f"scd_type={scd_type} needs merge_on")
        if file_format not in (*SUFFIXES, "delta", "table"):
            raise ValueError(f"unknown file_format {file_format!r}")
        functools.update_wrapper(self, fn)
        self.fn, self.source, self.target, self.merge_on = fn, source, target, merge_on
        self.fail_on_version_mismatch, self.file_format = fail_on_version_mismatch, file_format
        below = target if not target.endswith("/") else target[:-1]
        self.watermark_store = watermark_store if watermark_store else f"{below}/.watermark"
        self.partition_by, self.scd_type, self.history_target, self.compact_every = partition_by, scd_type, history_target, compact_every
        self.compute_context, self.reader_kwargs, self.concat_options, self.order_by = compute_context, reader_kwargs, concat_options, order_by
        self.now = now or (lambda: datetime.now(timezone.utc))
        self.pipeline_hash = code_hash(fn)

    @property
    def spark(self) -> SparkSession:
        return self.compute_context or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, self.watermark_store)

    @property
    def sources(self) -> list[Source]:
        """The given sources; strings are folders of files or, with a table format, versioned tables."""
        given = list(self.source) if isinstance(self.source, (list, tuple)) else [self.source]
        out: list[Source] = []
        for s in given:
            if not isinstance(s, str):
                if not isinstance(s, Source):
                    raise TypeError(f"{type(s).__name__} has no poll(since)")
                out.append(s)
            elif self.file_format in SUFFIXES:
                out.append(DirSource(self.spark, s, self.file_format, self.reader_kwargs, self.concat_options))
            else:
                out.append(TableSource(self.spark, s, merge.listed(self.merge_on)))
        return out

    def __call__(self, *frames: DataFrame) -> DataFrame:
        """The transform alone."""
        return self.fn(*frames)

    @staticmethod
    def labels(source: Source, before: Any, batch: Batch) -> list[str]:
        if isinstance(source, DirSource):
            old = {*before} if isinstance(before, list) else {None}
            return [p for p in batch.cursor if p not in old]
        return [f"v{batch.cursor}"] if isinstance(source, TableSource) else [str(batch.cursor)[:100]]

    def _guard(self) -> None:
        stored = self.ledger.code()
        if stored is not None and stored != self.pipeline_hash:
            said = f"the transform has changed since its last run (was {stored[:12]}, is {self.pipeline_hash[:12]}); its cursors may not fit"
            if self.fail_on_version_mismatch:
                raise RuntimeError(said)
            log.warning(said)

    def write(self, df: DataFrame) -> None:
        """Write a result as the pipeline is told to; partitions and keys as configured."""
        spark, parts = self.spark, merge.listed(self.partition_by)
        table, now = VersionedTable(spark, self.target), self.now()
        if self.scd_type == 2:
            merge.write_scd2(table, df, self.merge_on, parts, now)
        elif self.scd_type == 4:
            merge.write_scd4(table, VersionedTable(spark, self.history_target), df, self.merge_on, parts, now, self.order_by)
        elif self.merge_on is not None:
            merge.write_upsert(table, df, [*merge.listed(self.merge_on), *[p for p in parts if p not in merge.listed(self.merge_on)]], parts)
        else:
            merge.write_append(table, df, parts)

    def run(self, dry_run=False) -> list[str]:
        """Ingest what is new; what it was: paths of files, ``v<version>`` of a table, the cursor of another source. Nothing new: []."""
        cursors, sources = self.ledger.cursors(), self.sources
        found = [(k, b) for k, s in enumerate(sources) if (b := s.poll(cursors.get(k))) is not None]
        if not found:
            log.info("nothing new")
            return []
        labels = [x for k, b in found for x in self.labels(sources[k], cursors.get(k), b)]
        if dry_run:
            return labels
        self._guard()
        result = self.fn(*[b.frame for _, b in found])
        if not isinstance(result, Skip):
            self.write(result)
        self.ledger.save_cursors(cursors | {k: b.cursor for k, b in found}, self.now())
        try:
            self.ledger.save_code(self.pipeline_hash)
        except Exception:
            log.exception("the transform's hash was not saved")
        if self.compact_every is not None:
            runs = self.ledger.runs() + 1
            self.ledger.save_runs(runs)
            if runs % self.compact_every == 0 and VersionedTable(self.spark, self.target).exists():
                maintain_table(self.target, spark=self.spark)
        return labels

    def reset(self) -> None:
        """Forget the cursors, so that the next run loads everything; the target, the count of runs and the hash stay."""
        log.info("cursors cleared" if self.ledger.clear() else "there were no cursors")

    def status(self) -> DataFrame:
        return self.ledger.frame()

    def maintain(self, compact: bool = True, z_order_by: Names = None, vacuum: bool = True, retention_hours: float = 168) -> None:
        maintain_table(self.target, compact, z_order_by, vacuum, retention_hours, self.spark)


def incremental(source, target: str, merge_on: Names = None, partition_by: Names = None, scd_type: int = 1, history_target: Where = None, file_format: str = "parquet", watermark_store: Where = None, compact_every: Every = None, fail_on_version_mismatch: bool = False, compute_context: Session = None, staging: Any = None, reader_kwargs: Options = None, concat_options: Options = None, order_by: str | None = None, now: Clock = None) -> Callable[[Callable[..., DataFrame]], IncrementalPipeline]:
    """Make a transform an incremental pipeline.

    source: a folder, a table's path, anything with ``poll(since)``, or a list of these. merge_on: keys of an upsert; without it rows are
    appended. scd_type 2 keeps versions with valid_from, valid_to and is_current, 4 moves replaced rows to ``history_target``.
    compute_context: the session to run in (not a Spark Connect one: storage needs the JVM gateway). staging has no use here and is accepted for callers that
    give it. order_by: which of a batch's equal keys is the last (SCD-4). now: the clock."""

    def decorate(fn: Callable[..., DataFrame]) -> IncrementalPipeline:
        given = {"file_format": file_format, "watermark_store": watermark_store, "compact_every": compact_every, "compute_context": compute_context, "reader_kwargs": reader_kwargs, "concat_options": concat_options}
        return IncrementalPipeline(fn, source, target, merge_on, partition_by, scd_type, history_target, fail_on_version_mismatch=fail_on_version_mismatch, order_by=order_by, now=now, **given)

    return decorate
