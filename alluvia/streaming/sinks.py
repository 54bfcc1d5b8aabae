"""The sinks of incremental pipelines under Structured Streaming: the checkpoint takes the ledger's place.

Each micro-batch is written by the same commits as a batch run. A batch that is repeated after a crash is recognised by its number, which
stands in the very commit that wrote it, so appends are not doubled. (SCD-4 has two tables and so two commits: a crash between them repeats the history's.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from alluvia.operators import merge
from alluvia.sources.table import VersionedTable


def write_batches(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, merge_on: str | Sequence[str] | None = None, partition_by: str | Sequence[str] | None = None, scd_type: int = 1, history_target: str | None = None, once: bool = True, order_by: str | None = None) -> StreamingQuery:
    """Start writing a stream to a versioned table; with ``once``, all that is there now, then stop."""
    if scd_type != 1 and merge_on is None:
        raise ValueError(f"scd_type={scd_type} needs merge_on")

    known: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        df, table, parts = transform(batch), VersionedTable(spark, target), merge.listed(partition_by)
        name = checkpoint.rstrip("/")
        if not known:  # only the first batch of a run can be a repeated one
            known.append(table.last_batch(name))
            if known[0] >= number:
                return
        table.stream = [name, number]
        if scd_type == 2:
            merge.write_scd2(table, df, merge_on, parts)
        elif scd_type == 4:
            merge.write_scd4(table, VersionedTable(spark, history_target), df, merge_on, parts, order_by=order_by)
        elif merge_on is not None:
            merge.write_upsert(table, df, [*merge.listed(merge_on), *[p for p in parts if p not in merge.listed(merge_on)]], parts)
        else:
            merge.write_append(table, df, parts)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of a folder's files. A stream's schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format("json" if fmt == "ndjson" else fmt).load(path)
