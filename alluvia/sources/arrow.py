"""Arrow record batches as a DataFrame: a Python data source whose partitions are read by the executors.

``make_lazy`` takes a factory of readers, so the batches can be read more than once and by several tasks; a plain reader, which can be
read once, is first written as Arrow files to the shared folder, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from alluvia.storage import Scratch

Factory = Callable[[], pa.RecordBatchReader]


class _Part(InputPartition):
    def __init__(self, factory: Factory):
        super().__init__(0)
        self.factory = factory


class _Reader(DataSourceReader):
    def __init__(self, factories: Sequence[Factory]):
        self.factories = list(factories)

    def partitions(self) -> list[InputPartition]:
        return [_Part(f) for f in self.factories]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for batch in partition.factory():
            if batch.num_rows:
                yield batch


def source_of(name_: str, schema_, factories: Sequence[Factory]) -> type[DataSource]:
    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self):
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return _Reader(factories)

    return Batches


def make_lazy(reader: pa.RecordBatchReader | Factory | Sequence[Factory], spark: SparkSession | None = None) -> DataFrame:
    """A lazy frame over record batches. The schema is known before anything is read; a limit and a projection apply as to any frame."""
    spark = spark or SparkSession.getActiveSession()
    if isinstance(reader, pa.RecordBatchReader):
        return _spooled(reader, spark)
    factories = [reader] if callable(reader) else list(reader)
    schema = from_arrow_schema(factories[0]().schema)
    name = f"alluvia_batches_{id(factories)}"
    spark.dataSource.register(source_of(name, schema, factories))
    return spark.read.format(name).load()


def _spooled(reader: pa.RecordBatchReader, spark: SparkSession, most: int = 64 << 20) -> DataFrame:
    """Copy a single-use reader into Parquet by way of the session, holding at most about ``most`` bytes on the driver."""
    scratch = Scratch(spark, "batches")
    schema = from_arrow_schema(reader.schema)
    held: list[pa.RecordBatch] = []
    size = n = 0

    def flush() -> None:
        nonlocal size, n
        spark.createDataFrame(pa.Table.from_batches(held, reader.schema), schema).write.parquet(scratch.path(f"part={n}"))
        held.clear()
        size, n = 0, n + 1

    for batch in reader:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                flush()
    if held or not n:
        flush()
    return spark.read.schema(schema).parquet(*[scratch.path(f"part={i}") for i in range(n)])
