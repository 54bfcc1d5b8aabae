"""Driver-side access to any file system that Spark can reach, and scratch tables for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fs:
    """The Hadoop file system behind a path; every call takes full paths or URIs."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def of(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.of(p).exists(self.path(p))

    def mkdirs(self, p: str) -> None:
        self.of(p).mkdirs(self.path(p))

    def delete(self, p: str) -> bool:
        return self.of(p).delete(self.path(p), True)

    def list(self, p: str, recursive: bool = False) -> list[tuple[str, int, int]]:
        """Files below p as (path, bytes, modification time in ms); a missing folder has none."""
        fs, at, out = self.of(p), self.path(p), []
        if not fs.exists(at):
            return out
        it = fs.listFiles(at, recursive)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return out

    def folders(self, p: str) -> list[str]:
        fs, at = self.of(p), self.path(p)
        return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []

    def create(self, p: str, text: str) -> bool:
        """Write a new file; False if it is there already, so that two writers cannot both win."""
        fs, at = self.of(p), self.path(p)
        try:
            out = fs.create(at, False)
        except Exception as e:  # py4j wraps every Java exception alike
            if fs.exists(at):
                return False
            raise e
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def read(self, p: str) -> str:
        stream = self.of(p).open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def qualify(self, p: str) -> str:
        return self.of(p).makeQualified(self.path(p)).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a local one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark, "_alluvia_local"):
        spark._alluvia_local = "file://" + tempfile.mkdtemp(prefix="alluvia-")
        atexit.register(_remove_local, spark._alluvia_local)
    return spark._alluvia_local


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Intermediate tables below the shared folder: written once, so that losing an executor costs no recomputation of what lies before them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.fs = spark, Fs(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.path(name))


def give_back(spark: SparkSession) -> None:
    """Ask the JVM of each executor to collect its garbage, after which it returns free heap to the system, for the Python workers beside it.
    There is a task for each core; nothing depends on where they run."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
