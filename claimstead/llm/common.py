"""What the training-data operators share: table reading, the shared folder, tables kept in it for a while."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (where it is unset, on a local master only) a new local one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="claimstead-")
    if not current.isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As durable(), for wide rows: a compressed table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run, forget: Callable[[], None] | None = None) -> Run:
    """run, giving its memory back to the system when a task ends: workers live on and serve other stages.

    forget: a module's function that empties what it keeps between tasks.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget:
            forget()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


class Scratch:
    """Tables in the shared folder that a computation keeps and drops; with the block, whatever is left goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path, table
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self.paths.pop(id(table), (None, None))
            if path:
                drop_path(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path, _ in self.paths.values():
            with suppress(Exception):
                drop_path(self.spark, path)
        self.paths.clear()
