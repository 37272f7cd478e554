"""Helpers shared by the corpus operators: shared-folder tables, batch limits and text keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch that Spark hands to a Python worker; long texts make batches of fewer rows.
ARROW_BATCH_BYTES = 4 << 20

#: The whitespace that separates words in the contracts, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"

#: Maps the bytes A-Z to a-z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, because texts differ in length by orders of magnitude; a bound of the caller's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local session gets a temporary one and a cluster an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Table:
    """A table written to the shared folder: it cuts the lineage and outlives lost executors.

    `release()` deletes it once nothing will read it again; otherwise it goes when the session's JVM ends. Tables that
    an operator's result still reads are the caller's to release: `made()` lists those made inside it.
    """

    def __init__(self, df: DataFrame, label: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        where, fs = _hadoop(self.spark, self.path)
        fs.deleteOnExit(where)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        for tables in _open:
            tables.append(self)

    def release(self) -> None:
        where, fs = _hadoop(self.spark, self.path)
        fs.delete(where, True)


_open: list[list[Table]] = []


@contextmanager
def made() -> Iterator[list[Table]]:
    """The tables made inside, for release when what reads them has been written."""
    tables: list[Table] = []
    _open.append(tables)
    try:
        yield tables
    finally:
        _open[:] = [t for t in _open if t is not tables]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy() -> None:
    """Give freed memory back: a worker waits for its next task with no more than it still holds."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches], *forget: Callable[[], object]) -> Callable[[Batches], Batches]:
    """run, clearing its caches and tidying up when its task ends: a worker outlives its task and serves other stages."""

    def tidy_run(batches: Batches) -> Batches:
        yield from run(batches)
        for clear in forget:
            clear()
        tidy()

    return tidy_run


def text_key(text="text"):
    """With doc_id, names a document's row: repeated rows share it, different texts under one id do not."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def encoded(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""
