"""Tables in the folder that driver and executors share, which cut lineage and survive lost executors; and Arrow batches in pieces."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or (only where that is unset, on a single machine) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/lectern-{uuid.uuid4().hex}"
    path = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again."""
    path = f"{folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(path: str, kind: str) -> str:
    folder, name = path.rsplit("/", 1)
    return f"{folder}/.{name}.{kind}"


class Store:
    """Files of the store of a path, whichever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.of = self.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.of.exists(self.fs.Path(path))

    def delete(self, path: str) -> None:
        self.of.delete(self.fs.Path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.of.rename(self.fs.Path(old), self.fs.Path(new)):
            raise OSError(f"{old} could not be moved to {new}")


def settled(spark: SparkSession, path: str) -> str:
    """The path of a table, after a replacement that broke off has been taken back: where the table is gone, the one that was put
    aside returns."""
    store, aside = Store(spark, path), beside(path, "previous")
    if not store.exists(path) and store.exists(aside):
        store.rename(aside, path)
    return path


#: Bytes of a column that a function takes as Python objects at a time; those take many times the room of an Arrow array.
SLICE = 1 << 20


def slices(n: int, size: int, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, rows) of pieces of ``n`` rows with ``size`` bytes in all, of about ``most`` bytes each if rows are alike."""
    step = max(1, n * most // max(size, 1))
    return ((at, min(step, n - at)) for at in range(0, n, step))


def sliced(run: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``run`` over columns of one batch, a piece of bounded bytes at a time: a batch of Arrow has up to 64 MB."""
    size = sum(c.nbytes for c in columns)
    return pa.concat_arrays([run(*(c.slice(at, rows) for c in columns)) for at, rows in slices(len(columns[0]), size)] or [pa.array([], kind)])
