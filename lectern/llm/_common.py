"""Shared plumbing of the corpus operators: inputs and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python at once: whole documents, some very long, so far fewer than Spark's default.
BATCH_ROWS = 1000


#: Bytes up to which a table is broadcast, as its hash table takes them (``ROW_BYTES`` and twice its values a row).
SENT_BYTES, ROW_BYTES = 8 << 20, 24


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows of Arrow batches of this session where nobody has set them; memory of a Python worker follows them.
    Plans read the setting when they run, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader (the folder may be in any store)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. ``spark.checkpoint.dir`` names it; only where that is unset
    (local tests, one machine) a temporary folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not base:
        base = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        shared_dir.own = base
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, spare: list[str] | None = None, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors. Its path is put
    into ``spare``, for tables that ``discard`` may delete when what depends on them is written itself."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    if spare is not None:
        spare.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing depends on any more, in whichever store they lie."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` under a name that no operator uses, and a function that gives the columns of a result
    their names back: so extra columns may have any name."""
    columns = docs.columns
    names = [c if c in own else f"__other{k}" for k, c in enumerate(columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*columns)


def bounded(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``df`` marked for broadcast if a count proves that its hash table has at most ``most`` bytes, else as it is (shuffle
    join). ``df`` should be a written table of numbers, as it is counted and its rows have one size."""
    row = ROW_BYTES + 2 * sum(8 for _ in df.columns)
    return F.broadcast(df) if df.limit(most // row + 1).count() <= most // row else df
