"""Helpers shared by the training-data operators.

Every operator takes and returns DataFrames.  The helpers here cover the three
things they have in common: reading a table of a data folder, cutting lineage
in the cluster's shared folder, and appending columns computed on Arrow batches
while every other column of a row is handed through untouched.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made and set, under a local master only:
    executors elsewhere would write to their own disks.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(found)
    return found


#: Folders made by this process in the shared one.
_MADE: list[str] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared one, to be removed by remove() or, with all others, by clear()."""
    _MADE.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _MADE:
        _MADE.remove(path)


def clear(spark: SparkSession) -> None:
    """Removes all folders made so far; results that read them lazily are lost."""
    for path in list(_MADE):
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and store it in the shared folder, so that lost executors
    never repeat the steps before it and several readers share one pass."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table in the shared folder: smaller, and columns are read singly."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Small rows (some keys and numbers) that a task takes at least.
FEW = 1 << 16


def fewer(df: DataFrame, n: int, rows: int = FEW) -> DataFrame:
    """df, of about n rows, in no more tasks than so many rows each give, or one a core: each task of a step leaves files and
    events, however few rows it has, so that many steps over a small table would fill the disk.  Tasks grow in number with n, not in size.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)))


#: A key with more than this part of all rows is joined by broadcast.
HOT = 1000


def joined(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left with right's columns by key, where right has one row a key with n, the key's number of left's total rows.

    Keys with more than a HOT-th of all rows, fewer than HOT in number, are broadcast, so that their rows stay where they are.
    """
    hot = F.broadcast(fewer(right.where(F.col("n") * HOT > total).drop("n"), total))
    rest = right.where(F.col("n") * HOT <= total).drop("n")
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(rest, key))


def give_back() -> None:
    """Gives freed memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, but a finished task leaves no freed memory with its Python worker, which stays for other stages' tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of a batch's texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def append(df: DataFrame, fields: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with more columns, computed batch by batch; rows and other columns stay as they are.

    make() runs once in each task and returns the function from a batch to the
    new columns' values.  A column of df that has the name of a new one is replaced.
    """
    base = df.drop(*fields.names)
    schema = T.StructType(base.schema.fields + fields.fields)
    kinds = [f.type for f in to_arrow_schema(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            new = [pa.array(v, type=k) for v, k in zip(work(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return base.mapInArrow(lean(run), schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def portions(items: list[str], most_items: int = 256, most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """items in order, in lists of bounded length and size (a longer text comes alone)."""
    part: list[str] = []
    chars = 0
    for x in items:
        if part and (len(part) >= most_items or chars + len(x) > most_chars):
            yield part
            part, chars = [], 0
        part.append(x)
        chars += len(x)
    if part:
        yield part
