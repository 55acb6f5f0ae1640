"""Storing intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder of its own where that is unset and the master local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(found)
    return found


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder, cutting its lineage."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Removes what cut() kept; neither df nor a frame made from it can be read any longer."""
    kept = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if kept.isDefined():
        remove(df.sparkSession, kept.get())


def tidy(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the shuffle files of frames that nothing refers to any longer: it learns of them
    when the driver collects its garbage, which one with memory left does seldom."""
    gc.collect()  # frames that only a cycle of Python objects holds
    spark._jvm.System.gc()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, which takes a fraction of what cut() does, and its path for remove()."""
    path = fresh(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1 on, in a total order: rows are numbered within the sorted ranges
    that Spark deals out, and each range starts behind the counts of those before it (one number a range)."""
    at = F.monotonically_increasing_id()  # the range in the bits from 33 on, the row in it below
    ranged = cut(df.orderBy(*order).withColumn("__at", at))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    starts, upto = [], 0
    for r in sorted(ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r.p, upto))
        upto += r.n
    ahead = df.sparkSession.createDataFrame(starts, "__p long, __ahead long")
    return ranged.join(F.broadcast(ahead), part == F.col("__p")).withColumn(name, F.col("__ahead") + row + 1).drop("__at", "__p", "__ahead")
