"""Cutting lineage in the shared folder, and numbering rows without one task for a group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.getConf().get("spark.checkpoint.dir") and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="siteledger-"))
    return sc.getCheckpointDir()


#: Folders of the written tables that clear() hasn't removed yet.
_written: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared folder, which clear() removes."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _written[-1]


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df, written as a table in the shared folder and read back."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer: a small table is one file of one row group, and so one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def clear(spark: SparkSession) -> int:
    """Remove all tables that this process has written since the last call; how many. Results that still read them must have been used."""
    n = len(_written)
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """rows with their number in the group, from 1, in the given order (which must be unique).

    Rows are sorted over all tasks; a prefix sum over the tasks' counts gives each row a place, and a group's
    first place is taken off. So a group of any size is spread over many tasks. Null groups count as one.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    laid = laid.withColumn("_task", F.shiftright("_id", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each task
    starts = laid.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", before.alias("_before"))
    placed = laid.join(F.broadcast(starts), "_task").withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_before", "_id")
    first = cut(placed.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("_place").alias("_first")), "first")
    same = [placed[g].eqNullSafe(first[f"_{g}"]) for g in group]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return placed.join(first, on).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *[f"_{g}" for g in group])
