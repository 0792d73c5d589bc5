"""Append-only history of snapshots, and reports under row and byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(history: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The incoming rows to append: the first of each key that history lacks."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*").select(*incoming.columns)
    return first.join(history.select(key).distinct(), key, "left_anti").select(*incoming.columns)


def newest(history: DataFrame, time: str, id_: str, n: int) -> DataFrame:
    """The n newest rows; 1 <= n <= 1000. Each task sends n rows at most."""
    if not 1 <= n <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return history.orderBy(F.col(time).desc(), F.col(id_).desc()).limit(n)


def within_budget(rows: DataFrame, group: list[str], order: list[Column], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """The first rows of each group, up to a number and a running number of bytes (each row and a line end).

    Only the first most_rows of a group get past the map side, so a group of any size fits one task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_rows)
    run = F.sum(size + 1).over(Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("bytes_so_far", run.cast("bigint")).where(F.col("bytes_so_far") <= most_bytes)
