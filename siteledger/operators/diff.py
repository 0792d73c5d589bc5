"""Differences of snapshots: grouped keys, multisets, functions, counters, whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import numbered


def inventory(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, n_before, n_after, change for keys whose counts differ: added, removed, or ambiguous if both sides have some.

    Both sides are counted before they meet, so a key of many rows travels as one row for each task.
    """
    tagged = before.select(*key, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(*key, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    out = tagged.groupBy(*key).agg(F.sum("_b").cast("bigint").alias("n_before"), F.sum("_a").cast("bigint").alias("n_after")).where("n_before != n_after")
    return out.withColumn("change", F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed").otherwise("ambiguous"))


def listed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in the order of reports, nulls first. For outputs only: the sort is over all rows."""
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in order])


def introduced(before: DataFrame, after: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """after with introduced: whether a row goes beyond the number of equal keys before, in the given order."""
    old = before.groupBy(*key).agg(F.count(F.lit(1)).alias("_old"))
    placed = numbered(after, key, order, "occurrence").join(old, key, "left")
    return placed.withColumn("introduced", F.col("occurrence") > F.coalesce("_old", F.lit(0))).drop("_old")


def functions(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Function metrics by key: before, after, delta, correspondence.

    A key that each side has once is matched; equal multisets of values are unchanged and left out; all other
    keys are ambiguous, added or removed, and an absent side is null, never zero.
    """
    tagged = before.select(*key, value, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(*key, value, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    # counts of values meet, not values, so a key of many rows travels as one row for each task
    counts = tagged.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_value")).agg(F.sum("_b").alias("_nb"), F.sum("_a").alias("_na"))
    some = lambda n: F.max(F.when(F.col(n) > 0, F.col("_value")))
    each = counts.groupBy(*key).agg(F.bool_or(F.col("_nb") != F.col("_na")).alias("_differs"), F.sum("_nb").alias("_before"), F.sum("_na").alias("_after"), some("_nb").alias("_vb"), some("_na").alias("_va"))
    one = (F.col("_before") == 1) & (F.col("_after") == 1)
    kind = F.when(one, "matched").when(F.col("_before") == 0, "added").when(F.col("_after") == 0, "removed").otherwise("ambiguous")
    single = lambda n, v: F.when(F.col(n) == 1, F.col(v))
    return each.where("_differs").select(*key, single("_before", "_vb").alias("before"), single("_after", "_va").alias("after"), F.when(one, F.col("_va") - F.col("_vb")).alias("delta"), kind.alias("correspondence"))


def severity(rows: DataFrame, metric: str, tie: list[str]) -> list[Column]:
    """Sort order of changes: metric, larger of both values first, then the tie columns, nulls first."""
    return [F.col(metric).asc(), F.greatest("before", "after").desc(), *[F.col(c).asc_nulls_first() for c in tie]]


def ranked(rows: DataFrame, metric: str, tie: list[str]) -> DataFrame:
    """rows with rank among the changes of their metric, in the order of severity(), over all rows; tie must tell rows of a metric apart."""
    return numbered(rows.withColumn("_less", -F.greatest("before", "after")), [metric], ["_less", *tie], "rank").drop("_less")


def counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """counter, before, after, delta of two one-row frames with the same numeric columns."""
    stacked = lambda df, name: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("double").alias(name)) for c in df.columns])))
    out = stacked(before, "before").join(stacked(after, "after"), "counter", "full_outer")
    return out.withColumn("delta", F.col("after") - F.col("before"))


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with side; empty if the frames are equal as multisets."""
    only = lambda a, b, name: a.exceptAll(b).withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def key_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row: added, removed, changed, unchanged."""
    a, b = old.select(F.col(key), F.col(value).alias("_old")), new.select(F.col(key), F.col(value).alias("_new"))
    both = a.withColumn("_in_old", F.lit(True)).join(b.withColumn("_in_new", F.lit(True)), key, "full_outer")
    here, gone = F.col("_in_old").isNull(), F.col("_in_new").isNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return both.agg(F.count_if(here).alias("added"), F.count_if(gone).alias("removed"), F.count_if(~here & ~gone & ~same).alias("changed"), F.count_if(~here & ~gone & same).alias("unchanged"))
