"""Rows of the Markdown reports, under limits of rows and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions.text import percent_encoded
from siteledger.operators.history import within_budget

MOST_BYTES = 12_000


def location(path: Column, line: Column, repository: Column, revision: Column) -> Column:
    """`path:line`, as a link where the revision is verified (not null)."""
    plain = F.concat(F.lit("`"), percent_encoded(path), F.lit(":"), line.cast("string"), F.lit("`"))
    link = F.concat(F.lit("["), plain, F.lit("](https://github.com/"), repository, F.lit("/blob/"), revision, F.lit("/"), percent_encoded(path), F.lit("#L"), line.cast("string"), F.lit(")"))
    return F.coalesce(link, plain)


def listed(rows: DataFrame, group: list[str], order: list[Column], text: Column, most_rows: int = 20, most_bytes: int = MOST_BYTES) -> DataFrame:
    """group, rank, row: list items of each group's first rows, up to a number of rows and of bytes with line ends."""
    lines = rows.withColumn("row", F.concat(F.lit("* "), text))
    return within_budget(lines, group, order, F.octet_length("row"), most_rows, most_bytes).select(*group, F.col("rank").cast("bigint").alias("rank"), "row")


def hotspots(changes: DataFrame, metric: str, tie: list[str], cell: Column, most_rows: int = 5, most_bytes: int = MOST_BYTES) -> DataFrame:
    """metric, rank, row: the rows of each metric with the larger of before and after first, up to a number for each metric.

    Rows run in order of metric and rank, and end before the first that would pass the running number of bytes (with line ends).
    Only most_rows of a metric get past the map side.
    """
    worst = F.greatest("before", "after")
    order = [worst.desc(), *[F.col(c).asc_nulls_first() for c in tie], F.col("before").isNull().asc()]
    top = changes.withColumn("_rank", F.row_number().over(Window.partitionBy(metric).orderBy(*order))).where(F.col("_rank") <= most_rows)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    delta = F.when(F.col("delta").isNull(), "—").when(F.col("delta") >= 0, F.concat(F.lit("+"), F.col("delta").cast("string"))).otherwise(F.col("delta").cast("string"))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(metric).cast("string"), cell, value("before"), value("after"), delta, F.when(F.col("delta").isNotNull(), "same path/name").otherwise("not established")), F.lit(" |"))
    lines = top.select(F.col(metric).alias("metric"), F.col("_rank").cast("bigint").alias("rank"), text.alias("row"))
    # most_rows lines for each metric: bytes before a metric are a prefix sum of one row for each
    used = lines.withColumn("_inside", F.sum(F.octet_length("row") + 1).over(Window.partitionBy("metric").orderBy("rank")))
    whole = used.groupBy("metric").agg(F.max("_inside").alias("_n"))
    before = whole.select("metric", F.coalesce(F.sum("_n").over(Window.orderBy("metric").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return used.join(before, "metric").where(F.col("_before") + F.col("_inside") <= most_bytes).select("metric", "rank", "row")
