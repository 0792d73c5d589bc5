"""The registry of reviewed sites against a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def additions(candidates: DataFrame, registry: DataFrame, key: str, seq: str) -> DataFrame:
    """Candidates that the registry lacks; of equal keys the first by seq."""
    rest = [c for c in candidates.columns if c != key]
    first = candidates.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row")).select(key, "_row.*")
    return first.join(registry.select(key).distinct(), key, "left_anti")


def missing(candidates: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Registry rows whose candidate is gone."""
    return registry.join(candidates.select(key).distinct(), key, "left_anti")


def unreviewed(candidates: DataFrame, inside: Column, reviewed: DataFrame, key: str) -> DataFrame:
    """Candidates outside specifications that no review names; null keys stay, as nothing names them."""
    return candidates.where(~F.coalesce(inside, F.lit(False))).join(reviewed.select(key).distinct(), key, "left_anti")


def coverage(sites: DataFrame, eligible: Column, points: Column) -> DataFrame:
    """eligible, earned, coverage_percent: points earned of four for each eligible site; null if there is none."""
    out = sites.agg(F.count_if(eligible).alias("eligible"), F.coalesce(F.sum(F.when(eligible, points)), F.lit(0)).cast("bigint").alias("earned"))
    return out.withColumn("coverage_percent", F.try_divide(F.col("earned").cast("double") * 100, F.col("eligible").cast("double") * 4))
