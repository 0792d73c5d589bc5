"""The measure: live definitions over remaining decision sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of definitions that come twice, the status that stands; unknown beats live beats dead.
PRIORITY = {"unknown": 2, "live": 1, "dead": 0}


def strongest(definitions: DataFrame, key: list[str], status: str, seq: str) -> DataFrame:
    """One row for each key: highest status priority, then the earliest. Combines before the shuffle."""
    rank = F.lit(-1)
    for name, p in PRIORITY.items():
        rank = F.when(F.col(status) == name, p).otherwise(rank)
    rest = [c for c in definitions.columns if c not in key]
    return definitions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(rank, -F.col(seq))).alias("_row")).select(*key, "_row.*")


def placed(candidates: DataFrame, covered: Column, excluded: DataFrame, key: str) -> DataFrame:
    """Each candidate's part of the partition: covered, else excluded, else remaining."""
    marks = excluded.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    joined = candidates.join(marks, candidates[key] == marks["_key"], "left")
    part = F.when(covered, "covered").when(F.col("_hit"), "excluded").otherwise("remaining")
    return joined.withColumn("part", part).drop("_key", "_hit")


def state(s: Column, u: Column) -> Column:
    return F.when(u > 0, "ratio").when(s > 0, "complete").otherwise("not_applicable")


def partition_counts(parts: DataFrame) -> DataFrame:
    return parts.agg(*[F.count_if(F.col("part") == p).alias(p) for p in ("covered", "excluded", "remaining")])


def definition_counts(definitions: DataFrame, status: str) -> DataFrame:
    """Counts by status and S, the live and the unknown."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("live", "dead", "unknown")]
    return definitions.agg(*counts).withColumn("definitions", F.col("live") + F.col("unknown"))


def report(parts: DataFrame, definitions: DataFrame, status: str, issues: DataFrame | None = None) -> DataFrame:
    """The one-row measure. provisional: some issue, or some unknown definition. Both sides are single rows."""
    out = partition_counts(parts).withColumn("_one", F.lit(1)).join(definition_counts(definitions, status).withColumn("_one", F.lit(1)), "_one")
    out = out.withColumn("ratio", F.try_divide(F.col("definitions").cast("double"), F.col("remaining").cast("double")))
    out = out.withColumn("state", state(F.col("definitions"), F.col("remaining")))
    if issues is not None:
        out = out.join(issues.agg(F.count(F.lit(1)).alias("issues")).withColumn("_one", F.lit(1)), "_one")
        out = out.withColumn("provisional", (F.col("issues") > 0) | (F.col("unknown") > 0))
    return out.drop("_one")
