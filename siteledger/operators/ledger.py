"""Reconciliation of an attempt ledger with the rows and the receipt that claim to sum it up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut, numbered

START, POST, FINISH = "start", "post", "finish"


def attempts(events: DataFrame, request: str, order: str, event: str, retry: str) -> DataFrame:
    """request, starts, posts, finishes, ambiguous, broken: for each request, from its events in order.

    An attempt is a start, perhaps a post, and a finish; after a finish that schedules a retry comes the next start, and after
    any other nothing. broken counts the places where that doesn't hold. A finish that retries after a post is ambiguous. Each event meets
    the one before it by its number, so a request of any size is spread over all tasks.
    """
    rows = cut(numbered(events.select(request, order, F.col(event).alias("kind"), F.coalesce(F.col(retry), F.lit(False)).alias("again")), [request], [order]), "events")
    before = rows.select(request, (F.col("position") + 1).alias("position"), F.col("kind").alias("last_kind"), F.col("again").alias("last_again"))
    last = rows.groupBy(request).agg(F.max("position").alias("n"))
    both = rows.join(before, [request, "position"], "left").join(last, request)
    good = (
        F.when(F.col("position") == 1, F.col("kind") == START).when(F.col("last_kind") == START, F.col("kind").isin(POST, FINISH)).when(F.col("last_kind") == POST, F.col("kind") == FINISH)
        .otherwise(F.col("last_again") & (F.col("kind") == START))
    )
    ended = (F.col("position") < F.col("n")) | ((F.col("kind") == FINISH) & ~F.col("again"))
    count = lambda c: F.count_if(c)
    return both.groupBy(request).agg(
        count(F.col("kind") == START).alias("starts"), count(F.col("kind") == POST).alias("posts"), count(F.col("kind") == FINISH).alias("finishes"),
        count((F.col("kind") == FINISH) & F.col("again") & (F.col("last_kind") == POST)).alias("ambiguous"), (count(~F.coalesce(good, F.lit(False))) + count(~ended)).alias("broken"),
    )


def reconciled(found: DataFrame, claimed: DataFrame, request: str) -> DataFrame:
    """request, problem: null where the ledger holds together and the row's starts, posts and ambiguous are the ledger's."""
    mine = claimed.select(request, *[F.col(c).alias(f"row_{c}") for c in ("starts", "posts", "ambiguous")])
    both = found.withColumn("_in", F.lit(True)).join(mine.withColumn("_row", F.lit(True)), request, "full_outer")
    same = F.lit(True)
    for c in ("starts", "posts", "ambiguous"):
        same = same & F.col(c).eqNullSafe(F.col(f"row_{c}"))
    problem = F.when(F.col("_in").isNull(), "no_events").when(F.col("_row").isNull(), "no_row").when(F.col("broken") > 0, "broken_sequence").when(~same, "counters_differ")
    return both.select(request, problem.alias("problem"))
