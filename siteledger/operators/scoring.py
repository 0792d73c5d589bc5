"""Scores of predictions against references, between arms, and between repeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, reference: str, predicted: str, labels: list[str]) -> DataFrame:
    """reference, predicted, n for every pair of labels, zeros included."""
    found = rows.groupBy(F.col(reference).alias("reference"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "reference string, predicted string")
    return grid.join(found, ["reference", "predicted"], "left").select("reference", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def metrics(rows: DataFrame, reference: str, predicted: str, labels: list[str]) -> DataFrame:
    """label, support, precision, recall, f1; null where a denominator is zero."""
    per = []
    for label in labels:
        r, p = F.col(reference) == label, F.col(predicted) == label
        per.append(F.struct(F.lit(label).alias("label"), F.count_if(r & p).alias("tp"), F.count_if(p).alias("positive"), F.count_if(r).alias("support")))
    out = rows.agg(F.array(*per).alias("_all")).select(F.inline("_all"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("positive"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), F.col("positive") + F.col("support"))).select("label", "support", "precision", "recall", "f1")


def summary(rows: DataFrame, reference: str, predicted: str, labels: list[str], abstain: str | None = None) -> DataFrame:
    """One row: n, matched, accuracy, macro_f1 (over labels that have one), abstention, coverage."""
    macro = metrics(rows, reference, predicted, labels).agg(F.avg("f1").alias("macro_f1"), F.lit(1).alias("_one"))
    away = (F.col(predicted) == abstain) if abstain else F.lit(False)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(reference) == F.col(predicted)).alias("matched"), F.count_if(away | F.col(predicted).isNull()).alias("abstained"))
    ratio = lambda a: F.try_divide(a.cast("double"), F.col("n").cast("double"))
    out = out.withColumn("accuracy", ratio(F.col("matched"))).withColumn("abstention", ratio(F.col("abstained"))).withColumn("coverage", ratio(F.col("n") - F.col("abstained")))
    return out.withColumn("_one", F.lit(1)).join(macro, "_one").drop("_one")


def paired_gains(rows: DataFrame, case: str, arm: str, right: Column, first: str, second: str) -> DataFrame:
    """One row: cases, gains (second right, first wrong), losses, net. Only cases that both arms have."""
    side = lambda name: F.max(F.when(F.col(arm) == name, right.cast("int")))
    both = rows.groupBy(case).agg(side(first).alias("a"), side(second).alias("b")).where("a is not null and b is not null")
    out = both.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("b") > F.col("a")).alias("gains"), F.count_if(F.col("b") < F.col("a")).alias("losses"))
    return out.withColumn("net", F.col("gains") - F.col("losses"))


def repeat_stability(rows: DataFrame, case: str, repeat: str, label: str, confidence: str) -> DataFrame:
    """One row: pairs (cases with repeats 1 and 2), changed labels, largest confidence difference."""
    pick = lambda k, c: F.max(F.when(F.col(repeat) == k, F.col(c)))
    out = rows.groupBy(case).agg(*[pick(k, c).alias(f"{c}{k}") for k in (1, 2) for c in (label, confidence)]).where(f"{label}1 is not null and {label}2 is not null")
    return out.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col(f"{label}1") != F.col(f"{label}2")).alias("changed"), F.max(F.abs(F.col(f"{confidence}1") - F.col(f"{confidence}2"))).alias("max_delta"))


def agreement(rows: DataFrame, view: str, case: str, annotator: str, label: str) -> DataFrame:
    """view, cases, unanimous, pairs, agreeing: over all unordered pairs of annotators of a case, counted without making them."""
    per = rows.groupBy(view, case, label).agg(F.count(F.lit(1)).alias("n"))
    cases = per.groupBy(view, case).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"))
    return cases.groupBy(view).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("labels") == 1).alias("unanimous"), F.sum(F.expr("`all` * (`all` - 1) div 2")).cast("bigint").alias("pairs"), F.sum("same").cast("bigint").alias("agreeing"))


def configuration_groups(rows: DataFrame, config: str, mode: str, modes: list[str]) -> DataFrame:
    """config, counts by mode, balanced (all modes equally often)."""
    out = rows.groupBy(config).agg(*[F.count_if(F.col(mode) == m).alias(m) for m in modes])
    return out.withColumn("balanced", F.size(F.array_distinct(F.array(*modes))) == 1)


def usage(rows: DataFrame, group: list[str], tokens: list[str], model: str) -> DataFrame:
    """Sums of tokens (null if none is metered), and the distinct models, sorted."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in tokens], F.array_sort(F.collect_set(model)).alias("models"))


def interval(families: DataFrame, family: str, gain: str, draws: int = 2000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """low, high: percentile bootstrap of the mean gain by families, of any number; no row if there is none.

    A draw weighs a family by how often it would be taken, which is nearly Poisson with mean 1. That number comes from an MD5 of seed,
    draw and family, so tasks add up their own families and only one row for each draw and task is shuffled. A quantile
    is the element int(q * (n - 1)) of the sorted means, with no interpolation. A draw without any family counts as 0.
    """
    each = families.groupBy(family).agg(F.sum(F.col(gain).cast("double")).alias("s"), F.count(gain).alias("n"))
    drawn = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", F.col(family).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    below, term, times = 0.0, math.exp(-1), F.lit(0)
    for k in range(1, 18):
        below += term
        times = times + F.when(u >= below, 1).otherwise(0)
        term /= k
    means = drawn.withColumn("w", times).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n")).cast("double")).alias("mean"))
    ordered = means.agg(F.array_sort(F.collect_list(F.coalesce("mean", F.lit(0.0)))).alias("m"))  # one number for each draw
    at = lambda q: F.element_at("m", int(q * (draws - 1)) + 1)
    return ordered.where(F.size("m") > 0).select(at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def probability_change(before: Column, after: Column, slack: str = "0.005") -> Column:
    """low, high, sign of a difference of rounded probabilities, in exact decimals."""
    dec = lambda c: c.cast("string").cast("decimal(20,10)")
    two = F.lit(slack).cast("decimal(20,10)")
    low = F.greatest(dec(after) - two, F.lit(0).cast("decimal(20,10)")) - F.least(dec(before) + two, F.lit(1).cast("decimal(20,10)"))
    high = F.least(dec(after) + two, F.lit(1).cast("decimal(20,10)")) - F.greatest(dec(before) - two, F.lit(0).cast("decimal(20,10)"))
    sign = F.when(low > 0, "positive").when(high < 0, "negative").otherwise("unresolved")
    return F.struct(low.alias("low"), high.alias("high"), sign.alias("sign"))
