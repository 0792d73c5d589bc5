"""Maximal clones: longest runs of equal lines, each against the place where they first stood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut, numbered


def windows(files: DataFrame, file: str, text: str, rows: int) -> DataFrame:
    """file, i (from 1), body (digest of rows lines with white space squeezed), own (words of the first line), words: every window of every file.

    A window is made where its text lies, so no line travels; a file shorter than a window has none.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    each = files.select(F.col(file).alias("file"), lines.alias("t"), F.transform(lines, lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))).alias("n"))
    at = F.when(F.size("t") >= rows, F.sequence(F.lit(1), F.size("t") - rows + 1)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(
        i.cast("long").alias("i"), F.unhex(F.md5(F.array_join(F.slice("t", i, F.lit(rows)), "\n"))).alias("body"), F.element_at("n", i).alias("own"),
        F.aggregate(F.slice("n", i, F.lit(rows)), F.lit(0), lambda a, b: a + b).alias("words"),
    )
    return each.select("file", F.inline(F.transform(at, window)))


def maximal(files: DataFrame, file: str, text: str, rows: int = 3, tokens: int = 30) -> DataFrame:
    """file, start, first_file, first_start, lines, tokens of each clone of at least rows lines and tokens words.

    A window that stood before is paired with its first occurrence (by file and place) alone, so a window of n places has n - 1 pairs, however
    popular. Pairs of two files that lie on one diagonal and follow each other are one clone, which ends where the next
    window is new or first stood elsewhere. Rows are numbered over all tasks, so a file of any length isn't one task's. Ids of
    files must be unique; null texts have no lines.
    """
    each = cut(windows(files.where(F.col(text).isNotNull()), file, text, rows), "windows")
    classes = each.groupBy("body").agg(F.min(F.struct("file", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("body", "first")
    pairs = each.join(cut(classes, "clone-classes"), "body").where((F.col("file") != F.col("first.file")) | (F.col("i") != F.col("first.i")))
    pairs = pairs.select("file", F.col("first.file").alias("first_file"), (F.col("i") - F.col("first.i")).alias("shift"), "i", "own", "words")
    key = ["file", "first_file", "shift"]
    runs = numbered(pairs, key, ["i"]).withColumn("run", F.col("i") - F.col("position"))
    found = runs.groupBy(*key, "run").agg(F.min("i").alias("start"), (F.max("i") - F.min("i") + rows).alias("lines"), (F.sum("own") + F.max_by(F.col("words") - F.col("own"), "i")).cast("long").alias("tokens"))
    return found.where(F.col("tokens") >= tokens).select("file", "start", "first_file", (F.col("start") - F.col("shift")).alias("first_start"), "lines", "tokens")


def totals(found: DataFrame) -> DataFrame:
    """One row: clone_pairs, duplicate_lines and duplicate_tokens, summed over clones."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg(F.count(F.lit(1)).alias("clone_pairs"), whole("lines").alias("duplicate_lines"), whole("tokens").alias("duplicate_tokens"))
