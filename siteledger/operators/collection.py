"""Collections of measurements: digests of what was measured and how, and differences of their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut


#: Digests that a cell holds at the most, about: hashes fall evenly into buckets.
CELL = 10_000


def set_digest(rows: DataFrame, columns: list[str], cell: int = CELL) -> DataFrame:
    """One row: the digest of the set of rows, whatever their order or number.

    A row's digest falls into a bucket by its first hex digits: two, or as many as keep a bucket to about `cell` rows. A bucket's
    digest is that of its rows' digests in order; sixteen buckets at a time become one until two digits are left, and the
    whole digest is that of those 256 in order. So no cell grows with the set.
    """
    each = cut(rows.select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("d")).distinct(), "digests")
    n, digits = each.count(), 2
    while n > cell * 16**digits:
        digits += 1
    told = lambda c: F.sha2(F.array_join(c, ""), 256).alias("d")
    buckets = each.groupBy(F.substring("d", 1, digits).alias("b")).agg(told(F.array_sort(F.collect_list("d"))))
    for k in reversed(range(2, digits)):
        buckets = buckets.groupBy(F.substring("b", 1, k).alias("p")).agg(told(F.array_sort(F.collect_list(F.struct("b", "d")))["d"])).withColumnRenamed("p", "b")
    # an empty set has the digest of an empty text
    return buckets.agg(F.sha2(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), F.lit("")), 256).alias("digest"))


def scope_digest(entries: DataFrame, path: str, role: str, reason: str, closed_world: bool) -> DataFrame:
    """One row: digest of a scope, that is of its set of entries (a null reason is an empty one) and of whether it is a closed world.

    problem is set, and the digest null, if one path and role has two reasons.
    """
    each = entries.select(F.col(path).alias("path"), F.col(role).alias("role"), F.coalesce(reason, F.lit("")).alias("reason"))
    bad = each.groupBy("path", "role").agg((F.min("reason") != F.max("reason")).alias("bad")).agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("_bad"), F.lit(1).alias("_one"))
    one = set_digest(each, ["path", "role", "reason"]).withColumn("_one", F.lit(1)).join(bad, "_one")
    whole = F.sha2(F.concat_ws("|", F.lit("scope/1"), F.lit("closed" if closed_world else "open"), "digest"), 256)
    return one.select(F.when(~F.col("_bad"), whole).alias("digest"), F.when(F.col("_bad"), "conflicting_reasons").alias("problem"))


def contract_digest(policy: dict[str, Column]) -> Column:
    """The digest of the fields that decide what is counted, in the given order; execution details such as roots stay out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in policy.items()]), {"ignoreNullFields": "false"}), 256)


def numeric_delta(before: DataFrame, after: DataFrame, group: str, name: str, value: str, status: str, versions: str) -> DataFrame:
    """group, name, delta, comparable: values that are numbers on both sides, of groups complete on both with equal versions.

    Groups that can't be compared give one row with a null name and delta. value is text; what doesn't read as a number counts as none.
    """
    side = lambda df, p: df.groupBy(group).agg(F.bool_and(F.col(status) == "complete").alias(f"{p}_done"), F.min(versions).alias(f"{p}_versions"), F.max(versions).alias(f"{p}_versions2"))
    groups = side(before, "b").join(side(after, "a"), group, "full_outer")
    one = (F.col("b_versions") == F.col("b_versions2")) & (F.col("a_versions") == F.col("a_versions2")) & (F.col("b_versions") == F.col("a_versions"))
    groups = groups.select(group, F.coalesce(F.col("b_done") & F.col("a_done") & one, F.lit(False)).alias("comparable"))
    number = lambda df, p: df.select(group, name, F.col(value).try_cast("double").alias(p)).where(F.col(p).isNotNull())
    deltas = number(before, "_b").join(number(after, "_a"), [group, name]).join(groups.where("comparable"), group)
    return deltas.select(group, name, (F.col("_a") - F.col("_b")).alias("delta"), "comparable").unionByName(groups.where("not comparable").select(group, F.lit(None).cast("string").alias(name), F.lit(None).cast("double").alias("delta"), "comparable"))


def evidence_problem(references: DataFrame, files: DataFrame, reference: str, path: str, text: str) -> DataFrame:
    """references with problem: null if `path#needle` names a file that holds the needle; the path alone needs the file only."""
    place = F.substring_index(reference, "#", 1)
    needle = F.when(F.instr(F.col(reference), "#") > 0, F.expr(f"substring({reference}, instr({reference}, '#') + 1)")).otherwise("")
    asked = references.withColumn("_path", place).withColumn("_needle", needle)
    outside = F.exists(F.split("_path", "/"), lambda x: x == "..") | F.col("_path").startswith("/")
    joined = asked.join(files.select(F.col(path).alias("_path"), F.col(text).alias("_text"), F.lit(True).alias("_there")), "_path", "left")
    problem = (
        F.when(F.coalesce(F.trim(F.col(reference)) == "", F.lit(True)), "empty").when(outside, "escapes_root").when(F.col("_there").isNull(), "no_file")
        .when((F.col("_needle") != "") & ~F.coalesce(F.col("_text").contains(F.col("_needle")), F.lit(False)), "no_marker")
    )
    return joined.withColumn("problem", problem).drop("_path", "_needle", "_text", "_there")


def clone_totals(lines: DataFrame, file: str, number: str, text: str, rows: int = 3, tokens: int = 30) -> DataFrame:
    """One row: clone_classes, clone_pairs, duplicate_lines of windows of rows lines with tokens words or more.

    Windows meet by the hash of their lines with white space squeezed. A class of n windows has n (n - 1) / 2 pairs, which
    are counted and never made; duplicate_lines are the lines that lie in a window of a class beyond its first one. number must
    count a file's lines without gaps.
    """
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    each = lines.select(F.col(file).alias("f"), F.col(number).cast("long").alias("i"), squeezed.alias("t"))
    # a line goes to the windows that hold it, so windows are groups of a few rows and no file is one task
    spread = each.select("f", F.explode(F.sequence(F.col("i") - (rows - 1), F.col("i"))).alias("start"), "i", "t")
    windows = spread.groupBy("f", "start").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("body"))
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    good = windows.where((F.col("n") == rows) & (words >= tokens)).select("f", "start", F.sha2("body", 256).alias("h"))
    classes = good.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("f", "start")).alias("first")).where("n > 1")
    twins = good.join(classes, "h").where((F.col("f") != F.col("first.f")) | (F.col("start") != F.col("first.start")))
    covered = twins.select("f", F.explode(F.sequence(F.col("start"), F.col("start") + rows - 1)).alias("i")).distinct()
    one = F.lit(1).alias("_one")
    total = classes.agg(F.count(F.lit(1)).alias("clone_classes"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("bigint").alias("clone_pairs"), one)
    return total.join(covered.agg(F.count(F.lit(1)).alias("duplicate_lines"), one), "_one").drop("_one")
