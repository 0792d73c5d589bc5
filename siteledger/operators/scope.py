"""Roles of paths by the longest prefix of a manifest, and prefix filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A manifest up to this length goes to all executors as one literal; a longer one is joined.
MOST_ENTRIES = 10_000


def under(path: Column, prefix: Column) -> Column:
    return (prefix == ".") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def roles(paths: DataFrame, manifest: list[tuple[str, str]], path_col: str = "path") -> DataFrame:
    """paths with role and scope_issue. `.` is the least specific prefix; two roles at the best one conflict."""
    if len(manifest) > MOST_ENTRIES:
        return joined_roles(paths, paths.sparkSession.createDataFrame(manifest, "_prefix string, _role string"), path_col)
    path = F.col(path_col)
    entries = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(r).alias("role"), F.lit(0 if p == "." else len(p.encode())).alias("weight")) for p, r in manifest]) if manifest else F.array().cast("array<struct<prefix:string,role:string,weight:int>>")
    hits = F.filter(entries, lambda e: under(path, e["prefix"]))
    best = F.aggregate(hits, F.lit(-1), lambda m, e: F.greatest(m, e["weight"]))
    found = F.array_distinct(F.transform(F.filter("_hits", lambda e: e["weight"] == F.col("_best")), lambda e: e["role"]))
    out = paths.withColumn("_hits", hits).withColumn("_best", best).withColumn("_roles", found)
    return out.withColumn("role", F.when(F.size("_roles") == 1, F.col("_roles")[0])).withColumn(
        "scope_issue", F.when(F.size("_roles") == 0, "no role").when(F.size("_roles") > 1, "conflicting roles")
    ).drop("_hits", "_best", "_roles")


def joined_roles(paths: DataFrame, entries: DataFrame, path_col: str = "path") -> DataFrame:
    """roles() for a manifest of any length, as rows of _prefix and _role: each distinct path meets the entries by its own ancestors."""
    parts = F.split("_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("_prefix"), k.alias("_depth")))
    each = paths.select(F.col(path_col).alias("_path")).where("_path is not null").distinct()
    each = each.select("_path", F.inline(F.concat(F.array(F.struct(F.lit(".").alias("_prefix"), F.lit(0).alias("_depth"))), above)))
    per = each.join(entries.distinct(), "_prefix").groupBy("_path", "_depth").agg(F.count(F.lit(1)).alias("n"), F.min("_role").alias("role"))
    best = per.groupBy("_path").agg(F.max_by(F.struct("n", "role"), "_depth").alias("b")).select("_path", F.when(F.col("b.n") == 1, F.col("b.role")).alias("role"), F.when(F.col("b.n") > 1, "conflicting roles").alias("scope_issue"), F.lit(True).alias("_hit"))
    out = paths.join(best, F.col(path_col) == F.col("_path"), "left")
    return out.withColumn("scope_issue", F.when(F.col("_hit").isNull(), "no role").otherwise(F.col("scope_issue"))).drop("_path", "_hit")


def included(paths: DataFrame, prefixes: list[str], path_col: str = "path") -> DataFrame:
    """Rows at or under one of the prefixes; all of them if there is none."""
    if not prefixes:
        return paths
    return paths.where(F.exists(F.array(*map(F.lit, sorted(set(prefixes)))), lambda p: under(F.col(path_col), p)))


def contained(points: DataFrame, spans: DataFrame, id_col: str, key: str, at: str, start: str, end: str) -> DataFrame:
    """points with inside: whether one of the key's spans [start, end) holds the point. id_col names a point.

    A span is opened and closed by two events; along a key's sorted events a point is inside while more
    spans are open than closed. Events are sorted over all tasks, and the number of open spans is carried from task
    to task by a prefix sum for each key, so a key of any size is spread over many tasks.
    """
    from pyspark.sql import Window

    from siteledger.plans.lineage import cut

    event = lambda df, at_col, delta, id_: df.select(key, F.col(at_col).alias("_at"), F.lit(delta).alias("_delta"), id_.alias(id_col))
    none = F.lit(None).cast(points.schema[id_col].dataType)
    borders = event(spans, start, 1, none).unionByName(event(spans, end, -1, none)).groupBy(key, "_at").agg(F.sum("_delta").alias("_delta"))
    events = borders.select(key, "_at", "_delta", F.lit(0).alias("_order"), none.alias(id_col)).unionByName(event(points, at, 0, F.col(id_col)).select(key, "_at", F.col("_delta").cast("long").alias("_delta"), F.lit(1).alias("_order"), id_col))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(events.repartitionByRange(n, key, "_at", "_order", id_col).withColumn("_task", F.spark_partition_id()), "events")
    # a key has one row for each task here
    sums = laid.groupBy(F.col(key).alias("_key"), F.col("_task").alias("_t")).agg(F.sum("_delta").alias("_sum"))
    before = sums.select("_key", "_t", F.coalesce(F.sum("_sum").over(Window.partitionBy("_key").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_task", key).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    here = laid.withColumn("_here", F.sum("_delta").over(order)).where("_order = 1")
    counted = here.join(before, (here["_task"] == before["_t"]) & here[key].eqNullSafe(before["_key"])).withColumn("_open", F.col("_before") + F.col("_here"))
    return counted.select(id_col, (F.col("_open") > 0).alias("inside"))
