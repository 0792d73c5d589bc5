"""Overlap of feature sets: sites against rule templates, and related sites of one kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut


def near_templates(sites: DataFrame, templates: DataFrame, site_id: str, template_id: str, features: str, least: int = 3) -> DataFrame:
    """site, template, common, total of pairs with common >= least and 2 * common >= total features of both.

    Such a pair shares at least half of the larger set, so a site with over twice the features of the largest template is
    out at once, and the pair shares one of any half + 1 of the template's features: only the rarest so many are looked up.
    """
    most = templates.agg(F.max(F.size(features))).first()[0] or 0
    hashed = F.transform(F.col(features), lambda x: F.xxhash64(x))
    small = cut(sites.where(F.size(features) <= 2 * most).select(F.col(site_id), hashed.alias("_site")), "sites")
    asked = cut(templates.select(F.col(template_id), hashed.alias("_template")), "templates")
    each = small.select(site_id, F.explode("_site").alias("feature"))
    wanted = asked.select(F.explode("_template").alias("feature")).distinct()
    df = each.join(wanted, "feature", "left_semi").groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy(template_id).orderBy("df", "feature")
    rare = asked.select(template_id, F.size("_template").alias("n"), F.explode("_template").alias("feature")).join(df, "feature", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = rare.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= F.floor(F.col("n") / 2) + 1).select(template_id, "n", "feature")
    sized = small.select(site_id, F.size("_site").alias("m"), F.explode("_site").alias("feature"))
    pairs = sized.join(rare, "feature").where("m <= 2 * n and n <= 2 * m").select(site_id, template_id).distinct()
    wide = pairs.join(small, site_id).join(asked, template_id)
    common = F.size(F.array_intersect("_site", "_template"))
    out = wide.select(site_id, template_id, common.cast("bigint").alias("common"), (F.size("_site") + F.size("_template") - common).cast("bigint").alias("total"))
    return out.where((F.col("common") >= least) & (2 * F.col("common") >= F.col("total")))


def related(sites: DataFrame, group: list[str], order: str, most: int = 8) -> DataFrame:
    """For each site up to `most` other sites of its group, the first ones by order: order column, related, rank.

    A group sends its first most + 1 sites to the join, so the result grows with the sites alone.
    """
    w = Window.partitionBy(*group).orderBy(order)
    first = sites.select(*group, F.col(order).alias("related"), F.row_number().over(w).alias("_rank")).where(F.col("_rank") <= most + 1)
    joined = sites.select(*group, order).join(first, group).where(F.col("related") != F.col(order))
    again = joined.groupBy(*group, order).agg(F.slice(F.array_sort(F.collect_list("related")), 1, most).alias("_all"))
    return again.select(order, F.posexplode("_all").alias("_pos", "related")).select(order, "related", (F.col("_pos") + 1).cast("bigint").alias("rank"))
