"""An index of documents' vectors: what an update has to encode, publication as a whole, and reads that refuse stale data.

Layout under a root in shared storage: `vectors/<random>` (cache key, vector), a folder for each encoding; `data/<random>` (id, cache key), one folder for each
publication, and a log of numbered entries that name them (see versions). An entry is put last, and only if its number is free: an update that fails
leaves the version before it in use, and of two publishers at once each gets a number of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.sources import versions


def cache_key(profile: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(profile), text), 256)


def update_plan(current: DataFrame, previous: DataFrame, cached: DataFrame, id_: str, key: str) -> DataFrame:
    """One row: documents, added, removed, changed, encode_inputs (distinct keys without a vector), reused_documents, repeated_ids."""
    now = current.groupBy(id_).agg(F.min(key).alias("_new"), F.count(F.lit(1)).alias("_times"))
    both = now.join(previous.select(id_, F.col(key).alias("_old")), id_, "full_outer").join(cached.select(F.col(key).alias("_new"), F.lit(True).alias("_have")).distinct(), "_new", "left")
    here, was, have = F.col("_new").isNotNull(), F.col("_old").isNotNull(), F.col("_have").isNotNull()
    return both.agg(
        F.count_if(here).alias("documents"), F.count_if(here & ~was).alias("added"), F.count_if(was & ~here).alias("removed"), F.count_if(here & was & (F.col("_new") != F.col("_old"))).alias("changed"),
        F.count_distinct(F.when(here & ~have, F.col("_new"))).alias("encode_inputs"), F.count_if(here & have).alias("reused_documents"), F.count_if(F.col("_times") > 1).alias("repeated_ids"),
    )


def active(spark: SparkSession, root: str) -> DataFrame | None:
    """id, key, profile, source of the newest version; None if there is none."""
    found = versions.numbers(spark, root)
    return spark.read.parquet(f"{root}/data/{versions.entry(spark, root, found[-1])['folders'][-1]}") if found else None


def cached_keys(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{root}/vectors/*").select("key")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "key string")


def publish(documents: DataFrame, root: str, profile: str, source: str, encode: Callable[[DataFrame], DataFrame], id_: str = "id", text: str = "text") -> int:
    """Encode texts whose key has no vector (encode: key, text to key, vector), then write the next version; its number."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_).alias("id"), F.col(text).alias("text"), cache_key(profile, F.col(text)).alias("key"))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("document ids are not unique")
    missing = rows.groupBy("key").agg(F.first("text").alias("text")).join(cached_keys(spark, root), "key", "left_anti")
    encode(missing).select("key", "vector").write.parquet(f"{root}/vectors/{uuid.uuid4().hex}")
    lost = rows.select("key").join(cached_keys(spark, root), "key", "left_anti").limit(1).count()
    if lost:
        raise ValueError("the encoder returned too few vectors")
    folder = uuid.uuid4().hex
    rows.select("id", "key", F.lit(profile).alias("profile"), F.lit(source).alias("source")).write.parquet(f"{root}/data/{folder}")
    version = (versions.numbers(spark, root) or [0])[-1] + 1
    while not versions.put_if_absent(spark, root, version, {"folders": [folder]}):
        version += 1
    return version


def read_snapshot(documents: DataFrame, root: str, profile: str, source: str, id_: str = "id", text: str = "text") -> DataFrame:
    """id, vector of the active version; refuses one of another source or profile, or whose documents differ from those given."""
    spark = documents.sparkSession
    manifest = active(spark, root)
    if manifest is None:
        raise ValueError("there is no index")
    if manifest.where((F.col("profile") != profile) | (F.col("source") != source)).limit(1).count():
        raise ValueError("the index is stale: another source or profile")
    wanted = documents.select(F.col(id_).alias("id"), cache_key(profile, F.col(text)).alias("wanted"))
    if wanted.join(manifest, "id", "full_outer").where(~F.col("wanted").eqNullSafe(F.col("key"))).limit(1).count():
        raise ValueError("the index is stale: documents differ")
    return manifest.join(spark.read.parquet(f"{root}/vectors/*").dropDuplicates(["key"]), "key").select("id", "vector")
