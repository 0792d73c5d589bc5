"""Raw documents to packed token windows: language, quality, near duplicates, personal data, packing.

Each stage works on all that the one before it kept, returns the columns of documents (the last one the packed
pieces) and is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import langid, minhash, packing, pii, quality
from siteledger.llm.queries import pii_key, table, vocabulary
from siteledger.llm.shared import cut

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; lang becomes the predicted language of the others."""
    found = langid.predict(docs, langid.train(docs), docs.columns).where("lang_pred != 'und'")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are mostly boilerplate lines, go."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.apply(docs, field, docs.columns).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays."""
    gone = cut(minhash.classes(docs).where("not kept").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars follows the new text."""
    new = pii.rewritten(docs, pii_key(spark))
    own = {"text": F.col("text"), "n_chars": F.length("text")}
    return new.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
