"""Helpers that the operators of this subpackage share: the shared folder, lineage cuts and byte shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.plans.lineage import cut, new_path, shared_dir

__all__ = ["annotated", "cut", "new_path", "read_shards", "shared_dir", "write_shards"]


def annotated(docs: DataFrame, keep: list[str], text_col: str, answer: Callable[[list[str | None]], Iterator[list]], new: str) -> DataFrame:
    """row (a struct of the kept columns, so no names clash) and the new columns that answer gives for texts.

    answer takes the texts of a batch and yields arrays for runs of them, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for arrays in answer(batch.column(1).to_pylist()):
                n = len(arrays[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(a) for a in arrays)], names=["row", *[c.split()[0] for c in new.split(", ")]])
                at += n

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T._parse_datatype_string(new).fields]))


def write_shards(df: DataFrame, shard: str, total: str, blob: str, path: str) -> None:
    """One file for each row of df: the bytes in blob and a final newline, in path/shard=N/total=M.

    Spark's text writer puts bytes out as they are, and its committer keeps only files of
    tasks that succeeded, on any store that Spark can reach.
    """
    df.select(F.col(shard).alias("shard"), F.col(total).alias("total"), F.col(blob).cast("string").alias("value")).write.partitionBy("shard", "total").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, total, content of the files that write_shards wrote; content is only read where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    number = lambda name: F.regexp_extract("path", rf"/{name}=(-?\d+)/", 1).cast("long").alias(name)
    return files.select(number("shard"), number("total"), "content")
