"""Trees of digests over tables, and differences that open only what is unequal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut

#: Digests that a bucket holds at the most, but for one digest that comes often, which is one entry with its number.
BUCKET = 1024


@dataclass(frozen=True)
class Tree:
    """leaves: prefix, digest, entries (digest:count of each row, in order); levels[k]: prefix of k hex digits, digest."""

    leaves: DataFrame
    levels: list[DataFrame]

    def root(self) -> DataFrame:
        """digest: one row, also for no rows."""
        top = self.levels[0]
        return top.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def row_digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """digest, n: each different row and how often it comes."""
    told = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(told.alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def tree(rows: DataFrame, columns: list[str], depth: int | None = None, bucket: int = BUCKET) -> Tree:
    """The tree of a multiset of rows, whatever their order.

    Rows are dealt by the first hex digits of their digests; digits are added until no bucket holds more than bucket, so
    cells are bounded at any size. A bucket's digest is that of its entries, a node's that of its children, of which
    there are sixteen at the most. With a depth given, it is at least that, so two trees can be compared.
    """
    each = cut(row_digests(rows, columns), "rows")
    n, digits = each.count(), depth or 0
    while n > bucket * 16**digits or (n and each.groupBy(F.substring("digest", 1, digits)).count().agg(F.max("count")).first()[0] > bucket):
        digits += 1
    entries = F.array_sort(F.collect_list(F.concat_ws(":", "digest", "n"))).alias("entries")
    leaves = cut(each.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(entries).withColumn("digest", F.sha2(F.array_join("entries", ""), 256)), "leaves")
    levels = [leaves.select("prefix", "digest")]
    for k in reversed(range(digits)):
        below = levels[0].groupBy(F.substring("prefix", 1, k).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("prefix", "digest")))["digest"].alias("d"))
        levels.insert(0, cut(below.select(F.col("parent").alias("prefix"), F.sha2(F.array_join("d", ""), 256).alias("digest")), "level"))
    return Tree(leaves, levels)


def matched_depth(before: DataFrame, after: DataFrame, columns: list[str], bucket: int = BUCKET) -> tuple[Tree, Tree]:
    """The trees of two tables with equal depths."""
    a = tree(before, columns, bucket=bucket)
    b = tree(after, columns, len(a.levels) - 1, bucket)
    return (a if len(a.levels) == len(b.levels) else tree(before, columns, len(b.levels) - 1, bucket)), b


def descent(a: Tree, b: Tree) -> DataFrame:
    """prefix of the leaves whose digests differ: each level is read only below the unequal nodes of the one above."""
    open_ = None
    for k, (x, y) in enumerate(zip(a.levels, b.levels, strict=True)):
        if open_ is not None:
            keep = open_.select(F.col("prefix").alias("parent"))
            x, y = (t.join(keep, F.substring("prefix", 1, k - 1) == F.col("parent"), "left_semi") for t in (x, y))
        both = x.select("prefix", F.col("digest").alias("x")).join(y.select("prefix", F.col("digest").alias("y")), "prefix", "full_outer")
        open_ = cut(both.where("not (x <=> y)").select("prefix"), "unequal")
    return open_


def changed(a: Tree, b: Tree) -> DataFrame:
    """digest, n_before, n_after of rows that one side has more often; only unequal leaves are opened."""
    open_ = descent(a, b)
    entry = lambda t, n: t.leaves.join(open_, "prefix", "left_semi").select(F.explode("entries").alias("e")).select(F.substring_index("e", ":", 1).alias("digest"), F.substring_index("e", ":", -1).cast("long").alias(n))
    both = entry(a, "n_before").join(entry(b, "n_after"), "digest", "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.where("n_before != n_after")
