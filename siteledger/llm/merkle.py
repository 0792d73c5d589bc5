"""A Merkle manifest of a table: digests of rows, trees of them for each group, one tree over the groups, proofs.

Bottom up, a tree is built in strata of STRIDE levels: a block of ARITY ** STRIDE neighbouring nodes makes all its
levels in one row, which is written, and hands its top to the next stratum. So N rows are shuffled once and the strata above
hold N / 256 of them, and no row holds more than a block, however many rows a group has. Top down, each stratum's blocks meet
the proof that their top inherited, and each child puts its own siblings before that suffix. A node alone in its run
becomes the digest of itself, which is a step without siblings.

Null fields have a sign of their own, so null and empty texts differ. Groups are ordered by their bytes, null first; rows by their key, nulls
first, then by their digest, so equal rows are interchangeable. An empty table has no rows and no root. A text of any length
is digested in one pass and travels no further. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.shared import cut
from siteledger.plans.lineage import numbered

ARITY, STRIDE = 2, 8
#: A proof: at each level the node's place in its run and the run's other digests.
STEPS = "array<struct<place:int,others:array<string>>>"


def digest(*fields: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of fields one after the other: "-" for null, else the count of bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def parents(level: Column, arity: int) -> Column:
    """Digests of the runs of arity neighbours in a list of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * arity + 1, F.lit(arity)), ""), 256))


def strata(nodes: DataFrame, most: int, arity: int = ARITY, stride: int = STRIDE) -> list[DataFrame]:
    """tree, n, block, levels, lowest stratum first, each written; nodes: tree, n (nodes of the tree), place (from 0), digest.

    levels holds the block's digests level by level, up to its top alone. most is the largest n. A tree is in all
    strata up to the one where one block holds all its nodes.
    """
    out, wide = [], arity**stride
    while True:
        blocks = nodes.groupBy("tree", "n", F.expr(f"place div {wide}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"].alias("l0"))
        for k in range(stride):  # a level of its own for each step, so that none is computed twice
            blocks = blocks.withColumn(f"l{k + 1}", F.when(F.col("n") > arity**k, parents(F.col(f"l{k}"), arity)))
        out.append(cut(blocks.select("tree", "n", "block", F.array_compact(F.array(*[f"l{k}" for k in range(stride + 1)])).alias("levels")), "stratum"))
        if most <= wide:
            return out
        most = -(-most // wide)
        nodes = out[-1].where(F.col("n") > wide).select("tree", F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), F.col("block").alias("place"), top().alias("digest"))


def top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def tops(built: list[DataFrame], arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """tree, digest: each tree's root."""
    return reduce(DataFrame.unionByName, [s.where(F.col("n") <= arity**stride).select("tree", top().alias("digest")) for s in built])


def steps(at: Column, arity: int, stride: int) -> Column:
    """The way of the node at a place of its block up to the block's top: at each level its place in the run and the run's others."""
    def step(k: int) -> Column:
        here = F.floor(at / arity**k).cast("int")
        mine = here % arity
        run = F.slice(F.get("levels", F.lit(k)), here - mine + 1, F.lit(arity))
        return F.when(F.size("levels") > k + 1, F.struct(mine.alias("place"), F.filter(run, lambda x, i: i != mine).alias("others")))

    return F.array_compact(F.array(*[step(k) for k in range(stride)]))


def proofs(built: list[DataFrame], above: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """tree, place, digest, proof: of each lowest node, from itself to the end of the proof that above (tree, proof) gives its root."""
    wide, suffixes = arity**stride, None
    for k, stratum in reversed(list(enumerate(built))):
        mine = stratum.where(F.col("n") <= wide).select("tree", "block").join(above, "tree")
        suffixes = mine if suffixes is None else mine.unionByName(suffixes.select("tree", F.col("place").alias("block"), "proof"))
        each = stratum.join(suffixes, ["tree", "block"]).select("tree", "block", "levels", "proof", F.posexplode(F.get("levels", F.lit(0))).alias("at", "digest"))
        each = each.select("tree", (F.col("block") * wide + F.col("at")).alias("place"), "digest", F.concat(steps(F.col("at"), arity, stride), "proof").alias("proof"))
        suffixes = cut(each, "proofs") if k else each
    return suffixes


def folded(start: Column, proof: Column) -> Column:
    """The root that a digest and a proof lead to."""
    def up(below: Column, step: Column) -> Column:
        others = step["others"]
        return F.sha2(F.concat(F.array_join(F.slice(others, F.lit(1), step["place"]), ""), below, F.array_join(F.slice(others, step["place"] + 1, F.size(others)), "")), 256)

    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """All siblings of a proof, in order, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), "")


def manifest(rows: DataFrame, group: str, order: str, leaf: str, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """rows with subroot, root and proof (steps from the leaf to the root); rows has none of these columns, nor tree, n or place.

    rows is written once before it is sorted, so its digests aren't computed again for the sort's sample.
    """
    rows = cut(rows, "leaves")
    placed = cut(numbered(rows, [group], [order, leaf], "place").withColumn("place", F.col("place") - 1), "placed")
    groups = placed.groupBy(F.col(group).alias("_group")).agg((F.max("place") + 1).alias("n"))
    groups = cut(numbered(groups.withColumn("_all", F.lit(0)), ["_all"], ["_group"], "tree").drop("_all"), "groups")
    nodes = cut(placed.join(groups, F.col(group).eqNullSafe(F.col("_group"))).drop("_group"), "nodes")
    most, trees = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    low = strata(nodes.select("tree", "n", "place", F.col(leaf).alias("digest")), most or 0, arity, stride)
    subroots = cut(tops(low, arity, stride), "subroots")
    high = strata(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).alias("n"), (F.col("tree") - 1).alias("place"), "digest"), trees, arity, stride)
    root = tops(high, arity, stride).select("tree", F.col("digest").alias("root"))
    over = proofs(high, root.select("tree", F.array().cast(STEPS).alias("proof")), arity, stride)
    above = cut(over.join(root, "tree").select((F.col("place") + 1).alias("tree"), F.col("digest").alias("subroot"), "root", "proof"), "above")
    found = proofs(low, above.select("tree", "proof"), arity, stride).select("tree", "place", "proof")
    return nodes.join(found, ["tree", "place"]).join(above.drop("proof"), "tree").drop("tree", "place", "n")
