"""Reachability with least depths, by rounds of joins whose state is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut

#: Rounds after which long chains are jumped.
PLAIN = 10


def leaps(edges: DataFrame) -> list[DataFrame]:
    """_from, _to, _steps by powers of two: where the nodes with a single edge get by 1, 2, 4, ... steps along such nodes.

    Each table is at most one row for each such node, and the last one is the one before none gets further; on a cycle,
    whose steps never end, the one that is longer than there are nodes.
    """
    single = cut(edges.groupBy("_from").agg(F.min("_to").alias("_to"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_from", "_to"), "leap")
    n, out = single.count(), []
    while not single.isEmpty():
        out.append(single.withColumn("_steps", F.lit(1 << len(out))))
        if 1 << len(out) > n:
            break
        again = single.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        single = cut(single.join(again, "_to").select("_from", F.col("_next").alias("_to")), "leap")
    return out


def stepped(front: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """node, depth of what front reaches along each edge; edges: _from, _to, _steps."""
    return front.join(edges, front[node] == edges["_from"]).select(F.col("_to").alias(node), (F.col("depth") + F.col("_steps")).alias("depth"))


def reached(seeds: DataFrame, edges: DataFrame, node: str, source: str, target: str, rounds: int | None = None, log: list[str] | None = None) -> DataFrame:
    """node, depth: nodes that seeds reach along edges, with the least number of steps. Cycles end by themselves.

    A round takes a step from the nodes whose depth fell in the last one and writes each node's least depth. If that hasn't ended after
    PLAIN rounds, chains of nodes with a single edge are also jumped, by all powers of two from the
    largest down, so a chain of any length takes a logarithmic number of joins. Depths only fall, so what a jump finds too far away is mended
    later. Rounds follow the number of branches on the longest path. With rounds given, there are so many and no jumps. Null ids have no edges.
    """
    edges = cut(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where("_from is not null and _to is not null").distinct().withColumn("_steps", F.lit(1)), "edges")
    state = cut(seeds.select(F.col(node)).distinct().select(node, F.lit(0).alias("depth"), F.lit(None).cast("int").alias("_old")), "reached")
    jumps: list[DataFrame] | None = None
    k = 0
    while rounds is None or k < rounds:
        front = state.where("_old is null or depth < _old").select(node, "depth")
        if front.isEmpty():
            break
        k += 1
        found = state.select(node, "depth", F.col("depth").alias("_old"))
        if rounds is None and k > PLAIN:
            jumps = leaps(edges) if jumps is None else jumps
            for leap in reversed(jumps):
                front = cut(front.unionByName(stepped(front, leap, node)).groupBy(node).agg(F.min("depth").alias("depth")), "jumped")
            found = found.unionByName(front.withColumn("_old", F.lit(None).cast("int")))
        found = found.unionByName(stepped(front, edges, node).withColumn("_old", F.lit(None).cast("int")))
        state = cut(found.groupBy(node).agg(F.min("depth").alias("depth"), F.min("_old").alias("_old")), "reached")
        if log is not None:
            log.append(f"round {k}: {len(jumps or [])} jumps")
    return state.select(node, "depth")
