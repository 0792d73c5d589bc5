"""Near-duplicate vectors: navigable small-world graphs per shard, queried by every vector of the label.

Equal vectors of a label stand for one. A label's vectors are dealt to shards of about SHARD; a task
builds a shard's hierarchical graph and searches it with the shard's own vectors. A search goes down the
layers, runs a beam on the lowest one, and then opens all vectors within a margin of the threshold until
no new one comes. A sample of searches is compared with a scan of the shard; while the recall is under
1, beam and margin are widened, up to the whole shard. All links are verified by cosine in double
precision. Where a label has several shards, every vector is searched in each shard of a larger number too; a link
that is found there counts for both ends, so two shards meet once. Tiles of TILE
shards' graphs meet tiles of TILE shards' vectors, so a graph travels once for every TILE shards. Tasks
return counts of links and links between components, never all pairs. audits() gives each shard's measured recall.

Vectors that are null, zero, or hold null or non-finite components, and null labels, link with
nothing. Vectors of unlike length link with nothing. Rows with equal ids and unlike vectors keep their
rows. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.graph import components
from siteledger.llm.shared import cut

COSINE = 0.98
SHARD, TILE = 4000, 8
#: Links of a node in upper layers and in the lowest, and the beam of insertion.
M, M0, EF_BUILD = 12, 24, 48
#: First beam and margin of a search, and searches of each call that are audited.
EF, MARGIN, AUDIT = 32, 0.05, 256
#: Vectors inserted or searched at a time.
BATCH = 256


class Graph:
    """Unit vectors with neighbours by layer; -1 where there is none. Nodes are in order of falling level."""

    def __init__(self, unit: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = len(unit)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(np.int64), 6)
        self.order = np.argsort(-level, kind="stable")
        self.unit, self.level = unit[self.order], level[self.order]
        self.near = [np.full((n, (M0 + 4) if k == 0 else M), -1, np.int32) for k in range(int(self.level[0]) + 1)]
        at = 1
        while at < n:
            # a batch has nodes of one level, and is no larger than what is there already
            stop = min(n, at + min(BATCH, at), int(np.searchsorted(-self.level, -self.level[at], "right")))
            self._insert(np.arange(at, stop))
            at = stop
        self._mend()

    def _beam(self, query: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes that a beam finds for each query, best first; -1 past the end."""
        near, q = self.near[layer], len(query)
        nodes = np.full((q, ef), -1, np.int64)
        sims = np.full((q, ef), -np.inf)
        nodes[:, 0] = entry
        sims[:, 0] = np.einsum("qd,qd->q", query, self.unit[entry])
        opened = np.zeros((q, ef), bool)
        seen = np.zeros((q, len(self.unit)), bool)
        seen[np.arange(q), entry] = True
        live = np.arange(q)
        while len(live):
            best = np.where(opened[live] | (nodes[live] < 0), -np.inf, sims[live])
            pick = best.argmax(1)
            more = best[np.arange(len(live)), pick] > -np.inf
            live, pick = live[more], pick[more]
            if not len(live):
                break
            opened[live, pick] = True
            new = near[nodes[live, pick]].astype(np.int64)
            fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            row, col = np.nonzero(fresh)
            seen[live[row], new[row, col]] = True
            sim = np.full(new.shape, -np.inf)
            sim[row, col] = np.einsum("rd,rd->r", query[live[row]], self.unit[new[row, col]])
            all_sims = np.concatenate([sims[live], sim], 1)
            all_nodes = np.concatenate([nodes[live], np.where(fresh, new, -1)], 1)
            all_open = np.concatenate([opened[live], np.zeros(new.shape, bool)], 1)
            top = np.argpartition(-all_sims, ef - 1, 1)[:, :ef] if ef < all_sims.shape[1] else np.arange(ef)[None].repeat(len(live), 0)
            sims[live], nodes[live], opened[live] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_nodes, all_open))
        best = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)

    def _entry(self, query: np.ndarray, down_to: int) -> np.ndarray:
        entry = np.zeros(len(query), np.int64)
        for layer in range(len(self.near) - 1, down_to, -1):
            entry = self._beam(query, entry, layer, 1)[0][:, 0]
        return entry

    def _chosen(self, nodes: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Of candidates, best first: those nearer to the node than to any one chosen before, then the rest."""
        q, width = nodes.shape
        vectors = self.unit[np.maximum(nodes, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        good = np.zeros((q, width), bool)
        for k in range(width):
            rival = np.where(good, between[:, k], -np.inf).max(1)
            good[:, k] = (nodes[:, k] >= 0) & (sims[:, k] > rival) & (good.sum(1) < m)
        rank = np.where(nodes < 0, 2, np.where(good, 0, 1))
        top = np.argsort(rank, 1, kind="stable")[:, :m]
        out = np.take_along_axis(nodes, top, 1)
        return np.pad(out, ((0, 0), (0, max(0, m - width))), constant_values=-1)

    def _insert(self, batch: np.ndarray) -> None:
        query, top = self.unit[batch], min(int(self.level[batch[0]]), len(self.near) - 1)
        entry = self._entry(query, top)
        within = query @ query.T
        np.fill_diagonal(within, -np.inf)
        for layer in range(top, -1, -1):
            nodes, sims = self._beam(query, entry, layer, EF_BUILD)
            entry = nodes[:, 0]
            peers = np.argsort(-within, 1, kind="stable")[:, : min(EF_BUILD, len(batch) - 1)]
            nodes = np.concatenate([nodes, batch[peers]], 1)
            sims = np.concatenate([sims, np.take_along_axis(within, peers, 1)], 1)
            best = np.argsort(-sims, 1, kind="stable")[:, :EF_BUILD]
            nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
            m = M if layer == 0 else M // 2
            chosen = self._chosen(nodes, sims, m)
            self.near[layer][batch, :m] = chosen
            self._link_back(layer, np.repeat(batch, m), chosen.ravel())

    def _link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        near, room = self.near[layer], M0 if layer == 0 else M
        real = target >= 0
        source, target = source[real], target[real]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        hubs, first, count = np.unique(target, return_index=True, return_counts=True)
        for k in range(0, len(hubs), 512):
            hub, n = hubs[k : k + 512], count[k : k + 512]
            extra = np.full((len(hub), int(n.max())), -1, np.int64)
            row = np.repeat(np.arange(len(hub)), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            extra[row, at] = source[np.repeat(first[k : k + 512], n) + at]
            nodes = np.concatenate([near[hub, :room].astype(np.int64), extra], 1)
            sims = np.where(nodes >= 0, np.einsum("qd,qkd->qk", self.unit[hub], self.unit[np.maximum(nodes, 0)]), -np.inf)
            # one place for a node that is there twice
            by = np.argsort(nodes, 1, kind="stable")
            twin = np.zeros(nodes.shape, bool)
            inner = np.take_along_axis(nodes, by, 1)
            np.put_along_axis(twin, by, np.concatenate([np.zeros((len(hub), 1), bool), inner[:, 1:] == inner[:, :-1]], 1), 1)
            nodes, sims = np.where(twin, -1, nodes), np.where(twin, -np.inf, sims)
            best = np.argsort(-sims, 1, kind="stable")[:, : room + 16]
            near[hub, :room] = self._chosen(np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1), room)

    def _mend(self) -> None:
        """Give every node that can't be reached from the first one a link from its nearest node that can, in the spare places."""
        near = self.near[0]
        spare = np.full(len(near), M0)
        reached = np.zeros(len(near), bool)
        reached[0] = True
        frontier = np.array([0])
        while True:
            while len(frontier):
                new = np.unique(near[frontier])
                frontier = new[new >= 0]
                frontier = frontier[~reached[frontier]]
                reached[frontier] = True
            if reached.all():
                return
            lost = np.flatnonzero(~reached)[:256]
            sims = self.unit[lost] @ self.unit.T
            sims[:, ~reached | (spare >= near.shape[1])] = -np.inf
            frontier = []
            for node, row in zip(lost.tolist(), sims, strict=True):
                row[spare >= near.shape[1]] = -np.inf
                by = int(row.argmax())
                if row[by] == -np.inf:
                    break
                near[by, spare[by]] = node
                spare[by] += 1
                reached[node] = True
                frontier.append(node)
            frontier = np.array(frontier, np.int64)
            if not len(frontier):
                raise ValueError("no room to mend the graph")

    def within(self, query: np.ndarray, ef: int, margin: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes found with a cosine of COSINE or more."""
        rows, hits = [], []
        for k in range(0, len(query), BATCH):
            q = query[k : k + BATCH]
            nodes, sims = self._beam(q, self._entry(q, 0) if own is None else own[k : k + BATCH], 0, min(ef, len(self.unit)))
            seen = np.zeros((len(q), len(self.unit)), bool)
            row, col = np.nonzero((nodes >= 0) & (sims >= COSINE - margin))
            node = nodes[row, col]
            seen[row, node] = True
            while len(row):
                new = self.near[0][node].astype(np.int64)
                row, node = np.repeat(row, new.shape[1]), new.ravel()
                real = node >= 0
                row, node = row[real], node[real]
                fresh = ~seen[row, node]
                key = np.unique(row[fresh] * len(self.unit) + node[fresh])
                row, node = key // len(self.unit), key % len(self.unit)
                sim = np.empty(len(row))
                for a in range(0, len(row), 65536):
                    sim[a : a + 65536] = np.einsum("rd,rd->r", q[row[a : a + 65536]], self.unit[node[a : a + 65536]])
                seen[row, node] = True
                row, node = row[sim >= COSINE - margin], node[sim >= COSINE - margin]
            row, node = np.nonzero(seen)
            sim = np.concatenate([np.einsum("rd,rd->r", q[row[a : a + 65536]], self.unit[node[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.empty(0)])
            rows.append(row[sim >= COSINE] + k)
            hits.append(node[sim >= COSINE])
        row, node = np.concatenate(rows), np.concatenate(hits)
        if own is None:
            return row, node
        # a link that one end has found holds for the other
        query_of = np.empty(len(self.unit), np.int64)
        query_of[own] = np.arange(len(own))
        key = np.unique(np.concatenate([row * len(self.unit) + node, query_of[node] * len(self.unit) + own[row]]))
        return key // len(self.unit), key % len(self.unit)

    def search(self, query: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """within(), from the queries' own nodes if they have some, with beam and margin widened until a sample of the searches has found all that a scan finds.

        The beam and the sample's recall stay in self.audit.
        """
        ef, margin = EF, MARGIN
        sample = np.linspace(0, len(query) - 1, min(AUDIT, len(query))).astype(np.int64)
        scan = query[sample] @ self.unit.T >= COSINE + 1e-9  # sums in another order may differ in the last digits
        while True:
            row, node = self.within(query, ef, margin, own)
            found = np.bincount(row, minlength=len(query))[sample]
            self.audit = ef, float(np.minimum(found, scan.sum(1)).sum() / max(1, scan.sum()))
            if (found >= scan.sum(1)).all() or ef >= len(self.unit):
                return row, node
            ef, margin = ef * 2, margin * 2

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, unit=self.unit, level=self.level, order=self.order, **{f"near{k}": x for k, x in enumerate(self.near)})
        return out.getvalue()

    @classmethod
    def loaded(cls, blob: bytes) -> Graph:
        parts = np.load(io.BytesIO(blob))
        out = cls.__new__(cls)
        out.unit, out.level, out.order = parts["unit"], parts["level"], parts["order"]
        out.near = [parts[f"near{k}"] for k in range(int(out.level[0]) + 1)]
        return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component, by links a-b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low]
        low = low[root]
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def units(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(table.num_rows, -1)
    out = out / np.abs(out).max(1)[:, None]  # else squares of tiny or huge components leave the doubles' range
    return out / np.linalg.norm(out, axis=1)[:, None]


def build(table: pa.Table) -> pa.Table:
    """One shard: its graph, and its vectors with their links and components inside the shard."""
    table = table.sort_by("vec_id")
    ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
    unit = units(table)
    graph = Graph(unit)
    own = np.empty(len(ids), np.int64)
    own[graph.order] = np.arange(len(ids))
    row, node = graph.search(unit, own)
    node = graph.order[node]
    n = np.bincount(row, copies[node] * (row != node), len(ids)).astype(np.int64)
    component = ids[roots(len(ids), row, node)]
    head = [table.column(k)[0].as_py() for k in ("label", "dim", "shard", "shards")]
    several = head[3] > 1
    values = [pa.array([x]) for x in head] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, n, component, copies)] + [pa.array([graph.dumped() if several else None], pa.binary()), pa.array([unit.tobytes() if several else None], pa.binary()), pa.array([graph.audit[0]]), pa.array([graph.audit[1]])]
    return pa.table(values, names=[c.split()[0] for c in BUILT.split(", ")])


BUILT = "label long, dim long, shard long, shards long, ids binary, n binary, component binary, copies binary, graph binary, units binary, beam long, recall double"


def across(targets: pa.Table, sources: pa.Table) -> pa.Table:
    """A tile's vectors searched in the graphs of another tile, those of larger shards: both ends' links, and linked components."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pairs = [np.empty((0, 2), np.int64)]
    vectors = [(s, *(np.frombuffer(sources.column(k)[i].as_buffer(), np.int64) for k in ("ids", "component", "copies")), np.frombuffer(sources.column("units")[i].as_buffer(), np.float64)) for i, s in enumerate(sources.column("shard").to_pylist())]
    for i, shard in enumerate(targets.column("shard").to_pylist()):
        graph = Graph.loaded(targets.column("graph")[i].as_py())
        ids, component, copies = (np.frombuffer(targets.column(k)[i].as_buffer(), np.int64) for k in ("ids", "component", "copies"))
        for other, mine, own, many, unit in vectors:
            if other >= shard:
                continue
            row, node = graph.search(unit.reshape(len(mine), -1))
            node = graph.order[node]
            for who, n in ((mine, np.bincount(row, copies[node], len(mine))), (ids, np.bincount(node, many[row], len(ids)))):
                found.append((who[n > 0], n[n > 0].astype(np.int64)))
            pairs.append(np.unique(np.stack([own[row], component[node]], 1), axis=0))
    ids, n = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
    pair = np.unique(np.concatenate(pairs), axis=0)
    counts = pa.table([pa.array(ids), pa.array(n), pa.nulls(len(n), pa.int64())], names=["a", "n", "b"])
    return pa.concat_tables([counts, pa.table([pa.array(pair[:, 0]), pa.nulls(len(pair), pa.int64()), pa.array(pair[:, 1])], names=["a", "n", "b"])])


def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, n, component in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (ids, n, component)], names=["vec_id", "n", "component"])


def keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """The vectors that can link, with a digest that equal vectors share."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(real, F.lit(False)))
    return cut(good.withColumn("dim", F.size("embedding").cast("long")).withColumn("digest", F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256)), "vectors")


def shards(good: DataFrame, first: DataFrame) -> DataFrame:
    """One row for each shard, see BUILT. first: label, digest, first, copies of distinct vectors."""
    one = good.join(first.select("label", "digest", F.col("first").alias("vec_id"), "copies"), ["label", "digest", "vec_id"]).dropDuplicates(["label", "digest"]).select("vec_id", "label", "dim", "copies", "embedding")
    sizes = one.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("long").alias("shards"))
    dealt = one.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    return cut(dealt.groupBy("label", "dim", "shard").applyInArrow(build, BUILT), "shards")


def firsts(good: DataFrame) -> DataFrame:
    return cut(good.groupBy("label", "digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "first")


def audits(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """label, dim, shard, vectors, beam, recall: of the searches inside each shard that were compared with a scan."""
    good = keyed(vectors, id_col, vector_col, label_col)
    return shards(good, firsts(good)).select("label", "dim", "shard", (F.octet_length("ids") / 8).cast("long").alias("vectors"), "beam", "recall")


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    good = keyed(vectors, id_col, vector_col, label_col)
    first = firsts(good)
    member = cut(good.join(first, ["label", "digest"]).select("vec_id", "first", "copies"), "membership")
    built = shards(good, first)
    inside = cut(built.select("ids", "n", "component").mapInArrow(unrolled, "vec_id long, n long, component long"), "inside")
    # every tile's vectors go to the graphs of its own tile and of those with larger shards
    many = built.where("shards > 1").withColumn("tile", F.floor(F.col("shard") / TILE))
    lower, upper = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))), F.explode(F.sequence(F.col("tile"), F.floor((F.col("shards") - 1) / TILE)))
    fresh = lambda *names: [F.col(c).alias(c) for c in names]
    targets = many.select(*fresh("label", "dim", "shard", "ids", "component", "copies", "graph"), F.col("tile").alias("q"), lower.alias("p"))
    sources = many.select(*fresh("label", "dim", "shard", "ids", "component", "copies", "units"), F.col("tile").alias("p"), upper.alias("q"))
    by = ["label", "dim", "p", "q"]
    crossed = cut(targets.groupBy(*by).cogroup(sources.groupBy(*by)).applyInArrow(across, "a long, n long, b long"), "crossed")
    counts = inside.select("vec_id", "n").unionByName(crossed.where("n is not null").select(F.col("a").alias("vec_id"), "n")).groupBy("vec_id").agg(F.sum("n").alias("n"))
    edges = inside.select(F.col("vec_id").alias("a"), F.col("component").alias("b")).unionByName(crossed.where("b is not null").select("a", "b")).unionByName(member.select(F.col("vec_id").alias("a"), F.col("first").alias("b")))
    found = components(edges, "a", "b")
    # each id once on the right, so a hot first vector only makes a long left side, which Spark can split
    counted = member.join(cut(counts.withColumnRenamed("vec_id", "first"), "counts"), "first").select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n"))
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    counted = cut(counted.groupBy("vec_id").agg(F.max("n").alias("n")), "counted")
    out = ids.join(counted, "vec_id", "left").join(found.withColumnRenamed("u", "vec_id"), "vec_id", "left")
    component = F.coalesce("v", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
