"""Operators over orders and structures against plain loops, with hot keys over many tasks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siteledger.catalog_ordered import SESSION
from siteledger.operators import clones, closure, collection, digests, phases, scope


@pytest.mark.parametrize("block", [4, 16])
def test_phases_of_a_hot_key(spark, block):
    draw = random.Random(block)
    sizes = {"hot": 3000, "one": 1, None: 40, **{f"k{i}": draw.randint(1, 20) for i in range(20)}}
    rows = [(k, i, draw.choice([*SESSION.moves, None, "unknown"][: 5 if i % 50 else 7]), float(i)) for k, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "user string, at long, kind string, value double").repartition(6)
    got = {}
    for r in phases.traced(frame, "user", ["at"], "kind", SESSION, block).collect():
        got.setdefault(r.user, []).append((r.position, r.before, r.after))
    want = {}
    for user, _, kind, _ in rows:
        trace = want.setdefault(user, [])
        before = trace[-1][2] if trace else "start"
        trace.append((len(trace) + 1, before, SESSION.moves.get(kind, {}).get(before, "failed")))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("block", [4, 1024])
def test_phases_broadcast_no_events(spark, block):
    """States of sorted events are small as files and large in memory, so a join with them must not go by a file's size."""
    frame = spark.range(3000).select((F.col("id") % 2).alias("user"), F.col("id").alias("at"), F.lit("view").alias("kind"), F.col("id").cast("double").alias("value"))
    plan = phases.traced(frame, "user", ["at"], "kind", SESSION, block)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and ("Join" in plan) == (block == 4)


def test_phases_of_no_events(spark):
    frame = spark.createDataFrame([], "user string, at long, kind string, value double")
    traced = phases.traced(frame, "user", ["at"], "kind", SESSION)
    assert traced.count() == 0 and phases.summary(traced, "user", "value", "complete", "failed", F.lit(True)).count() == 0


def breadth_first(seeds, edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    depth, front = dict.fromkeys(seeds, 0), set(seeds)
    while front:
        front = {b for a in front for b in after.get(a, ()) if b not in depth and not depth.update({b: depth[a] + 1})}
    return depth


def graphs():
    draw = random.Random(2)
    yield "path with a short cut", [0], [(i, i + 1) for i in range(700)] + [(3, 650)]
    yield "cycle", [5], [(i, (i + 1) % 300) for i in range(300)]
    yield "chains that meet and branch", [0, 1000], [(i, i + 1) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(1150, 120), (200, 2000), (200, 3000), *[(2000 + i, 2001 + i) for i in range(90)], (2090, 3050), *[(3000 + i, 3001 + i) for i in range(80)]]
    yield "dense", [0, 1], [(draw.randrange(200), draw.randrange(200)) for _ in range(500)]
    yield "no edges", [4], []


@pytest.mark.parametrize(("name", "seeds", "edges"), list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_depths(spark, name, seeds, edges):
    log = []
    frame = spark.createDataFrame([*edges, (None, 1), (seeds[0], None)], "a long, b long")
    got = closure.reached(spark.createDataFrame([(s,) for s in seeds], "node long"), frame, "node", "a", "b", log=log)
    assert {r.node: r.depth for r in got.collect()} == breadth_first(seeds, edges)
    assert len(log) <= 15


def test_steps_are_limited(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    got = closure.reached(spark.createDataFrame([(0,)], "node long"), frame, "node", "a", "b", rounds=4)
    assert {r.node: r.depth for r in got.collect()} == {i: i for i in range(5)}


def test_tree_opens_few_buckets(spark):
    rows = spark.range(60_000).select("id", F.concat(F.lit("v"), "id").alias("v"))
    later = rows.where("id != 77").unionByName(spark.createDataFrame([(-1, "new"), (5, "v5")], "id long, v string"))
    a, b = digests.matched_depth(rows, later, ["id", "v"], bucket=64)
    assert a.leaves.agg(F.max(F.size("entries"))).first()[0] <= 64 and len(a.levels) == len(b.levels) >= 4
    assert digests.descent(a, b).count() == 3 < a.leaves.count() / 500
    got = {r.digest: (r.n_before, r.n_after) for r in digests.changed(a, b).collect()}
    of = {r.digest: r.id for r in rows.unionByName(later).select("id", F.sha2(F.to_json(F.struct("id", "v")), 256).alias("digest")).where("id in (77, -1, 5)").collect()}
    assert {of[d]: n for d, n in got.items()} == {77: (1, 0), -1: (0, 1), 5: (1, 2)}
    assert a.root().first() != b.root().first()
    shuffled, same = digests.matched_depth(rows.repartition(7), rows, ["id", "v"], bucket=64)
    assert shuffled.root().first() == same.root().first() and digests.changed(shuffled, same).count() == 0


def test_tree_of_no_rows(spark):
    empty = spark.createDataFrame([], "id long, v string")
    a, b = digests.matched_depth(empty, empty.unionByName(spark.createDataFrame([(1, None)] * 5000, "id long, v string")), ["id", "v"], bucket=2)
    assert a.root().count() == 1 and [(r.n_before, r.n_after) for r in digests.changed(a, b).collect()] == [(0, 5000)]


def test_clones_by_hand(spark):
    lines = [f"line {k} has some ten words so that windows count {k}" for k in range(40)]
    files = {
        1: [*lines[:8], "only here", *lines[20:23]], 2: ["before", *(x.replace(" ", "\t  ") for x in lines[2:7]), "after", *lines[20:23]],
        3: [*lines[:8]], 4: ["x"] * 50, 5: [*lines[30:33], *lines[30:33]], 6: [], 7: None,
    }
    frame = spark.createDataFrame([(k, None if v is None else "\n".join(v)) for k, v in files.items()], "id long, t string")
    got = sorted((r.file, r.start, r.first_file, r.first_start, r.lines) for r in clones.maximal(frame, "id", "t").collect())
    # each run of x first stood at the file's start, too short for a clone
    assert got == [(2, 2, 1, 3, 5), (2, 8, 1, 10, 3), (3, 1, 1, 1, 8), (5, 4, 5, 1, 3)]
    total = clones.totals(clones.maximal(frame, "id", "t")).first()
    assert total.clone_pairs == len(got) and total.duplicate_lines == sum(r[4] for r in got)
    assert clones.totals(clones.maximal(frame.limit(0), "id", "t")).first().clone_pairs == 0


def test_popular_window_is_no_square(spark):
    text = "\n".join(["the very same ten words stand in each of files"] * 3)
    frame = spark.createDataFrame([(k, text) for k in range(400)], "id long, t string")
    assert clones.maximal(frame, "id", "t").count() == 399 and clones.maximal(frame, "id", "t", tokens=31).count() == 0


def test_roles_of_long_manifests(spark, monkeypatch):
    manifest = [(".", "excluded"), ("a", "application"), ("a/b", "test"), ("a/b", "vendored"), ("c/d/e", "test"), ("c/d/e", "test"), ("c", "application")]
    paths = spark.createDataFrame([(p, i) for i, p in enumerate(["a", "a/x.py", "a/b/y.py", "ab/z.py", "c/d/e", "c/d/f.py", "q", "q", "a/b"])], "path string, prefix int")
    rows = lambda m: sorted((r.path, r.prefix, r.role, r.scope_issue) for r in scope.roles(paths, m).select("path", "prefix", "role", "scope_issue").collect())
    short = [rows(manifest), [r for r in rows(manifest[1:])]]
    monkeypatch.setattr(scope, "MOST_ENTRIES", 2)
    assert [rows(manifest), rows(manifest[1:])] == short and any(r[3] == "no role" for r in short[1]) and any(r[3] == "conflicting roles" for r in short[0])


def test_set_digest_of_many_rows(spark):
    """Small cells: three digits of buckets, against plain hashing."""
    rows = spark.range(3000).select("id")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = {}
    for d in sorted(sha(f'{{"id":{i}}}') for i in range(3000)):
        level[d[:3]] = level.get(d[:3], "") + d
    level = {p: sha(x) for p, x in level.items()}
    two = {}
    for p in sorted(level):
        two[p[:2]] = two.get(p[:2], "") + level[p]
    want = sha("".join(sha(two[p]) for p in sorted(two)))
    assert collection.set_digest(rows.repartition(5).unionByName(rows), ["id"], cell=2).first().digest == want
    assert collection.set_digest(rows.limit(0), ["id"]).first().digest == sha("")
