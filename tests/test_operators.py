"""Operators that the catalogue's SQL doesn't reach."""

import ast
import json
import os
import random
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteledger import catalog_sources
from siteledger.functions import text as T
from siteledger.functions import vectors as V
from siteledger.operators import arms, context, history, policy, retrieval, reuse, scoring
from siteledger.plans import lineage
from siteledger.plans.lineage import numbered
from siteledger.sources import documents, vector_index, versions
from siteledger.streaming.history import keep, keep_with_state


def test_text(spark):
    row = spark.createDataFrame([("py:a.py:if:ab:3", "\n  \t héé x \n y", "a/b c+*é", "Straße fooBar_1")], "fp string, t string, p string, u string")
    got = row.select(T.split_fingerprint(F.col("fp")).alias("f"), T.excerpt(F.col("t")).alias("e"), T.within_bytes(F.lit("aéé"), 4).alias("b"), T.percent_encoded(F.col("p")).alias("p"), T.unicode_tokens(F.col("u")).alias("u"), T.is_base(F.lit("m.Specification[int]")).alias("s")).first()
    assert (got.f.key, got.f.occurrence) == ("py:a.py:if:ab", 3) and got.e == "héé x" and tuple(got.b) == ("aé", True)
    assert got.p == "a/b%20c%2B%2A%C3%A9" and got.u == ["strasse", "foo", "bar", "1"] and got.s


def test_vectors(spark):
    row = spark.sql("select array(3.0, 4.0, 0.0) as v, array(0.0, 0.0) as z").select(V.truncated(F.col("v"), 2).alias("t"), V.unit(F.col("z")).alias("u"), V.cosine(F.col("z"), F.col("z")).alias("c")).first()
    assert row.t == [0.6, 0.8] and row.u is None and row.c is None


def test_nearest_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)] + [(90, None), (91, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    good = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v is not None}
    want = {(q, d) for q in good if q % 3 == 0 for d in sorted((d for d in good if d != q), key=lambda d: (-round(float(good[q] @ good[d]), 6), d))[:4]}
    for block in (7, 2048):
        got = retrieval.nearest(df, df.where("id % 3 = 0"), "id", "v", 4, rows=block).collect()
        assert {(r.query, r.doc) for r in got} == want and len(got) == len(want)


def test_clear_removes_what_was_written(spark):
    lineage.clear(spark)
    df = lineage.cut(spark.range(5), "gone")
    path = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path) and lineage.clear(spark) == 1 and not os.path.exists(path)


def test_numbered_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 3), ("a", 0), (None, 2), ("b", 5)], "g string, o int")
    assert {(r.g, r.o): r.position for r in numbered(df, ["g"], ["o"]).collect()} == {("a", 0): 1, ("a", 1): 2, (None, 2): 1, (None, 3): 2, ("b", 5): 1}


def test_append_once_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 0, "y"), ("m", 2, "z")], "key string, ms int, v string")
    path = str(tmp_path / "h")
    assert versions.append_once(df, path, "key", "ms") == (2, 1) and versions.append_once(df, path, "key", "ms") == (0, 1)
    assert {r.v for r in versions.read(spark, path).collect()} == {"y", "z"}
    df.withColumn("key", F.concat("key", F.lit("2"))).write.parquet(str(tmp_path / "in"))
    query = keep(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), path, "key", "ms", str(tmp_path / "c"))
    query.awaitTermination(120)
    assert versions.read(spark, path).count() == 4 and versions.read(spark, path, 1).count() == 2
    with pytest.raises(ValueError):
        history.newest(df, "ms", "key", 0)


def test_history_by_state(spark, tmp_path):
    """Doubles, rows out of order and a restart; what is later than the state reaches is dropped."""
    kind = "key string, at timestamp, v string"

    def arrive(name, rows):
        spark.createDataFrame([(k, datetime(2024, 1, 1, 0, m), v) for k, m, v in rows], kind).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        keep_with_state(source, str(tmp_path / "out"), "key", "at", "20 minutes", str(tmp_path / "check")).awaitTermination(120)
        return sorted((r.key, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("1", [("a", 10, "a1"), ("b", 12, "b1")])
    assert run() == [("a", "a1"), ("b", "b1")]
    arrive("2", [("a", 11, "a2"), ("c", 5, "c1")])  # started again: a is known, c is out of order but in time
    assert run() == [("a", "a1"), ("b", "b1"), ("c", "c1")]
    arrive("3", [("d", 50, "d1")])
    run()
    arrive("4", [("e", 1, "late"), ("f", 45, "f1")])
    assert run() == [("a", "a1"), ("b", "b1"), ("c", "c1"), ("d", "d1"), ("f", "f1")]


def test_two_writers(spark, tmp_path):
    """Both have looked before either has written: the loser looks again, so nothing is lost or doubled."""
    frame = lambda lo, hi, v: spark.createDataFrame([(f"k{i}", i, v) for i in range(lo, hi)], "key string, ms int, v string")
    root, meet, met = str(tmp_path / "table"), threading.Barrier(2), []

    def once():
        if threading.get_ident() not in met:
            met.append(threading.get_ident())
            meet.wait(120)

    with ThreadPoolExecutor(2) as pool:
        done = [f.result() for f in [pool.submit(versions.append_once, frame(0, 60, "a"), root, "key", "ms", once), pool.submit(versions.append_once, frame(40, 100, "b"), root, "key", "ms", once)]]
    rows = versions.read(spark, root).collect()
    assert sorted(r.key for r in rows) == sorted(f"k{i}" for i in range(100)) and sorted(n for n, _ in done) == [40, 60] and sorted(v for _, v in done) == [1, 2]
    assert versions.vacuum(spark, root) == 1 and versions.read(spark, root).count() == 100
    assert not versions.put_if_absent(spark, root, 2, {"folders": []}) and versions.numbers(spark, root) == [1, 2]


def test_two_publishers(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")
    encode = lambda rows: rows.select("key", F.array(F.length("text").cast("float")).alias("vector"))
    root = str(tmp_path / "index")
    with ThreadPoolExecutor(2) as pool:
        got = [f.result() for f in [pool.submit(vector_index.publish, docs.where(c), root, "p", s, encode) for c, s in (("id < 3", "one"), ("id >= 2", "two"))]]
    assert sorted(got) == [1, 2]
    last = "one" if got[0] == 2 else "two"
    assert vector_index.read_snapshot(docs.where("id < 3" if last == "one" else "id >= 2"), root, "p", last).count() == 3


def test_policy_and_scores(spark):
    row = spark.createDataFrame([("a", {"a": 0.6, "b": 0.4}), ("a", {"a": 0.5, "b": 0.5}), ("b", {"a": 0.7, "b": 0.3}), ("a", {"a": 0.7})], "c string, p map<string,double>")
    got = row.select(policy.choice_problem(F.col("c"), F.lit(0.9), F.col("p"), ["a", "b"], 1e-6).alias("w"), policy.strict_majority(F.col("c"), F.col("p")).alias("m")).collect()
    assert [r.w for r in got] == [None, None, "not_the_best", "wrong_labels"] and [r.m for r in got][:3] == [True, False, False]
    families = spark.createDataFrame([("x", 1.0), ("x", 0.0), ("y", 1.0)], "f string, g double")
    got = scoring.interval(families, "f", "g", draws=200, seed=3).first()
    assert got == scoring.interval(families, "f", "g", draws=200, seed=3).first() and got.low in (0.0, 0.5) and got.high == 1.0


def brute_match(template, expression, renameable):
    """Both trees walked together."""
    a, b = (ast.parse(f"({t})", mode="eval").body for t in (template, expression))
    names = {}

    def same(x, y):
        if isinstance(x, ast.Name) and x.id in renameable:
            if not isinstance(y, ast.Name) or (x.id not in names and y.id in names.values()):
                return False
            return names.setdefault(x.id, y.id) == y.id
        if isinstance(x, ast.AST):
            return type(x) is type(y) and all(same(getattr(x, f, None), getattr(y, f, None)) for f in x._fields if f not in ("ctx", "kind"))
        if isinstance(x, list):
            return isinstance(y, list) and len(x) == len(y) and all(map(same, x, y))
        return type(x) is type(y) and x == y

    return same(a, b)


def test_reuse_matches_as_a_walk_over_both_trees(spark):
    rng = random.Random(13)
    expressions = sorted({f"{a}.k {op} {b} and {c}.f('x', {d})" for a, b, c, d in (rng.choices("xyzw", k=4) for _ in range(60)) for op in ("<", "==")})
    catalogue = {"rules": [{"id": f"r{k}", "paths": ["."], "templates": [{"id": "t", "expression": e, "renameable_identifiers": free}]} for k, (e, free) in enumerate((e, f) for e in expressions[::9] for f in (["x"], ["x", "y"], []))]}
    texts = spark.createDataFrame([("a.py", "".join(f"if {e}: pass\n" for e in expressions))], "path string, text string")
    got = {(r.line, r.rule_id) for r in reuse.findings(reuse.parsed(texts), reuse.templates_frame(spark, catalogue)).where("basis = 'equivalent_template'").collect()}
    want = {(i + 1, r["id"]) for i, e in enumerate(expressions) for r in catalogue["rules"] for t in r["templates"] if brute_match(t["expression"], e, t["renameable_identifiers"])}
    assert got == want and len(want) > len(catalogue["rules"])


def test_reuse_of_many_sites(spark, monkeypatch, sf):
    """Sites are neither written nor joined by their numbers; those of one file and shape are numbered the same over all tasks, and equal ones count once."""
    _, now, templates = catalog_sources.reuse_facts(spark, sf)
    old = now.where("line % 3 = 0 or fact != 'site'")
    paths = now.where("fact = 'site'").select("path").distinct()
    written = []
    monkeypatch.setattr(reuse, "cut", lambda df, what="cut": written.append(lineage.cut(df, what)) or written[-1])
    answers = []
    for most in (1_000_000, 2):
        monkeypatch.setattr(reuse, "LONG", most, raising=False)
        for after in (now, now.unionByName(now)):
            found, total, _ = reuse.compared(old, after, paths, templates)
            answers.append((sorted(map(tuple, found.collect()), key=repr), total.first()))
            if most > 2:
                assert not [df for df in written if "construct" in df.columns]
    assert all(a == answers[0] for a in answers) and {r[-1] for r in answers[0][0]} == {True, False}


def test_reuse_hits_are_not_dealt(spark, sf):
    """A site travels once, with all its hits; nothing that has a row for each hit is written or dealt."""
    old, now, templates = catalog_sources.reuse_facts(spark, sf)
    found = reuse.compared(old, now, now.where("fact = 'site'").select("path").distinct(), templates)[0]
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    # the others are of the catalogue, by rule and by shape
    dealt = [x for x in lines if "hashpartitioning(path" in x or "_hit" in x and "Exchange" in x]
    assert len(dealt) == 1 and "REPARTITION_BY_COL" in dealt[0]
    assert not any("SortMergeJoin" in x or "Exchange rangepartitioning" in x for x in lines)


def test_reuse_outside_any_of_two_declarations(spark):
    """A name that is declared twice: sites inside either declaration don't count."""
    body = "PredicateSpec(lambda p: p.kind == 'adult' and p.age > 17 and p.ok)\n"
    rule = {"id": "adult", "paths": ["."], "canonical_path": "a.py", "canonical_symbol": "ADULT", "templates": [{"id": "t", "expression": "p.kind == 'adult' and p.age > 17 and p.ok", "renameable_identifiers": ["p"]}]}
    texts = spark.createDataFrame([("a.py", f"ADULT = {body}ADULT = {body}OTHER = {body}")], "path string, text string")
    found = reuse.findings(reuse.parsed(texts), reuse.templates_frame(spark, {"rules": [rule]}))
    assert [r.line for r in found.collect()] == [3]


def test_reuse_catalogue_and_requests(spark):
    for bad in ({"rules": [{"id": "x", "paths": []}, {"id": "x", "paths": []}]}, {"rules": [{"id": "x", "paths": ["../a"]}]}):
        with pytest.raises(ValueError):
            reuse.templates_frame(spark, bad)
    rows = [("a.py", 1, 1, "if_statement", "x" * n, "r", "near_match", "feature_overlap", None, True) for n in (10, 30_000)]
    found = spark.createDataFrame(rows, "path string, line long, column long, construct string, code string, rule_id string, kind string, basis string, template_id string, introduced boolean")
    assert sorted((r.request is None, r.diagnostic) for r in reuse.review_requests(found).collect()) == [(False, None), (True, "context_too_large")]


def test_interval_of_many_families(spark):
    rng = random.Random(3)
    rows = [(f"f{k}", rng.random() < 0.3) for k in range(400) for _ in range(3)]
    families = spark.createDataFrame([(f, float(g)) for f, g in rows], "f string, g double")
    sums, means = {}, []
    for f, g in rows:
        sums.setdefault(f, []).append(float(g))
    for _ in range(2000):
        drawn = [x for f in rng.choices(list(sums), k=len(sums)) for x in sums[f]]
        means.append(sum(drawn) / len(drawn))
    means.sort()
    many = scoring.interval(families, "f", "g", seed=5).first()
    assert abs(means[int(0.025 * 1999)] - many.low) < 0.01 and abs(means[int(0.975 * 1999)] - many.high) < 0.01
    assert scoring.interval(families.limit(0), "f", "g").count() == 0


def test_vector_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    encode = lambda df: df.select("key", F.array(F.length("text").cast("double")).alias("vector"))
    root = str(tmp_path)
    with pytest.raises(ValueError):
        vector_index.read_snapshot(docs, root, "p", "s")
    assert vector_index.publish(docs, root, "p", "s", encode) == 1
    more = docs.union(spark.createDataFrame([("c", "zz")], docs.schema))
    with pytest.raises(ValueError, match="too few"):
        vector_index.publish(more, root, "p", "s", lambda df: encode(df).limit(0))
    assert vector_index.read_snapshot(docs, root, "p", "s").count() == 2
    assert vector_index.publish(more, root, "p", "s", encode) == 2
    assert {(r.id, r.vector[0]) for r in vector_index.read_snapshot(more, root, "p", "s").collect()} == {("a", 1.0), ("b", 1.0), ("c", 2.0)}
    for stale in ((docs, "p", "s"), (more, "q", "s"), (more, "p", "t")):
        with pytest.raises(ValueError, match="stale"):
            vector_index.read_snapshot(stale[0], root, *stale[1:])
    with pytest.raises(ValueError, match="unique"):
        vector_index.publish(docs.union(docs), root, "p", "s", encode)


def shrunk(meta, excerpt, enclosing, related, most):
    """One reduction at a time, as a reader of the rule would do it."""
    state = {"excerpt": excerpt, "excerpt_truncated": False, "enclosing": enclosing, "enclosing_truncated": False, "related": [{"text": r, "truncated": False} for r in related]}
    cut = lambda t, n: t.encode()[: max(n, 0)].decode("utf-8", "ignore")
    while True:
        excess = len(json.dumps({"meta": meta, "context": state}, ensure_ascii=False, separators=(",", ":")).encode()) - most
        if excess <= 0:
            return state | {"fits": True}
        site = next((r for r in reversed(state["related"]) if r["text"]), None)
        if site:
            site.update(text=cut(site["text"], len(site["text"].encode()) - excess), truncated=True)
        elif name := next((n for n in ("enclosing", "excerpt") if state[n]), None):
            state[name], state[f"{name}_truncated"] = cut(state[name], len(state[name].encode()) - excess), True
        else:
            return state | {"fits": False}


def test_contexts_fit_their_limit(spark):
    rng = random.Random(23)
    word = lambda n: "".join(rng.choices('aé"漢\n ', k=rng.randrange(n)))
    rows = [(word(40), word(60), word(60), [word(50) for _ in range(rng.randrange(5))], i) for i in range(60)]
    df = spark.createDataFrame(rows, "meta string, excerpt string, enclosing string, related array<string>, id int")
    for most in (120, 300, 800):
        got = {r.id: r.c.asDict(recursive=True) for r in df.select("id", context.fitted(F.col("meta"), F.col("excerpt"), F.col("enclosing"), F.col("related"), most).alias("c")).collect()}
        assert got == {r[4]: shrunk(*r[:4], most) for r in rows}


def test_registries_and_collections(spark, tmp_path):
    path = str(tmp_path / "r.toml")
    assert documents.load_registry(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        documents.load_registry(spark, path, must_exist=True)
    rows = [("2", "f2", "python", 'a"\\\x7f\n.py', "if", "excluded", "why é", ("t", None, "o", None)), ("1", "f1", "python", "b.py", "if", "unreviewed", None, None)]
    sites = spark.createDataFrame(rows, documents.REGISTRY)
    documents.save_registry(sites, path)
    back = {r.id: r for r in documents.load_registry(spark, path, must_exist=True).collect()}
    assert back["2"].path == rows[0][3] and tuple(back["2"].evidence) == ("t", None, "o", None) and back["1"].reason is None and len(back) == 2
    for name, digest, n in (("b", "x", 3), ("a", "x", 5), ("c", "y", 5)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": 1, "project": "p", "contract_digest": digest, "primary": {"specification_definitions": n, "remaining_opportunities": 10 - n}}, indent=1))
    load = lambda n: documents.load_collection(spark, str(tmp_path / f"{n}.json"))
    assert tuple(documents.comparable(load("b"), load("a")).first()) == ("p", None, 2, -2)
    assert tuple(documents.comparable(load("b"), load("c")).first()) == ("p", "incompatible_contracts", None, None)


def test_small_functions(spark):
    row = spark.createDataFrame([("ok", 0, False, " Final [ Literal['a b'] ] ")], "s string, a int, d boolean, t string")
    got = row.select(arms.usable(F.lit("valid"), F.col("a"), F.col("d")).alias("u"), arms.usable(F.lit("valid"), F.lit(None).cast("int"), F.col("d")).alias("n"), T.type_text(F.col("t")).alias("t"), T.unicode_tokens(F.lit("v2Beta ΣΑΣ")).alias("w")).first()
    assert (got.u, got.n, got.t, got.w) == (True, False, "Final[Literal['a b']]", ["v2beta", "σασ"])
    low = scoring.probability_change(F.lit(0.4), F.lit(0.5))
    assert row.select(low["sign"].alias("x")).first().x == "positive"


def test_whole_closure_follows_a_long_path(spark, tmp_path):
    from siteledger.catalog import QUERIES

    spark.createDataFrame([(9001, -1.0), (9002, 5.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 9001 + k) for k in range(8)] + [(50, 100)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, k) for k in range(8)] + [(k, k + 1) for k in range(8)] + [(50, 77)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node for r in QUERIES["fixpoint_closure_whole"](spark, str(tmp_path)).collect()}
    assert got == {f"c{9001 + k}" for k in range(8)} | {f"p{k}" for k in range(9)}


def test_a_large_key_is_not_gathered_in_one_task(spark):
    from siteledger.operators import diff, scope

    points = spark.range(4000).selectExpr("id", "if(id % 10 = 0, id, 0) as k", "id as at")
    spans = points.where("id % 100 = 0").selectExpr("0L as k", "at as start", "at + 7 as stop")
    inside = scope.contained(points, spans, "id", "k", "at", "start", "stop")
    assert {r.id for r in inside.where("inside").collect()} == {i for i in range(4000) if i % 100 < 7 and (i % 10 or i == 0)}
    # no task of the window holds the whole key
    assert "Window [" in (plan := inside._jdf.queryExecution().optimizedPlan().toString()) and "[_task" in plan
    changed = diff.functions(points.where("id < 2000"), points.where("id >= 1000"), ["k"], "at")
    assert "collect_list" not in changed._jdf.queryExecution().optimizedPlan().toString()
    assert changed.where("k = 0").first()["correspondence"] == "ambiguous" and changed.where("k = 1500").isEmpty()
