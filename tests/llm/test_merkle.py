"""Merkle manifests against plain trees, on odd tables and with small blocks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siteledger.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """The root and each leaf's siblings."""
    others, leaves = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + arity, len(nodes))) for i in range(0, len(nodes), arity)]
        for run in runs:
            for i in run:
                for leaf in leaves[i]:
                    others[leaf] += [nodes[j] for j in run if j != i]
        leaves = [[leaf for i in run for leaf in leaves[i]] for run in runs]
        nodes = [sha(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], others


def expected(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], told(*row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    groups = [sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in names]
    low = [tree([leaf for _, leaf in g], arity) for g in groups]
    root, over = tree([r for r, _ in low], arity)
    return sorted((told_leaf, sub, root, sha(*own, *up)) for g, (sub, others), up in zip(groups, low, over, strict=True) for (_, told_leaf), own in zip(g, others, strict=True))


ROWS = [(i, ["en", "de", None, "é", ""][min(4, i % 9)], f"text {i}" * (i % 5)) for i in range(70)]
ODD = [(None, "x", None), (None, "x", None), (7, "x", ""), (7, "x", "zwei"), (7, "x", "zwei"), (3, None, "a\n" * 100_000)]


@pytest.mark.parametrize(("rows", "arity", "stride"), [(ROWS, 2, 2), (ROWS + ODD, 2, 8), (ROWS + ODD, 3, 1), (ROWS[:1], 2, 2)])
def test_proofs(spark, rows, arity, stride):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    leaves = docs.select("doc_id", "lang", merkle.digest(*[F.col(c) for c in docs.columns]).alias("leaf"))
    found = merkle.manifest(leaves, "lang", "doc_id", "leaf", arity, stride)
    got = found.select("leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("p"), merkle.folded(F.col("leaf"), F.col("proof")).alias("folded"), merkle.folded(F.lit("0"), F.col("proof")).alias("bad")).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(rows, arity)
    assert all(r.folded == r.root for r in got)
    assert len(rows) == 1 or all(r.bad != r.root for r in got)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, leaf string, extra int")
    found = merkle.manifest(empty, "lang", "doc_id", "leaf")
    assert found.columns == ["doc_id", "lang", "leaf", "extra", "proof", "subroot", "root"] and found.count() == 0
