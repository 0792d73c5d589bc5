"""Archives, vectors and conversations."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siteledger.llm import annlinks, graph, quotes, warc
from siteledger.llm.queries import queries, table


def test_archives(spark, sf):
    rows = [(1, "a\nb", "<p>"), (2, None, "<p>"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\ny"), (None, "u", "<p>"), (1, "a", "<p>"), (6, "u", "é" * 90_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.round_trip(df).collect()
    assert len(back) == len(rows) and all(r.intact for r in back)
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in back}
    assert kinds[2, ""] == ("revisit", 1) and kinds[4, "u"] == ("revisit", 3) and kinds[None, "u"] == ("response", None) and kinds[1, "a b"] == ("response", None)
    assert next(bytes(r.payload) for r in back if r.page_id == 5) == b"x\r\n\r\ny"
    assert {r.record_type for r in warc.round_trip(df, min_bytes=4).where("page_id in (2, 4)").collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0
    clashing = df.withColumns({c: F.lit("x") for c in ("payload", "shard", "sha", "first_id", "record_type")})
    assert sorted((r.page_id or 0, r.record_type) for r in warc.round_trip(clashing).collect()) == sorted((r.page_id or 0, r.record_type) for r in back)
    want = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    for r in queries()["op5_warc"](spark, sf).collect():
        assert (r.payload_bytes, r.payload_digest) == (len(want[r.page_id]), base64.b32encode(hashlib.sha1(want[r.page_id]).digest()).decode())


def test_near_ranges_become_one_read():
    got = list(warc.ranges([(0, 10), (10, 10), (20 + warc.GAP + 1, 5), (warc.RANGE * 2, 5)]))
    assert [len(r) for r in got] == [2, 1, 1]


def brute(rows):
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.array(v, float) / np.abs(v).max(), k) for i, v, k in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, (i, v, label) in enumerate(good):
        for j, w, other in good[:k]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i in n}


def test_vectors(spark, sf, monkeypatch):
    def got(df):
        clashing = df.withColumn("n_links", F.lit("x")).withColumn("shard", F.lit("x"))
        return {r.vec_id: (r.n_links, r.component_id) for r in annlinks.links(clashing).collect()}

    odd = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.1], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1e-200, 0.0], 1), (13, [1e30, 1e29], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    assert got(spark.createDataFrame(odd, schema)) == brute(odd)
    assert got(spark.createDataFrame([], schema)) == {}
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * 0.12).tolist(), c % 2) for k in range([60, 3, 25][c % 3])]
    df, want = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), brute(rows)
    assert got(df) == want
    monkeypatch.setattr(annlinks, "SHARD", 60)
    for tile in (1, 3):
        monkeypatch.setattr(annlinks, "TILE", tile)
        assert got(df) == want
    real = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, sf, "embeddings").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries()["op8_embedding_links"](spark, sf).collect()} == brute(real)


def test_recall_of_many_shards(spark):
    """12,000 vectors of one label in three shards: a sample's links against a scan, and the shards' audits."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    centres = unit(rng.normal(size=(800, 32)))
    vectors = unit(centres[rng.integers(0, 800, 12_000)] + rng.normal(size=(12_000, 32)) * rng.choice([0.01, 0.022, 0.03], (12_000, 1)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in annlinks.links(df).collect()}
    asked = range(0, 12_000, 50)
    want = {i: int((vectors @ vectors[i] >= 0.98).sum()) - 1 for i in asked}
    assert all(got[i] <= want[i] for i in asked)
    assert sum(got[i] for i in asked) >= 0.99 * sum(want.values()) > 1000
    audits = annlinks.audits(df).collect()
    assert len(audits) == 3 and all(a.recall == 1 for a in audits) and sum(a.vectors for a in audits) == 12_000


def test_two_shards_meet_once(spark, monkeypatch):
    """Their links count for both ends, copies included."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    vectors = unit(unit(rng.normal(size=(8, 16)))[rng.integers(0, 8, 120)] + rng.normal(size=(120, 16)) * 0.02)
    table = pa.table({"vec_id": np.arange(120), "embedding": vectors.tolist(), "label": np.ones(120, int), "dim": np.full(120, 16), "copies": rng.integers(1, 4, 120), "shard": np.arange(120) % 3, "shards": np.full(120, 3)})
    built = pa.concat_tables([annlinks.build(table.filter(pa.array(np.arange(120) % 3 == k))) for k in range(3)])
    asked = []
    search = annlinks.Graph.search
    monkeypatch.setattr(annlinks.Graph, "search", lambda self, query, own=None: (asked.append(len(query)), search(self, query, own))[1])
    out = annlinks.across(built, built)
    assert asked == [40, 40, 40]
    near = (vectors @ vectors.T >= 0.98) & (np.arange(120)[:, None] % 3 != np.arange(120)[None] % 3)
    got = np.zeros(120, int)
    counts = out.filter(out.column("n").is_valid())
    np.add.at(got, counts.column("a").to_numpy(), counts.column("n").to_numpy())
    assert got.tolist() == (near @ table.column("copies").to_numpy()).tolist() and got.sum() > 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (4, 9), (7, 7), (None, 3), *((100 + i, 101 + i) for i in range(40))]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {2: 1, 3: 1, 5: 4, 9: 4, **{101 + i: 100 for i in range(40)}}


def test_conversations(spark):
    long = "Fine, thanks, and how is yours?"
    rows = [
        (1, 0, "Hello there.\n\nHow are you?"), (1, 1, f"On Monday X wrote:\n> Hello there.\n>\n> How are you?\n{long}"), (1, 2, f"> > How are   you?\n> {long}\nGood."), (1, 3, "> hello THERE.\nback to first"),
        (2, 0, f"> {long}\ncross"), (2, 1, "next"), (3, 5, None), (3, 5, "dup"), (None, 1, "> x\nnull"), (4, 1, "> unknown quote\ntext"), (4, 7, "> text\n>> unknown quote\nself"),
        (5, 0, "> Hello there.\nshort passages link no conversations"), (6, 0, "a line that two conversations hold"), (7, 0, "a line that two conversations hold"), (8, 0, "> a line that two conversations hold\ncommon"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, position string")
    got = {(r.conv_id, r.turn, r.text): r for r in quotes.conversations(df).collect()}
    assert len(got) == len(rows)
    parent = lambda c, t, x: (got[c, t, x].parent_conv, got[c, t, x].parent_turn)
    assert parent(1, 1, long) == (1, 0) and parent(1, 2, "Good.") == (1, 1) and parent(1, 3, "back to first") == (1, 0) and parent(2, 0, "cross") == (1, 1)
    assert (got[2, 1, "next"].thread_conv, got[2, 1, "next"].thread_turn, got[2, 1, "next"].position) == (1, 0, 5)
    assert got[None, 1, "null"].thread_conv is None and parent(4, 1, "text") == (None, None) and got[4, 7, "self"].n_linked == 1
    assert parent(5, 0, "short passages link no conversations") == (None, None) == parent(8, 0, "common")
    assert quotes.conversations(df.limit(0)).count() == 0


def test_a_very_long_message(spark):
    long = "\n".join(f"line {k} of a long message" for k in range(60_000))
    df = spark.createDataFrame([(1, 0, long), (1, 1, "".join(f"> {x}\n" for x in long.split("\n")) + "short"), (1, 1, None)], "conv_id long, turn long, text string")
    got = sorted((r.turn, len(r.text), r.n_quotes, r.n_linked) for r in quotes.conversations(df).collect())
    assert got == [(0, len(long), 0, 0), (1, 0, 0, 1), (1, 5, 1, 1)]


def generated(seed, n_conv):
    """Messages that quote earlier ones of their own or another conversation, up to three levels deep."""
    rng = random.Random(seed)
    own, full, rows = {}, {}, []
    for conv in range(n_conv):
        for turn in range(rng.randrange(1, 9)):
            text = "\n".join(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 6, 9]))) for _ in range(rng.randrange(1, 4)))
            head = ""
            if full and rng.random() < 0.6:
                source = rng.choice([k for k in full if k[0] == conv] or list(full)) if rng.random() < 0.7 else rng.choice(list(full))
                quoted = full[source].split("\n")
                if rng.random() < 0.4:
                    quoted = [rng.choice(quoted)]
                head = "Someone wrote:\n" + "".join(("> " if rng.random() < 0.9 else ">") + q + "\n" for q in quoted)
            own[conv, turn], full[conv, turn] = text, head + text
            rows.append((conv, turn, head + text))
    return rows


def threads_of(rows):
    """Brute force over all earlier messages."""
    norm = lambda t: " ".join(t.lower().split())
    parts = lambda t: [p for p in dict.fromkeys(norm(p) for p in [t, *t.split("\n\n"), *t.split("\n")]) if p]
    own, quoted = {}, {}
    for c, t, text in rows:
        mine, runs = [], []
        for line in text.split("\n"):
            level, body = 0, line
            while body.lstrip(" \t").startswith(">"):
                level, body = level + 1, body.lstrip(" \t")[1:]
            body = body[1:] if level and body[:1] in (" ", "\t") else body
            if not level:
                mine.append(line)
            elif runs and runs[-1][2] and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                if mine and mine[-1].endswith("wrote:") and not (runs and runs[-1][2]):
                    mine.pop()
                runs.append([level, [body], True])
            if not level and runs:
                runs[-1][2] = False
        own[c, t], quoted[c, t] = "\n".join(mine), [(level, "\n".join(body)) for level, body, _ in runs]
    held = {k: parts(v) for k, v in own.items()}
    parent, linked, root = {}, {}, {}
    for k in sorted(own):
        links = []
        for no, (level, passage) in enumerate(quoted[k]):
            for rank, p in enumerate(parts(passage)):
                near = [m for m in sorted(held) if m[0] == k[0] and p in held[m]]
                homes = {m[0] for m in held if p in held[m]}
                far = [m for m in sorted(held) if p in held[m]] if len(homes) == 1 and len(p.split()) >= quotes.FAR_WORDS else []
                source = next((m[0] for m in (near, far) if m and m[0] < k), None)
                if source:
                    links.append((level, no, rank, source))
        linked[k] = len({no for _, no, _, _ in links})
        before = [m for m in own if m[0] == k[0] and m < k]
        first = min(((no, rank, source) for level, no, rank, source in links if level == 1), default=None)
        parent[k] = first[2] if first else max(before, default=None)
        root[k] = root[parent[k]] if parent[k] else k
    order = {r: sorted(k for k in root if root[k] == r) for r in set(root.values())}
    return {k: (own[k].strip("\n"), len(quoted[k]), linked[k], parent[k], root[k], order[root[k]].index(k)) for k in own}


def test_generated_conversations(spark):
    rows = generated(11, 120)
    want = threads_of(rows)
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()
    both = lambda a, b: None if a is None else (a, b)
    assert {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, both(r.parent_conv, r.parent_turn), (r.thread_conv, r.thread_turn), r.position) for r in got} == want
    assert sum(w[2] > 0 for w in want.values()) > 100 and any(w[3] and w[3][0] != k[0] for k, w in want.items())
