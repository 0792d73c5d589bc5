"""Near-duplicate documents by weighted Jaccard similarity of word shingles.

Weights: a shingle (five words, ASCII case folded) weighs its count in the document times
1 + log(N / df) / log(N), df counted over all N documents, copies included. Sketches: improved
consistent weighted sampling, SAMPLES draws in bands of ROWS. Documents that share a band become candidates
and are verified by weighted Jaccard similarity of at least THRESHOLD; linked ones form classes.

1. Exact copies (equal texts) are found by digest and stand for one document afterwards.
2. Document frequencies: each task sorts its shingles' hashes and sends them, as packed differences, to
   the task of their range, which counts them and returns those that come in two documents or more. Hashes
   have some bits more than the number of shingles needs, so few shingles share one.
3. A document whose shingles with df >= 2 weigh under THRESHOLD of its total can't reach the
   threshold with any other; it ends here. The others are sketched.
4. Within a bucket pairs are not emitted. A round compares its members with some leaders, at first one,
   then 64 times as many each time. A bucket is done if its members are in one class; if few members lie
   outside the largest class, they are compared with all others and it is done too; else the next leaders
   follow. From the second round on, bounded blocks of leaders meet bounded blocks of members in a task, which
   returns only links that join classes. So every pair of different classes in a bucket is compared in the end.

Null texts and texts without words are alike to nothing but equal texts are copies of each other; null texts
link with nothing. A text of one to four words is one shingle. Rows with equal ids count as one
document, which links by the smallest of their texts in byte order and by all equal texts; rows with a null id get
a null class and stay. An empty table gives no rows. A text of any length is one document; it is never cut. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.graph import components
from siteledger.llm.packing import starts_of
from siteledger.llm.pretokens import mixed
from siteledger.llm.quality import WHITE, hashes
from siteledger.llm.shared import cut

WORDS, THRESHOLD = 5, 0.8
SAMPLES, ROWS = 36, 3
#: Characters of documents in one chunk, and of shingles in one range of hashes.
CHUNK_CHARS, RANGE_CHARS = 6_000_000, 4_000_000
#: Shingles that a task holds before it sends them on.
HELD = 2_000_000
#: Bytes of shingles in a block of a bucket, and members outside a bucket's largest class that meet all others at once.
BLOCK_BYTES, FEW = 1_000_000, 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(texts: list[bytes], words: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, hash, count of each text's distinct shingles, sorted by both."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    text_end = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(WHITE[data], prepend=True))
    at, end = edge[::2], edge[1::2]
    word = hashes(data, at, end)
    owner = np.searchsorted(text_end, at, "right")
    n = np.bincount(owner, minlength=len(texts))
    m = max(0, len(word) - words + 1)
    key = word[:m].copy()
    for k in range(1, words):
        key = mixed(key * np.uint64(31) + word[k : m + k])
    whole = owner[:m] == owner[words - 1 :] if m else np.zeros(0, bool)
    owners, keys = [owner[:m][whole]], [key[whole]]
    first = np.cumsum(n) - n
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():
        fold = np.array([n[i]], np.uint64)
        for w in word[first[i] : first[i] + n[i]]:
            fold = mixed(fold * np.uint64(31) + w)
        owners.append(np.array([i]))
        keys.append(fold)
    owner, key = np.concatenate(owners), np.concatenate(keys) >> np.uint64(64 - bits)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    where = np.flatnonzero(new)
    return owner[where], key[where], np.diff(np.append(where, len(key)))


def packed(values: np.ndarray) -> bytes:
    """Rising integers as differences of as few bytes as the largest needs."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) > 1 else 8
    head = int(values[0]).to_bytes(8, "little")
    if len(steps) > 1:
        width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8)
    return bytes([width]) + head + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    width, n = blob[0], (len(blob) - 9) // blob[0]
    wide = np.zeros((n + 1, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8, 1)
    wide[1:, :width] = np.frombuffer(blob, np.uint8, n * width, 9).reshape(n, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def packed_counts(df: np.ndarray) -> bytes:
    """Document frequencies: a byte each, and eight more at the end for each that reaches 255."""
    return np.minimum(df, 255).astype(np.uint8).tobytes() + df[df >= 255].astype("<i8").tobytes()


def unpacked_counts(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n)
    return out


def weight_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    """1 + log(N / df) / log(N): from 2 for a shingle of one document down to 1 for one of all."""
    return 2 - np.log(df) / np.log(max(n_docs, 2))


def draws(key: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling, draw k: each shingle's value (the least one is drawn) and its level."""
    unit = lambda bits: ((bits & np.uint64(0xFFFFFFFF)).astype(np.float64) + 1) / 4294967297.0
    a, b, c = (mixed(key + np.uint64(0x9E3779B97F4A7C15 * (3 * k + j) % (1 << 64))) for j in (1, 2, 3))
    r = -np.log(unit(a) * unit(a >> np.uint64(32)))
    gamma = -np.log(unit(b) * unit(b >> np.uint64(32)))
    beta = unit(c)
    level = np.floor(np.log(weight) / r + beta)
    return np.log(gamma) - r * (level - beta) - r, level


def sketch(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A row of SAMPLES 32-bit samples for each of n documents, all of which have shingles."""
    out = np.empty((n, SAMPLES), np.uint32)
    start = np.searchsorted(owner, np.arange(n))
    for k in range(SAMPLES):
        value, level = draws(key, weight, k)
        order = np.lexsort((key, value, owner))
        first = order[start]
        out[:, k] = (mixed(key[first] * np.uint64(31) + level[first].astype(np.int64).astype(np.uint64) + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)
    return out


def weighted_jaccard(a: bytes, wa: bytes, b: bytes, wb: bytes, total_a: float, total_b: float) -> float:
    """Of two documents' repeated shingles (keys and weights) and total weights."""
    _, i, j = np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True, return_indices=True)
    shared = float(np.minimum(np.frombuffer(wa, "<f4")[i].astype(float), np.frombuffer(wb, "<f4")[j].astype(float)).sum())
    return shared / (total_a + total_b - shared)


def pieces(batch_texts: list[str | None], size: int = 400_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about size bytes, with the place of the first."""
    at, held, n = 0, [], 0
    for i, t in enumerate(batch_texts):
        b = (t or "").encode()
        if held and n + len(b) > size:
            yield at, held
            at, held, n = i, [], 0
        held.append(b)
        n += len(b)
    if held:
        yield at, held


def repeated(docs: DataFrame, bits: int, ranges: int) -> DataFrame:
    """p, keys, counts: for chunk p its shingles that come in two documents or more, with their numbers of documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        n_held = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for p, parts in held.items():
                key = np.concatenate(parts)
                parts.clear()
                key.sort()
                where = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count, key = np.diff(np.append(where, len(key))), key[where]
                place = ((key.astype(np.float64) * ranges) / 2.0**bits).astype(np.int64)
                edge = np.flatnonzero(np.diff(place, prepend=-1))
                rows += [(int(place[a]), p, packed(key[a:b]), b"" if (count[a:b] == 1).all() else count[a:b].astype("<u4").tobytes()) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["r", "p", "keys", "counts"])

        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            for at, texts in pieces(batch.column(1).to_pylist()):
                owner, key, _ = shingles(texts, WORDS, bits)
                if not len(key):
                    continue
                # owners rise, so a run of documents of one chunk has its keys in a row
                edge = np.append(np.flatnonzero(np.diff(chunk[at : at + len(texts)], prepend=chunk[at] - 1)), len(texts))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    held.setdefault(int(chunk[at + a]), []).append(key[np.searchsorted(owner, a) : np.searchsorted(owner, b)])
                n_held += len(key)
                if n_held > HELD:
                    yield flush()
                    held.clear()
                    n_held = 0
        if n_held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        keys = [unpacked(b) for b in table.column("keys").to_pylist()]
        counts = [np.frombuffer(b, "<u4") if b else np.ones(len(k), np.uint32) for b, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)[inverse]
        out, at = [], 0
        for p, key in zip(table.column("p").to_pylist(), keys, strict=True):
            mine = df[at : at + len(key)]
            at += len(key)
            if (often := mine >= 2).any():
                out.append((p, packed(key[often]), packed_counts(mine[often])))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["p", "keys", "counts"])

    sent = docs.select("p", "text").mapInArrow(send, "r long, p long, keys binary, counts binary")
    return sent.groupBy("r").applyInArrow(count, "p long, keys binary, counts binary")


SKETCHED = "doc_id long, samples array<int>, keys binary, weights binary, total double"


def sketched(docs: DataFrame, common: DataFrame, copies: DataFrame, bits: int, n_docs: int) -> DataFrame:
    """Sketches and repeated shingles of the documents that can reach the threshold with another one."""
    side = common.select("p", "keys", "counts", F.lit(None).cast("long").alias("copy")).unionByName(copies.select("p", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), F.col("doc_id").alias("copy")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        skip = set(right.column("copy").drop_null().to_pylist())
        blobs = [(key := unpacked(k), unpacked_counts(c, len(key))) for k, c in zip(right.column("keys").to_pylist(), right.column("counts").to_pylist(), strict=True) if k is not None]
        known = np.concatenate([b[0] for b in blobs]) if blobs else np.empty(0, np.uint64)
        df = np.concatenate([b[1] for b in blobs]) if blobs else np.empty(0, np.int64)
        known, first = np.unique(known, return_index=True)
        df = df[first]
        out: dict[str, list] = {k: [] for k in ("doc_id", "samples", "keys", "weights", "total")}
        seen: set[int] = set()
        ids, n = np.unique(left.column("doc_id").to_numpy(), return_counts=True)
        least: dict[int, bytes] = {}
        if (n > 1).any():
            again = left.filter(pc.is_in(left.column("doc_id"), pa.array(ids[n > 1])))
            for i, t in zip(again.column("doc_id").to_pylist(), again.column("text").to_pylist(), strict=True):
                least[i] = min(least.get(i, t.encode()), t.encode())
        for batch in left.select(["doc_id", "text"]).to_batches(max_chunksize=1024):
            rows = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i not in skip and i not in seen and (i not in least or t.encode() == least[i]) and not seen.add(i)]
            for at, texts in pieces([t for _, t in rows]):
                owner, key, count = shingles(texts, WORDS, bits)
                if not len(key) or not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                often = known[place] == key
                weight = count * np.where(often, weight_of(df[place], n_docs), 2.0)
                total = np.bincount(owner, weight, len(texts))
                good = np.bincount(owner, weight * often, len(texts)) >= THRESHOLD * total - 1e-9
                good &= total > 0
                if not good.any():
                    continue
                picks = np.flatnonzero(good)
                mine = good[owner]
                number = np.cumsum(good) - 1
                samples = sketch(number[owner[mine]], key[mine], weight[mine], len(picks))
                both = mine & often
                start, stop = np.searchsorted(owner[both], picks), np.searchsorted(owner[both], picks, "right")
                k, w = key[both].astype("<u8"), weight[both].astype("<f4")
                out["doc_id"] += [rows[at + i][0] for i in picks.tolist()]
                out["samples"] += samples.view(np.int32).tolist()
                out["keys"] += [k[a:b].tobytes() for a, b in zip(start, stop, strict=True)]
                out["weights"] += [w[a:b].tobytes() for a, b in zip(start, stop, strict=True)]
                out["total"] += total[picks].tolist()
        types = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.float64())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return docs.groupBy("p").cogroup(side.groupBy("p")).applyInArrow(run, SKETCHED)


def verified(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            good = [(a, b) for a, b, ka, wa, ta, kb, wb, tb in rows if weighted_jaccard(ka, wa, kb, wb, ta, tb) >= THRESHOLD - 1e-6]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("weights").alias(f"weights_{x}"), F.col("total").alias(f"total_{x}"))
    # only the documents in question travel
    asked = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "asked")
    sketches = sketches.join(asked, "doc_id", "left_semi")
    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "keys_a", "weights_a", "total_a", "keys_b", "weights_b", "total_b")
    return wide.mapInArrow(run, "a long, b long")


def cost() -> Column:
    """Bytes that a document's shingles take."""
    return F.octet_length("keys") + F.octet_length("weights") + 64


def matched(heads: pa.Table, members: pa.Table) -> list[tuple[int, int]]:
    """Links between heads and members of unlike classes, as few as join the classes that belong together."""

    def side(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
        weights = [np.frombuffer(w, "<f4").astype(float) for w in table.column("weights").to_pylist()]
        return keys, weights, table.column("total").to_numpy()

    keys_h, weights_h, total_h = side(heads)
    keys_m, weights_m, total_m = side(members)
    known, place = np.unique(np.concatenate(keys_m), return_inverse=True)
    weight, sizes = np.concatenate(weights_m), np.array([len(k) for k in keys_m])
    stop = np.cumsum(sizes)
    ids, names = np.concatenate([heads.column("doc_id").to_numpy(), members.column("doc_id").to_numpy()]), np.concatenate([heads.column("class").to_numpy(), members.column("class").to_numpy()])
    _, group = np.unique(names, return_inverse=True)
    group_h, group_m = group[: len(keys_h)], group[len(keys_h) :]
    dense, out = np.zeros(len(known)), []
    for h in range(len(keys_h)):
        # a similarity is the smaller total over the larger one at the most, so this loses nothing
        ask = np.flatnonzero((group_m != group_h[h]) & (np.minimum(total_m, total_h[h]) >= (THRESHOLD - 1e-6) * np.maximum(total_m, total_h[h])))
        if not len(ask):
            continue
        at = np.minimum(np.searchsorted(known, keys_h[h]), len(known) - 1)
        hit = known[at] == keys_h[h]
        dense[at[hit]] = weights_h[h][hit]
        if 2 * len(ask) > len(keys_m):
            shared = np.bincount(np.repeat(np.arange(len(keys_m)), sizes), np.minimum(dense[place], weight), len(keys_m))[ask]
        else:
            shared = np.array([np.minimum(dense[place[stop[m] - sizes[m] : stop[m]]], weight[stop[m] - sizes[m] : stop[m]]).sum() for m in ask.tolist()])
        dense[at[hit]] = 0
        good = ask[shared / (total_h[h] + total_m[ask] - shared) >= THRESHOLD - 1e-6]
        for g, m in zip(*np.unique(group_m[good], return_index=True), strict=True):
            out.append((int(ids[h]), int(ids[len(keys_h) + good[m]])))
            mine = group_h[h]
            group_m[group_m == g], group_h[group_h == g] = mine, mine
    return out


def by_blocks(live: DataFrame, heads: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b: links between each bucket's heads and members. No pair is a row: blocks of members meet blocks of heads.

    A bucket is dealt to blocks of about BLOCK_BYTES by the hash of the id, however large it is.
    """
    asked = cut(live.select("doc_id").unionByName(heads.select("doc_id")).distinct(), "asked")
    payload = cut(sketches.select("doc_id", "keys", "weights", "total").join(asked, "doc_id", "left_semi"), "asked-shingles")
    members, heads = live.join(payload, "doc_id"), heads.join(payload, "doc_id")
    blocks = lambda side, name: side.groupBy("bucket").agg(F.ceil(F.sum(cost()) / BLOCK_BYTES).alias(name))
    sizes = cut(blocks(members, "m_blocks").join(blocks(heads, "h_blocks"), "bucket"), "blocks")
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    columns = [F.col(c).alias(c) for c in ("bucket", "doc_id", "class", "keys", "weights", "total")]
    members = members.join(sizes, "bucket").select(*columns, own("m_blocks").alias("m"), others("h_blocks").alias("h"))
    heads = heads.join(sizes, "bucket").select(*columns, own("h_blocks").alias("h"), others("m_blocks").alias("m"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = matched(left, right) if left.num_rows and right.num_rows else []
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return heads.groupBy("bucket", "m", "h").cogroup(members.groupBy("bucket", "m", "h")).applyInArrow(run, "a long, b long")


def links(sketches: DataFrame) -> DataFrame:
    """u, v: classes of sketched documents by verified links, in rounds of leaders."""
    n_bands = SAMPLES // ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.xxhash64(k, F.slice("samples", k * ROWS + 1, ROWS))))
    members = cut(sketches.select("doc_id", band.alias("bucket")), "members")
    # of buckets with the same members one is enough
    alike = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.min("doc_id").alias("least")).where("n > 1")
    sizes = alike.groupBy("n", "x", "least").agg(F.min("bucket").alias("bucket")).select("bucket")
    # written first, so that Spark can split a bucket that is hot
    open_ = cut(members.join(cut(sizes, "buckets"), "bucket", "left_semi").select("bucket", "doc_id"), "open")
    totals = sketches.select("doc_id", "total")
    classes = done = None
    leaders = 1
    while not open_.isEmpty():
        labelled = open_.withColumn("class", F.col("doc_id")) if classes is None else open_.join(classes, open_["doc_id"] == classes["u"], "left").select("bucket", "doc_id", F.coalesce("v", "doc_id").alias("class"))
        state = cut(labelled, "state")
        per_class = state.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
        sizes = per_class.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "class"))["class"].alias("top"), F.max("n").alias("most")).where("classes > 1")
        few = F.lit(1 if leaders == 1 else max(leaders, FEW))
        buckets = cut(sizes.select("bucket", "top", (F.col("n") - F.col("most") <= few).alias("whole")), "bucket-state")
        live = state.join(buckets, "bucket")
        ahead = live.where("not whole").select("bucket", "doc_id", "class")
        if done is not None:
            ahead = ahead.join(done, "bucket", "left").where(F.col("last").isNull() | (F.col("doc_id") > F.col("last"))).select("bucket", "doc_id", "class")
        # a task sends no more than the leaders of a bucket to the window
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))
        lead = cut(ahead.withColumn("rank", rank).where(F.col("rank") <= leaders).select("bucket", "doc_id", "class"), "leaders")
        rest = live.where("whole and class != top").select("bucket", "doc_id", "class")
        heads = cut(lead.unionByName(rest), "heads")
        if leaders == 1:
            # a member meets one head of a bucket, so pairs are as many as members at the most
            one = heads.select("bucket", F.col("doc_id").alias("a"), F.col("class").alias("class_a"))
            pairs = live.join(one, "bucket").where((F.col("class") != F.col("class_a")) & (F.col("whole") | (F.col("doc_id") > F.col("a"))))
            pairs = cut(pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct(), "pairs")
            near = pairs.join(totals.select(F.col("doc_id").alias("a"), F.col("total").alias("ta")), "a").join(totals.select(F.col("doc_id").alias("b"), F.col("total").alias("tb")), "b")
            # a similarity is the smaller total over the larger one at the most, so this loses nothing
            able = F.least("ta", "tb") >= (THRESHOLD - 1e-6) * F.greatest("ta", "tb")
            new = cut(verified(cut(near.where(able).select("a", "b"), "candidates"), sketches), "verified")
        else:
            new = cut(by_blocks(live.select("bucket", "doc_id", "class"), heads, sketches), "verified")
        classes = components(new if classes is None else new.unionByName(classes.select(F.col("u").alias("a"), F.col("v").alias("b"))), "a", "b")
        # a bucket goes on until its last member has led; then no pair of it is left
        done = cut(lead.groupBy("bucket").agg(F.max("doc_id").alias("last")), "done")
        open_ = cut(open_.join(done.select("bucket"), "bucket", "left_semi"), "open")
        leaders *= 64
    return classes if classes is not None else sketches.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).limit(0)


def dealt(docs: DataFrame) -> DataFrame:
    """docs with p, their chunk: chunks are runs of rising ids with about CHUNK_CHARS characters each.

    A prefix sum over the tasks' characters cuts the runs, so how ids are spread doesn't matter.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = cut(docs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")), "lengths")
    laid = cut(lengths.repartitionByRange(n, "doc_id").withColumn("task", F.spark_partition_id()), "laid")
    # one row for each task
    before = F.broadcast(starts_of(laid.groupBy("task").agg(F.sum("n").alias("total")), "task", "total"))
    inside = F.sum("n").over(Window.partitionBy("task").orderBy("doc_id")) - F.col("n")
    placed = laid.withColumn("at", inside).join(before, "task")
    firsts = placed.groupBy(F.floor((F.col("before") + F.col("at")) / CHUNK_CHARS).alias("k")).agg(F.min("doc_id").alias("first"))
    starts = sorted(r["first"] for r in firsts.collect())
    # a binary search for the last chunk that starts at the id or before it
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]
    first = F.lit(starts).cast("array<long>")
    found = F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda i, s: F.when(F.get(first, i + s) <= F.col("doc_id"), i + s).otherwise(i))
    return docs.withColumn("p", found.cast("long"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of its class), kept (doc_id = class_id), one row for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    real = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    chars, n_docs = real.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    if not n_docs:
        return rows.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    ranges = -(-(chars + 1) // RANGE_CHARS)
    # a shingle for every two characters at the most; twelve bits over that
    bits = min(63, max(40, (chars // 2 + 1).bit_length() + 12))
    real = dealt(real)
    digests = cut(real.select("doc_id", "p", F.md5(F.col("text").cast("binary")).alias("digest")), "digests")
    first = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "copies")
    copies = cut(digests.join(first, "digest").where("doc_id != first").select("p", "doc_id", "first").distinct(), "copies")
    sketches = cut(sketched(real, repeated(real, bits, ranges), copies, bits, n_docs), "sketches")
    near = links(sketches)
    together = near.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    found = components(together, "a", "b")
    ids = rows.select("doc_id")
    out = ids.join(found, ids["doc_id"] == found["u"], "left").select("doc_id", F.coalesce("v", "doc_id").alias("class_id"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))
