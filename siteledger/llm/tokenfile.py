"""Token-id output: shards of documents' ids, compressed by Re-Pair grammars.

Each round counts all neighbouring pairs of a shard, gives the most frequent ones nonterminals and
replaces them from left to right; rounds end when no pair comes LEAST times. A round takes many
pairs at once, so a pair that a better one overlaps may lose places to it, and comes up again in
the next round. No pair reaches over a document's end, so every document keeps symbols of its own.

File format (little endian): magic, end id, first nonterminal, counts of rules, documents and symbols;
then rules (left, right), expansion lengths of the rules, doc ids, symbol ends and id ends of the
documents, and the symbols (without end ids, which the reader puts back). A file's folders name its shard and its total of ids, so
starts come from a listing; the reader holds each total against the file. One document is read by expanding its own symbols; a range within it by a
binary search over the running expansion lengths.

Null text counts as empty and gives the end id alone. Repeated ids keep their rows, in any order. An
empty table writes no shard. Null ids come first and come back as nulls (the file has NO_ID for them). A text of any length stays in one shard. Only the id and
text columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.packing import starts_of, with_end
from siteledger.llm.pretokens import encoder
from siteledger.llm.shared import new_path, read_shards, write_shards

MAGIC = b"RPRS"
HEAD = struct.Struct("<4sIIQQQ")
#: Stands for a document's end while a shard is compressed.
END = 0xFFFFFFFF
#: Stands for a null id in a file.
NO_ID = -(1 << 63)
#: Times that a pair must come to get a nonterminal.
LEAST = 16
#: Buckets of pairs that one round looks at.
PAIRS = 4096
#: Places that a round sorts without buckets, and of which it sorts those to look at next.
FEW, SPARSE = 1 << 16, 1 << 12
#: Ids after which a shard ends; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Buckets of a round's first count, by which it leaves out rare pairs.
BUCKETS = 1 << 20


def buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bucket for each pair."""
    key = left * np.uint32(0x9E3779B1)
    key ^= key >> np.uint32(15)
    key += right * np.uint32(0x85EBCA77)
    key ^= key >> np.uint32(13)
    key *= np.uint32(0xC2B2AE3D)
    return (key >> np.uint32(12)).astype(np.int64)


def told_apart(pairs: np.ndarray, bucket: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, which of them each one is, and how often each comes. Most buckets hold one pair, so few pairs need sorting."""
    one = np.zeros(n_buckets, np.uint64)
    one[bucket] = pairs
    other = np.flatnonzero(one[bucket] != pairs)
    more, place = np.unique(pairs[other], return_inverse=True)
    kind = bucket.astype(np.int64)
    kind[other] = n_buckets + place
    return np.concatenate([one, more]), kind, np.bincount(kind, minlength=n_buckets + len(more))


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """symbols, rules: rule k stands for the pair rules[k] and has the symbol first + k. Ends stay as they are.

    A pair that is rare once stays rare, as only pairs with a new symbol can come up. So each round looks at
    the places that the last one left frequent, and at those next to its new symbols.
    """
    symbols, rules, n_rules = ids.astype(np.uint32), [], 0
    most = PAIRS
    at = None  # all places
    while len(symbols) > 1:
        if at is None or len(at) > FEW:
            left, right = (symbols[:-1], symbols[1:]) if at is None else (symbols[at], symbols[at + 1])
            bucket = buckets(left, right)
            bucket[(left == END) | (right == END)] = BUCKETS
            rough = np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS]
            often = np.flatnonzero(rough >= least)
            top = often[np.argsort(-rough[often], kind="stable")[:most]]
            rate = np.zeros(BUCKETS + 1, np.int32)
            rate[often] = 1
            rate[top] = np.arange(2, len(top) + 2)
            rate = rate[bucket]
            live = np.flatnonzero(rate > 0)
            kind = rate[live] - 2
            known = np.flatnonzero(kind >= 0)
            hit, kind = live[known], kind[known]
            if at is not None:
                live, hit = at[live], at[hit]
            whole = len(top) == len(often)
            pairs, kind, n = told_apart((symbols[hit].astype(np.uint64) << np.uint64(32)) | symbols[hit + 1], kind, len(top))
        else:
            hit = at[(symbols[at] != END) & (symbols[at + 1] != END)]
            pairs, kind, n = np.unique((symbols[hit].astype(np.uint64) << np.uint64(32)) | symbols[hit + 1], return_inverse=True, return_counts=True)
            live, whole = hit[n[kind] >= least], True
        order = np.lexsort((pairs, -n))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        best = n[order] >= least
        if not best.any():
            # buckets may be full of rare pairs; then more of them are looked at
            if whole:
                break
            most *= 16
            continue
        rank = rank[kind]
        # masks are turned into places, as picking by places takes a third of the time
        good = np.flatnonzero(rank < int(best.sum()))
        hit, rank = hit[good], rank[good]
        # of places that overlap, the one of the more frequent pair stays; alike pairs go from left to right
        near = hit[1:] == hit[:-1] + 1
        worse = np.zeros(len(hit), bool)
        worse[1:] = near & (rank[1:] > rank[:-1])
        worse[:-1] |= near & (rank[:-1] > rank[1:])
        stays = np.flatnonzero(~worse)
        hit, rank = hit[stays], rank[stays]
        near = np.zeros(len(hit), bool)
        near[1:] = hit[1:] == hit[:-1] + 1
        run_at = np.maximum.accumulate(np.where(near, 0, np.arange(len(hit))))
        even = np.flatnonzero((np.arange(len(hit)) - run_at) & 1 == 0)
        hit, rank = hit[even], rank[even]
        used = np.flatnonzero(np.bincount(rank, minlength=len(pairs)))
        number = np.zeros(len(pairs), np.uint32)
        number[used] = np.arange(len(used)) + first + n_rules
        rules.append(pairs[order][used])
        n_rules += len(used)
        symbols[hit] = number[rank]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        stays = np.flatnonzero(keep)
        symbols = symbols[stays]
        new = hit - np.arange(len(hit))
        if len(live) > SPARSE:
            look = np.zeros(len(keep), bool)
            look[live] = True
            look = look[stays]
            look[new] = look[new - 1] = True  # place -1 is the last one, which starts no pair
            at = np.flatnonzero(look[:-1])
        else:
            live = live[keep[live]]
            at = np.unique(np.concatenate([live - np.searchsorted(hit, live), new, new - 1]))
            at = at[(at >= 0) & (at < len(symbols) - 1)]
    pairs = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    return symbols, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule stands for; a rule only uses rules before it."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def write_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, end_id: int, first: int) -> bytes:
    """counts: ids of each document, without the end id."""
    symbols, rules = compress(np.insert(ids, np.cumsum(counts), END), first)
    lengths = expansion_lengths(rules, first)
    ends = np.flatnonzero(symbols == END) - np.arange(len(doc_ids))
    symbols = symbols[symbols != END]
    head = HEAD.pack(MAGIC, end_id, first, len(rules), len(doc_ids), len(symbols))
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), np.cumsum(counts + 1).astype("<i8").tobytes(), symbols.astype("<u4").tobytes()])


class Shard:
    """A shard file's parts, and the ids of any document or range of one."""

    def __init__(self, blob: bytes):
        magic, self.end_id, self.first, n_rules, n_docs, n_symbols = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def part(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = part("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = part("<u4", n_rules)
        self.doc_ids, self.symbol_ends, self.id_ends = part("<i8", n_docs), part("<i8", n_docs), part("<i8", n_docs)
        self.symbols = part("<u4", n_symbols)
        self.flat = None

    def _rule_ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all rules in a row, with each rule's start and length; made once."""
        if self.flat is None:
            start = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
            pool = np.empty(int(self.lengths.sum()), np.uint32)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at = int(start[k])
                for x in (a, b):
                    if x < self.first:
                        pool[at] = x
                        at += 1
                    else:
                        n, s = int(self.lengths[x - self.first]), int(start[x - self.first])
                        pool[at : at + n] = pool[s : s + n]
                        at += n
            self.flat = pool, start, self.lengths.astype(np.int64)
        return self.flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        pool, start, lengths = self._rule_ids()
        big = symbols >= self.first
        n = np.ones(len(symbols), np.int64)
        rule = symbols[big].astype(np.int64) - self.first
        n[big] = lengths[rule]
        after = np.cumsum(n)
        out = np.empty(int(after[-1]) if len(n) else 0, np.uint32)
        at = after - n
        out[at[~big]] = symbols[~big]
        m = n[big]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(at[big], m) + inner] = pool[np.repeat(start[rule], m) + inner]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.documents(k, k + 1)[0]

    def documents(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of documents a to b in a row, and how many each has."""
        ids = self.expand(self.symbols[self.symbol_ends[a - 1] if a else 0 : self.symbol_ends[b - 1]])
        counts = np.diff(self.id_ends[a:b], prepend=self.id_ends[a - 1] if a else 0) - 1
        return with_end(ids, counts, self.end_id)

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k; expands only the symbols that hold them."""
        symbols = self.symbols[self.symbol_ends[k - 1] if k else 0 : self.symbol_ends[k]]
        big = symbols >= self.first
        n = np.ones(len(symbols), np.int64)
        n[big] = self.lengths[symbols[big] - self.first]
        after = np.cumsum(n)
        a, b = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left") + 1
        base = int(after[a - 1]) if a else 0
        return np.append(self.expand(symbols[a:b]), np.uint32(self.end_id) if b > len(symbols) else np.empty(0, np.uint32))[start - base : stop - base]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, first: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents in ascending id order; shard numbers rise with the ids. first: above any id.

    A task cuts its run of ids into shards of about SHARD_IDS, so neither a task's memory nor a file grows with the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal number
            doc_ids, counts, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            blob = write_shard(doc_ids, counts, ids, end_id, first)
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([len(ids) + len(counts)], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "total", "blob"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                ids, n = enc.encode(piece.column(1).to_pylist())
                doc_ids, after, at = piece.column(0).fill_null(NO_ID).to_numpy(), np.concatenate([[0], np.cumsum(n)]), 0
                while at < len(n):
                    # up to the document with which the shard has enough
                    room = SHARD_IDS - sum(len(h[2]) for h in held)
                    stop = min(len(n), max(at + 1, int(np.searchsorted(after, after[at] + room))))
                    held.append((doc_ids[at:stop], n[at:stop], ids[after[at] : after[stop]]))
                    if after[stop] - after[at] >= room:
                        yield flush()
                    at = stop
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    write_shards(ranged.mapInArrow(run, "shard long, total long, blob binary"), "shard", "total", "blob", path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, shard_start, n_tokens, ids (little-endian unsigned 32-bit) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, total, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(blob.as_buffer())
                if total != (shard.id_ends[-1] if len(shard.id_ends) else 0):
                    raise ValueError(f"shard {number} doesn't hold the {total} ids that its folder names")
                for k in range(0, len(shard.doc_ids), 256):
                    stop = min(k + 256, len(shard.doc_ids))
                    ids, n = shard.documents(k, stop)
                    ends = np.cumsum(n)
                    blobs = [ids[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(n), pa.int64()), pa.array(shard.doc_ids[k:stop], mask=shard.doc_ids[k:stop] == NO_ID), pa.array(shard.id_ends[k:stop] - n), pa.array(n), pa.array(blobs, pa.binary())], names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])

    return read_shards(spark, path).mapInArrow(run, "shard long, doc_id long, shard_start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, first: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids, read the files back: doc_id, start, n_tokens, ids, shard."""
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write(docs, path, tokenizer, end_id, first, id_col, text_col)
    back = read(spark, path)

    # one row for each shard file
    starts = F.broadcast(starts_of(read_shards(spark, path).select("shard", "total"), "shard", "total"))
    return back.join(starts, "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids", "shard")
