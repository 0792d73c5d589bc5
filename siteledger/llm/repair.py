"""Cheapest repair of a conversation's structure by a scan of min-plus matrices.

The repaired roles' initials must read (s?(ua)+)?. That language has an automaton of four states: nothing yet, after s, after u (an
answer is due), after a (may end). An edit moves between states at a cost: keep 0, rerole 2, delete 3, insert 2, and 1 more for a
truncated turn that stays; blank and repeated turns must go. A turn is a 4x4 matrix of (cost, audit), where the audit
holds the edits' initials: the closure of inserts before it, times the moves of its own edits. Products
take the least (cost, audit), which is associative, and sound for audits too: of two audits of equal cost over the same turns
none is the start of the other, as it would have to be by inserts alone. So each chunk of CHUNK neighbouring
turns becomes one matrix in its own task, and FAN neighbouring matrices become one in each round of a tree, over as many tasks as there are
groups. The audit fixes all roles: counted from the end, repaired turns are assistant and user in turn, and the first
one is a system's where their number is odd.

Nulls in role and text count as one blank; null turns come first and count for no gap; a null conversation is one of its own.
Turns of equal number are ordered by role and by the text's SHA-256, so equal rows are interchangeable. Roles count
by their first character alone, other initials can't be kept. Texts of any length are read once for faults and once for
the result. An empty table has no conversations. Only the named columns are read, so others can have any names. An audit is one
cell, so a conversation's letters must fit in one (2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.shared import cut
from siteledger.plans.lineage import numbered

#: Turns of a chunk, matrices that become one in a round, and letters that are worked on at a time.
CHUNK, FAN, LETTERS = 1024, 16, 500_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Characters that are no ink, and the marks that end a text.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Classes of roles and faults; a turn's kind is a letter for its pair.
ROLES, FAULTS = "suao", ("none", "truncated", "blank", "duplicate")

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]

#: The state that follows each state (rows) after s, u and a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product of two matrices, each 16 entries row by row."""
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for k in range(4) if (x := a[i + k]) is not None and (y := b[4 * k + j]) is not None]
            out.append(min(ways, default=None))
    return tuple(out)


def matrix(moves: Iterable[tuple[int, int, int, str]]) -> Matrix:
    """Of moves (from, to, cost, letter) the cheapest between each two states."""
    out: list[Entry] = [None] * 16
    for i, j, cost, letter in moves:
        out[4 * i + j] = min([e for e in (out[4 * i + j], (cost, letter)) if e is not None])
    return tuple(out)


ONE = matrix((i, i, 0, "") for i in range(4))
_INSERT = matrix([(i, j, INSERT, "I") for i in range(4) for x, j in NEXT[i].items() if x in "ua"])
#: Any number of inserts; a third one never pays, as two lead back to the same state.
INSERTS = tuple(min([e for e in three if e is not None], default=None) for three in zip(ONE, _INSERT, times(_INSERT, _INSERT), strict=True))


def _turn(role: str, fault: str) -> Matrix:
    moves = [(i, i, DELETE, "D") for i in range(4)]
    if fault in ("none", "truncated"):
        more = TRUNCATED if fault == "truncated" else 0
        moves += [(i, j, KEEP + more, "K") for i in range(4) for x, j in NEXT[i].items() if x == role]
        moves += [(i, j, REROLE + more, "R") for i in range(4) for x, j in NEXT[i].items() if x in "ua"]
    return times(INSERTS, matrix(moves))


TURN = {chr(65 + 4 * f + r): _turn(role, fault) for f, fault in enumerate(FAULTS) for r, role in enumerate(ROLES)}


def product(kinds: str) -> Matrix:
    """The matrix of a run of turns, by halves."""
    if len(kinds) <= 16:
        return _short(kinds)
    half = len(kinds) // 2
    return times(product(kinds[:half]), product(kinds[half:]))


@lru_cache(100_000)
def _short(kinds: str) -> Matrix:
    half = len(kinds) // 2
    return times(_short(kinds[:half]), _short(kinds[half:])) if half else TURN[kinds]


ENTRIES = "array<struct<cost:bigint,audit:string>>"
_ENTRY = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _matrices(chunks: DataFrame, of: str, make) -> DataFrame:
    """key, chunk, entries: make turns the column of into a matrix; what it holds is bounded by LETTERS, or by one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, out = 0, 0, []
            for n in range(batch.num_rows):
                m = make(batch.column(2)[n].as_py())
                out.append([None if e is None else {"cost": e[0], "audit": e[1]} for e in m])
                size += 16 * max(len(e[1]) for e in m if e is not None)
                if size > LETTERS or n == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), batch.column(1).slice(start, len(out)), pa.array(out, _ENTRY)], names=["key", "chunk", "entries"])
                    start, size, out = n + 1, 0, []

    kind = chunks.schema["key"].dataType.simpleString()
    return chunks.select("key", "chunk", of).mapInArrow(run, f"key {kind}, chunk bigint, entries {ENTRIES}")


def _joined(parts: list[dict]) -> Matrix:
    ms = [tuple(None if e is None else (e["cost"], e["audit"]) for e in p) for p in parts]
    while len(ms) > 1:
        ms = [times(*ms[k : k + 2]) if k + 1 < len(ms) else ms[k] for k in range(0, len(ms), 2)]
    return ms[0]


def cheapest(marked: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """key, cost, audit of each conversation of marked (key, position from 1, kind)."""
    chunks = marked.groupBy("key", F.expr(f"(position - 1) div {chunk}").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "kind")))["kind"], "").alias("kinds"))
    level = cut(_matrices(chunks, "kinds", product), "matrices")
    done = []
    while True:
        more = cut(level.where("chunk > 0").select("key").distinct(), "more")
        if more.isEmpty():
            done.append(level)
            break
        done.append(level.join(more, "key", "left_anti"))
        groups = level.join(more, "key", "left_semi").groupBy("key", F.expr(f"chunk div {fan}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("entries").alias("m"))))["m"].alias("parts"))
        level = cut(_matrices(groups, "parts", _joined), "matrices")
    whole = reduce(DataFrame.unionByName, done)

    def end(state: int) -> Column:
        e, more = F.element_at("entries", state + 1), INSERTS[4 * state + 3] if state else (0, "")
        return F.when(e.isNotNull(), F.struct((e["cost"] + more[0]).alias("cost"), F.concat(e["audit"], F.lit(more[1])).alias("audit")))

    best = F.array_min(F.array(*[end(s) for s in range(4)]))
    return whole.select("key", best.alias("best")).select("key", "best.cost", "best.audit")


EDITS = "position bigint, place bigint, edit string, role string"


def edits(found: DataFrame) -> DataFrame:
    """key, position (of the turn, null for inserts), place (in the repaired conversation, null for deletions), edit, role (of inserts and reroles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                letters = np.frombuffer(batch.column(1)[n].as_py().encode(), np.uint8)
                stays, own = letters != ord("D"), letters != ord("I")
                total, place, position = int(stays.sum()), 0, 0
                for at in range(0, len(letters), LETTERS):
                    part, here, mine = letters[at : at + LETTERS], stays[at : at + LETTERS], own[at : at + LETTERS]
                    places, positions = place + np.cumsum(here), position + np.cumsum(mine)
                    place, position = int(places[-1]), int(positions[-1])
                    role = np.where((total - places) % 2 == 0, "assistant", "user")
                    key = pa.chunked_array([batch.column(0).slice(n, 1)]).take(pa.array(np.zeros(len(part), np.int64))).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array(positions, mask=~mine), pa.array(places, mask=~here), pa.array(np.array(list(part.tobytes().decode()))), pa.array(role.astype(object), pa.string(), mask=~np.isin(part, list(b"IR")))],
                        names=["key", "position", "place", "edit", "role"],
                    )

    kind = found.schema["key"].dataType.simpleString()
    return found.where("audit <> ''").select("key", "audit").mapInArrow(run, f"key {kind}, {EDITS}")


def digests(turns: DataFrame) -> DataFrame:
    """key, sha256 of role:text lines joined by newlines. A digest has one reader: it streams, and holds a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array([h.hexdigest()])], names=["key", "sha256"])

        for batch in batches:
            for n, (k, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if h is None or key[0].as_py() != k:
                    if h is not None:
                        yield told()
                    key, h = batch.column(0).slice(n, 1), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if h is not None:
            yield told()

    laid = turns.select("key", "place", "role", "text").repartition("key").sortWithinPartitions("key", "place")
    return laid.mapInArrow(run, f"key {turns.schema['key'].dataType.simpleString()}, sha256 string")


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Two frames: key (a struct of the conversation's id), gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation that has turns;
    and its repaired turns: key, place (from 1), edit, role, text."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = messages.select(F.struct(F.col(conv)).alias("key"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    ending = F.when(last == "", "blank").when(~last.isin(*ENDS), "truncated").otherwise("none")
    rows = numbered(rows.select("key", "turn", "role", "text", F.sha2("text", 256).alias("digest"), ending.alias("ending")), ["key"], ["turn", "role", "digest"])
    first = rows.groupBy("key", "role", "digest").agg(F.min("position").alias("position")).select("key", "position", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    marked = rows.select("key", "turn", "position", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), "ending").join(first, ["key", "position"], "left")
    fault = F.when(F.col("ending") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("ending"))
    place = lambda c, names: reduce(lambda w, n: w.when(c == n[1], n[0]), list(enumerate(names))[1:], F.when(c == names[0], 0))
    marked = marked.withColumn("fault", fault).withColumn("kind", F.chr(65 + 4 * place(F.col("fault"), FAULTS) + place(F.col("initial"), list(ROLES))))
    marked = cut(marked.select("key", "turn", "position", "initial", "fault", "kind"), "marked")
    before = marked.select("key", (F.col("position") + 1).alias("position"), F.col("initial").alias("before"))
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    count = lambda c: F.count_if(c)
    n_turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = marked.groupBy("key").agg(n_turns.alias("gaps"), *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    pairs = marked.join(before, ["key", "position"]).groupBy("key").agg(count(~legal).alias("illegal"))
    found = cut(cheapest(marked, chunk, fan), "repairs")
    report = counts.join(pairs, "key", "left").join(found, "key").select("key", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).cast("long").alias("illegal"), "cost", "audit")
    moves = edits(found)
    own = moves.where("edit in ('K', 'R')").withColumnRenamed("role", "new").join(rows.select("key", "position", "role", "text"), ["key", "position"])
    added = moves.where("edit = 'I'").select("key", "place", "edit", "role", F.lit("").alias("text"))
    return report, own.select("key", "place", "edit", F.coalesce("new", "role").alias("role"), "text").unionByName(added)
