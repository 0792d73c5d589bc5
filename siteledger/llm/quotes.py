"""Conversations from messages with quotations: link quoted passages to their messages, order by reply.

A line's quote level is the number of leading `>` (blanks before each and one after them don't count). Lines of
one level in a row form a passage; a deeper level is a passage of its own. Passages are normalised (lower case,
white space squeezed) and hashed: whole, then by paragraph, then by line. So is each message's own text.
A quoted passage comes from the earliest message of its conversation, before the quoting one, that holds it;
failing that, and if it has FAR_WORDS words or more and messages of one conversation alone hold it, from the earliest of
those, if that comes before the quoting one by (conversation, turn). Short or common passages link no conversations.
The parent of a message is the source of its first linked passage of level one, else the turn before
it in its conversation. A thread is a tree of parents; its root is its earliest message, and since
parents always come earlier, (conversation, turn) is its reply order.

One row for each row of messages: the text without quotes and without the attribution line over a
quote, parent, thread, position in the thread from 0. Null texts count as empty. Rows with a null conversation
or turn have no parent, thread or position. Rows with equal conversation and turn count as one message that holds all their
passages. Texts of any length are read whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.graph import components
from siteledger.llm.packing import starts_of
from siteledger.llm.shared import cut

#: Words that a passage needs to link two conversations.
FAR_WORDS = 5
LEAD = re.compile(r"(?:[ \t]*>)+[ \t]?")
ATTRIBUTION = re.compile(r"(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)
EMPTY_LINE = re.compile(r"\n[ \t]*\n")
WHITE = re.compile(r"\s+")


def units(text: str) -> dict[str, int]:
    """Hashes of a text, with their words: whole, its paragraphs, its lines; each once, in this order."""
    parts = (WHITE.sub(" ", p.lower()).strip() for p in [text, *EMPTY_LINE.split(text), *text.split("\n")])
    return {hashlib.sha256(p.encode("utf-8", "surrogatepass")).hexdigest(): p.count(" ") + 1 for p in parts if p}


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages with their levels."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        lead = LEAD.match(line)
        level, body = (lead[0].count(">"), line[lead.end() :]) if lead else (0, line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            if level and runs and runs[-1][0] == 0 and ATTRIBUTION.search(runs[-1][1][-1]):
                runs[-1][1].pop()
            runs.append((level, [body]))
    own = "\n".join(line for level, body in runs if level == 0 for line in body)
    return own.strip("\n"), [(level, "\n".join(body)) for level, body in runs if level]


PARSED = "conv long, turn long, clean string, n_quotes long, quotes array<struct<no:int,level:int,rank:int,hash:string,words:int>>, units array<string>"


def parse(messages: DataFrame) -> DataFrame:
    quote = pa.struct([("no", pa.int32()), ("level", pa.int32()), ("rank", pa.int32()), ("hash", pa.string()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out = [parsed(t) for t in part.column(2).to_pylist()]
                quotes = [[{"no": no, "level": level, "rank": rank, "hash": h, "words": n} for no, (level, passage) in enumerate(found) for rank, (h, n) in enumerate(units(passage).items())] for _, found in out]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([o for o, _ in out], pa.string()), pa.array([len(f) for _, f in out], pa.int64()), pa.array(quotes, pa.list_(quote)), pa.array([list(units(o)) for o, _ in out], pa.list_(pa.string()))], names=["conv", "turn", "clean", "n_quotes", "quotes", "units"])

    return messages.mapInArrow(run, PARSED)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with rank (over all, from 0) and position (in the group, from 0), by group and order. No group meets in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*group, *order]
    laid = cut(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    totals = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    ranked = laid.withColumn("_part", part).join(F.broadcast(starts_of(totals, "_part", "_n")), "_part").withColumn("rank", F.col("before") + row).drop("_part", "before", "_id")
    first = cut(ranked.groupBy(*group).agg(F.min("rank").alias("_first")), "first")
    return cut(ranked.join(first, group).withColumn("position", F.col("rank") - F.col("_first")).drop("_first"), "numbered")


def runs(tree: DataFrame, rows: int = 65_536) -> DataFrame:
    """tree with run: the id of the message that starts the run of turns, each of which follows the one before it.

    Ids rise by conversation and turn, so a run's start is the last start up to its message. It is looked for in blocks
    of ids, and what comes from earlier blocks is one number for each block.
    """
    start = F.when(F.col("link").isNotNull() | F.col("before").isNull(), F.col("id"))
    marked = tree.withColumn("block", F.floor(F.col("id") / rows)).withColumn("start", start)
    last = marked.groupBy("block").agg(F.max("start").alias("start"))
    carry = cut(last.select("block", F.max("start").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry")), "carry")
    so_far = F.max("start").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return cut(marked.withColumn("so_far", so_far).join(carry, "block").withColumn("run", F.coalesce("so_far", "carry")).drop("block", "start", "so_far", "carry"), "runs")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn, text (clean), n_quotes, n_linked, parent_conv, parent_turn, thread_conv, thread_turn, position."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    got = cut(parse(rows), "parsed")
    real = got.where("conv is not null and turn is not null")
    keys = numbered(real.select("conv", "turn").distinct(), ["conv"], ["turn"]).withColumnRenamed("rank", "id")
    before = keys.select("conv", (F.col("position") + 1).alias("position"), F.col("id").alias("before"))
    keys = keys.join(before, ["conv", "position"], "left").select("conv", "turn", "id", "before")
    quotes = real.where(F.size("quotes") > 0).select("conv", "turn", F.inline("quotes")).join(keys.select("conv", "turn", "id"), ["conv", "turn"]).select("conv", "id", "no", "level", "rank", "hash", "words").distinct()
    quotes = cut(quotes, "quotes")
    if quotes.isEmpty():
        tree = cut(keys.select("conv", "turn", "id", "before", F.lit(None).cast("long").alias("link"), F.lit(0).cast("long").alias("n_linked")), "tree")
    else:
        asked = cut(quotes.select("hash").distinct(), "asked")
        held = real.select("conv", "turn", F.explode("units").alias("hash")).join(asked, "hash", "left_semi").join(keys.select("conv", "turn", "id"), ["conv", "turn"])
        near = cut(held.groupBy("hash", "conv").agg(F.min("id").alias("near")), "near")
        far = cut(near.groupBy("hash").agg(F.min("near").alias("far"), F.count(F.lit(1)).alias("homes")).where("homes = 1").select("hash", "far"), "far")
        found = quotes.join(near, ["hash", "conv"], "left").join(far, "hash", "left")
        source = F.when(F.col("near") < F.col("id"), F.col("near")).when((F.col("far") < F.col("id")) & (F.col("words") >= FAR_WORDS), F.col("far"))
        found = found.withColumn("source", source).where("source is not null")
        best = found.groupBy("id").agg(F.min(F.when(F.col("level") == 1, F.struct("no", "rank", "source")))["source"].alias("link"), F.count_distinct("no").alias("n_linked"))
        tree = cut(keys.join(best, "id", "left").select("conv", "turn", "id", "before", "link", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")), "tree")
    parts = runs(tree)
    links = parts.where("link is not null").select(F.col("run").alias("from"), "link").join(parts.select(F.col("id").alias("link"), F.col("run").alias("to")), "link")
    root = components(links, "from", "to")
    threads = parts.join(root, parts["run"] == root["u"], "left").withColumn("thread", F.coalesce("v", "run")).withColumn("parent", F.coalesce("link", "before"))
    placed = numbered(threads.select("thread", "id", "conv", "turn", "parent", "n_linked"), ["thread"], ["id"]).drop("rank")
    name = lambda x: tree.select(F.col("id").alias(x), F.col("conv").alias(f"{x}_conv"), F.col("turn").alias(f"{x}_turn"))
    placed = placed.join(name("parent"), "parent", "left").join(name("thread"), "thread", "left").select("conv", "turn", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "position")
    out = got.select("conv", "turn", "clean", "n_quotes").join(cut(placed, "placed"), ["conv", "turn"], "left")
    return out.select(F.col("conv").alias("conv_id"), "turn", F.col("clean").alias("text"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn", "thread_conv", "thread_turn", "position")
