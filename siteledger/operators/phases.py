"""Finite automata over ordered events: the phase before and after each event of each key."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut

#: Rows of a block, within which moves are composed in one task, and so many blocks' rows make a key long.
BLOCK, LONG = 1024, 8
_SIGNS = string.digits + string.ascii_letters


@dataclass(frozen=True)
class Automaton:
    """moves: for each symbol the state that follows each state. States that a symbol doesn't name go to `otherwise`, as do all for unknown and null symbols."""

    states: tuple[str, ...]
    start: str
    otherwise: str
    moves: dict[str, dict[str, str]]

    def image(self, move: dict[str, str]) -> str:
        """A move as a text: the sign of the state that follows, for each state in turn."""
        return "".join(_SIGNS[self.states.index(move.get(s, self.otherwise))] for s in self.states)

    def function(self, symbol: Column) -> Column:
        out = F.lit(self.image({}))
        for name, move in self.moves.items():
            out = F.when(symbol == name, self.image(move)).otherwise(out)
        return out

    def named(self, sign: Column) -> Column:
        """The name of the state of a sign."""
        out = F.lit(self.start)
        for k, name in enumerate(self.states):
            out = F.when(sign == _SIGNS[k], name).otherwise(out)
        return out


def blocked(rows: DataFrame, order: list[str], signs: str, block: int) -> DataFrame:
    """rows (_key, _move, _n, columns of order and others) as _key, _block, _items (rows as structs, in order), _move (all of them composed) and _n (added up), written once.

    A key of at most LONG times block rows is one block, whose number is null. Longer ones are sorted over all tasks and cut
    after every block rows of a task, so a key of any length is spread over as many tasks as it has blocks.
    """
    long = cut(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > LONG * block).select("_key"), "long-keys")
    whole = rows.withColumn("_block", F.lit(None).cast("bigint"))
    if not long.isEmpty():
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = rows.join(long, "_key", "left_semi").repartitionByRange(n, "_key", *order).sortWithinPartitions("_key", *order).withColumn("_block", F.monotonically_increasing_id())
        # the task's number, and the row's in the task by blocks
        laid = laid.withColumn("_block", F.shiftleft(F.shiftright("_block", 33), 33) + F.expr(f"(_block & {(1 << 33) - 1}) div {block}"))
        whole = whole.join(long, "_key", "left_anti").unionByName(laid)
    item = F.struct(*order, *[c for c in rows.columns if c not in (*order, "_key")])
    blocks = whole.groupBy("_key", "_block").agg(F.sort_array(F.collect_list(item)).alias("_items"), F.sum("_n").alias("_n"))
    return cut(blocks.withColumn("_move", F.aggregate("_items", F.lit(signs), lambda move, x: F.call_function("translate", move, F.lit(signs), x["_move"]))), "blocks")


def led(blocks: DataFrame, signs: str, block: int) -> DataFrame:
    """blocks with _carry (the moves of the key's earlier blocks, composed) and _first (their rows).

    Moves are functions from states to states, so their composition is associative: the blocks of a long key are rows that are
    cut into blocks themselves.
    """
    ends = blocks.where("_block is not null").select("_key", F.col("_block").alias("_at"), "_move", "_n")
    if ends.isEmpty():
        return blocks.withColumns({"_carry": F.lit(signs), "_first": F.lit(0).cast("bigint")})
    upper = led(blocked(ends, ["_at"], signs, block), signs, block)
    size = F.size("_items")
    moves, width = running(F.col("_carry"), signs), len(signs)
    rows = F.aggregate("_items", F.array(F.col("_first")), lambda ns, x: F.concat(ns, F.array(F.element_at(ns, -1) + x["_n"])))
    each = upper.select("_key", F.explode(F.arrays_zip(F.transform("_items", lambda x: x["_at"]).alias("at"), F.regexp_extract_all(moves, F.lit(f".{{{width}}}"), F.lit(0)).alias("carry"), F.slice(rows, 1, size).alias("first"))).alias("_x"))
    each = cut(each.where("_x.at is not null").select("_key", F.col("_x.at").alias("_block"), F.col("_x.carry").alias("_carry"), F.col("_x.first").alias("_first")), "carries")
    short = blocks.where("_block is null").withColumns({"_carry": F.lit(signs), "_first": F.lit(0).cast("bigint")})
    return short.unionByName(blocks.where("_block is not null").join(each.hint("merge"), ["_key", "_block"]))


def running(first: Column, signs: str) -> Column:
    """first, and first after each of the moves of _items in turn, laid end to end."""
    zero = F.struct(first.alias("at"), F.lit("").alias("all"))
    step = lambda a, x: F.struct(F.call_function("translate", a["at"], F.lit(signs), x["_move"]).alias("at"), F.concat(a["all"], a["at"]).alias("all"))
    return F.aggregate("_items", zero, step, lambda a: F.concat(a["all"], a["at"]))


def traced(events: DataFrame, key: str, order: list[str], symbol: str, automaton: Automaton, block: int = BLOCK) -> DataFrame:
    """events with position (in the key, from 1), before and after (states). order must be unique in a key; a null key is one of its own; columns must have an order (no maps).

    A block carries its events, so nothing is joined but what leads into the blocks of long keys.
    """
    signs = _SIGNS[: len(automaton.states)]
    rows = events.select("*", F.struct(key).alias("_key"), automaton.function(F.col(symbol)).alias("_move"), F.lit(1).cast("bigint").alias("_n"))
    blocks = led(blocked(rows, order, signs, block), signs, block)
    states = F.split(running(F.substring("_carry", automaton.states.index(automaton.start) + 1, 1), signs), "")
    size = F.size("_items")
    each = blocks.select("_first", F.posexplode(F.arrays_zip(F.col("_items").alias("item"), F.slice(states, 1, size).alias("before"), F.slice(states, 2, size).alias("after"))).alias("_pos", "_x"))
    return each.select(*[F.col(f"_x.item.{c}").alias(c) for c in events.columns], (F.col("_first") + F.col("_pos") + 1).alias("position"), automaton.named(F.col("_x.before")).alias("before"), automaton.named(F.col("_x.after")).alias("after"))


def summary(trace: DataFrame, key: str, value: str, goal: str, bad: str, says: Column) -> DataFrame:
    """key, n_events, final_state, completions, violations, first_violation, last_value, agrees for each key of traced events.

    A completion enters goal, a violation enters bad. last_value is the value of the last completion, and agrees whether it equals
    the value of the last event for which says holds.
    """
    enters = lambda s: (F.col("after") == s) & (F.col("before") != s)
    at = lambda c: F.when(c, F.col("position"))
    out = trace.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"), F.max_by("after", "position").alias("final_state"), F.count_if(enters(goal)).alias("completions"), F.count_if(enters(bad)).alias("violations"),
        F.min(at(enters(bad))).alias("first_violation"), F.max_by(value, at(enters(goal))).alias("last_value"), F.max_by(value, at(says)).alias("_said"),
    )
    return out.withColumn("agrees", F.col("last_value").eqNullSafe(F.col("_said"))).drop("_said")
