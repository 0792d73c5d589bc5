"""Queries of operators over orders and structures: automata, reachability, digests in trees, clones, renames, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.catalog import query, table
from siteledger.operators import clones, digests, phases

#: A session opens, has items, and completes; what comes in another phase fails it; an error is a barrier after which all starts anew.
SESSION = phases.Automaton(("start", "open", "items", "complete", "failed"), "start", "failed", {
    "signup": {"start": "open", "open": "open", "complete": "open"},
    "click": {"open": "items", "items": "items"},
    "view": {"start": "start", "open": "open", "items": "items", "complete": "complete"},
    "purchase": {"items": "complete"},
    "error": {s: "start" for s in ("start", "open", "items", "complete", "failed")},
})


def _next_sql() -> str:
    moves = " ".join(f"when event_type = '{e}' and s = '{a}' then '{b}'" for e, move in SESSION.moves.items() for a, b in move.items())
    return f"case {moves} else '{SESSION.otherwise}' end"


@query("phase_traces", f"""
with recursive e as (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as position from events),
t as (select user_id, 0::bigint as position, null::varchar as before, 'start' as s, null::double as value, null::varchar as event_type from e where position = 1
union all select t.user_id, e.position, t.s, {_next_sql().replace('event_type', 'e.event_type').replace(' s =', ' t.s =')}, e.value, e.event_type from t join e on e.user_id = t.user_id and e.position = t.position + 1),
g as (select user_id, count(*) as n_events, arg_max(s, position) as final_state, count(*) filter (s = 'complete' and before <> s) as completions, count(*) filter (s = 'failed' and before <> s) as violations, min(position) filter (s = 'failed' and before <> s) as first_violation,
arg_max(value, position) filter (s = 'complete' and before <> s) as last_value, arg_max(value, position) filter (event_type = 'purchase') as said from t where position > 0 group by 1)
select user_id, n_events, final_state, completions, violations, first_violation, last_value, last_value is not distinct from said as agrees from g""")
def phase_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events through the phases of a session, and whether the last completion is the last purchase."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return phases.summary(phases.traced(events, "user_id", ["ts", "event_id"], "event_type", SESSION), "user_id", "value", "complete", "failed", F.col("event_type") == "purchase")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
#: The later version of orders: some keys gone, some with another status, some twice.
LATER = "o_orderkey, o_custkey, case when o_orderkey % 1013 = 5 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority"
ORDER_JSON = """sha256('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}')"""


def later_orders(spark: SparkSession, sf: str) -> DataFrame:
    from siteledger.catalog_scores import columns

    orders = table(spark, sf, "orders")
    now = columns(orders, LATER).where("o_orderkey % 997 != 3")
    return now.unionByName(now.where("o_orderkey % 1511 = 7"))


@query("tree_changes", f"""
with a as (select {ORDER_JSON} as digest, count(*) as n_before from orders group by 1), l as (select {LATER} from orders where o_orderkey % 997 <> 3), b as (select {ORDER_JSON} as digest, count(*) as n_after from (select * from l union all select * from l where o_orderkey % 1511 = 7) group by 1)
select digest, coalesce(n_before, 0) as n_before, coalesce(n_after, 0) as n_after from a full join b using (digest) where coalesce(n_before, 0) <> coalesce(n_after, 0)""")
def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ between two versions of orders, found by going down two trees of digests."""
    return digests.changed(*digests.matched_depth(table(spark, sf, "orders"), later_orders(spark, sf), ORDER_COLUMNS))


def _root_sql() -> str:
    """Buckets of at most 1024 digests (spread evenly, so by their number), and levels above them."""
    up = "l4 as (select left(d, (select digits from depth)) as p, sha256(string_agg(e, '' order by e)) as h from entries group by 1)"
    for k in (3, 2, 1, 0):
        up += f",\nl{k} as (select left(p, {k}) as p, case when max(strlen(p)) > {k} then sha256(string_agg(h, '' order by p)) else min(h) end as h from l{k + 1} group by 1)"
    sizes = " ".join(f"when (select max(n) from (select count(*) as n from entries group by left(d, {k}))) <= 1024 then {k}" for k in range(4))
    return f"with entries as (select d, d || ':' || count(*) as e from (select {ORDER_JSON} as d from orders) group by d), depth as (select case {sizes} else 4 end as digits),\n{up}\nselect h as digest from l0"


@query("tree_root", _root_sql())
def tree_root(spark: SparkSession, sf: str) -> DataFrame:
    return digests.tree(table(spark, sf, "orders"), ORDER_COLUMNS).root()


CLONES_SQL = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), s as (select doc_id, i, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') as t from l),
n as (select *, len(list_filter(string_split(t, ' '), lambda w: w <> '')) as own from s), w as (select doc_id, i, own, own + lead(own, 1) over w + lead(own, 2) over w as words, t || chr(10) || lead(t, 1) over w || chr(10) || lead(t, 2) over w as body from n window w as (partition by doc_id order by i)),
f as (select *, first_value(doc_id) over v as fd, first_value(i) over v as fi from w where body is not null window v as (partition by body order by doc_id, i rows between unbounded preceding and unbounded following)),
p as (select *, i - fi as shift, i - row_number() over (partition by doc_id, fd, i - fi order by i) as run from f where doc_id <> fd or i <> fi),
c as (select doc_id, min(i) as start, fd as first_doc, min(i) - shift as first_start, max(i) - min(i) + 3 as lines, (sum(own) + arg_max(words - own, i))::bigint as tokens from p group by doc_id, fd, shift, run)"""


@query("maximal_clones", f"{CLONES_SQL} select doc_id, start, first_doc, first_start, lines, tokens from c where tokens >= 30")
def maximal_clones(spark: SparkSession, sf: str) -> DataFrame:
    found = clones.maximal(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.withColumnsRenamed({"file": "doc_id", "first_file": "first_doc"})


@query("clone_sums", f"{CLONES_SQL} select count(*) as clone_pairs, coalesce(sum(lines), 0)::bigint as duplicate_lines, coalesce(sum(tokens), 0)::bigint as duplicate_tokens from c where tokens >= 30")
def clone_sums(spark: SparkSession, sf: str) -> DataFrame:
    return clones.totals(clones.maximal(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text"))
