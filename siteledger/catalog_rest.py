"""Queries of judging rules whose facts vary with the rows; both engines read the facts by the same SQL text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.catalog import query, table
from siteledger.operators import arms, collection, diff, policy, registry, scoring

AXES = ("concern_kind", "evidence_confidence", "ownership", "tool_responsibility")
#: An order as an assessment: its labels, the action it is to bear out, what was required and what was checked.
ASSESSED = """select o_orderkey as id, case o_orderkey % 4 when 0 then 'policy' when 1 then 'mechanics' when 2 then 'variant_behavior' else 'unknown' end as concern_kind, case o_orderkey % 3 when 0 then 'insufficient' else 'supported' end as evidence_confidence,
case o_orderkey % 5 when 0 then 'unknown' when 1 then 'existing_specification' when 2 then 'simple_composition' else 'absent_in_scope' end as ownership, case o_custkey % 3 when 0 then 'yes' when 1 then 'no' else 'unknown' end as tool_responsibility,
case o_orderkey % 7 when 0 then 'reuse_specification' when 1 then 'exclude_owned' when 2 then 'delegate_tool' when 3 then 'create_specification' else 'keep' end as action, o_orderstatus <> 'P' as answered, o_custkey % 13 = 0 as missing, o_orderkey % 2 = 0 as tool_required,
case o_custkey % 4 when 0 then 'tool_responsibility' else 'ownership' end as axis, case o_orderpriority when '1-URGENT' then 'exact_decision' when '2-HIGH' then 'tool_rule' else 'scoped_absence' end as relation, case o_custkey % 5 when 0 then 'existing_specification' when 1 then 'simple_composition' else 'absent_in_scope' end as claimed, o_custkey % 6 = 5 as two from {orders}"""
RULES = {
    "analysis_unavailable": "not answered or concern_kind is null", "missing_premises": "missing",
    "inconsistent_answers": "concern_kind is not null and ((concern_kind = 'unknown') <> (evidence_confidence = 'insufficient') or ownership in ('existing_specification', 'simple_composition') and tool_responsibility = 'yes')",
    "unresolved_role": "concern_kind = 'unknown'", "insufficient_evidence": "concern_kind is not null and evidence_confidence <> 'supported'",
    "required_axis_unknown": "concern_kind is not null and (concern_kind = 'unknown' or tool_required and tool_responsibility = 'unknown' or action in ('reuse_specification', 'exclude_owned') and ownership = 'unknown' or action = 'delegate_tool' and tool_responsibility = 'unknown')",
    "required_evidence_missing": "concern_kind is not null and case when action in ('reuse_specification', 'exclude_owned') then not (axis = 'ownership' and relation = 'exact_decision' and claimed = ownership) when action = 'delegate_tool' then not (axis = 'tool_responsibility' and relation = 'tool_rule') when action = 'create_specification' then not (axis = 'ownership' and relation = 'scoped_absence' and claimed = 'absent_in_scope') else false end",
    "evidence_conflict": "two or concern_kind is not null and (axis = 'ownership' and ownership <> 'unknown' and ownership <> claimed or axis = 'tool_responsibility' and tool_responsibility <> 'unknown' and tool_responsibility <> claimed)",
}


@query("routing_observations", f"""with a as (select * replace (case when id % 17 = 0 then null else concern_kind end as concern_kind) from ({ASSESSED.format(orders='orders')}) x),
f as (select id, list_filter([{', '.join(f"case when {c} then '{n}' end" for n, c in RULES.items())}], lambda x: x is not null) as findings from a)
select id, findings, case when list_contains(findings, 'analysis_unavailable') then 'stop_incomplete' when len(findings) > 0 then 'ordinary_review' else 'retain_proposal' end as route, case when list_contains(findings, 'analysis_unavailable') then 'analysis_incomplete' when len(findings) > 0 then 'needs_review' else 'proposed_not_accepted' end as status from f""")
def routing_observations(spark: SparkSession, sf: str) -> DataFrame:
    """All eight observations on each order's assessment, and its route."""
    c = F.col
    rows = spark.sql(ASSESSED, orders=table(spark, sf, "orders")).withColumn("concern_kind", F.when(c("id") % 17 != 0, c("concern_kind")))
    claim = lambda value: F.struct("axis", "relation", value.alias("value"))
    claims = F.when(c("two"), F.array(claim(c("claimed")), claim(F.concat("claimed", F.lit("2"))))).otherwise(F.array(claim(c("claimed"))))
    required = F.when(c("tool_required"), F.array(F.lit("tool_responsibility")))
    stops, asks = policy.review_observations(c("answered"), c("missing"), {a: c(a) for a in AXES}, c("action"), required, claims)
    return rows.select("id", policy.routed(stops, asks).alias("x")).select("id", "x.*")


#: A line as an answer on reuse: three probabilities in hundredths.
ANSWERED = "select l_orderkey, l_linenumber, l_partkey % 60 as p, l_suppkey % 41 as q, 100 - l_partkey % 60 - l_suppkey % 41 + l_linenumber % 5 - 2 as r, case l_orderkey % 9 when 8 then 'other' when 7 then 'needs_review' else 'same_rule' end as choice, l_discount * 9 as confidence, case when l_orderkey % 19 = 0 then '' else 'm' || l_linenumber end as model from {lineitem}"
REUSE_LABELS = ["same_rule", "different_rule", "needs_review"]


@query("reuse_answers", f"""with a as (select *, choice in ('same_rule', 'different_rule', 'needs_review') and strlen(model) between 1 and 128 and confidence between 0 and 1 and p between 0 and 100 and q between 0 and 100 and r between 0 and 100 and abs(p + q + r - 100) < 2 as good from ({ANSWERED.format(lineitem='lineitem')}) x)
select l_orderkey, l_linenumber, p, case when good then choice else 'needs_review' end as choice, case when not good then 'malformed_provider_output' end as diagnostic from a""")
def reuse_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers whose probabilities add up to 1 within less than 0.02."""
    rows = spark.sql(ANSWERED, lineitem=table(spark, sf, "lineitem"))
    parts = F.map_from_arrays(F.array(*map(F.lit, REUSE_LABELS)), F.array(*[(F.col(c) / 100).cast("double") for c in "pqr"]))
    return rows.select("l_orderkey", "l_linenumber", "p", policy.reuse_answer(F.col("choice"), F.col("confidence"), parts, REUSE_LABELS, F.col("model")).alias("x")).select("l_orderkey", "l_linenumber", "p", "x.*")


@query("suggestion_diagnostics", f"""with a as (select *, choice in ('same_rule', 'different_rule', 'needs_review') and confidence between 0 and 1 and r between 0 and 100 as g1, l_linenumber % 6 <> 5 and q between 0 and 100 as g2, confidence < 0.3 as u1, l_linenumber * 0.2 < 0.3 as u2 from ({ANSWERED.format(lineitem='lineitem')}) x)
select l_orderkey, l_linenumber, p, case when g1 and g2 and not u1 then choice else 'needs_review' end as opportunity, case when g1 and g2 and not u2 then 'policy' else 'unknown' end as concern, list_filter([case when not (g1 and g2) then 'malformed_provider_output' end, case when u1 or u2 then 'close_decision' end], lambda x: x is not null) as diagnostics from a""")
def suggestion_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Two axes of an answer: either malformed makes both fall back, a low confidence only its own."""
    c = F.col
    rows = spark.sql(ANSWERED, lineitem=table(spark, sf, "lineitem"))
    of = lambda names, *cols: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[(x / 100).cast("double") for x in cols]))
    one = (c("choice"), c("confidence"), of(REUSE_LABELS, c("p"), F.lit(50), c("r")), REUSE_LABELS, "needs_review")
    two = (F.lit("policy"), F.least(c("l_linenumber") * F.lit(0.2), F.lit(1.0)), F.when(c("l_linenumber") % 6 != 5, of(["policy", "mechanics"], c("q"), F.lit(1))).otherwise(of(["mechanics"], c("q"))), ["policy", "mechanics"], "unknown")
    return rows.select("l_orderkey", "l_linenumber", "p", policy.suggested({"opportunity": one, "concern": two}, 0.3).alias("x")).select("l_orderkey", "l_linenumber", "p", "x.*")


#: Orders as cases with two arms: labels of each, and the truth.
PAIRED = """select o_orderkey as id, arm, case (o_custkey + arm * (o_orderkey % 3)) % 4 when 0 then 'policy' when 1 then 'mechanics' else 'unknown' end as concern_kind, case (o_orderkey + arm) % 3 when 0 then 'insufficient' else 'supported' end as evidence_confidence, case (o_custkey + arm * (o_orderkey % 5)) % 3 when 0 then 'unknown' when 1 then 'existing_specification' else 'absent_in_scope' end as ownership,
case o_custkey % 4 when 0 then 'policy' when 1 then 'unknown' else 'mechanics' end as t_kind, case o_orderkey % 4 when 3 then 'insufficient' else 'supported' end as t_confidence, case o_custkey % 6 when 0 then 'existing_specification' when 1 then 'unknown' else 'absent_in_scope' end as t_owner from {orders}, (values (0), (1)) v(arm) where arm = 0 or o_orderkey % 10 <> 0"""


@query("paired_resolutions", f"""with a as (select *, (t_kind <> 'unknown' and t_confidence = 'supported' and concern_kind = t_kind and evidence_confidence = 'supported')::int as role, (t_owner <> 'unknown' and ownership = t_owner)::int as owner, ownership <> 'unknown' and ownership <> t_owner as wrong, t_owner <> 'unknown' or t_kind <> 'unknown' and t_confidence = 'supported' as usable from ({PAIRED.format(orders='orders')}) x),
p as (select b.role as r1, r.role as r2, b.owner as o1, r.owner as o2, r.wrong and (not b.wrong or b.ownership <> r.ownership) as new, b.usable or r.usable as usable from a b join a r on b.id = r.id and b.arm = 0 and r.arm = 1)
select sum(r2 - r1 + o2 - o1)::bigint as net, sum((r2 > r1)::int + (o2 > o1)::int)::bigint as gains, sum((r2 < r1)::int + (o2 < o1)::int)::bigint as losses, count(*) filter (new) as new_unsupported, count(*) filter (usable) as adjudicable, sum(r2 - r1 + o2 - o1)::double / count(*) filter (usable) as mean_net from p""")
def paired_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    """Gains and losses of resolved facts of one arm over the other, and owners that it newly gets wrong."""
    rows = spark.sql(PAIRED, orders=table(spark, sf, "orders")).withColumn("arm", F.when(F.col("arm") == 0, "baseline").otherwise("retrieval"))
    c = F.col
    return arms.paired_resolutions(rows, "id", "arm", {a: c(a) for a in AXES[:3]}, {"concern_kind": c("t_kind"), "evidence_confidence": c("t_confidence"), "ownership": c("t_owner")}, "baseline", "retrieval")


TRANSITION = ("conflict", "owned", "tool", "source_proof", "same_decision", "search_approved", "review_approved", "review_complete", "review_limitations", "comparison_conflict", "search_failed", "search_complete", "inventory_complete", "search_limitations", "comparisons_complete", "catalogue_closed", "ranked", "all_different")
#: Facts that are mostly false, and the others, which mostly hold; each by a remainder of its own.
RARE = ("conflict", "owned", "tool", "source_proof", "review_limitations", "comparison_conflict", "search_failed", "search_limitations", "ranked")
FLAGS = ", ".join(f"(l_orderkey * {k + 3} + l_partkey * {k % 4 + 1} + l_linenumber) % {11 + k} {'=' if f in RARE else '<>'} {k % 5} as {f}" for k, f in enumerate(TRANSITION))


@query("ownership_facts", f"""with f as (select l_orderkey, l_linenumber, l_partkey, {FLAGS} from lineitem), g as (select *, conflict or owned or (tool and (source_proof or same_decision)) as blocked, search_approved and review_approved and review_complete and not review_limitations and not comparison_conflict as reviewed from f),
h as (select l_orderkey, l_linenumber, l_partkey, case when blocked then null when source_proof or (reviewed and not search_failed and same_decision) then 'existing_specification' when reviewed and search_complete and inventory_complete and not search_limitations and comparisons_complete and catalogue_closed and not ranked and all_different then 'absent_in_scope' end as accepted from g)
select *, case when accepted is null then 'needs_review' else 'accepted' end as status from h""")
def ownership_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The transition over facts that all vary with the rows."""
    rows = spark.sql(f"select l_orderkey, l_linenumber, l_partkey, {FLAGS} from {{lineitem}}", lineitem=table(spark, sf, "lineitem"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", policy.ownership_transition({f: F.col(f) for f in TRANSITION}).alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "x.*")


@query("manifest_digest", """with e as (select distinct sha256('{"path":"' || c_mktsegment || '/' || c_nationkey || '","role":"' || case when c_nationkey % 4 = 0 then 'test' else 'application' end || '","reason":"' || case when c_nationkey % 4 = 0 then 'r' || c_nationkey else '' end || '"}') as d from customer),
s as (select sha256(string_agg(d, '' order by b)) as digest from (select d[1:2] as b, sha256(string_agg(d, '' order by d)) as d from e group by 1)) select sha256('scope/1|closed|' || digest) as digest, null::varchar as problem from s""")
def manifest_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a scope in a closed world."""
    test = F.col("c_nationkey") % 4 == 0
    rows = table(spark, sf, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("path"), F.when(test, "test").otherwise("application").alias("role"), F.when(test, F.concat(F.lit("r"), "c_nationkey")).alias("reason"))
    return collection.scope_digest(rows, "path", "role", "reason", closed_world=True)


def _weight_sql() -> str:
    below, term, parts = 0.0, math.exp(-1), []
    for k in range(1, 18):
        below += term
        parts.append(f"(u >= {below!r}::double)::int")
        term /= k
    return " + ".join(parts)


@query("family_interval", f"""with e as (select l_suppkey as f, sum(l_discount::double) as s, count(l_discount) as n from lineitem group by 1), d as (select draw, s, n, ('0x' || substr(md5('7|' || draw || '|' || f), 1, 13))::bigint / 4503599627370496.0::double as u from e, range(200) t(draw)),
m as (select draw, coalesce(sum(w * s) / sum(w * n), 0) as mean from (select *, {_weight_sql()} as w from d) x group by 1), o as (select list_sort(list(mean)) as m from m) select round(m[5], 9) as low, round(m[195], 9) as high from o""")
def family_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The bootstrap of mean discounts by suppliers, 200 draws."""
    found = scoring.interval(table(spark, sf, "lineitem").select("l_suppkey", "l_discount"), "l_suppkey", "l_discount", draws=200, seed=7)
    return found.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("changes_ranked", """with t as (select l_partkey, l_suppkey, max(l_quantity) filter (l_shipdate < timestamp '1995-06-17') as before, max(l_quantity) filter (l_shipdate >= timestamp '1995-06-17') as after from lineitem group by 1, 2)
select l_partkey, l_suppkey, before, after, row_number() over (partition by l_partkey % 3 order by greatest(before, after) desc, l_partkey, l_suppkey) as rank from t where before is distinct from after""")
def changes_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The rank of every change among those of its metric."""
    old = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.when(old, F.col("l_quantity"))).alias("before"), F.max(F.when(~old, F.col("l_quantity"))).alias("after")).where("not (before <=> after)")
    return diff.ranked(rows.withColumn("metric", F.col("l_partkey") % 3), "metric", ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "before", "after", "rank")


@query("pair_counts", "select p_brand, count(*) as groups, sum(n * (n - 1) // 2)::bigint as pairs from (select p_brand, p_size, count(*) as n from part group by 1, 2) group by 1")
def pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return arms.pair_counts(table(spark, sf, "part"), "p_brand", ["p_size"])


@query("unreviewed_sites", "select event_id from events where not coalesce(value < 20, false) and event_id not in (select event_id from events where event_type = 'signup')")
def unreviewed_sites(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return registry.unreviewed(events, F.col("value") < 20, events.where("event_type = 'signup'"), "event_id").select("event_id")


@query("first_arms", """with c as (select c_custkey, row_number() over (order by sha256(c_custkey::varchar)) as i from customer), r(repeat) as (values (1), (2), (3)) select c_custkey, repeat, case when (i - 1 + repeat) % 2 = 1 then 'baseline' else 'retrieval' end as first_arm from c, r""")
def first_arms(spark: SparkSession, sf: str) -> DataFrame:
    return arms.counterbalanced(table(spark, sf, "customer"), "c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256), [1, 2, 3], "baseline", "retrieval")
