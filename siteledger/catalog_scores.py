"""Queries of the paired scores, policies, ledgers, collections and indexes, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.catalog import TOKENS_SQL, query, table
from siteledger.functions import text as T
from siteledger.operators import arms, collection, diff, ledger, policy, reports
from siteledger.plans.lineage import numbered
from siteledger.sources import vector_index

AXES = ["opportunity", "concern"]
ABSTAIN = {"opportunity": "A", "concern": "unknown"}
#: Line items as answers: an order is a case, odd and even lines are two arms, and every two lines a repeat.
ANSWER_COLUMNS = """l_orderkey as case_id, case when l_linenumber % 2 = 1 then 'baseline' else 'retrieval' end as arm, case when l_linenumber <= 2 then 1 when l_linenumber <= 4 then 2 when l_linenumber <= 6 then 3 else 4 end as repeat,
l_discount < 0.09 as valid, l_returnflag as opportunity, case when l_quantity > 30 then 'policy' when l_quantity > 10 then 'mechanics' else 'unknown' end as concern, case when l_tax < 0.06 then l_partkey end as tokens, l_discount as score"""
REFERENCE_COLUMNS = "o_orderkey as case_id, case o_orderstatus when 'F' then 'R' when 'O' then 'N' else 'A' end as opportunity, case when o_totalprice > 150000 then 'policy' else 'mechanics' end as concern, o_orderkey % 2 as side, o_custkey"
WITH = f"with a as (select {ANSWER_COLUMNS} from lineitem), r as (select {REFERENCE_COLUMNS} from orders), j as (select a.*, r.opportunity as ro, r.concern as rc from a join r using (case_id))"


def columns(df: DataFrame, text: str) -> DataFrame:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return df.selectExpr(*parts)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return columns(table(spark, sf, "lineitem"), ANSWER_COLUMNS)


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return columns(table(spark, sf, "orders"), REFERENCE_COLUMNS)


@query("assigned_responses", """
with p as (select o_orderkey as k, count(*) as np, min(o_orderstatus) as s from orders where o_orderkey % 7 <> 0 group by 1), b as (select l_orderkey as k, count(*) as nb, min(l_linestatus) as s from lineitem where l_linenumber <= 2 and l_orderkey % 11 <> 0 group by 1)
select k, case when np is null then 'unexpected' when np > 1 then 'planned_twice' when nb is null then 'missing' when nb > 1 then 'duplicate' when p.s is distinct from b.s then 'assignment_differs' end as problem from p full join b using (k)""")
def assigned_responses(spark: SparkSession, sf: str) -> DataFrame:
    planned = table(spark, sf, "orders").where("o_orderkey % 7 != 0").selectExpr("o_orderkey as k", "o_orderstatus as s")
    observed = table(spark, sf, "lineitem").where("l_linenumber <= 2 and l_orderkey % 11 != 0").selectExpr("l_orderkey as k", "l_linestatus as s")
    return arms.assigned(planned, observed, ["k"], ["s"])


MATCHES_SQL = WITH + """, m as (select arm, unnest(['opportunity', 'concern']) as axis, count(*) filter (valid) as compared, count(*) as planned, unnest([count(*) filter (valid and opportunity = ro), count(*) filter (valid and concern = rc)]) as matches from j group by arm)"""


@query("axis_matches", MATCHES_SQL + " select arm, axis, matches, compared, planned from m")
def axis_matches(spark: SparkSession, sf: str) -> DataFrame:
    return arms.axis_matches(answers(spark, sf), reference(spark, sf), "case_id", "arm", "valid", AXES)


@query("arm_delta", MATCHES_SQL + " select sum(matches) filter (arm = 'baseline')::bigint as first, sum(matches) filter (arm = 'retrieval')::bigint as second, bool_and(compared = planned) as complete, (case when bool_and(compared = planned) then sum(matches) filter (arm = 'retrieval') - sum(matches) filter (arm = 'baseline') end)::bigint as delta from m")
def arm_delta(spark: SparkSession, sf: str) -> DataFrame:
    return arms.arm_delta(axis_matches(spark, sf), "arm", "baseline", "retrieval")


@query("pair_correctness", WITH + """, p as (select case_id // 2 as pair, case when case_id % 2 = 0 then 'mechanics' else 'policy' end as role, * from j where arm = 'baseline' and repeat = 1 and valid),
g as (select pair, count(*) filter (role = 'mechanics') = 1 and count(*) filter (role = 'policy') = 1 as complete, bool_and(opportunity = ro) as o, bool_and(concern = rc) as c, max(score) filter (role = 'policy') - max(score) filter (role = 'mechanics') as d from p group by 1)
select pair, complete, complete and o as opportunity_correct, complete and c as concern_correct, case when complete then round(d, 6) end as delta, complete and o and c as jointly_correct from g""")
def pair_correctness(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers(spark, sf).where("arm = 'baseline' and repeat = 1").selectExpr("*", "case_id div 2 as pair", "case when case_id % 2 = 0 then 'mechanics' else 'policy' end as role")
    return arms.pair_correctness(rows, reference(spark, sf), "case_id", "pair", "role", ("mechanics", "policy"), "valid", AXES, "score").withColumn("delta", F.round("delta", 6))


TWO_SQL = WITH + """, t as (select case_id, max(opportunity) filter (arm = 'baseline') as o1, max(opportunity) filter (arm = 'retrieval') as o2, max(concern) filter (arm = 'baseline') as c1, max(concern) filter (arm = 'retrieval') as c2, min(ro) as ro, min(rc) as rc
from j where repeat = 1 group by 1 having count(*) filter (arm = 'baseline') = 1 and count(*) filter (arm = 'retrieval') = 1)"""


@query("changed_labels", TWO_SQL + """, l as (select case_id, 'opportunity' as axis, o1 as x, o2 as y, ro as r from t union all select case_id, 'concern', c1, c2, rc from t)
select case_id, axis, case when x = r then 'first_only_correct' when y = r then 'second_only_correct' else 'changed' end as change from l where x <> y""")
def changed_labels(spark: SparkSession, sf: str) -> DataFrame:
    return arms.changed_labels(answers(spark, sf).where("repeat = 1"), reference(spark, sf), "case_id", "arm", "baseline", "retrieval", AXES)


@query("differing_axes", TWO_SQL + """ select case_id, list_filter([case when o1 <> o2 then 'opportunity' end, case when c1 <> c2 then 'concern' end], lambda x: x is not null) as differing, (o1 = 'A' and c1 = 'policy') or (o2 = 'A' and c2 = 'policy') as review from t""")
def differing_axes(spark: SparkSession, sf: str) -> DataFrame:
    odd = (F.col("opportunity") == "A") & (F.col("concern") == "policy")
    return arms.differing_axes(answers(spark, sf).where("repeat = 1"), "case_id", "arm", "baseline", "retrieval", AXES, odd)


@query("label_histograms", WITH + """, l as (select arm, repeat, 'opportunity' as axis, opportunity as label, opportunity <> 'A' as decisive from a union all select arm, repeat, 'concern', concern, concern <> 'unknown' from a union all select arm, repeat, 'joint', opportunity || '/' || concern, opportunity <> 'A' and concern <> 'unknown' from a)
select arm, repeat, axis, label, count(*) as n, bool_and(decisive) as decisive from l group by all""")
def label_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return arms.label_histograms(answers(spark, sf), ["arm", "repeat"], AXES, ABSTAIN)


@query("two_rounds", WITH + """, t as (select case_id, arm, max(opportunity) filter (repeat = 1) as o1, max(opportunity) filter (repeat = 2) as o2, max(concern) filter (repeat = 1) as c1, max(concern) filter (repeat = 2) as c2 from a group by 1, 2 having count(*) filter (repeat = 1) = 1 and count(*) filter (repeat = 2) = 1),
l as (select case_id, 'opportunity' as axis, o1 = o2 as same, o1 <> 'A' and o2 <> 'A' as sure, (o1 = 'A')::int + (o2 = 'A')::int as away from t union all select case_id, 'concern', c1 = c2, c1 <> 'unknown' and c2 <> 'unknown', (c1 = 'unknown')::int + (c2 = 'unknown')::int from t
union all select case_id, 'joint', o1 = o2 and c1 = c2, o1 <> 'A' and o2 <> 'A' and c1 <> 'unknown' and c2 <> 'unknown', (o1 = 'A')::int + (o2 = 'A')::int + (c1 = 'unknown')::int + (c2 = 'unknown')::int from t)
select axis, count(*) filter (same) as matched, count(*) as total, count(*) filter (same and sure) as decisive_matched, count(*) filter (sure) as decisive_total, coalesce(sum(away) filter (case_id % 9 = 0), 0)::bigint as control_abstentions from l group by 1""")
def two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return arms.two_rounds(answers(spark, sf), ["case_id", "arm"], "repeat", (1, 2), AXES, ABSTAIN, F.col("case_id") % 9 == 0)


@query("ablation_hypothesis", WITH + """, n as (select case_id, arm, repeat, case when valid then opportunity end as label, ro from j), p as (select arm, repeat, count(*) as cases, count(*) filter (label = ro) as agreement, count(*) filter (label = 'N' and ro <> 'N') as false_exclusions, count(*) filter (label is null) as errors from n group by 1, 2),
b as (select p.*, coalesce(p.agreement * q.cases > q.agreement * p.cases and p.false_exclusions < q.false_exclusions and p.errors = 0, false) as better from p left join p q on q.arm = 'baseline' and q.repeat = p.repeat), w as (select arm, bool_and(better) as supported from b group by 1)
select p.arm, repeat, cases, agreement, false_exclusions, errors, case when p.arm <> 'baseline' then supported end as supported from p join w using (arm)""")
def ablation_hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers(spark, sf).selectExpr("case_id", "arm", "repeat", "case when valid then opportunity end as opportunity")
    return arms.ablation(rows, reference(spark, sf), "case_id", "arm", "repeat", "opportunity", "baseline", "N")


@query("arm_usage", WITH + """ select arm, count(*) as planned, count(*) filter (valid) as valid, coalesce(sum((opportunity = ro)::int + (concern = rc)::int) filter (valid), 0)::bigint as matching_axes, count(*) filter (valid and opportunity = ro and concern = rc) as complete_views,
count(*) filter (valid and tokens is not null) as metered, sum(tokens) filter (valid)::bigint as tokens from j group by 1""")
def arm_usage(spark: SparkSession, sf: str) -> DataFrame:
    return arms.arm_usage(answers(spark, sf), reference(spark, sf), "case_id", "arm", "valid", AXES, "tokens")


@query("repeatability", WITH + """, g as (select case_id, arm, count(*) as n, count(distinct opportunity || '/' || concern) = 1 as same from a where valid group by 1, 2) select arm, count(*) as cases, count(*) filter (n = 2) as twice, count(*) filter (n = 2 and same) as same from g group by 1""")
def repeatability(spark: SparkSession, sf: str) -> DataFrame:
    return arms.repeatability(answers(spark, sf), "case_id", "arm", "valid", AXES)


@query("option_change", WITH + """, l as (select case_id, arm, repeat, score as x, round(1 - score, 2) as y from a), g as (select case_id, arm, max(x) filter (repeat = 1) as x1, max(x) filter (repeat = 2) as x2, max(y) filter (repeat = 1) as y1, max(y) filter (repeat = 2) as y2 from l group by 1, 2)
select count(*) as pairs, round(max(greatest(abs(x1 - x2), abs(y1 - y2))), 6) as max_change from g where x1 is not null and x2 is not null""")
def option_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers(spark, sf).withColumn("options", F.create_map(F.lit("eligible"), F.col("score"), F.lit("excluded"), F.round(1 - F.col("score"), 2)))
    return arms.option_change(rows, ["case_id", "arm"], "repeat", (1, 2), "options").withColumn("max_change", F.round("max_change", 6))


@query("sparse_confusion", WITH + """, b as (select case_id, opportunity from a where arm = 'retrieval' and repeat = 1) select r.opportunity as reference, b.opportunity as predicted, count(*) as n from r left join b using (case_id) group by all""")
def sparse_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return arms.sparse_confusion(answers(spark, sf).where("arm = 'retrieval' and repeat = 1"), reference(spark, sf), "case_id", "opportunity")


@query("best_variant", """
with s as (select o_orderpriority as name, round(avg((o_orderstatus = 'F')::int), 6) as recall, round(avg((o_totalprice > 150000)::int), 6) as precision, round(avg((o_orderstatus = 'P')::int), 6) as abstention from orders group by 1) select * from s order by recall desc, precision desc, abstention, name limit 1""")
def best_variant(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c, n: F.round(F.avg(F.expr(c).cast("int")), 6).alias(n)
    scores = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(share("o_orderstatus = 'F'", "recall"), share("o_totalprice > 150000", "precision"), share("o_orderstatus = 'P'", "abstention"))
    return arms.best_variant(scores, "name", "recall", "precision", "abstention")


@query("anchored_sites", """
with s as (select l_partkey as p, l_linenumber as l, count(*) as n, max(l_returnflag) as c from lineitem where l_quantity > 25 group by 1, 2)
select ps.p_partkey as case_id, case when n is null then 'missing' when n > 1 then 'duplicate' else 'matched' end as status, case when n = 1 then c end as category from part ps left join s on s.p = ps.p_partkey and s.l = ps.p_size % 7 + 1""")
def anchored_sites(spark: SparkSession, sf: str) -> DataFrame:
    sites = table(spark, sf, "lineitem").where("l_quantity > 25").selectExpr("l_partkey as p", "l_linenumber as l", "l_returnflag as category")
    return arms.anchored(table(spark, sf, "part").selectExpr("p_partkey as case_id", "p_partkey as p", "p_size % 7 + 1 as l"), sites, ["p", "l"], "case_id", "category")


@query("unordered_pairs", """
with s as (select p_brand, p_size, p_partkey from part where p_size <= 10) select a.p_brand, a.p_size, a.p_partkey as left_id, b.p_partkey as right_id from s a join s b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey""")
def unordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").where("p_size <= 10").select("p_brand", "p_size", "p_partkey")
    return part.withColumnRenamed("p_partkey", "left_id").join(part.withColumnRenamed("p_partkey", "right_id"), ["p_brand", "p_size"]).where("left_id < right_id")


@query("counterbalanced_arms", """
with c as (select c_custkey, row_number() over (order by sha256(c_custkey::varchar)) as i from customer), r(repeat) as (values (1), (2)) select c_custkey, repeat, case when (i - 1 + repeat) % 2 = 1 then 'baseline' else 'retrieval' end as first_arm from c, r""")
def counterbalanced_arms(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"), F.lit(0).alias("all"))
    placed = numbered(cases, ["all"], ["h"]).withColumn("repeat", F.explode(F.array(F.lit(1), F.lit(2))))
    return placed.select("c_custkey", "repeat", F.when((F.col("position") - 1 + F.col("repeat")) % 2 == 1, "baseline").otherwise("retrieval").alias("first_arm"))


LEDGER = "user_id, event_id, case event_type when 'signup' then 'start' when 'view' then 'post' when 'click' then 'start' else 'finish' end as kind, value < 40 as again"
LEDGER_SQL = f"""with e as (select {LEDGER} from events), o as (select *, row_number() over w as i, lag(kind) over w as lk, lag(again) over w as la, count(*) over (partition by user_id) as n from e window w as (partition by user_id order by event_id)),
b as (select *, coalesce(case when i = 1 then kind = 'start' when lk = 'start' then kind in ('post', 'finish') when lk = 'post' then kind = 'finish' else la and kind = 'start' end, false) as good, i < n or (kind = 'finish' and not again) as ended from o),
f as (select user_id, count(*) filter (kind = 'start') as starts, count(*) filter (kind = 'post') as posts, count(*) filter (kind = 'finish') as finishes, count(*) filter (kind = 'finish' and again and lk = 'post') as ambiguous, count(*) filter (not good) + count(*) filter (not ended) as broken from b group by 1)"""


@query("attempt_ledger", LEDGER_SQL + " select * from f")
def attempt_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.attempts(columns(table(spark, sf, "events"), LEDGER), "user_id", "event_id", "kind", "again")


@query("ledger_reconciled", LEDGER_SQL + """, g as (select user_id, starts, posts, ambiguous, broken % 2 as broken from f), c as (select user_id, count(*) filter (event_type in ('signup', 'click')) as starts, count(*) filter (event_type = 'view') as posts, count(*) filter (event_type = 'error') % 3 as ambiguous from events where user_id % 13 <> 0 group by 1)
select user_id, case when c.user_id is null then 'no_row' when broken > 0 then 'broken_sequence' when g.starts <> c.starts or g.posts <> c.posts or g.ambiguous <> c.ambiguous then 'counters_differ' end as problem from g left join c using (user_id)""")
def ledger_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    found = attempt_ledger(spark, sf).withColumn("broken", F.col("broken") % 2)
    claimed = table(spark, sf, "events").where("user_id % 13 != 0").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("signup", "click")).alias("starts"), F.count_if(F.col("event_type") == "view").alias("posts"), (F.count_if(F.col("event_type") == "error") % 3).alias("ambiguous"))
    return ledger.reconciled(found, claimed, "user_id")


FACT_COLUMNS = """d.doc_id, case when l.quality = 1 then 'policy' when l.toxic = 1 then 'mechanics' when d.n_chars > 3000 then 'variant_behavior' else 'unknown' end as role, case when l.doc_id is not null then 'supported' else 'insufficient' end as support,
case when d.n_chars % 5 = 0 then 'existing_specification' when d.n_chars % 5 = 1 then 'absent_in_scope' else 'unknown' end as ownership, case when d.n_chars % 3 = 0 then 'yes' when d.n_chars % 3 = 1 then 'no' else 'unknown' end as tool, case when d.n_chars % 2 = 0 then 'completed' else 'not_done' end as intent"""
FACT_SQL = f"""with f as (select {FACT_COLUMNS} from documents d left join labels l on l.doc_id = d.doc_id), c as (select *, ownership = 'existing_specification' and tool = 'yes' as conflict, support = 'supported' as sure from f),
s as (select *, case when conflict then 'conflicting_facts' when ownership = 'existing_specification' then 'existing_specification' when tool = 'yes' then 'tool_responsibility' when sure and role in ('policy', 'variant_behavior') then 'domain_contract' when role = 'mechanics' and sure then 'mechanics' when not sure and intent = 'completed' then 'formalization_preference' else 'missing_facts' end as basis,
list_filter([case when not sure then 'role_not_established' end, case when ownership = 'unknown' then 'same_decision_ownership_not_checked' end, case when tool = 'unknown' then 'tool_responsibility_not_checked' end, case when intent = 'not_done' then 'bounded_intent_lookup_not_completed' end, case when conflict then 'conflicting_facts' end], lambda x: x is not null) as unresolved from c)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").alias("d").join(table(spark, sf, "labels").alias("l"), F.expr("l.doc_id = d.doc_id"), "left")
    return columns(both, FACT_COLUMNS)


@query("recommendation_policy", FACT_SQL + """, m as (select *, case basis when 'existing_specification' then 'reuse_specification' when 'tool_responsibility' then 'use_tool_rules' when 'domain_contract' then 'formalize' when 'mechanics' then 'keep_procedural' when 'formalization_preference' then 'formalize' end as action from s)
select doc_id, action, basis, case when action is null then 'needs_review' when action = 'reuse_specification' or len(unresolved) = 0 then 'recommended_in_scope' else 'provisional' end as status, unresolved from m""")
def recommendation_policy(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return facts(spark, sf).select("doc_id", policy.recommendation(c("role"), c("support"), c("ownership"), c("tool"), c("intent")).alias("x")).select("doc_id", "x.*")


@query("review_routing", FACT_SQL + """, g as (select doc_id, list_filter([case when intent = 'not_done' and tool = 'unknown' then 'analysis_unavailable' end, case when (role = 'unknown') <> (support = 'insufficient') then 'inconsistent_answers' end, case when role = 'unknown' then 'unresolved_role' end, case when conflict then 'evidence_conflict' end], lambda x: x is not null) as findings from c)
select doc_id, findings, case when list_contains(findings, 'analysis_unavailable') then 'stop_incomplete' when len(findings) > 0 then 'ordinary_review' else 'retain_proposal' end as route, case when list_contains(findings, 'analysis_unavailable') then 'analysis_incomplete' when len(findings) > 0 then 'needs_review' else 'proposed_not_accepted' end as status from g""")
def review_routing(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    semantic = [("inconsistent_answers", (c("role") == "unknown") != (c("support") == "insufficient")), ("unresolved_role", c("role") == "unknown"), ("evidence_conflict", policy.conflicting(c("ownership"), c("tool"), c("intent")))]
    out = policy.routed([("analysis_unavailable", (c("intent") == "not_done") & (c("tool") == "unknown"))], semantic)
    return facts(spark, sf).select("doc_id", out.alias("x")).select("doc_id", "x.*")


@query("ownership_transition", FACT_SQL + """, t as (select doc_id, ownership <> 'unknown' as owned, tool = 'yes' as tool, sure as proof, intent = 'completed' as same, role = 'variant_behavior' as absent from c)
select doc_id, case when owned or (tool and (proof or same)) then null when proof or same then 'existing_specification' when absent then 'absent_in_scope' end as accepted, case when (owned or (tool and (proof or same))) or not (proof or same or absent) then 'needs_review' else 'accepted' end as status from t""")
def ownership_transition(spark: SparkSession, sf: str) -> DataFrame:
    c, yes, no = F.col, F.lit(True), F.lit(False)
    known = {k: yes for k in ("search_approved", "review_approved", "review_complete", "search_complete", "inventory_complete", "comparisons_complete", "catalogue_closed")} | {k: no for k in ("conflict", "review_limitations", "comparison_conflict", "search_failed", "search_limitations", "ranked")}
    known |= {"owned": c("ownership") != "unknown", "tool": c("tool") == "yes", "source_proof": c("support") == "supported", "same_decision": c("intent") == "completed", "all_different": c("role") == "variant_behavior"}
    return facts(spark, sf).select("doc_id", policy.ownership_transition(known).alias("x")).select("doc_id", "x.*")


@query("fact_violations", FACT_SQL + " select doc_id, list_filter([case when (role = 'unknown') <> (support = 'insufficient') then 'role_support' end, case when conflict then 'responsibilities' end], lambda x: x is not null) as violations from c")
def fact_violations(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("doc_id", policy.fact_violations(F.col("role"), F.col("support"), F.col("ownership"), F.col("tool")).alias("violations"))


@query("citation_check", r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls, n_chars % 4 + 10 as s, n_chars % 4 + 10 + n_chars % 3 as e from documents), q as (select *, array_to_string(ls[s - 9 : e - 9], chr(10)) || case when e - 9 < len(ls) then chr(10) else '' end as span, len(ls) - case when ls[len(ls)] = '' then 1 else 0 end as n from d)
select doc_id, case when doc_id % 5 = 0 then false else e < 10 + n and trim(span, e' \t\n\r\x0B\x0C') <> '' end as holds from q""")
def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("s", (F.col("n_chars") % 4 + 10).cast("int")).withColumn("e", (F.col("s") + F.col("n_chars") % 3).cast("int"))
    lines = F.split("text", "\n")
    span = F.concat(F.array_join(F.slice(lines, F.col("s") - 9, F.col("e") - F.col("s") + 1), "\n"), F.when(F.col("e") - 9 < F.size(lines), "\n").otherwise(""))
    quote = F.when(F.col("doc_id") % 5 == 0, F.concat(span, F.lit("x"))).otherwise(span)
    return docs.select("doc_id", policy.cited(F.col("text"), F.lit(10), F.col("s"), F.col("e"), quote).alias("holds"))


@query("review_cascade", WITH + """ select case_id, arm, repeat, case when score < 0.05 then opportunity else case when concern <> 'unknown' then concern end end as label, case when score < 0.05 then 'not_needed' when concern = 'unknown' then 'not_run' else 'completed' end as review_status from a""")
def review_cascade(spark: SparkSession, sf: str) -> DataFrame:
    reviewed = F.when(F.col("concern") != "unknown", F.col("concern"))
    return answers(spark, sf).select("case_id", "arm", "repeat", policy.cascade(F.col("opportunity"), F.col("score") >= 0.05, reviewed).alias("x")).select("case_id", "arm", "repeat", "x.*")


@query("packet_limits", """
select doc_id, list_filter([case when n_chars % 20 not between 1 and 16 then 'questions' end, case when n_chars % 20 > 0 and n_chars % 37 not between 2 and 32 then 'criteria' end, case when n_chars % 20 > 0 and n_chars % 37 > 0 and source = 'src3' then 'empty_criterion' end, case when strlen(text) > 65536 then 'bytes' end], lambda x: x is not null) as problems from documents where text is not null""")
def packet_limits(spark: SparkSession, sf: str) -> DataFrame:
    criteria = F.array_repeat(F.when(F.col("source") == "src3", " ").otherwise("good"), (F.col("n_chars") % 37).cast("int"))
    names = F.when(F.col("n_chars") % 20 > 0, F.sequence(F.lit(1), (F.col("n_chars") % 20).cast("int"))).otherwise(F.array().cast("array<int>"))
    questions = F.map_from_arrays(names, F.transform(names, lambda _: criteria))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", policy.packet_problems(questions, F.col("text")).alias("problems"))


@query("profile_limits", """
with s as (select p_partkey, string_split(p_type, ' ') as a, string_split(p_name, ' ') as b from part) select p_partkey, list_filter([case when len(a) > 4 then 'types_items' end, case when len(b) > 4 then 'names_items' end,
case when len(list_filter(a, lambda x: trim(x) = '')) > 0 or len(list_distinct(a)) < len(a) then 'types_ids' end, case when len(list_filter(b, lambda x: trim(x) = '')) > 0 or len(list_distinct(b)) < len(b) then 'names_ids' end], lambda x: x is not null) as problems from s""")
def profile_limits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", policy.profile_problems({"types": F.split("p_type", " "), "names": F.split("p_name", " ")}).alias("problems"))


@query("suggestion_validation", WITH + " select case_id, arm, repeat, case when opportunity in ('R', 'N') and score >= 0.04 then opportunity else 'needs_review' end as accepted from a")
def suggestion_validation(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("case_id", "arm", "repeat", policy.suggestion(F.col("opportunity"), F.col("score"), ["R", "N"], 0.04, "needs_review").alias("accepted"))


@query("summary_delta", """
with b as (select event_type, 'k' || (user_id % 5) as name, case when user_id % 5 = 4 then 'none' else count(*)::varchar end as v from events where event_id % 2 = 0 group by 1, 2, user_id % 5), a as (select event_type, 'k' || (user_id % 5) as name, case when user_id % 5 = 4 then 'none' else count(*)::varchar end as v from events where event_id % 2 = 1 group by 1, 2, user_id % 5),
g as (select event_type, event_type <> 'error' as comparable from events group by 1) select event_type, name, a.v::double - b.v::double as delta, true as comparable from b join a using (event_type, name) join g using (event_type) where comparable and a.v <> 'none' and b.v <> 'none' union all select event_type, null, null, false from g where not comparable""")
def summary_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("k"), (F.col("event_id") % 2).alias("side")).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("k") == 4, "none").otherwise(F.col("n").cast("string"))
    rows = rows.select("event_type", "side", F.concat(F.lit("k"), F.col("k")).alias("name"), value.alias("v"), F.lit("complete").alias("status"), F.when((F.col("event_type") == "error") & (F.col("side") == 1), "2").otherwise("1").alias("versions"))
    return collection.numeric_delta(rows.where("side = 0"), rows.where("side = 1"), "event_type", "name", "v", "status", "versions")


@query("scope_digest", r"""
with e as (select distinct sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}') as d from orders), b as (select d[1:2] as b, sha256(string_agg(d, '' order by d)) as d from e group by 1) select sha256(string_agg(d, '' order by b)) as digest from b""")
def scope_digest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return collection.set_digest(rows, ["o_orderpriority", "o_orderstatus", "day"])


@query("contract_digest", """select c_custkey, sha256('{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || ',"version":null}') as digest from customer""")
def contract_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", collection.contract_digest({"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "version": F.lit(None).cast("string")}).alias("digest"))


@query("evidence_references", """
with r as (select l.doc_id, case when l.doc_id % 7 = 0 then '' when l.doc_id % 7 = 1 then '../x' when l.doc_id % 7 = 2 then 'none' when l.doc_id % 7 = 3 then 'd' || l.doc_id || '#no such words' when l.doc_id % 7 = 4 then 'd' || l.doc_id else 'd' || l.doc_id || '#' || substr(d.text, 3, 4) end as reference from labels l join documents d using (doc_id) where d.text is not null)
select r.doc_id, reference, case when trim(reference) = '' then 'empty' when starts_with(reference, '../') then 'escapes_root' when d.doc_id is null then 'no_file' when strpos(reference, '#') > 0 and not contains(d.text, substr(reference, strpos(reference, '#') + 1)) then 'no_marker' end as problem from r left join documents d on 'd' || d.doc_id = string_split(reference, '#')[1]""")
def evidence_references(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    name = F.concat(F.lit("d"), F.col("doc_id"))
    k = F.col("doc_id") % 7
    reference = F.when(k == 0, "").when(k == 1, "../x").when(k == 2, "none").when(k == 3, F.concat(name, F.lit("#no such words"))).when(k == 4, name).otherwise(F.concat(name, F.lit("#"), F.substring("text", 3, 4)))
    refs = table(spark, sf, "labels").select("doc_id").join(docs, "doc_id").select("doc_id", reference.alias("reference"))
    return collection.evidence_problem(refs, table(spark, sf, "documents").select(name.alias("path"), "text"), "reference", "path", "text")


@query("clone_totals", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), s as (select doc_id, i, trim(regexp_replace(t, '\s+', ' ', 'g')) as t from l),
w as (select doc_id, i as start, t || chr(10) || lead(t, 1) over w || chr(10) || lead(t, 2) over w as body from s window w as (partition by doc_id order by i)), g as (select doc_id, start, sha256(body) as h from w where body is not null and len(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')) >= 30),
c as (select h, count(*) as n, min((doc_id, start)) as first from g group by 1 having count(*) > 1), t as (select distinct g.doc_id, start + k as i from g join c using (h), (values (0), (1), (2)) v(k) where (g.doc_id, start) <> first)
select (select count(*) from c) as clone_classes, (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from c) as clone_pairs, (select count(*) from t) as duplicate_lines""")
def clone_totals(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return collection.clone_totals(lines, "doc_id", "i", "t")


HOT = "l_returnflag as metric, l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then l_quantity::int end as before, case when l_linenumber % 5 <> 0 then l_partkey::int % 60 end as after"


@query("complexity_hotspots", f"""
with c as (select {HOT} from lineitem), d as (select *, after - before as delta from c where before is distinct from after), k as (select *, row_number() over (partition by metric order by greatest(before, after) desc, l_orderkey, l_linenumber) as rank from d),
t as (select metric, rank, '| ' || metric || ' | `' || l_orderkey || ':' || l_linenumber || '` | ' || coalesce(before::varchar, '—') || ' | ' || coalesce(after::varchar, '—') || ' | ' || case when delta is null then '—' when delta >= 0 then '+' || delta else delta::varchar end || ' | ' || case when delta is null then 'not established' else 'same path/name' end || ' |' as row from k where rank <= 5)
select metric, rank, row from (select *, sum(strlen(row) + 1) over (order by metric, rank) as used from t) where used <= 12000""")
def complexity_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    rows = columns(table(spark, sf, "lineitem"), HOT.replace("::int", "")).withColumns({c: F.col(c).cast("int") for c in ("before", "after")})
    rows = rows.where("not (before <=> after)").withColumn("delta", F.col("after") - F.col("before"))
    cell = F.concat(F.lit("`"), F.concat_ws(":", "l_orderkey", "l_linenumber"), F.lit("`"))
    return reports.hotspots(rows, "metric", ["l_orderkey", "l_linenumber"], cell)


@query("report_locations", r"""
select page_id, case when page_id % 2 = 0 then '[`' || e || ':' || page_id || '`](https://github.com/o/r/blob/' || sha1('x') || '/' || e || '#L' || page_id || ')' else '`' || e || ':' || page_id || '`' end as location from (select page_id, replace(url_encode(url), '%2F', '/') as e from pages)""")
def report_locations(spark: SparkSession, sf: str) -> DataFrame:
    revision = F.when(F.col("page_id") % 2 == 0, F.sha1(F.lit("x")))
    return table(spark, sf, "pages").select("page_id", reports.location(F.col("url"), F.col("page_id"), F.lit("o/r"), revision).alias("location"))


@query("opportunity_report", r"""
with l as (select page_id % 4 as section, page_id, '* ' || case when page_id % 2 = 0 then '[`' || e || ':' || page_id || '`](https://github.com/o/r/blob/' || sha1('x') || '/' || e || '#L' || page_id || ')' else '`' || e || ':' || page_id || '`' end as row from (select page_id, replace(url_encode(url), '%2F', '/') as e from pages)),
k as (select *, row_number() over (partition by section order by page_id) as rank from l), b as (select *, sum(strlen(row) + 1) over (partition by section order by rank) as used from k where rank <= 20) select section, rank, row from b where used <= 1800""")
def opportunity_report(spark: SparkSession, sf: str) -> DataFrame:
    revision = F.when(F.col("page_id") % 2 == 0, F.sha1(F.lit("x")))
    rows = table(spark, sf, "pages").withColumn("section", F.col("page_id") % 4)
    return reports.listed(rows, ["section"], [F.col("page_id")], reports.location(F.col("url"), F.col("page_id"), F.lit("o/r"), revision), most_bytes=1800)


@query("frozen_inventory", """
with e as (select page_id, sha256(html) as d from pages where page_id % 9 <> 0 and html is not null), f as (select page_id, sha256(case when page_id % 10 = 1 then url else html end) as d from pages where page_id % 8 <> 0 and html is not null)
select page_id, case when e.page_id is null then 'unexpected' when f.page_id is null then 'missing' when e.d <> f.d then 'assignment_differs' end as problem from e full join f using (page_id)""")
def frozen_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Files (here pages) of a frozen artifact against those that are there, by digest."""
    pages = table(spark, sf, "pages").where("html is not null")
    expected = pages.where("page_id % 9 != 0").select("page_id", F.sha2("html", 256).alias("digest"))
    return arms.assigned(expected, pages.where("page_id % 8 != 0").select("page_id", F.sha2(F.when(F.col("page_id") % 10 == 1, F.col("url")).otherwise(F.col("html")), 256).alias("digest")), ["page_id"], ["digest"])


@query("index_update_plan", """
with now as (select doc_id, sha256('p|' || text) as k from documents where doc_id % 5 <> 0 and text is not null), old as (select doc_id, sha256('p|' || case when doc_id % 3 = 0 then lang else text end) as k from documents where doc_id % 7 <> 0 and text is not null), have as (select distinct sha256('p|' || text) as k from documents where doc_id % 2 = 0 and text is not null)
select count(n.doc_id) as documents, count(*) filter (o.doc_id is null) as added, count(*) filter (n.doc_id is null) as removed, count(*) filter (n.k <> o.k) as changed, count(distinct n.k) filter (h.k is null) as encode_inputs, count(*) filter (h.k is not null) as reused_documents, 0::bigint as repeated_ids
from now n full join old o on n.doc_id = o.doc_id left join have h on h.k = n.k""")
def index_update_plan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    key = lambda c: vector_index.cache_key("p", c).alias("key")
    old = docs.where("doc_id % 7 != 0").select("doc_id", key(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("text"))))
    return vector_index.update_plan(docs.where("doc_id % 5 != 0").select("doc_id", key(F.col("text"))), old, docs.where("doc_id % 2 = 0").select(key(F.col("text"))), "doc_id", "key")


@query("changes_by_severity", """
with t as (select l_partkey, l_suppkey, l_quantity, l_shipdate < timestamp '1995-06-17' as old from lineitem), g as (select l_partkey, l_suppkey, max(l_quantity) filter (old) as before, max(l_quantity) filter (not old) as after from t group by 1, 2)
select l_partkey, l_suppkey, before, after from g where before is distinct from after order by l_partkey % 3, greatest(before, after) desc, l_partkey, l_suppkey limit 500""")
def changes_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    old = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.when(old, F.col("l_quantity"))).alias("before"), F.max(F.when(~old, F.col("l_quantity"))).alias("after")).where("not (before <=> after)")
    return rows.withColumn("metric", F.col("l_partkey") % 3).orderBy(*diff.severity(rows, "metric", ["l_partkey", "l_suppkey"])).limit(500).drop("metric")


@query("unreviewed_outside", """
select o_orderkey from orders where o_orderstatus <> 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def unreviewed_outside(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus != 'F'").join(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("text_normalised", rf"""
select doc_id, list_count(regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '[\p{{L}}\p{{N}}]+'))::bigint as n_unicode_tokens, {TOKENS_SQL}[2] as second_token from documents""")
def text_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.unicode_tokens(F.col("text"))).cast("bigint").alias("n_unicode_tokens"), F.try_element_at(T.ascii_tokens(F.col("text")), F.lit(2)).alias("second_token"))
