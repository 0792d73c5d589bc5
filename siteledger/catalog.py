"""Queries over whole tables, one for each relational operator, each with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions import text as T
from siteledger.functions import vectors as V
from siteledger.operators import closure, diff, history, measure, policy, registry, retrieval, scope, scoring, similarity
from siteledger.plans.lineage import cut, numbered, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


STATUS_SQL = "case when c_acctbal < 0 then 'dead' when c_acctbal < 2000 then 'unknown' else 'live' end"


@query("measure_partition", f"""
with p as (select case when o_orderstatus = 'F' then 'covered' when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 'excluded' else 'remaining' end as part from orders),
c as (select count(*) filter (part = 'covered') as covered, count(*) filter (part = 'excluded') as excluded, count(*) filter (part = 'remaining') as remaining from p),
d as (select count(*) filter (s = 'live') as live, count(*) filter (s = 'dead') as dead, count(*) filter (s = 'unknown') as unknown from (select {STATUS_SQL} as s from customer))
select covered, excluded, remaining, live, dead, unknown, live + unknown as definitions, case when remaining > 0 then (live + unknown)::double / remaining end as ratio,
case when remaining > 0 then 'ratio' when live + unknown > 0 then 'complete' else 'not_applicable' end as state from c, d""")
def measure_partition(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    excluded = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    parts = measure.placed(orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", excluded, "o_orderkey")
    return measure.report(parts, table(spark, sf, "customer").select(F.expr(STATUS_SQL).alias("status")), "status")


EVENT_STATUS = "case when value < 20 then 'dead' when value < 60 then 'live' else 'unknown' end"


@query("dedup_priority", f"""
select user_id, event_type, status, event_id from (select *, row_number() over (partition by user_id, event_type order by case status when 'unknown' then 2 when 'live' then 1 else 0 end desc, event_id) as r
from (select user_id, event_type, event_id, {EVENT_STATUS} as status from events)) where r = 1""")
def dedup_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.expr(EVENT_STATUS).alias("status"))
    return measure.strongest(rows, ["user_id", "event_type"], "status", "event_id").select("user_id", "event_type", "status", "event_id")


@query("occurrence_fingerprint", r"""
with b as (select doc_id, lang || ':' || source || ':doc:' || substr(sha256(regexp_replace(text, '\s+', '', 'g')), 1, 16) as base from documents)
select doc_id, base || ':' || row_number() over (partition by base order by doc_id) as fingerprint from b""")
def occurrence_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    base = T.base_key(F.col("lang"), F.col("source"), F.lit("doc"), F.col("text"), r"\s+")
    rows = table(spark, sf, "documents").select("doc_id", base.alias("base"))
    return numbered(rows, ["base"], ["doc_id"]).select("doc_id", F.concat_ws(":", "base", "position").alias("fingerprint"))


@query("registry_sync", """
select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders)
where r = 1 and o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def registry_sync(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return registry.additions(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), known, "o_custkey", "o_orderkey")


@query("registry_reconcile", """
with found as (select distinct l_partkey as p_partkey from lineitem where l_quantity > 45), reg as (select * from part where p_size < 30),
e as (select count(*) filter (p_retailprice < 1500) as eligible, coalesce(sum(case when p_retailprice < 1500 then (p_size > 5)::int + (p_size > 10)::int + (p_name <> '')::int + (p_brand = 'x')::int end), 0)::bigint as earned from reg)
select (select count(*) from found where p_partkey not in (select p_partkey from reg)) as newly_found, (select count(*) from reg where p_partkey not in (select p_partkey from found)) as missing,
eligible, earned, case when eligible > 0 then earned::double * 100 / (eligible::double * 4) end as coverage_percent from e""")
def registry_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("seq"))
    known = table(spark, sf, "part").where("p_size < 30")
    mark = lambda c: F.when(c, "x").otherwise("")
    points = T.evidence_points(mark(F.col("p_size") > 5), mark(F.col("p_size") > 10), F.col("p_name"), mark(F.col("p_brand") == "x"))
    one = F.lit(1).alias("_one")
    new = registry.additions(found, known, "p_partkey", "seq").agg(F.count(F.lit(1)).alias("newly_found"), F.lit(1).alias("_one"))
    gone = registry.missing(found, known, "p_partkey").agg(F.count(F.lit(1)).alias("missing"), F.lit(1).alias("_one"))
    cover = registry.coverage(known, F.col("p_retailprice") < 1500, points).select("*", one)
    return new.join(gone, "_one").join(cover, "_one").drop("_one")


MANIFEST = [(".", "excluded"), ("fr", "application"), ("de", "test"), ("en", "application"), ("en/1", "vendored"), ("es", "application"), ("es", "test")]
PAGE_PATH = r"regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1)"


@query("longest_prefix_role", f"""
with m(prefix, role) as (values {', '.join(str(x) for x in MANIFEST)}), p as (select page_id, {PAGE_PATH} as path from pages),
h as (select page_id, path, role, rank() over (partition by page_id, path order by case when prefix = '.' then 0 else strlen(prefix) end desc) as r from p join m on prefix = '.' or path = prefix or starts_with(path, prefix || '/'))
select page_id, path, case when count(distinct role) = 1 then min(role) end as role, case when count(distinct role) > 1 then 'conflicting roles' end as scope_issue from h where r = 1 group by 1, 2""")
def longest_prefix_role(spark: SparkSession, sf: str) -> DataFrame:
    return scope.roles(table(spark, sf, "pages").select("page_id", F.expr(PAGE_PATH).alias("path")), MANIFEST)


@query("included_paths", f"""
select page_id, {PAGE_PATH} as path from pages where exists (select 1 from (values ('fr'), ('de/1')) v(p) where {PAGE_PATH} = p or starts_with({PAGE_PATH}, p || '/'))""")
def included_paths(spark: SparkSession, sf: str) -> DataFrame:
    return scope.included(table(spark, sf, "pages").select("page_id", F.expr(PAGE_PATH).alias("path")), ["fr", "de/1"])


@query("span_containment", """
select p.event_id, exists (select 1 from events s where s.user_id = p.user_id and s.value > 80 and p.event_id >= s.event_id and p.event_id < s.event_id + 400) as inside from events p""")
def span_containment(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "value", F.col("event_id").alias("at"))
    spans = events.where("value > 80").select("user_id", F.col("at").alias("start"), (F.col("at") + 400).alias("stop"))
    return scope.contained(events, spans, "event_id", "user_id", "at", "start", "stop")


HALF = "cast(substr(source, 4) as int) % 2"


@query("inventory_diff", f"""
with d as (select lang, substr(sha256(text), 1, 16) as digest, {HALF} as side from documents), c as (select lang, digest, count(*) filter (side = 0) as n_before, count(*) filter (side = 1) as n_after from d group by 1, 2)
select lang, digest, n_before, n_after, case when n_before = 0 then 'added' when n_after = 0 then 'removed' else 'ambiguous' end as change from c where n_before <> n_after""")
def inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", F.substring(F.sha2("text", 256), 1, 16).alias("digest"), F.expr(HALF).alias("side"))
    return diff.listed(diff.inventory(rows.where("side = 0"), rows.where("side = 1"), ["lang", "digest"]), ["lang", "digest"])


@query("introduced_multiset", f"""
with d as (select doc_id, substr(sha256(text), 1, 16) as digest, {HALF} as side from documents), o as (select digest, count(*) as n from d where side = 0 group by 1),
a as (select doc_id, digest, row_number() over (partition by digest order by doc_id) as occurrence from d where side = 1) select doc_id, digest, occurrence, occurrence > coalesce(n, 0) as introduced from a left join o using (digest)""")
def introduced_multiset(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"), F.expr(HALF).alias("side"))
    return diff.introduced(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"), ["digest"], ["doc_id"]).select("doc_id", "digest", "occurrence", "introduced")


@query("function_change", """
with t as (select l_partkey, l_suppkey, l_quantity, l_shipdate < timestamp '1995-06-17' as old from lineitem),
g as (select l_partkey, l_suppkey, list_sort(coalesce(list(l_quantity) filter (old), [])) as b, list_sort(coalesce(list(l_quantity) filter (not old), [])) as a from t group by 1, 2)
select l_partkey, l_suppkey, case when len(b) = 1 then b[1] end as before, case when len(a) = 1 then a[1] end as after, case when len(a) = 1 and len(b) = 1 then a[1] - b[1] end as delta,
case when len(a) = 1 and len(b) = 1 then 'matched' when len(b) = 0 then 'added' when len(a) = 0 then 'removed' else 'ambiguous' end as correspondence from g where b <> a""")
def function_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", (F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")).alias("old"))
    return diff.functions(rows.where("old"), rows.where("not old"), ["l_partkey", "l_suppkey"], "l_quantity")


COUNTERS = "count(*) as orders, count(distinct o_custkey) as customers, sum(cast(o_totalprice as decimal(18,2))) as price, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as urgent"


@query("snapshot_delta", f"""
with b as (select {COUNTERS} from orders where year(o_orderdate) = 1995), a as (select {COUNTERS} from orders where year(o_orderdate) = 1996), s as (
{' union all '.join(f"select '{c}' as counter, (select {c}::double from b) as before, (select {c}::double from a) as after" for c in ('orders', 'customers', 'price', 'urgent'))}) select counter, before, after, after - before as delta from s""")
def snapshot_delta(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    of = lambda y: orders.where(f"year(o_orderdate) = {y}").selectExpr(*COUNTERS.split(", ")[:2], "sum(cast(o_totalprice as decimal(18,2))) as price", "sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as urgent")
    return diff.counters(of(1995), of(1996))


@query("key_changes", """
with o as (select p_partkey as k, p_brand as v from part where p_size <= 40), n as (select p_partkey as k, case when p_size % 7 = 0 then 'new' else p_brand end as v from part where p_size >= 10)
select count(*) filter (o.k is null) as added, count(*) filter (n.k is null) as removed, count(*) filter (o.k is not null and n.k is not null and o.v is distinct from n.v) as changed,
count(*) filter (o.k is not null and n.k is not null and o.v is not distinct from n.v) as unchanged from o full join n on o.k = n.k""")
def key_changes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    old = part.where("p_size <= 40").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    return diff.key_changes(old, part.where("p_size >= 10").selectExpr("p_partkey as k", "case when p_size % 7 = 0 then 'new' else p_brand end as v"), "k", "v")


@query("snapshot_equality", """
(select o_custkey, o_orderstatus, 'left' as side from orders where o_totalprice > 1000 except all select o_custkey, o_orderstatus, 'left' from orders where o_orderpriority <> '5-LOW') union all
(select o_custkey, o_orderstatus, 'right' from orders where o_orderpriority <> '5-LOW' except all select o_custkey, o_orderstatus, 'right' from orders where o_totalprice > 1000)""")
def snapshot_equality(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return diff.unequal(orders.where("o_totalprice > 1000").select("o_custkey", "o_orderstatus"), orders.where("o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderstatus"))


@query("history_topk", "select event_id, ts, user_id, event_type from events order by ts desc, event_id desc limit 1000")
def history_topk(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id", 1000)


@query("idempotent_append", """
with e as (select sha256(event_type || '|' || user_id || '|' || floor(value)::bigint) as snapshot_key, event_id, event_type from events)
select snapshot_key, min(event_id) as event_id, arg_min(event_type, event_id) as event_type from e where event_id % 3 <> 0 and snapshot_key not in (select snapshot_key from e where event_id % 3 = 0) group by 1""")
def idempotent_append(spark: SparkSession, sf: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", "event_type", "user_id", F.floor("value").cast("string")), 256)
    rows = table(spark, sf, "events").select(key.alias("snapshot_key"), "event_id", "event_type")
    return history.new_rows(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), "snapshot_key", "event_id")


TOKENS_SQL = r"regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z]+|[0-9]+')"


@query("feature_similarity", f"""
with s as (select doc_id, list_distinct({TOKENS_SQL}) as f from documents), t as (select item_id, list_distinct({TOKENS_SQL}) as f from benchmark),
p as (select doc_id, item_id, len(list_intersect(s.f, t.f)) as common, len(s.f) + len(t.f) as n_both from s, t)
select doc_id, item_id, common::bigint as common, (n_both - common)::bigint as total from p where common >= 3 and 2 * common >= n_both - common""")
def feature_similarity(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array_distinct(T.ascii_tokens(F.col("text"))).alias("features")
    return similarity.near_templates(spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tokens), table(spark, sf, "benchmark").select("item_id", tokens), "doc_id", "item_id", "features")


@query("related_sites", """
with r as (select lang, source, doc_id as related, row_number() over (partition by lang, source order by doc_id) as k from documents), j as (
select d.doc_id, r.related, row_number() over (partition by d.doc_id order by r.related) as rank from documents d join r on d.lang = r.lang and d.source = r.source and r.k <= 9 and r.related <> d.doc_id) select doc_id, related, rank from j where rank <= 8""")
def related_sites(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.related(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


LABELLED = "select doc_id, case when quality = 1 then 'eligible' when toxic = 1 then 'excluded' else 'needs_review' end as reference, case when toxic = 1 then 'excluded' when quality = 1 then 'eligible' else 'excluded' end as predicted from labels"
DOMAIN = ["eligible", "excluded", "needs_review"]
DOMAIN_SQL = "(values ('eligible'), ('excluded'), ('needs_review'))"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    q = F.when(F.col("quality") == 1, "eligible").when(F.col("toxic") == 1, "excluded").otherwise("needs_review")
    p = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "eligible").otherwise("excluded")
    return table(spark, sf, "labels").select("doc_id", q.alias("reference"), p.alias("predicted"))


@query("confusion_matrix", f"with r as ({LABELLED}), a(x) as {DOMAIN_SQL}, b(y) as {DOMAIN_SQL} select x as reference, y as predicted, (select count(*) from r where reference = x and predicted = y) as n from a, b")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confusion(labelled(spark, sf), "reference", "predicted", DOMAIN)


METRICS_SQL = f"""with r as ({LABELLED}), a(label) as {DOMAIN_SQL}, c as (select label, (select count(*) from r where reference = label and predicted = label) as tp, (select count(*) from r where predicted = label) as pos, (select count(*) from r where reference = label) as support from a),
m as (select label, support, case when pos > 0 then tp::double / pos end as precision, case when support > 0 then tp::double / support end as recall, case when pos + support > 0 then (2 * tp)::double / (pos + support) end as f1 from c)"""


@query("classification_metrics", METRICS_SQL + " select * from m")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.metrics(labelled(spark, sf), "reference", "predicted", DOMAIN)


@query("score_summary", METRICS_SQL + """ select count(*) as n, count(*) filter (reference = predicted) as matched, count(*) filter (predicted = 'needs_review') as abstained, (count(*) filter (reference = predicted))::double / count(*) as accuracy,
(count(*) filter (predicted = 'needs_review'))::double / count(*) as abstention, (count(*) filter (predicted <> 'needs_review'))::double / count(*) as coverage, (select round(avg(f1), 12) from m) as macro_f1 from r""")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.summary(labelled(spark, sf), "reference", "predicted", DOMAIN, "needs_review").withColumn("macro_f1", F.round("macro_f1", 12))


@query("paired_stability", """
with p as (select l_orderkey, max(l_returnflag) filter (l_linenumber = 1) as a, max(l_returnflag) filter (l_linenumber = 2) as b, max(l_discount) filter (l_linenumber = 1) as x, max(l_discount) filter (l_linenumber = 2) as y from lineitem group by 1)
select count(*) as pairs, count(*) filter (a <> b) as changed, round(max(abs(x - y)), 9) as max_delta from p where a is not null and b is not null""")
def paired_stability(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.repeat_stability(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", "l_discount").withColumn("max_delta", F.round("max_delta", 9))


@query("paired_gains", """
with p as (select l_orderkey, max((l_returnflag = 'N')::int) filter (l_linenumber = 1) as a, max((l_returnflag = 'N')::int) filter (l_linenumber = 3) as b from lineitem group by 1)
select count(*) as cases, count(*) filter (b > a) as gains, count(*) filter (b < a) as losses, count(*) filter (b > a) - count(*) filter (b < a) as net from p where a is not null and b is not null""")
def paired_gains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("arm"), "l_returnflag")
    return scoring.paired_gains(rows, "l_orderkey", "arm", F.col("l_returnflag") == "N", "1", "3")


@query("annotator_agreement", """
with n as (select l_linestatus, l_orderkey, l_returnflag, count(*) as n from lineitem group by all), c as (select l_linestatus, l_orderkey, sum(n) as k, count(*) as labels, sum(n * (n - 1) // 2) as same from n group by 1, 2)
select l_linestatus, count(*) as cases, count(*) filter (labels = 1) as unanimous, sum(k * (k - 1) // 2)::bigint as pairs, sum(same)::bigint as agreeing from c group by 1""")
def annotator_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.agreement(table(spark, sf, "lineitem"), "l_linestatus", "l_orderkey", "l_linenumber", "l_returnflag")


@query("configuration_balance", """
with c as (select o_custkey, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1) select *, "F" = "O" and "O" = "P" as balanced from c""")
def configuration_balance(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.configuration_groups(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("usage_totals", """
select l_shipdate::date as day, count(*) as n, sum(l_partkey)::bigint as l_partkey, sum(case when l_linenumber > 6 then l_suppkey end)::bigint as metered, list_sort(list(distinct l_returnflag)) as models from lineitem group by 1""")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("cast(l_shipdate as date) as day", "l_partkey", "case when l_linenumber > 6 then l_suppkey end as metered", "l_returnflag")
    return scoring.usage(rows, ["day"], ["l_partkey", "metered"], "l_returnflag")


BM25_SQL = f"""
with d as (select doc_id, {TOKENS_SQL} as toks from documents), n as (select doc_id, len(toks) as n from d), s as (select count(*)::double as nd, avg(n) as avgdl from n),
tf as (select doc_id, token, count(*) as tf from (select doc_id, unnest(toks) as token from d) group by 1, 2), df as (select token, count(*) as df from tf group by 1), raw as (select token, ln((nd - df + 0.5) / (df + 0.5)) as idf from df, s),
idf as (select token, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw), q as (select item_id, token, count(*) as times from (select item_id, unnest({TOKENS_SQL}) as token from benchmark) group by 1, 2),
sc as (select item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 6) as score from q join idf using (token) join tf using (token) join n using (doc_id), s group by 1, 2)
select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc) where rank <= 10"""


@query("bm25_rank", BM25_SQL)
def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.ascii_tokens(F.col("text")).alias("tokens")
    return retrieval.bm25(spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tokens), table(spark, sf, "benchmark").select("item_id", tokens), "doc_id", "item_id", "tokens", k=10)


def near_sql(dims: int, k: int) -> str:
    v = f"e.embedding[1:{dims}]::double[]"
    return f"""select q.vec_id as query, e.vec_id as doc, round(list_cosine_similarity({v.replace('e.', 'q.')}, {v}), 6) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0"""


def near_ranked(dims: int, k: int) -> str:
    return f"select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from ({near_sql(dims, k)})) where rank <= {k}"


def near(spark: SparkSession, sf: str, dims: int | None, k: int) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", k, dims)


@query("dense_rank", near_ranked(64, 10))
def dense_rank(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, None, 10)


@query("matryoshka_rank", near_ranked(16, 10))
def matryoshka_rank(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, 16, 10)


FUSED_SQL = f"""select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from (select query, doc, round(sum(1.0::double / (60 + rank)), 9) as score from (select query, doc, rank from ({near_ranked(64, 50)}) union all select query, doc, rank from ({near_ranked(16, 50)})) group by 1, 2)) where rank <= 10"""


@query("rrf_fusion", FUSED_SQL)
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fused([near(spark, sf, None, 50), near(spark, sf, 16, 50)], 10)


UNICODE_SQL = r"regexp_extract_all(replace(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), 'ß', 'ss'), '[\p{L}\p{N}]+')"


def bm25_ranked_sql(tokens: str, k: int, positive: bool) -> str:
    """All documents in order for each query, zero scores by id; with positive, only those above zero."""
    scored = BM25_SQL.replace(TOKENS_SQL, tokens).rpartition("select item_id, doc_id, score, rank from")[0]
    everything = f"select i.item_id, d.doc_id, coalesce(sc.score, 0) as score from benchmark i cross join documents d left join sc on sc.item_id = i.item_id and sc.doc_id = d.doc_id where d.text is not null{' and sc.score > 0' if positive else ''}"
    return f"{scored} select item_id as query, doc_id as doc, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from ({everything})) where rank <= {k}"


HYBRID_ARMS = [(name, dims, tokens, positive) for name, tokens in (("ascii", TOKENS_SQL), ("unicode", UNICODE_SQL)) for positive in (False, True) for dims in (64, 16)]
#: The dense channel: a query has the vector of its id, and documents those of theirs.
DENSE_SQL = """select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from (select q.vec_id as query, e.vec_id as doc, round(list_cosine_similarity(q.embedding[1:{dims}]::double[], e.embedding[1:{dims}]::double[]), 6) as score
from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id in (select item_id from benchmark) and e.vec_id in (select doc_id from documents where text is not null))) where rank <= 50"""
HYBRID_SQL = " union all ".join(f"""select '{name}' as tokenizer, {positive}::boolean as positive_only, {dims} as dims, query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, doc) as rank
from (select query, doc, round(sum(1.0::double / (60 + rank)), 9) as score from (select query, doc, rank from ({bm25_ranked_sql(tokens, 50, positive)}) union all select query, doc, rank from ({DENSE_SQL.format(dims=dims)})) group by 1, 2)) where rank <= 10""" for name, dims, tokens, positive in HYBRID_ARMS)


@query("hybrid_rrf", HYBRID_SQL)
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 with a dense channel of two lengths, by two tokenizers, with all documents or only those of a positive score in the lexical channel."""
    docs, items = table(spark, sf, "documents").where("text is not null"), table(spark, sf, "benchmark")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    mine = cut(vectors.join(docs.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi"), "document-vectors")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    dense = {d: cut(retrieval.nearest(mine, asked, "vec_id", "embedding", 50, d), "dense") for d in (64, 16)}
    out = None
    for name, tokens in (("ascii", T.ascii_tokens), ("unicode", T.unicode_tokens)):
        toks = tokens(F.col("text")).alias("tokens")
        scored = cut(retrieval.bm25(docs.select("doc_id", toks), items.select("item_id", toks), "doc_id", "item_id", "tokens", k=50), "lexical")
        for positive in (False, True):
            lexical = retrieval.ranked(scored.where("score > 0").drop("rank"), "item_id", "doc_id", F.col("score"), 50) if positive else retrieval.padded(scored, docs, items, "doc_id", "item_id", 50)
            lexical = lexical.select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"), "rank")
            for dims in (64, 16):
                one = retrieval.fused([lexical, dense[dims]], 10).select(F.lit(name).alias("tokenizer"), F.lit(positive).alias("positive_only"), F.lit(dims).alias("dims"), "query", "doc", "score", "rank")
                out = one if out is None else out.unionByName(one)
    return out


@query("mrr_hits", f"""
with r as ({near_ranked(64, 10)}), f as (select r.query, min(rank) filter (a.label = b.label) as first from r join embeddings a on a.vec_id = r.query join embeddings b on b.vec_id = r.doc group by 1), q as (select vec_id as query from embeddings where vec_id % 50 = 0)
select count(*) as queries, round(avg(coalesce(1.0::double / first, 0)), 9) as mrr, count(*) filter (first <= 1) as hits_at_1, count(*) filter (first <= 5) as hits_at_5, count(*) filter (first <= 10) as hits_at_10 from q left join f using (query)""")
def mrr_hits(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    found = near(spark, sf, None, 10).join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(labels.select(F.col("vec_id").alias("doc"), F.col("label").alias("b")), "doc")
    return retrieval.quality(found.withColumn("relevant", F.col("a") == F.col("b")), labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query")), "relevant")


@query("first_match_policy", """
select d.doc_id, case when l.toxic = 1 and l.quality = 1 then 'conflicting' when l.toxic = 1 then 'tool' when d.n_chars < 200 then 'ordinary' when l.quality = 1 then 'existing' when l.quality = 0 then 'formalize' else 'unresolved' end as route,
list_filter([case when l.toxic = 1 then 'toxic' end, case when d.n_chars < 200 then 'short' end, case when l.doc_id is null then 'unlabelled' end], lambda x: x is not null) as findings from documents d left join labels l using (doc_id)""")
def first_match_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    route = policy.first_match([("conflicting", toxic & good), ("tool", toxic), ("ordinary", F.col("n_chars") < 200), ("existing", good), ("formalize", F.col("quality") == 0)], "unresolved")
    return rows.select("doc_id", route.alias("route"), policy.findings([("toxic", toxic), ("short", F.col("n_chars") < 200), ("unlabelled", F.col("quality").isNull())]).alias("findings"))


ANSWER = "select doc_id, case when quality = 1 then 'good' when doc_id % 11 = 0 then 'other' else 'bad' end as choice, (doc_id % 101)::decimal(10,2) / 100 as p, case when doc_id % 7 = 0 then 0.05::decimal(10,2) else 0::decimal(10,2) end as extra from labels"


@query("choice_validation", f"""
with a as (select doc_id, choice, p::double as g, (1 - p + extra)::double as b, p::decimal(20,10) + (1 - p + extra)::decimal(20,10) as mass from ({ANSWER}))
select doc_id, case when choice = 'other' then 'unknown_choice' when b > 1 or g > 1 then 'not_a_probability' when abs(mass - 1) > 0.01 then 'wrong_mass' when (case choice when 'good' then g else b end) < greatest(g, b) then 'not_the_best' end as problem,
case when choice = 'good' then g > b when choice = 'bad' then b > g end as majority from a""")
def choice_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("doc_id", "case when quality = 1 then 'good' when doc_id % 11 = 0 then 'other' else 'bad' end as choice", "cast(doc_id % 101 as decimal(10,2)) / 100 as p", "case when doc_id % 7 = 0 then 0.05 else 0 end as extra")
    rows = rows.select("doc_id", "choice", F.create_map(F.lit("good"), F.col("p").cast("double"), F.lit("bad"), (1 - F.col("p") + F.col("extra")).cast("double")).alias("probabilities"))
    problem = policy.choice_problem(F.col("choice"), F.lit(0.5), F.col("probabilities"), ["good", "bad"], 0.01)
    return rows.select("doc_id", problem.alias("problem"), policy.strict_majority(F.col("choice"), F.col("probabilities")).alias("majority"))


@query("byte_budget", """
with r as (select lang, source, doc_id, strlen(text) as n, row_number() over (partition by lang, source order by doc_id) as rank from documents), b as (select *, sum(n + 1) over (partition by lang, source order by rank)::bigint as bytes_so_far from r where rank <= 20)
select lang, source, doc_id, rank, bytes_so_far from b where bytes_so_far <= 12000""")
def byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", "source", "doc_id", F.octet_length("text").alias("n"))
    return history.within_budget(rows, ["lang", "source"], [F.col("doc_id")], F.col("n"), 20, 12000).select("lang", "source", "doc_id", F.col("rank").cast("bigint").alias("rank"), "bytes_so_far")


@query("fixpoint_closure", """
with recursive e as (select distinct a.o_custkey as a, b.o_custkey as b from orders a join orders b on b.o_orderkey = a.o_orderkey + 1 where a.o_custkey < b.o_custkey), r as (select c_custkey as node from customer where c_acctbal < 0 union select e.b from r join e on e.a = r.node)
select node from r""")
def fixpoint_closure(spark: SparkSession, sf: str) -> DataFrame:
    """From customers of negative balance to those with a larger key who bought next, and so on."""
    orders = table(spark, sf, "orders")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("b"))
    edges = orders.select("o_orderkey", F.col("o_custkey").alias("a")).join(after, "o_orderkey").where("a < b")
    seeds = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return closure.reached(seeds, edges, "node", "a", "b").select("node")


@query("fixpoint_closure_whole", """
with recursive o as (select o_custkey as c, l_partkey as p from orders join lineitem on l_orderkey = o_orderkey), e as (select distinct 'c' || c as a, 'p' || p as b from o union select distinct 'p' || p, 'c' || c from o),
r as (select 'c' || c_custkey as node from customer where c_acctbal < 0 union select e.b from r join e on e.a = r.node)
select node from r""")
def fixpoint_closure_whole(spark: SparkSession, sf: str) -> DataFrame:
    bought = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, p = F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    edges = bought.select(c.alias("a"), p.alias("b")).unionByName(bought.select(p.alias("a"), c.alias("b")))
    seeds = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    return closure.reached(seeds, edges, "node", "a", "b").select("node")


@query("text_functions", rf"""
select doc_id, {TOKENS_SQL}[1] as first_token, len({TOKENS_SQL})::bigint as n_tokens, substr(trim(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '\S'))[1], e' \t\n\r'), 1, 120) as excerpt, 'sha256:' || sha256(text) as digest from documents""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.ascii_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.try_element_at(tokens, F.lit(1)).alias("first_token"), F.size(tokens).cast("bigint").alias("n_tokens"), T.excerpt(F.col("text")).alias("excerpt"), T.digest(F.col("text")).alias("digest"))


@query("path_functions", f"""
select page_id, replace(url_encode(url), '%2F', '/') as encoded, replace(regexp_replace({PAGE_PATH}, '^src/', ''), '/', '.') as module, not starts_with({PAGE_PATH}, '/') and not exists (select 1 from unnest(string_split({PAGE_PATH}, '/')) u(x) where x in ('', '.', '..')) as valid from pages""")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr(PAGE_PATH)
    return table(spark, sf, "pages").select("page_id", T.percent_encoded(F.col("url")).alias("encoded"), T.module_name(path).alias("module"), T.valid_path(path).alias("valid"))


@query("vector_functions", """
select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) <= 0.0001 as valid from embeddings""")
def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), V.valid(v, 64).alias("valid"))
