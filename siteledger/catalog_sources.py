"""Queries of the source analysis over a code base that is read off the tables: customers are modules, orders in a row are imports.

Each kind of fact is one SQL text that Spark and the SQL of the queries share; what follows from the facts (resolved names,
derived specifications, statuses, places) is computed by the library on one side and by recursive SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.catalog import query, table
from siteledger.operators import reuse
from siteledger.plans import applications, scan
from siteledger.plans.lineage import cut
from siteledger.plans.python_facts import FIELDS
from siteledger.sources import trees

NAME = "case when {0} % 3 = 0 then 'C' else '_C' end || {0}"
MODULE = "'p' || ({0} % 7) || '.m' || {0}"
PATH = "'p' || ({0} % 7) || '/m' || {0} || '.py'"
#: A customer and the ones of the next two orders; the first imports from the second, at times what that imports from the third.
EDGES = "(select a.o_orderkey as o, a.o_custkey as a, b.o_custkey as b, coalesce(c.o_custkey, b.o_custkey) as c, a.o_orderstatus as status, a.o_orderpriority as priority from {orders} a join {orders} b on b.o_orderkey = a.o_orderkey + 1 left join {orders} c on c.o_orderkey = a.o_orderkey + 2 where a.o_custkey <> b.o_custkey and a.o_orderkey % 25 < 6) e"
TARGET = f"case when o % 23 = 2 then 'Z' || b when o % 4 = 0 then {NAME.format('c')} else {NAME.format('b')} end"
MAKER = "case when c_custkey % 4 = 0 then 'PredicateSpec' when c_custkey % 3 = 0 then 'FirstMatch.with_fallback' else 'FirstMatch' end"
ROOT = "case when c_custkey % 4 = 0 then 'PredicateSpec' else 'FirstMatch' end"
#: Kind of fact to the SQL of its columns.
FACT_SQL = {
    "file": f"select {PATH.format('c_custkey')} as path, {MODULE.format('c_custkey')} as module, false as flag from {{customer}}",
    "definition": f"select {PATH.format('k')} as path, {MODULE.format('k')} as module, {NAME.format('k')} as name, 'declaration' as kind, line, 1 as col, line + 4 as end_line, 1 as end_col, segment = 'BUILDING' and k % 5 = 0 as flag from (select c_custkey as k, c_mktsegment as segment, 1 as line from {{customer}} where c_custkey % 2 = 0 union all select c_custkey, c_mktsegment, 7 from {{customer}} where c_custkey % 40 = 2) t union all select {PATH.format('c_custkey')}, {MODULE.format('c_custkey')}, 'PredicateSpec', 'factory', 9, 1, 9, 20, false from {{customer}} where c_custkey % 30 = 1",
    "class": f"select {PATH.format('c_custkey')} as path, {MODULE.format('c_custkey')} as module, {NAME.format('c_custkey')} as name, 'declaration' as kind, 1 as line, 1 as col, 6 as end_line, 1 as end_col, false as flag from {{customer}} where c_custkey % 2 = 1",
    "base": f"select {MODULE.format('a')} as module, {NAME.format('a')} as name, {TARGET} as target_name from {EDGES} where a % 2 = 1 and o % 6 = 5",
    "import": f"select {MODULE.format('a')} as module, {TARGET} as name, {MODULE.format('b')} as target_module, {TARGET} as target_name, status = 'P' as flag from {EDGES} union all select {MODULE.format('c_custkey')}, {ROOT}, 'rules_core', {ROOT}, false from {{customer}} where c_custkey % 2 = 0 and c_custkey % 14 <> 6",
    "module_import": f"select {MODULE.format('a')} as module, 'x' || b as name, {MODULE.format('b')} as target_module, false as flag from {EDGES} where o % 9 = 1",
    "binder": f"select {MODULE.format('a')} as module, {TARGET} as name, status = 'P' as flag from {EDGES} union all select {MODULE.format('a')}, {TARGET}, true from {EDGES} where o % 17 = 0 union all select {MODULE.format('a')}, 'x' || b, false from {EDGES} where o % 9 = 1 union all select {MODULE.format('c_custkey')}, {NAME.format('c_custkey')}, false from {{customer}} union all select {MODULE.format('c_custkey')}, {ROOT}, false from {{customer}} where c_custkey % 2 = 0 union all select {MODULE.format('c_custkey')}, {ROOT}, false from {{customer}} where c_custkey % 22 = 4",
    "use": f"select {PATH.format('a')} as path, {MODULE.format('a')} as module, {TARGET} as name, case priority when '1-URGENT' then 'runtime' when '2-HIGH' then 'inherit' when '3-MEDIUM' then 'other' when '4-NOT SPECIFIED' then 'factory' else 'part' end as kind, o % 11 = 0 as flag, o % 1000 as line, 1 as col from {EDGES} where o % 3 <> 0 and priority <> '5-LOW' union all select {PATH.format('a')}, {MODULE.format('a')}, 'x' || b || '.' || {NAME.format('b')}, 'runtime', false, o % 1000, 9 from {EDGES} where o % 9 = 1 union all select {PATH.format('a')}, {MODULE.format('a')}, 'x' || b, 'other', false, o % 1000, 20 from {EDGES} where o % 135 = 1",
    "export": f"select {MODULE.format('c_custkey')} as module, {NAME.format('c_custkey')} as name from {{customer}} where c_custkey % 10 = 4",
    "assign": f"select {MODULE.format('c_custkey')} as module, 'Z' || c_custkey as name, case when c_custkey % 16 = 0 then 'literal' else 'other' end as kind from {{customer}} where c_custkey % 8 = 0",
    "candidate": f"select {PATH.format('o_custkey')} as path, {MODULE.format('o_custkey')} as module, case o_orderkey % 3 when 0 then 'if' when 1 then 'match' else 'comprehension_filter' end as kind, 2 + o_orderkey % 9 as line, 1 + o_orderkey % 4 as col, o_orderkey as seq, 'if ' || (o_orderkey % 7) || '  > 1' as text, o_orderkey % 13 = 0 as flag from {{orders}}",
}


def code_facts(spark: SparkSession, sf: str) -> DataFrame:
    frames = {n: table(spark, sf, n) for n in ("customer", "orders")}
    out = None
    for fact, sql in FACT_SQL.items():
        rows = spark.sql(sql, **{n: f for n, f in frames.items() if "{" + n + "}" in sql}).withColumnsRenamed({"col": "column", "end_col": "end_column"})
        named = dict(f.split() for f in FIELDS.split(", "))
        rows = rows.select(F.lit(fact).alias("fact"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in named.items() if c != "fact"])
        out = rows if out is None else out.unionByName(rows)
    return cut(out, "facts")


def code_scan(spark: SparkSession, sf: str) -> scan.Scan:
    """The scan of that code base; its digest is that of the pages, as contents."""
    none = spark.createDataFrame([], "class string, path string, message string")
    return scan.derived(code_facts(spark, sf), none, page_digest(spark, sf), closed_world=True)


def page_digest(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return trees.tree_digest(pages.select(F.concat_ws("/", "page_id", "url").alias("path"), F.col("html").cast("binary").alias("bytes")))


def _f(fact: str) -> str:
    return f"f_{fact}"


#: Facts, then names along imports, derived specifications, references, statuses.
FACTS = "with recursive " + ",\n".join(f"{_f(n)} as ({s.format(customer='customer', orders='orders')})" for n, s in FACT_SQL.items())
RESOLVED = f"""{FACTS},
bound as (select module, name, count(*) <> 1 or bool_or(flag) as unsure from f_binder group by 1, 2),
classes as (select module, name from f_definition where kind = 'declaration' union all select module, name from f_class),
named as (select distinct i.module, i.name, target_module, target_name, flag or coalesce(unsure, true) as unsure from f_import i left join bound using (module, name)),
way as (select c.module, c.name, c.module as dm, c.name as dn, many or coalesce(unsure, false) as ambiguous from (select module, name, count(*) <> 1 as many from classes group by 1, 2) c left join bound using (module, name)
union select n.module, n.name, dm, dn, ambiguous or unsure from way w join named n on n.target_module = w.module and n.target_name = w.name),
each as (select module, name, dm, dn, bool_or(ambiguous) as ambiguous from way group by all),
names as (select * replace (ambiguous or count(*) over (partition by module, name) > 1 as ambiguous) from each),
direct as (select distinct b.module, b.name, dm, dn from f_base b join names n on n.module = b.module and n.name = b.target_name where not ambiguous),
spec as (select module, name from f_definition where kind = 'declaration' union select d.module, d.name from spec s join direct d on d.dm = s.module and d.dn = s.name),
derived as (select * from f_class where (module, name) in (select module, name from spec)),
definitions as (select * from f_definition union all select * from derived)"""
LIVE = f"""{RESOLVED},
own as (select distinct module as dm, name as dn from definitions where kind = 'declaration'),
known as (select * from names where (dm, dn) in (select dm, dn from own)),
uses as (select distinct path, module, name, kind, flag, line, col from f_use),
aliases as (select distinct m.module, m.name as alias, target_module as target, n <> 1 as unsure from f_module_import m join (select module, name, count(*) as n from f_binder group by 1, 2) b using (module, name)),
refs as (select dm, dn, u.kind in ('runtime', 'factory', 'inherit') and not u.flag and not ambiguous as direct from uses u join known using (module, name) where not contains(u.name, '.')
union all select dm, dn, u.kind in ('runtime', 'factory', 'inherit') and not u.flag and not ambiguous and not unsure from uses u join aliases a on a.module = u.module and a.alias = string_split(u.name, '.')[1] join known k on k.module = target and k.name = string_split(u.name, '.')[2] where contains(u.name, '.')
union all select dm, dn, false from uses u join aliases a on a.module = u.module and a.alias = u.name join own on dm = target or starts_with(dm, target || '.') where kind not in ('part', 'factory')),
lost as (select distinct target_module, target_name from f_import where (target_module, target_name) not in (select module, name from known)),
maybe as (select dm, dn from own where dn in (select target_name from lost) union select dm, dn from own join (select distinct target_module from lost join f_assign on module = target_module and name = target_name where kind <> 'literal') c on dm = target_module or starts_with(dm, target_module || '.')),
used as (select dm, dn, bool_or(direct) as direct, bool_or(not direct) as unclear from (select * from refs union all select dm, dn, false from maybe) group by 1, 2),
live as (select d.path, d.name, d.kind, d.line, case when d.kind = 'factory' then 'live' when n <> 1 then 'unknown' when unclear then 'unknown' when direct or d.flag then 'live' when not starts_with(d.name, '_') or e.name is not null then 'unknown' else 'dead' end as status
from definitions d left join (select module, name, count(*) as n from definitions where kind = 'declaration' group by 1, 2) o using (module, name) left join used on dm = d.module and dn = d.name left join (select distinct module, name from f_export) e on e.module = d.module and e.name = d.name)"""
PLACE = "line * 1000000 + col"
SITES = f"""{RESOLVED},
based as (select *, 'python:' || path || ':' || kind || ':' || substr(sha256(regexp_replace(text, '\\s+', '', 'g')), 1, 16) as base from f_candidate),
sites as (select base || ':' || row_number() over (partition by base order by line, col, seq) as fingerprint, path, kind, line, col, flag or exists (select 1 from derived d where d.path = b.path and b.{PLACE.replace('col', 'b.col')} >= d.{PLACE.replace('col', 'd.col')} and b.{PLACE.replace('col', 'b.col')} < d.end_line * 1000000 + d.end_col) as inside_specification from based b)"""


@query("scan_candidates", f"""{SITES} select fingerprint, path, line, col as "column", kind, inside_specification from sites""")
def scan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return scan.ordered(code_scan(spark, sf))[0].select("fingerprint", "path", "line", "column", "kind", "inside_specification")


@query("scan_liveness", f"{LIVE} select path, name, kind, line, status from live")
def scan_liveness(spark: SparkSession, sf: str) -> DataFrame:
    return scan.ordered(code_scan(spark, sf))[1].select("path", "name", "kind", "line", "status")


DIGEST_SQL = """select 'sha256:' || sha256(string_agg(d, '' order by b)) as digest from (select d[1:2] as b, sha256(string_agg(d, '' order by d)) as d from (select distinct sha256('{"path":"' || page_id || '/' || url || '","content":"' || sha256(html) || '"}') as d from pages where html is not null) group by 1)"""


@query("scan_measure", f"""{LIVE}, {SITES[len(RESOLVED) + 1:]},
c as (select count(*) filter (inside_specification) as covered, 0::bigint as excluded, count(*) filter (not inside_specification) as remaining from sites), d as (select count(*) filter (status = 'live') as live, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'unknown') as unknown from live)
select *, live + unknown as definitions, (live + unknown)::double / remaining as ratio, 'ratio' as state, 0::bigint as issues, unknown > 0 as provisional, ({DIGEST_SQL}) as digest from c, d""")
def scan_measure(spark: SparkSession, sf: str) -> DataFrame:
    return scan.measured(code_scan(spark, sf))


@query("scan_import_closure", f"""{FACTS},
edges as (select * from (select distinct module as a, target_module as b from f_import union select module, target_module from f_module_import) e where b in (select module from f_file)),
steps as (select module, 0 as depth from (select distinct module from f_export) union select b, depth + 1 from steps join edges on a = module where depth < 40)
select module, min(depth) as depth from steps group by 1""")
def scan_import_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that the exporting ones import, and that these import, with the least number of steps."""
    found = code_facts(spark, sf)
    return scan.import_closure(found, found.where("fact = 'export'").select("module"))


@query("scan_positions", f"""{SITES}
select o_orderkey, min(fingerprint) as fingerprint from orders left join sites on path = {PATH.format('o_custkey')} and line = 2 + o_orderkey % 5 and col = 1 + o_orderkey % 3 and kind = 'if' group by 1""")
def scan_positions(spark: SparkSession, sf: str) -> DataFrame:
    """For a place of each order's module the `if` that stands exactly there."""
    places = spark.sql(f"select o_orderkey, {PATH.format('o_custkey')} as path, 2 + o_orderkey % 5 as line, 1 + o_orderkey % 3 as column from {{orders}}", orders=table(spark, sf, "orders"))
    return scan.at_position(places, code_scan(spark, sf).candidates).select("o_orderkey", "fingerprint")


#: Values of modules, calls of their methods elsewhere, and the if statements that hold some of the calls.
APPLIED_SQL = {
    "value": f"select {MODULE.format('c_custkey')} as module, {NAME.format('c_custkey')} as name, {MAKER} as text from {{customer}} where c_custkey % 2 = 0",
    "call": f"select {PATH.format('a')} as path, {MODULE.format('a')} as module, case when o % 9 = 1 then 'x' || b || '.' || {NAME.format('b')} else {TARGET} end as name, o % 1000 as line, o as col, case when o % 3 = 0 then 'decide' else 'is_satisfied_by' end as text, case when o % 3 <> 0 then o - o % 2 end as if_line, case when o % 3 <> 0 then 5 end as if_col, case o % 4 when 0 then 'value' when 1 then 'matched' end as projection, case o % 6 when 0 then 'binding' when 3 then 'embedded' end as consumer, o % 19 = 0 as local from {EDGES}",
    "if": f"select {PATH.format('o_custkey')} as path, {MODULE.format('o_custkey')} as module, o_orderkey as if_line, 5 as if_col, o_orderkey % 7 <> 0 as direct from {{orders}} where o_orderkey % 2 = 0",
}


def code_calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    frames = {n: table(spark, sf, n) for n in ("customer", "orders")}
    out = None
    for fact, sql in APPLIED_SQL.items():
        rows = spark.sql(sql, **{n: f for n, f in frames.items() if "{" + n + "}" in sql}).withColumnsRenamed({"col": "column", "if_col": "if_column"})
        rows = rows.select(F.lit(fact).alias("fact"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in applications.FACT.split(", ")) if c != "fact"])
        out = rows if out is None else out.unionByName(rows)
    return applications.resolved_calls(code_facts(spark, sf), cut(out, "applications"))


CALLS = f"""{FACTS}, {", ".join(f"f_{n} as ({x.format(customer='customer', orders='orders')})" for n, x in APPLIED_SQL.items())},
bound as (select module, name, count(*) as n, count(*) <> 1 or bool_or(flag) as unsure from f_binder group by 1, 2),
made as (select v.module, v.name, v.text as maker from f_value v join (select distinct module, name from f_import where name = target_name) i on i.module = v.module and i.name = string_split(v.text, '.')[1] join bound b on b.module = v.module and b.name = i.name where b.n = 1),
named as (select distinct i.module, i.name, target_module, target_name, flag or coalesce(unsure, true) as unsure from f_import i left join bound using (module, name)),
way as (select m.module, m.name, m.module as dm, m.name as dn, many or coalesce(unsure, false) as ambiguous from (select module, name, count(*) <> 1 as many from made group by 1, 2) m left join bound using (module, name)
union select n.module, n.name, dm, dn, ambiguous or unsure from way w join named n on n.target_module = w.module and n.target_name = w.name),
each as (select module, name, dm, dn, bool_or(ambiguous) as ambiguous from way group by all),
names as (select e.module, e.name, dm, dn, maker from (select * from each qualify not ambiguous and count(*) over (partition by module, name) = 1) e join made on made.module = dm and made.name = dn),
alias as (select module, name as front, min(target_module) as target from f_module_import group by 1, 2 having count(distinct target_module) = 1),
known as (select module, name, dm, dn, maker from names union select a.module, front || '.' || n.name, dm, dn, maker from alias a join names n on n.module = target),
hit as (select c.path, c.col, min(dn) as target_name, count(*) as n from f_call c join known using (module, name) where not local and (text = 'is_satisfied_by' and maker = 'PredicateSpec' or text = 'decide' and maker in ('FirstMatch', 'FirstMatch.with_fallback')) group by 1, 2),
calls as (select c.*, target_name from f_call c left join (select * from hit where n = 1) using (path, col))"""


@query("if_applications", f"""{CALLS},
per as (select path, if_line, if_col, bool_and(target_name is not null) as known from calls where text = 'is_satisfied_by' and if_line is not null group by all)
select path, if_line as line, case when known is null then 'no_application' when not known then 'unresolved_call' when direct then 'direct_application' else 'mixed_expression' end as category from f_if left join per using (path, if_line, if_col)""")
def if_applications(spark: SparkSession, sf: str) -> DataFrame:
    return applications.if_categories(*code_calls(spark, sf)).select("path", "line", "category")


@query("decide_calls", f"""{CALLS}
select path, line, col as "column", name as receiver, projection, consumer, case when target_name is null then 'unresolved_call' when consumer = 'binding' then 'direct_application' else 'mixed_expression' end as category from calls where text = 'decide'""")
def decide_calls(spark: SparkSession, sf: str) -> DataFrame:
    return applications.decide_categories(code_calls(spark, sf)[0])


#: Decision sites read off lineitem; a name list is a text with commas, as the two engines write lists differently.
SITE_PATH = "case when l_suppkey % 9 = 4 then 'domain/spec' || (l_partkey % 25) || '.py' else 'app/' || (l_partkey % 20) || '/f' || (l_suppkey % 50) || '.py' end"
#: The lines of an order don't all have numbers of their own, so a site's column also has the part and the supplier.
SITE_COLUMN = "l_linenumber + 8 * l_suppkey + 8000 * l_partkey"
SITE_SQL = {
    "site": f"select l_shipdate < timestamp '1995-06-17' as old, {SITE_PATH} as path, l_orderkey as line, {SITE_COLUMN} as col, l_orderkey as end_line, {SITE_COLUMN} + 10 as end_col, case when l_linenumber % 2 = 0 then 'if_statement' else 'lambda' end as construct, 'c' || l_orderkey as code, 's' || (l_suppkey % 30) as shape, case when l_orderkey % 4 = 0 then 'p' else 'q' end || ',n' || (l_partkey % 5) as names, 'a' || (l_partkey % 4) || ',b' || (l_suppkey % 4) || ',c' || (l_linenumber % 2) || ',d' || (l_orderkey % 2) as features, case when l_orderkey % 10 = 0 then 'SPEC' || ((l_suppkey % 25) % 8) end as evaluates from {{lineitem}}",
    "import": f"select distinct true as old, {SITE_PATH} as path, 'spec' || (l_suppkey % 25) as module, 'SPEC' || ((l_suppkey % 25) % 8) as code, 'SPEC' || ((l_suppkey % 25) % 8) as name from {{lineitem}}",
    "bound": f"select distinct true as old, {SITE_PATH} as path, 'SPEC' || ((l_suppkey % 25) % 8) as name from {{lineitem}} where l_suppkey % 7 = 0",
    "declaration": "select true as old, 'domain/spec' || n_nationkey || '.py' as path, 100 as line, 1 as col, 900 as end_line, 1 as end_col, case when n_nationkey % 7 <> 0 then 'lambda' end as construct, 'SPEC' || (n_nationkey % 8) as name, 'code' || n_nationkey as code from {nation} where n_nationkey % 5 <> 0",
    "issue": f"select distinct true as old, {SITE_PATH} as path from {{lineitem}} where l_suppkey % 50 = 13 and l_partkey % 20 < 3",
}
TEMPLATE_SQL = """select 'r' || n_nationkey as rule_id, 't' || k as template_id, k as ordinal, k = 3 as review_only, case when k = 2 then 'p,n' || (n_nationkey % 5) else 'p' end as renameable, case when n_nationkey % 7 = 0 then '.' else 'app/' || (n_nationkey % 20) || ',domain' end as paths, 'domain/spec' || n_nationkey || '.py' as canonical_path, 'SPEC' || (n_nationkey % 8) as canonical_symbol, case when n_nationkey % 6 = 1 then '0' when n_nationkey % 6 = 2 then sha2('code' || n_nationkey, 256) end as canonical_digest,
's' || ((n_nationkey + 9 * k) % 30) as t_shape, 'p,n' || ((n_nationkey + k) % 5) as t_names, 'a' || (n_nationkey % 4) || ',b' || ((n_nationkey + k) % 4) || ',c' || (k % 2) || ',d1' as t_features from {nation}, (values (1), (2), (3)) v(k)"""
LISTS = ("names", "features", "renameable", "paths", "t_names", "t_features")


def reuse_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of the old and the new side (only sites differ), and templates. The other facts are few and written; sites are read where they are used."""
    frames = {n: table(spark, sf, n) for n in ("lineitem", "nation")}
    read = lambda sql: spark.sql(sql, **{n: f for n, f in frames.items() if "{" + n + "}" in sql}).withColumnsRenamed({"col": "column", "end_col": "end_column"})
    few, sites = None, None
    for fact, sql in SITE_SQL.items():
        rows = read(sql)
        rows = rows.withColumns({c: F.split(c, ",") for c in LISTS if c in rows.columns})
        rows = rows.select("old", F.lit(fact).alias("fact"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in reuse.FACT.split(", ")) if c != "fact"])
        if fact == "site":
            sites = rows
        else:
            few = rows if few is None else few.unionByName(rows)
    few, templates = cut(few, "reuse-facts").drop("old"), read(TEMPLATE_SQL)
    templates = templates.withColumns({c: F.split(c, ",") for c in LISTS if c in templates.columns})
    return sites.where("old").drop("old").unionByName(few), sites.where("not old").drop("old").unionByName(few), cut(templates, "templates")


REUSE = "with " + ",\n".join(f"g_{n} as ({x.format(lineitem='lineitem', nation='nation')})" for n, x in SITE_SQL.items()) + f""",
split as (select * replace (string_split(names, ',') as names, string_split(features, ',') as features) from g_site),
t as (select * replace (string_split(renameable, ',') as renameable, string_split(paths, ',') as paths, string_split(t_names, ',') as t_names, string_split(t_features, ',') as t_features) from ({TEMPLATE_SQL.format(nation='nation').replace("sha2('code' || n_nationkey, 256)", "sha256('code' || n_nationkey)")}) x),
rules as (select distinct rule_id, paths, canonical_path, canonical_symbol from t),
pairs as (select s.*, t.* exclude (paths), list_transform(range(1, 3), lambda i: {{'t': t_names[i], 's': names[i]}}) as twins from split s join t on list_bool_or(list_transform(t.paths, lambda p: p = '.' or path = p or starts_with(path, p || '/')))),
exact as (select *, list_distinct(list_filter(twins, lambda x: list_contains(renameable, x.t))) as free from pairs where shape = t_shape and list_bool_and(list_transform(twins, lambda x: list_contains(renameable, x.t) or x.t = x.s))),
found as (select old, path, line, col, construct, code, shape, names, rule_id, case when review_only then 2 else 1 end as rank, ordinal, template_id from exact where len(list_distinct(list_transform(free, lambda x: x.t))) = len(free) and len(list_distinct(list_transform(free, lambda x: x.s))) = len(free)
union all select old, path, line, col, construct, code, shape, names, rule_id, 3, null, null from pairs where not review_only and len(list_intersect(features, t_features)) >= 3 and 2 * len(list_intersect(features, t_features)) >= len(features) + len(t_features) - len(list_intersect(features, t_features))
union all select s.old, s.path, s.line, s.col, s.construct, s.code, s.shape, s.names, r.rule_id, 0, null, null from split s join g_import i on i.path = s.path and i.name = evaluates join rules r on 'domain/' || i.module || '.py' = canonical_path and canonical_symbol = i.code where (s.path, evaluates) not in (select path, name from g_bound)
and list_bool_or(list_transform(r.paths, lambda p: p = '.' or s.path = p or starts_with(s.path, p || '/')))),
best as (select * from (select *, row_number() over (partition by old, path, line, col, construct, rule_id order by rank, ordinal nulls first, template_id nulls first) as k from found) where k = 1),
judged as (select b.* from best b where not exists (select 1 from g_declaration d join rules r on d.path = canonical_path and d.name = canonical_symbol where r.rule_id = b.rule_id and d.path = b.path and (b.line, b.col) >= (d.line, d.col) and (b.line, b.col + 10) <= (d.end_line, d.end_col))
and path not in (select path from g_issue)),
keyed as (select *, case when rank = 1 then 'reimplementation' else 'near_match' end as kind, case rank when 1 then 'equivalent_template' when 2 then 'review_template' else 'feature_overlap' end as basis, coalesce(template_id, shape || ',' || array_to_string(names, ',')) as key from judged where rank > 0),
was as (select path, rule_id, kind, key, count(*) as n from keyed where old group by all),
now as (select k.*, row_number() over (partition by path, rule_id, kind, key order by line, col, construct) > coalesce(n, 0) as introduced from keyed k left join was using (path, rule_id, kind, key) where not old)"""


@query("rule_reuse_findings", f"""{REUSE} select path, line, col as "column", rule_id, kind, basis, template_id, introduced from now""")
def rule_reuse_findings(spark: SparkSession, sf: str) -> DataFrame:
    old, new, templates = reuse_facts(spark, sf)
    found = reuse.compared(old, new, old.unionByName(new).where("fact = 'site'").select("path").distinct(), templates)[0]
    return found.select("path", "line", "column", "rule_id", "kind", "basis", "template_id", "introduced")


@query("rule_reuse_totals", f"""{REUSE},
files as (select distinct path, path in (select path from g_issue) as bad from g_site where exists (select 1 from rules r where list_bool_or(list_transform(r.paths, lambda p: p = '.' or path = p or starts_with(path, p || '/')))))
select count(*) filter (kind = 'reimplementation') as after_reimplementations, count(*) filter (kind = 'reimplementation' and introduced) as new_reimplementations, count(*) filter (kind = 'near_match' and introduced) as new_near_matches, (select count(*) from keyed where old and kind = 'reimplementation') as before_reimplementations,
(select count(*) from judged where not old and rank = 0) as reused_specifications, (select count(*) from files) as files_checked, (select count(*) from files where bad) as incomplete_files from now""")
def rule_reuse_totals(spark: SparkSession, sf: str) -> DataFrame:
    old, new, templates = reuse_facts(spark, sf)
    return reuse.compared(old, new, old.unionByName(new).where("fact = 'site'").select("path").distinct(), templates)[1]


@query("canonical_rules", f"""{REUSE}
select distinct t.rule_id, case when d.path is null then 'no_declaration' when canonical_digest <> sha256(d.code) then 'stale_digest' when d.construct is null then 'no_plain_predicate' end as problem from t left join g_declaration d on d.path = canonical_path and d.name = canonical_symbol""")
def canonical_rules(spark: SparkSession, sf: str) -> DataFrame:
    _, new, templates = reuse_facts(spark, sf)
    return reuse.canonical_problems(templates, new)
