"""Structural reuse of rules: decision sites of Python code against a catalogue's expression templates.

One pass parses each text once and gives rows: sites, imports, bound names, declarations. Everything after that is
joins. An expression's shape (its tree with all identifiers blanked and ordinary strings unquoted) is hashed, so exact matches
are an equi-join and a comparison of the identifiers in order; near matches meet on shared features.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteledger.operators import similarity
from siteledger.plans.lineage import cut, numbered

#: Bytes of a review request; a larger one is a diagnostic.
REQUEST_BYTES = 24 * 1024
FACT = "fact string, path string, line long, column long, end_line long, end_column long, construct string, name string, module string, code string, shape string, names array<string>, features array<string>, evaluates string"
NAMES = [f.split()[0] for f in FACT.split(", ")]
SCHEMA = pa.schema([(n, pa.int64() if "line" in n or "column" in n else pa.list_(pa.string()) if n in ("names", "features") else pa.string()) for n in NAMES])


def ordinary(raw: str) -> str | None:
    """The value of a plain quoted string; null for prefixes, escapes and triple quotes, which count as they are written."""
    if len(raw) >= 2 and raw[0] in "'\"" and raw[0] == raw[-1] and not raw.startswith(('"""', "'''")) and not set(raw[1:-1]) & {"\\", "\n", "\r"} and raw[0] not in raw[1:-1]:
        return raw[1:-1]
    return None


def described(root: ast.expr, source: str) -> dict:
    """shape, names (identifiers in order) and features (attribute names and ordinary string values) of one expression."""
    names: list[str] = []
    features: set[str] = set()

    def tree(node) -> object:
        if isinstance(node, list):
            return [tree(n) for n in node]
        if not isinstance(node, ast.AST):
            return node
        kind = type(node).__name__
        if isinstance(node, ast.Name):
            names.append(node.id)
            return "name"
        if isinstance(node, ast.arg):
            names.append(node.arg)
            return "arg"
        if isinstance(node, ast.Constant | ast.JoinedStr):
            raw = ast.get_source_segment(source, node) or repr(getattr(node, "value", ""))
            value = ordinary(raw)
            if value is None:
                return ["literal", raw]
            features.add(value)
            return ["string", value]
        if isinstance(node, ast.Attribute):
            inner = tree(node.value)
            features.add(node.attr)
            return ["attribute", inner, node.attr]
        if isinstance(node, ast.keyword) and node.arg:
            names.append(node.arg)
            return ["keyword", tree(node.value)]
        return [kind, *[tree(v) for f, v in ast.iter_fields(node) if f != "ctx"]]

    shape = json.dumps(tree(root), ensure_ascii=True, default=repr)
    return {"shape": hashlib.sha256(shape.encode()).hexdigest(), "names": names, "features": sorted(features)}


def evaluated(node: ast.expr) -> str | None:
    """X of `X.is_satisfied_by(...)`, perhaps negated."""
    while isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        node = node.operand
    f = node.func if isinstance(node, ast.Call) else None
    return f.value.id if isinstance(f, ast.Attribute) and f.attr == "is_satisfied_by" and isinstance(f.value, ast.Name) else None


def conditions(node: ast.AST, lines: list[str]) -> Iterator[tuple[str, ast.expr]]:
    # fixed values: the names of constructs
    if isinstance(node, ast.If):
        yield "elif_clause" if lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif") else "if_statement", node.test
    elif isinstance(node, ast.While):
        yield "while_statement", node.test
    elif isinstance(node, ast.Assert):
        yield "assert_statement", node.test
    elif isinstance(node, ast.Lambda):
        yield "lambda", node.body
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "require" and node.args:
        yield "call", node.args[0]


def rows_of(path: str, text: str) -> list[dict]:
    tree, lines, out = ast.parse(text), text.split("\n"), []
    place = lambda n: {"line": n.lineno, "column": n.col_offset + 1, "end_line": n.end_lineno, "end_column": n.end_col_offset + 1}
    for s in tree.body:
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else s
        name = target.id if isinstance(target, ast.Name) else getattr(target, "name", None)
        if name:
            value, extra = getattr(s, "value", None), {}
            body = value.args[0] if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id == "PredicateSpec" and value.args else None
            a = body.args if isinstance(body, ast.Lambda) else None
            if a and len(a.args) == 1 and not (a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or a.defaults):
                extra = described(body.body, text) | {"evaluates": a.args[0].arg, "construct": "predicate"}
            out.append({"fact": "declaration", "name": name, "code": ast.get_source_segment(text, s), **place(s), **extra})
        if isinstance(s, ast.ImportFrom) and not s.level:
            out += [{"fact": "import", "module": s.module or "", "code": a.name, "name": a.asname or a.name, **place(s)} for a in s.names]
    for node in ast.walk(tree):
        for construct, test in conditions(node, lines):
            out.append({"fact": "site", "construct": construct, "code": ast.get_source_segment(text, test), "evaluates": evaluated(test), **place(test), **described(test, text)})
        bound = [t.id for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)] if isinstance(node, ast.Assign | ast.AnnAssign) else [node.name] if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else [node.arg] if isinstance(node, ast.arg) else []
        out += [{"fact": "bound", "name": b} for b in bound]
    return [{"path": path, **r} for r in out]


def parsed(texts: DataFrame) -> DataFrame:
    """Fact rows of all texts (path, text); a text that can't be parsed gives one issue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = rows_of(path, text or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows = [{"fact": "issue", "path": path}]
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in NAMES} for r in rows[k : k + 5000]], schema=SCHEMA)

    return texts.select("path", "text").mapInArrow(run, FACT)


def templates_frame(spark: SparkSession, catalogue: dict) -> DataFrame:
    """A catalogue's rules and templates as rows, with shapes; ids must be unique, scopes relative and templates expressions."""
    rules = catalogue.get("rules", [])
    for what, ids in (("rule", [r["id"] for r in rules]), ("template", [(r["id"], t["id"]) for r in rules for t in r.get("templates", [])])):
        if len(ids) != len(set(ids)):
            raise ValueError(f"{what} ids are not unique")
    if bad := [p for r in rules for p in r["paths"] if p != "." and (p.startswith("/") or "\\" in p or set(p.split("/")) & {"", ".", ".."})]:
        raise ValueError(f"scopes must be relative paths: {bad}")
    rows = []
    for r in rules:
        for k, t in enumerate(r.get("templates", [])):
            source = f"({t['expression']})"
            d = described(ast.parse(source, mode="eval").body, source)
            rows.append((r["id"], t["id"], k, t["expression"], list(t.get("renameable_identifiers", [])), bool(t.get("review_only", False)), list(r["paths"]), r.get("canonical_path"), r.get("canonical_symbol"), r.get("canonical_digest"), d["shape"], d["names"], d["features"]))
    return spark.createDataFrame(rows, "rule_id string, template_id string, ordinal int, expression string, renameable array<string>, review_only boolean, paths array<string>, canonical_path string, canonical_symbol string, canonical_digest string, t_shape string, t_names array<string>, t_features array<string>")


def canonical_problems(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """rule_id, problem of each rule with a canonical declaration; null if it is there and its digest is the catalogue's."""
    own = facts.where("fact = 'declaration'").select(F.col("path").alias("canonical_path"), F.col("name").alias("canonical_symbol"), F.sha2("code", 256).alias("_digest"), F.col("construct").alias("_kind"))
    asked = rules.where("canonical_path is not null").select("rule_id", "canonical_path", "canonical_symbol", "canonical_digest").distinct()
    problem = F.when(F.col("_digest").isNull(), "no_declaration").when(F.coalesce(F.col("canonical_digest") != F.col("_digest"), F.lit(False)), "stale_digest").when(F.col("_kind").isNull(), "no_plain_predicate")
    return asked.join(own, ["canonical_path", "canonical_symbol"], "left").select("rule_id", problem.alias("problem"))


def renamed(names: Column, wanted: Column, renameable: Column) -> Column:
    """Whether the identifiers are the wanted ones in order, where renameable ones stand for others one to one."""
    pairs = F.zip_with(wanted, names, lambda t, s: F.struct(t.alias("t"), s.alias("s")))
    free = F.array_distinct(F.filter(pairs, lambda x: F.array_contains(renameable, x["t"])))
    one_to_one = (F.size(F.array_distinct(F.transform(free, lambda x: x["t"]))) == F.size(free)) & (F.size(F.array_distinct(F.transform(free, lambda x: x["s"]))) == F.size(free))
    return (F.size(names) == F.size(wanted)) & F.forall(pairs, lambda x: F.array_contains(renameable, x["t"]) | (x["t"] == x["s"])) & one_to_one


SITE = ["path", "line", "column", "construct", "code"]


#: Rows up to which a table goes to all tasks. A size in bytes is no measure, as written tables are compressed.
FEW = 20_000
#: Sites of a file with one shape up to which they are numbered in one task.
LONG = 1_000_000
BASES = ("verified_reuse", "equivalent_template", "review_template", "feature_overlap")


def beside(df: DataFrame) -> DataFrame:
    """df, written, as the right side of a join: sent to all tasks if it has few rows, else never."""
    df = cut(df, "beside")
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def catalogue(templates: DataFrame) -> DataFrame:
    """templates with numbers: _rule, and _template from 1 by rule, ordinal and id, and with scopes: a file is in one if its path and a slash start with it."""
    every = lambda *c: F.row_number().over(Window.orderBy(*c)).cast("bigint")  # noqa: E731  one row for each template
    rules = templates.select("rule_id").distinct().withColumn("_rule", every("rule_id"))
    scopes = F.transform("paths", lambda p: F.when(p == ".", "").otherwise(F.concat(p, F.lit("/"))))
    return cut(templates.join(rules, "rule_id").withColumns({"_template": every("rule_id", "ordinal", "template_id"), "scopes": scopes}), "catalogue")


def hit(rank: int | Column, template: int | Column = 0) -> Column:
    """A rule, a base's place in BASES and a template (or 0) as one number; of a site's hits on a rule the least counts."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.shiftleft("_rule", 32) + F.shiftleft(lit(rank).cast("bigint"), 30) + lit(template)


def rule_of(code: Column) -> Column:
    return F.shiftright(code, 32)


def rank_of(code: Column) -> Column:
    return F.shiftright(code, 30).bitwiseAND(F.lit(3).cast("bigint"))


def template_of(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 30) - 1).cast("bigint"))


def matched(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns of the site facts and _hits: for each rule in whose scope the site lies its hit(), if there is one.

    Bases, the first of which counts: verified_reuse (the site evaluates the rule's own specification, imported by name from
    its module and bound nowhere else in the file), equivalent_template, review_template (the first template by its place), and
    feature_overlap. Sites inside the rule's canonical declaration don't count. rules is the catalogue(), which is small, so sites
    meet it where they are read; they are neither written nor dealt anew unless there are many sets of features or imports.
    """
    sites = facts.where("fact = 'site'").withColumns({"_set": F.xxhash64("features"), "_file": F.concat("path", F.lit("/"))})
    shapes = rules.select(F.col("t_shape").alias("shape"), F.struct(hit(F.when(F.col("review_only"), 2).otherwise(1), F.col("_template")).alias("hit"), "scopes", "t_names", "renameable").alias("t"))
    shapes = shapes.groupBy("shape").agg(F.collect_list("t").alias("_same"))
    # one row for each distinct set of features of each side
    sets = sites.groupBy(F.col("_set").alias("set")).agg(F.any_value("features").alias("features"))
    wanted = rules.where("not review_only").select(F.col("_template").alias("template"), F.col("t_features").alias("features"))
    near = similarity.near_templates(cut(sets, "sets"), wanted, "set", "template", "features").join(F.broadcast(rules), F.col("template") == F.col("_template"))
    near = near.select("set", F.explode("scopes").alias("scope"), hit(3).alias("hit")).groupBy(F.col("set").alias("_set")).agg(F.collect_set(F.struct("scope", "hit")).alias("_near"))
    canonical = rules.where("canonical_path is not null").select("_rule", "scopes", "canonical_path", "canonical_symbol").distinct()
    bound = facts.where("fact = 'bound'").select("path", F.col("name").alias("evaluates")).distinct()
    imports = facts.where("fact = 'import'").select("path", "module", F.col("code").alias("canonical_symbol"), F.col("name").alias("evaluates"))
    stem = F.regexp_extract("canonical_path", r"([^/]*?)(?:\.py)?$", 1)
    known = imports.join(F.broadcast(canonical.withColumn("module", stem)), ["module", "canonical_symbol"]).join(bound, ["path", "evaluates"], "left_anti")
    known = known.select("path", "evaluates", F.explode("scopes").alias("scope"), hit(0).alias("hit")).groupBy("path", "evaluates").agg(F.collect_set(F.struct("scope", "hit")).alias("_known"))
    own = facts.where("fact = 'declaration'").select(F.col("path").alias("canonical_path"), F.col("name").alias("canonical_symbol"), F.struct("line", "column").alias("start"), F.struct("end_line", "end_column").alias("stop"))
    own = own.join(F.broadcast(canonical), ["canonical_path", "canonical_symbol"]).groupBy(F.col("canonical_path").alias("path")).agg(F.collect_list(F.struct("_rule", "start", "stop")).alias("_own"))
    met = sites.join(F.broadcast(shapes), "shape", "left").join(beside(near), "_set", "left").join(beside(known), ["path", "evaluates"], "left").join(beside(own), "path", "left")
    none = F.array().cast("array<bigint>")
    file = F.col("_file")
    same = F.filter("_same", lambda t: F.exists(t["scopes"], lambda p: file.startswith(p)) & renamed(F.col("names"), t["t_names"], t["renameable"]))
    given = [same, *[F.filter(c, lambda t: file.startswith(t["scope"])) for c in ("_near", "_known")]]
    hits = F.sort_array(F.concat(*[F.coalesce(F.transform(c, lambda t: t["hit"]), none) for c in given]))
    first = lambda best, x: F.when(rule_of(F.element_at(best, -1)) == rule_of(x), best).otherwise(F.concat(best, F.array(x)))
    # a leading 0 is of no rule
    hits = F.slice(F.aggregate(hits, F.array(F.lit(0).cast("bigint")), first), 2, 1 << 30)
    inside = lambda x: F.exists("_own", lambda d: (d["_rule"] == rule_of(x)) & (F.struct("line", "column") >= d["start"]) & (F.struct("end_line", "end_column") <= d["stop"]))
    hits = F.when(F.col("_own").isNull(), hits).otherwise(F.filter(hits, lambda x: ~inside(x)))
    # laid out from an array of one, as a filter would compute it a second time
    out = met.withColumn("_hits", F.explode(F.array(hits)))
    return out.where(F.size("_hits") > 0).drop("_same", "_near", "_known", "_own", "_set", "_file")


def named(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with rule_id, basis and template_id of their _hit."""
    ids = F.broadcast(rules.select("_rule", "rule_id").distinct())
    templates = F.broadcast(rules.select("_template", "template_id"))
    rows = rows.withColumns({"_rule": rule_of(F.col("_hit")), "_template": template_of(F.col("_hit"))}).join(ids, "_rule").join(templates, "_template", "left")
    return rows.withColumn("basis", F.element_at(F.array(*map(F.lit, BASES)), rank_of(F.col("_hit")).cast("int") + 1)).drop("_rule", "_template")


def judged(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """SITE columns, rule_id, basis and template_id, shape and names for each site and rule that matched()."""
    rules = catalogue(templates)
    rows = named(matched(facts, rules).withColumn("_hit", F.explode("_hits")), rules)
    return rows.select(*SITE, "rule_id", "basis", "template_id", "shape", "names").distinct()


def findings(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """judged() without verified reuse: SITE columns, rule_id, kind (reimplementation or near_match), basis, template_id."""
    rows = judged(facts, templates).where("basis != 'verified_reuse'")
    return rows.select(*SITE, "rule_id", F.when(F.col("basis") == "equivalent_template", "reimplementation").otherwise("near_match").alias("kind"), "basis", "template_id")


def long_cells(sites: DataFrame) -> DataFrame:
    """path and shape that more than LONG sites share."""
    return cut(sites.groupBy("path", "shape").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG).select("path", "shape"), "long-cells")


def introduced(sites: DataFrame, long: DataFrame) -> DataFrame:
    """SITE columns, old, _hit and introduced for each hit of sites (SITE, shape, names, _hits, old), equal ones once.

    Hits of one group (file, rule, base, and template or else expression) have one shape, so sites are dealt by file and shape, and their hits
    are laid out only after that. Hits of the long_cells() are numbered over all tasks.
    """
    cell, group, order = ["path", "shape"], ["path", "shape", "_hit", "_key"], ["line", "column", "construct"]
    sites = sites.select("old", *SITE, "shape", F.concat_ws(",", "names").alias("_names"), "_hits")
    key = F.when(rank_of(F.col("_hit")) == 3, F.col("_names")).otherwise("")
    each = lambda df: df.withColumn("_hit", F.explode("_hits")).withColumn("_key", key).drop("_hits", "_names")
    several = not long.isEmpty()
    # old ones come first
    w = Window.partitionBy(*group).orderBy(F.col("old").desc(), *order)
    rows = each((sites.join(long, cell, "left_anti") if several else sites).repartition(*cell))
    rows = rows.withColumn("_prior", F.lag(F.struct("old", *order)).over(w)).where(~F.col("_prior").eqNullSafe(F.struct("old", *order)))
    n = F.count_if("old").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("introduced", ~F.col("old") & (F.row_number().over(w) > 2 * n))
    out = [*SITE, "old", "_hit", "introduced"]
    if not several:
        return rows.select(*out)
    far = cut(each(sites.join(long, cell, "left_semi")).dropDuplicates(["old", *group, *order]), "long-hits")
    counts = far.where("old").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    now = numbered(far.where("not old"), group, order, "_k").join(counts, group, "left").withColumn("introduced", F.col("_k") > F.coalesce("_n", F.lit(0)))
    return rows.select(*out).unionByName(now.select(*out)).unionByName(far.where("old").withColumn("introduced", F.lit(False)).select(*out))


def check(before: DataFrame, after: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of the after side with introduced, one row of totals, and files that count as incomplete.

    before, after: path (the same on both sides, so renames are resolved already) and text of the changed files. A file that can't be parsed on
    either side is left out of all counts. A finding is introduced if it goes beyond the number of findings of one file before it with the same
    rule, kind and template (or, without a template, the same expression).
    """
    return compared(cut(parsed(before), "reuse-before"), cut(parsed(after), "reuse-after"), before.select("path").unionByName(after.select("path")).distinct(), templates)


def compared(old: DataFrame, new: DataFrame, paths: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What check() gives, from the facts of both sides and the paths of all changed files."""
    bad = old.where("fact = 'issue'").select("path").unionByName(new.where("fact = 'issue'").select("path")).distinct()
    scope = templates.select(F.explode("paths").alias("prefix")).distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    scoped = paths.withColumn("prefix", F.explode(F.concat(F.array(F.lit(".")), prefixes))).join(scope, "prefix").select("path").distinct()
    files = cut(scoped.join(bad.withColumn("bad", F.lit(True)), "path", "left"), "reuse-files")
    rules, broken = catalogue(templates), beside(bad)
    side = lambda facts, old: matched(facts.join(broken, "path", "left_anti"), rules).withColumn("old", F.lit(old))
    rows = introduced(side(old, True).unionByName(side(new, False)), long_cells(old.unionByName(new).where("fact = 'site'")))
    kind = F.when(F.col("basis") == "equivalent_template", "reimplementation").otherwise("near_match")
    found = named(rows.where(~F.col("old") & (rank_of(F.col("_hit")) > 0)), rules).select(*SITE, "rule_id", kind.alias("kind"), "basis", "template_id", "introduced")
    rank, one = rank_of(F.col("_hit")), F.lit(1).alias("_one")
    exact, near, now = rank == 1, rank > 1, ~F.col("old")
    total = rows.agg(
        F.count_if(exact & now).alias("after_reimplementations"), F.count_if(exact & F.col("introduced")).alias("new_reimplementations"), F.count_if(near & F.col("introduced")).alias("new_near_matches"),
        F.count_if(exact & F.col("old")).alias("before_reimplementations"), F.count_if((rank == 0) & now).alias("reused_specifications"), one,
    )
    total = total.join(files.agg(F.count(F.lit(1)).alias("files_checked"), F.count_if(F.col("bad")).alias("incomplete_files"), one), "_one").drop("_one")
    return found, total, files.where("bad").select("path")


def review_requests(found: DataFrame) -> DataFrame:
    """The introduced near matches as requests, with diagnostic context_too_large (and no request) for those over REQUEST_BYTES."""
    request = F.to_json(F.struct("path", "line", F.col("code").alias("predicate"), "basis", "rule_id", "template_id"))
    small = F.octet_length(request) <= REQUEST_BYTES
    return found.where("introduced and kind = 'near_match'").select(*SITE, "rule_id", F.when(small, request).alias("request"), F.when(~small, "context_too_large").alias("diagnostic"))
