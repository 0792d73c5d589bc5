"""Where specification values are applied: `.is_satisfied_by(...)` in the tests of if statements, and `.decide(...)` calls.

One pass parses each text into rows of values, calls and if statements. Which value a receiver is comes from joins along the tree's
imports; a call whose receiver isn't proven to be one value, bound once and not shadowed where it stands, is unresolved.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import cut
from siteledger.plans.python_facts import dotted, facts, module_of
from siteledger.plans.scan import resolved

FACT = "fact string, path string, module string, name string, line long, column long, if_line long, if_column long, text string, projection string, consumer string, local boolean, direct boolean"
NAMES = [f.split()[0] for f in FACT.split(", ")]
SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.bool_() if t == "boolean" else pa.string()) for n, t in (f.split() for f in FACT.split(", "))])
DEFERRED = (ast.Lambda, ast.GeneratorExp, ast.ListComp, ast.SetComp, ast.DictComp)
COMPREHENSION = DEFERRED[1:]
# fixed values: what makes a value of each method's kind
MAKERS = {"is_satisfied_by": ("PredicateSpec",), "decide": ("FirstMatch", "FirstMatch.with_fallback")}


def method(node: ast.AST) -> str | None:
    return node.func.attr if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) else None


def pure(node: ast.AST) -> bool:
    """A test of nothing but applications, joined by and, or, not."""
    if method(node) == "is_satisfied_by":
        return True
    parts = node.values if isinstance(node, ast.BoolOp) else [node.operand] if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) else []
    return bool(parts) and all(map(pure, parts))


def applied(node: ast.AST) -> Iterator[ast.Call]:
    """Applications in a test; deferred bodies and the arguments of an application aren't part of it."""
    if isinstance(node, DEFERRED):
        return
    if method(node) == "is_satisfied_by":
        yield node
        return
    for child in ast.iter_child_nodes(node):
        yield from applied(child)


def bindings(scope: ast.AST) -> set[str]:
    """Names that a function or lambda binds for itself."""
    a = scope.args
    out = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
    if not isinstance(scope, ast.Lambda):
        for n in (n for s in scope.body for n in ast.walk(s)):
            out |= {n.id} if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del) else {n.name} if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else {(x.asname or x.name).split(".")[0] for x in n.names} if isinstance(n, ast.Import | ast.ImportFrom) else set()
    return out


def consumed(node: ast.Call, parents: list[ast.AST]) -> tuple[str | None, str]:
    """projection (value or matched, if one is read at once) and what takes the result."""
    projection, child, rest = None, node, list(parents)
    if rest and isinstance(rest[-1], ast.Attribute) and rest[-1].value is node and rest[-1].attr in ("value", "matched"):
        child = rest.pop()
        projection = child.attr
    parent = rest[-1] if rest else None
    if isinstance(parent, ast.Assign | ast.AnnAssign) and parent.value is child:
        return projection, "binding"
    if isinstance(parent, ast.Return):
        return projection, "return"
    if isinstance(parent, ast.keyword) or isinstance(parent, ast.Call) and child in parent.args:
        return projection, "argument"
    if isinstance(parent, ast.Expr):
        return projection, "standalone"
    if isinstance(parent, ast.If) and parent.test is child and projection == "matched":
        return projection, "boolean_guard"
    return projection, "embedded"


def rows_of(path: str, text: str) -> list[dict]:
    lines, out = text.split("\n"), []
    at = lambda n: {"line": n.lineno, "column": n.col_offset + 1}
    tree = ast.parse(text)
    for s in tree.body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Call):
            f = s.value.func.value if isinstance(s.value.func, ast.Subscript) else s.value.func
            maker = dotted(f)
            if maker in {m for ms in MAKERS.values() for m in ms}:
                out.append({"fact": "value", "name": s.targets[0].id, "text": maker, **at(s)})

    def call(node: ast.Call, shadow: list[set[str]], parents: list[ast.AST], **extra) -> dict:
        receiver = dotted(node.func.value)
        hidden = receiver is None or any(receiver.split(".")[0] in s for s in shadow) or any(isinstance(p, COMPREHENSION) for p in parents)
        return {"fact": "call", "name": receiver, "text": node.func.attr, "local": hidden, **at(node), **extra}

    def walk(node: ast.AST, parents: list[ast.AST], shadow: list[set[str]]) -> None:
        if isinstance(node, ast.If) and not lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif"):
            place = {"if_line": node.lineno, "if_column": node.col_offset + 1}
            out.append({"fact": "if", "direct": pure(node.test), **place})
            out.extend(call(c, shadow, [*parents, node], **place) for c in applied(node.test))
        if method(node) == "decide":
            projection, consumer = consumed(node, parents)
            out.append(call(node, shadow, parents, projection=projection, consumer=consumer))
        scope = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda)
        for child in ast.iter_child_nodes(node):
            body = scope and (child is node.body if isinstance(node, ast.Lambda) else child in node.body)
            walk(child, [*parents, node], [*shadow, bindings(node)] if body else shadow)

    walk(tree, [], [])
    return [{"path": path, "module": module_of(path), **r} for r in out]


def parsed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = rows_of(path, text or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows = []
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in NAMES} for r in rows], schema=SCHEMA)

    return texts.select("path", "text").mapInArrow(run, FACT)


def calls(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All calls with target_module, target_name and maker (null where unresolved), and all if statements."""
    return resolved_calls(cut(facts(texts), "facts"), cut(parsed(texts), "applications"))


def resolved_calls(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from facts of the tree and rows of values, calls and if statements, wherever they come from."""
    values = rows.where("fact = 'value'").select("module", "name", F.col("text").alias("maker"))
    # the constructor's own name must be bound once in its module, by an import
    bound = found.where("fact = 'binder'").groupBy("module", "name").agg(F.count(F.lit(1)).alias("n"))
    imported = found.where("fact = 'import'").select("module", F.col("name").alias("root"), "target_name").distinct()
    made = values.withColumn("root", F.substring_index("maker", ".", 1)).join(imported, ["module", "root"]).where("target_name = root")
    made = cut(made.join(bound.select("module", F.col("name").alias("root"), "n"), ["module", "root"]).where("n = 1").select("module", "name", "maker"), "values")
    names = resolved(found, made.select("module", "name")).where("not ambiguous").join(made.select(F.col("module").alias("def_module"), F.col("name").alias("def_name"), "maker"), ["def_module", "def_name"])
    plain = names.select("module", "name", "def_module", "def_name", "maker")
    # a receiver with a dot starts at a module's alias
    alias = found.where("fact = 'module_import'").select("module", F.col("name").alias("front"), F.col("target_module").alias("to"))
    alias = alias.groupBy("module", "front").agg(F.min("to").alias("to"), F.count_distinct("to").alias("n")).where("n = 1").drop("n")
    far = alias.join(plain.select(F.col("module").alias("to"), F.col("name").alias("last"), "def_module", "def_name", "maker"), "to").select("module", F.concat_ws(".", "front", "last").alias("name"), "def_module", "def_name", "maker")
    known = plain.unionByName(far).distinct()
    all_calls = rows.where("fact = 'call'")
    kind = F.lit(False)
    for m, makers in MAKERS.items():
        kind = kind | ((F.col("text") == m) & F.col("maker").isin(*makers))
    hit = all_calls.where("not local").join(known, ["module", "name"]).where(kind)
    key = ["path", "line", "column", "text", "if_line", "if_column", "projection", "consumer"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    one = hit.groupBy(*key).agg(F.min("def_module").alias("target_module"), F.min("def_name").alias("target_name"), F.min("maker").alias("maker"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    joined = all_calls.alias("a").join(one.alias("b"), on, "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in key], F.col("a.name").alias("receiver"), "target_module", "target_name", "maker"), rows.where("fact = 'if'")


def if_applications(texts: DataFrame) -> DataFrame:
    """path, line, column, category of each if statement: no_application, unresolved_call (if one of its calls is), direct_application, mixed_expression."""
    return if_categories(*calls(texts))


def if_categories(found: DataFrame, ifs: DataFrame) -> DataFrame:
    per = found.where("text = 'is_satisfied_by' and if_line is not null").groupBy("path", "if_line", "if_column").agg(F.bool_and(F.col("target_name").isNotNull()).alias("known"))
    joined = ifs.join(per, ["path", "if_line", "if_column"], "left")
    category = F.when(F.col("known").isNull(), "no_application").when(~F.col("known"), "unresolved_call").when(F.col("direct"), "direct_application").otherwise("mixed_expression")
    return joined.select("path", F.col("if_line").alias("line"), F.col("if_column").alias("column"), category.alias("category"))


def decide_calls(texts: DataFrame) -> DataFrame:
    """path, line, column, receiver, projection, consumer, category of each decide call."""
    return decide_categories(calls(texts)[0])


def decide_categories(found: DataFrame) -> DataFrame:
    whole = F.col("consumer").isin("binding", "return", "argument", "standalone", "boolean_guard")
    category = F.when(F.col("target_name").isNull(), "unresolved_call").when(whole, "direct_application").otherwise("mixed_expression")
    return found.where("text = 'decide'").select("path", "line", "column", "receiver", "projection", "consumer", category.alias("category"))
