"""Facts of Python sources: one pass over each syntax tree, as tagged rows for joins.

Text is only parsed, never run. A file that can't be parsed gives an issue and no facts.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: names that make a class, a call or an argument part of a specification
BASES = {"Specification", "AsyncSpecification", "DecisionSpec", "AsyncDecisionSpec", "DecisionSpecification", "AutoContextSpecification"}
FACTORIES = {"PredicateSpec", "AsyncPredicateSpec", "FirstMatch", "AsyncFirstMatch"}
CONSUMERS = {"evaluate", "isinstance", "issubclass", "is_satisfied_by", "is_satisfied", "matches", "and", "or", "not", "all_of", "any_of", "compose", "register", "register_factory"}
LOOKUPS = {"getattr", "globals", "locals", "eval", "exec", "__import__", "import_module", "__subclasses__"}
REGISTRATIONS = {"register", "register_factory"}
MARKER, MARKER_VALUE = "__specmetrics_specification__", "specification/v1"
MARKER_TYPES = {f"{p}ClassVar[{q}Literal['{MARKER_VALUE}']]" for p, q in (("", ""), ("typing.", "typing."))}

FIELDS = "fact string, path string, module string, name string, target_module string, target_name string, kind string, line long, column long, end_line long, end_column long, seq long, text string, flag boolean"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
ARROW = pa.schema([(n, pa.bool_() if t == "boolean" else pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in FIELDS.split(", "))])


def module_of(path: str) -> str:
    return path.removeprefix("src/").removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def last(name: str | None) -> str:
    return (name or "").rpartition(".")[2]


class Facts:
    """Rows of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.module, self.rows, self.seq = path, module_of(path), [], 0
        self.package = self.module if path.endswith("/__init__.py") else self.module.rpartition(".")[0]
        self.lines = text.split("\n")
        self.text = text
        tree = ast.parse(text)
        self.shadowed: list[set[str]] = []
        self.walk(tree, [], False, False)
        self.binders(tree)
        self.flags(tree)

    def add(self, fact: str, node: ast.AST | None = None, **values) -> None:
        self.seq += 1
        at = {"line": node.lineno, "column": node.col_offset + 1, "end_line": node.end_lineno, "end_column": node.end_col_offset + 1} if node is not None else {}
        self.rows.append({"fact": fact, "path": self.path, "module": self.module, "seq": self.seq, **at, **values})

    def decision(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.If):
            # an elif of a chain is part of the first if
            return None if self.lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif") else "if"
        return {ast.IfExp: "conditional_expression", ast.Match: "match"}.get(type(node))

    def marker(self, node: ast.ClassDef) -> bool:
        """Whether the class has the marker, once and in full; an issue if it has it otherwise."""
        own = [s for s in node.body if isinstance(s, ast.Assign | ast.AnnAssign) and MARKER in [t.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]]
        if not own:
            return False
        s = own[0]
        good = len(own) == 1 and isinstance(s, ast.AnnAssign) and ast.unparse(s.annotation) in MARKER_TYPES and isinstance(s.value, ast.Constant) and s.value.value == MARKER_VALUE
        if not good:
            why = "it has more than one" if len(own) > 1 else "expected ClassVar[Literal[...]] with the marker's value"
            self.add("issue", s, kind="marker", text=f"marker on class {node.name!r}: {why}")
        return good

    def walk(self, node: ast.AST, parents: list[ast.AST], inside: bool, typed: bool) -> None:
        if isinstance(node, ast.ClassDef):
            bases = [dotted(b.value if isinstance(b, ast.Subscript) else b) for b in node.bases]
            native = any(last(b) in BASES for b in bases if b)
            top = len(parents) == 1
            registered = any(last(dotted(d.func if isinstance(d, ast.Call) else d)) in REGISTRATIONS for d in node.decorator_list)
            marked = self.marker(node)
            if native or marked:
                self.add("definition", node, name=node.name, kind="declaration", flag=registered)
            elif top:
                self.add("class", node, name=node.name, kind="declaration", flag=registered)
            if top:
                for b in filter(None, bases):
                    self.add("base", node, name=node.name, target_name=b)
            inside = inside or native or marked
        elif isinstance(node, ast.Call) and last(called := dotted(node.func.value if isinstance(node.func, ast.Subscript) else node.func)) in FACTORIES:
            self.add("definition", node, name=called, kind="factory", flag=False)
            inside = True
        if kind := self.decision(node):
            self.add("candidate", node, kind=kind, text=ast.get_source_segment(self.text, node), flag=inside)
        if isinstance(node, ast.comprehension):
            for test in node.ifs:
                self.add("candidate", test, kind="comprehension_filter", text="if " + (ast.get_source_segment(self.text, test) or ""), flag=inside)
        if isinstance(node, ast.match_case) and node.guard is not None:
            self.add("candidate", node.guard, kind="comprehension_filter", text="if " + (ast.get_source_segment(self.text, node.guard) or ""), flag=inside)
        if isinstance(node, ast.Import):
            for a in node.names:
                self.add("module_import", node, name=a.asname or a.name, target_module=a.name, flag=len(parents) > 1)
        elif isinstance(node, ast.ImportFrom):
            base = self.package.split(".") if self.package else []
            source = ".".join(base[: len(base) - node.level + 1] + ([node.module] if node.module else [])) if node.level else node.module or ""
            for a in node.names:
                self.add("import", node, name=a.asname or a.name, target_module=source, target_name=a.name, flag=len(parents) > 1)
        elif isinstance(node, ast.Name | ast.Attribute) and isinstance(node.ctx, ast.Load) and not typed and (name := dotted(node)):
            local = any(name.split(".")[0] in s for s in self.shadowed)
            self.add("use", node, name=name, kind=self.use_kind(node, parents), flag=local)
        scope = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda)
        if scope:
            a = node.args
            bound = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
            if not isinstance(node, ast.Lambda):
                bound |= {n.id for s in node.body for n in ast.walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del)}
            self.shadowed.append(bound)
        for field, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    self.walk(child, [*parents, node], inside, typed or field in ("annotation", "returns", "type_params"))
        if scope:
            self.shadowed.pop()

    def use_kind(self, node: ast.AST, parents: list[ast.AST]) -> str:
        """runtime, factory (a method of it is called), inherit, part (of a longer dotted name), or other."""
        p = parents[-1] if parents else None
        g = parents[-2] if len(parents) > 1 else None
        if isinstance(p, ast.ClassDef) and node in p.bases or isinstance(p, ast.Subscript) and p.value is node and isinstance(g, ast.ClassDef) and p in g.bases:
            return "inherit"
        if isinstance(p, ast.Call) and p.func is node or isinstance(p, ast.Subscript) and p.value is node and isinstance(g, ast.Call) and g.func is p:
            return "runtime"
        if isinstance(p, ast.Attribute):
            return "factory" if isinstance(g, ast.Call) and g.func is p else "part"
        if isinstance(p, ast.MatchClass) and p.cls is node or isinstance(p, ast.Dict) and node in p.values:
            return "runtime"
        call = p if isinstance(p, ast.Call) else g if isinstance(p, ast.Tuple) and isinstance(g, ast.Call) else None
        if call is not None and last(dotted(call.func)) in CONSUMERS:
            return "runtime"
        return "other"

    def binders(self, tree: ast.Module) -> None:
        """Every binding of a name in the module's own scope; flag: inside a compound statement."""

        def visit(stmts: list[ast.stmt], nested: bool) -> None:
            for s in stmts:
                if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    self.add("binder", s, name=s.name, flag=nested)
                elif isinstance(s, ast.Import | ast.ImportFrom):
                    for a in s.names:
                        self.add("binder", s, name=(a.asname or a.name).split(".")[0], flag=nested)
                else:
                    blocks = [b for f in ("body", "orelse", "finalbody") for b in [getattr(s, f, None)] if isinstance(b, list)] + [h.body for h in getattr(s, "handlers", [])] + [c.body for c in getattr(s, "cases", [])]
                    own = [n for f, v in ast.iter_fields(s) if f not in ("body", "orelse", "finalbody", "handlers", "cases") for x in (v if isinstance(v, list) else [v]) if isinstance(x, ast.AST) for n in ast.walk(x)]
                    for n in own:
                        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del):
                            self.add("binder", s, name=n.id, kind="assignment", flag=nested)
                    for b in blocks:
                        visit(b, True)

        visit(tree.body, False)

    def assigned(self, s: ast.stmt) -> None:
        """A name of the module that a statement gives a value; kind: literal, name or call (of target_name), or other."""
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AugAssign | ast.AnnAssign) else None
        if isinstance(target, ast.Name) and s.value is not None:
            v = s.value
            plain = isinstance(v, ast.JoinedStr) or isinstance(v, ast.Constant) and v.value is not Ellipsis
            source = v.id if isinstance(v, ast.Name) else last(dotted(v.func)) if isinstance(v, ast.Call) else None
            self.add("assign", s, name=target.id, kind="literal" if plain else "other" if source is None else "name" if isinstance(v, ast.Name) else "call", target_name=source)

    def flags(self, tree: ast.Module) -> None:
        dynamic = any(isinstance(n, ast.Call) and last(dotted(n.func) or getattr(n.func, "attr", "")) in LOOKUPS for n in ast.walk(tree))
        hook = any(isinstance(n, ast.FunctionDef) and n.name == "__getattr__" for s in tree.body if not isinstance(s, ast.ClassDef) for n in ([s] if isinstance(s, ast.FunctionDef) else ast.walk(s) if not isinstance(s, ast.AsyncFunctionDef) else []))
        for s in tree.body:
            self.assigned(s)
            target = s.targets[0] if isinstance(s, ast.Assign) else s.target if isinstance(s, ast.AugAssign | ast.AnnAssign) else None
            if isinstance(target, ast.Name) and target.id == "__all__":
                value = s.value
                plain = not isinstance(s, ast.AugAssign) and isinstance(value, ast.List | ast.Tuple) and all(isinstance(v, ast.Constant) and isinstance(v.value, str) for v in value.elts)
                dynamic = dynamic or not plain
                for v in getattr(value, "elts", []):
                    if isinstance(v, ast.Constant):
                        self.add("export", s, name=str(v.value))
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and dotted(s.value.func.value) == "__all__":
                dynamic = True
        self.add("file", flag=dynamic or hook)


def facts(texts: DataFrame) -> DataFrame:
    """Tagged fact rows of all Python texts (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = Facts(path, text).rows
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows = [{"fact": "issue", "path": path, "module": module_of(path), "kind": "parse", "text": f"syntax error: {type(e).__name__}", "seq": 1}]
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in NAMES} for r in rows[k : k + 5000]], schema=ARROW)

    return texts.select("path", "text").mapInArrow(run, FIELDS)
