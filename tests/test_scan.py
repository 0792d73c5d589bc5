"""Scans of small Python trees."""

import pytest
from pyspark.sql import functions as F

from siteledger.plans.python_facts import facts
from siteledger.plans.scan import kept_facts, measured, scan, scanned
from siteledger.sources import documents, trees

CASES = {
    "live": [
        ("a.py", "class _Ready(Specification[object]):\n    def is_satisfied_by(self, x):\n        if x:\n            return True\n", "b.py", "from a import _Ready\nprint(_Ready().is_satisfied_by(1))\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "import a as specs\nrule = specs._R.make('x')\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "from a import _R\nclass Child(_R): pass\nChild()\n"),
        ("a.py", "@register\nclass _R(Specification): pass\n", "b.py", "x = 1\n"),
        ("pkg/rules.py", "class _R(Specification): pass\n", "pkg/use.py", "from .rules import _R as Q\nisinstance(1, Q)\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "from a import _R\ntable = {'r': _R}\n"),
    ],
    "dead": [("a.py", "class _R(Specification): pass\n", "b.py", "if 1: pass\n"), ("a.py", "class _R(Specification): pass\n", "b.py", "import a\ndef f(x: a._R): pass\n"), ("pkg/a.py", "class _R(Specification): pass\n", "pkg/__init__.py", "limit = 3\n", "b.py", "from pkg import limit, a\nfrom os import path\nprint(limit)\n")],
    "unknown": [
        ("a.py", "class R(Specification): pass\n", "b.py", "x = 1\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "getattr(1, 'x')\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "from a import *\n_R()\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "try:\n    from a import _R\nexcept ImportError:\n    _R = None\n_R()\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "def broken(:\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "from elsewhere import _R\n_R()\n"),
        ("a.py", "class _R(Specification): pass\n", "b.py", "from elsewhere import *\n"),
        ("pkg/a.py", "class _R(Specification): pass\n", "pkg/__init__.py", "from os import environ\nrule = environ.get('r')\n", "b.py", "from pkg import rule\nrule()\n"),
    ],
}


def tree(tmp_path, *files):
    for name, text in zip(files[::2], files[1::2], strict=True):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


@pytest.mark.parametrize("status,files", [(s, f) for s, cases in CASES.items() for f in cases])
def test_status(spark, tmp_path, status, files):
    got = scan(spark, tree(tmp_path, *files), closed_world=True)
    assert {r.status for r in got.definitions.where(F.col("name").isin("_R", "R", "_Ready")).collect()} == {status}


def test_candidates_and_measure(spark, tmp_path):
    text = "class Ready(Specification):\n    def f(self, x):\n        return 1 if x else 2\n\n\nclass Child(Ready):\n    def g(self, x):\n        if x:\n            pass\n        elif not x:\n            pass\n\n\nif a:\n    pass\nelse:\n    if a:\n        pass\nz = [i for i in y if i]\nif a:\n    pass\n"
    got = scan(spark, tree(tmp_path, "m.py", text))
    rows = sorted((r.line, r.kind, r.inside_specification, r.fingerprint.rpartition(":")[2]) for r in got.candidates.collect())
    assert rows == [(3, "conditional_expression", True, "1"), (8, "if", True, "1"), (14, "if", False, "1"), (17, "if", False, "1"), (19, "comprehension_filter", False, "1"), (20, "if", False, "2")]
    one = measured(got).first()
    assert (one.covered, one.remaining, one.definitions, one.state) == (2, 4, 2, "ratio")
    assert one.ratio == 0.5


def test_second_scan_parses_what_changed(spark, tmp_path):
    keep = str(tmp_path / "kept")
    files = {"a.py": "class _R(Specification): pass\n", "b.py": "if 1: pass\n", "c.py": "def broken(:\n", "d.py": ""}
    texts = lambda files: spark.createDataFrame([(p, t, str(hash(t))) for p, t in files.items()], "path string, text string, digest string")
    plain = lambda found: sorted(map(str, found.select(*sorted(found.columns)).collect()))
    for change, n in (({}, 4), ({}, 0), ({"b.py": "from a import _R\n_R()\n"}, 1), ({"b.py": "if 1: pass\n"}, 0)):
        files |= change
        found, parsed = kept_facts(texts(files), keep)
        assert parsed == n and plain(found) == plain(facts(texts(files)))
    rows = [(p, "python", bytearray(t.encode()), len(t)) for p, t in files.items() if p != "c.py"]
    tree_ = spark.createDataFrame(rows, "path string, language string, bytes binary, length long")
    assert {(r.name, r.status) for r in scanned(tree_, closed_world=True, keep=keep).definitions.collect()} == {("_R", "dead")}


def test_scope_and_issues(spark, tmp_path):
    root = tree(tmp_path, "app/a.py", "x = 1\n", "tests/t.py", "y = 1\n", "other.py", "z = 1\n")
    (tmp_path / "app" / "bad.py").write_bytes(b"\xff\xfe")
    entries, closed = documents.manifest('closed_world = true\n[[source_sets]]\npath = "app"\nrole = "application"\n[[source_sets]]\npath = "tests"\nrole = "test"\n')
    assert closed and entries == [("app", "application"), ("tests", "test")]
    got = scan(spark, root, manifest=entries)
    assert sorted((r["class"], r.path) for r in got.issues.collect()) == [("parse", "app/bad.py"), ("scope", "other.py")]
    with pytest.raises(ValueError):
        trees.normalised(["../x"])
    with pytest.raises(ValueError):
        documents.manifest('[[source_sets]]\npath = "x"\nrole = "test"\n')


def test_marker(spark, tmp_path):
    good = "class A:\n    __specmetrics_specification__: ClassVar[Literal['specification/v1']] = 'specification/v1'\n"
    bad = "class B:\n    __specmetrics_specification__ = 'specification/v1'\n"
    got = scan(spark, tree(tmp_path, "a.py", good, "b.py", bad))
    assert [r.name for r in got.definitions.collect()] == ["A"]
    assert [r["class"] for r in got.issues.collect()] == ["marker"]


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1, "a": 2}'), (3, None), (4, "{")], "id int, text string")
    got = {r.id: (r.problem, r.value.a if r.value else None) for r in documents.strict_json(rows, "text", "a int").collect()}
    assert got == {1: (None, 1), 2: ("not strict JSON", None), 3: ("missing", None), 4: ("not strict JSON", None)}
    (tmp_path / "log.jsonl").write_text('{"a":1}\n{"a":2}\n{"a"')
    assert sorted((r.number, r.complete) for r in documents.json_lines(spark, str(tmp_path / "log.jsonl")).collect()) == [(0, True), (1, True), (2, False)]


def test_all_files_of_a_tree_but_ignored_ones(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/_private.py", "pkg/plain.py", "_build/y.py", "top.py", "empty.py", ".hidden/x.py", "gen/a.py", "gen/keep.py", "pkg/out/b.py", "pkg/c1.py", "deep/tmp/d.py", "other.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("" if n == "empty.py" else "x = 1\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "top.py")
    (tmp_path / ".gitignore").write_text("# made\n/gen/*\n!/gen/keep.py\n**/tmp/\nc[0-9].py\n")
    (tmp_path / "pkg/.gitignore").write_text("out/\n")
    whole = {n for n in names if n.endswith(".py") and not n.startswith(".")}
    listed = lambda: {r.path for r in trees.files(spark, str(tmp_path)).collect()}
    assert listed() == whole
    (tmp_path / ".git").mkdir()
    assert listed() == whole - {"gen/a.py", "pkg/out/b.py", "pkg/c1.py", "deep/tmp/d.py"}
    (tmp_path / ".ignore").write_text("top.py\n!c1.py\n")
    assert listed() == whole - {"gen/a.py", "pkg/out/b.py", "top.py", "deep/tmp/d.py"}
    with pytest.raises(ValueError, match="no source file"):
        scan(spark, str(tmp_path), includes=["absent"])
