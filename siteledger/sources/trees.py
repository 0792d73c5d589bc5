"""Source trees as DataFrames: path, language, content, and issues for what can't be read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.text import LANGUAGES, language, valid_path
from siteledger.operators.collection import set_digest
from siteledger.operators.scope import included, roles

#: By default a larger file is an issue, not a source.
MOST_BYTES = 4 << 20


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """pattern, negated, for directories only: the lines of a gitignore file, against paths relative to its folder."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders = line.endswith("/")
        line = line.rstrip("/")
        rooted = "/" in line
        rest, parts = line.removeprefix("/"), "" if rooted else "(?:.*/)?"
        if not rest:
            continue
        token = r"(?P<any>(?:^|(?<=/))\*\*/)|(?P<below>(?<=/)\*\*$)|(?P<star>\*+)|(?P<one>\?)|\[(?P<no>[!^]?)(?P<set>\]?[^\]]*)\]|\\(?P<plain>.)|(?P<char>.)"
        for m in re.finditer(token, rest):
            if m["any"]:
                parts += "(?:.*/)?"
            elif m["below"]:
                parts += ".+"
            elif m["star"]:
                parts += "[^/]*"
            elif m["one"]:
                parts += "[^/]"
            elif m["set"]:
                parts += f"(?!/)[{'^' if m['no'] else ''}{re.sub(r'([][^&~|])', r'\\\1', m['set'])}]"
            else:
                parts += re.escape(m["plain"] or m["char"])
        out.append((re.compile(parts, re.S), negated, folders))
    return out


def ignored(path: str, folder: bool, rules: list[tuple[str, list]]) -> bool | None:
    """What the last rule that matches says; rules are (folder, its rules), the strongest last. None if no rule matches."""
    for base, each in reversed(rules):
        for pattern, negated, folders in reversed(each):
            if (folder or not folders) and pattern.fullmatch(path[len(base) :]):
                return not negated
    return None


def walked(root: str) -> list[tuple[str, int]]:
    """path relative to root, bytes of the files of the languages known.

    As the reference's walk: names with a dot at the front and symbolic links are left out, and so is what `.ignore` files
    and, in a git work tree, `.gitignore` and `.git/info/exclude` say; ignore files above the root are read too. A folder that is left out is not entered.
    """
    store, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")))
    local, top = isinstance(store, fs.LocalFileSystem), top.rstrip("/")

    def rules_at(folder: str, name: str, base: str) -> list[tuple[str, list]]:
        if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            return []
        with store.open_input_stream(f"{folder}/{name}") as f:
            return [(base, ignore_rules(f.read().decode("utf-8", "replace")))]

    # paths are matched whole, so that the folders above count
    above = [top[:i] for i, c in enumerate(top) if c == "/"]
    git_at = next((d for d in reversed([*above, top]) if store.get_file_info(f"{d}/.git").type != fs.FileType.NotFound), None)
    plain = [r for d in above for r in rules_at(d, ".ignore", f"{d}/")]
    git = rules_at(git_at, ".git/info/exclude", f"{git_at}/") if git_at is not None else []
    git += [r for d in above if git_at is not None and len(d) >= len(git_at) for r in rules_at(d, ".gitignore", f"{d}/")]
    out, open_ = [], [(top, plain, git)]
    while open_:
        folder, plain, git = open_.pop()
        plain = plain + rules_at(folder, ".ignore", f"{folder}/")
        if git_at is not None:
            git = git + rules_at(folder, ".gitignore", f"{folder}/")
        for info in store.get_file_info(fs.FileSelector(folder)):
            is_folder = info.type == fs.FileType.Directory
            said = ignored(info.path, is_folder, plain)
            said = ignored(info.path, is_folder, git) if said is None else said
            # a rule that takes a name back also takes back one with a dot
            if said or (said is None and info.base_name.startswith(".")) or (local and os.path.islink(info.path)):
                continue
            if is_folder:
                open_.append((info.path, plain, git))
            elif info.type == fs.FileType.File and info.extension in LANGUAGES:
                out.append((info.path[len(top) + 1 :], info.size))
    return sorted(out)


def files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path (relative to root), language, bytes (null if over most_bytes), length of all files of the languages known.

    The driver lists paths, tasks read contents, by pyarrow.fs: local, HDFS, S3 and GCS paths.
    """
    at = root if "://" in root else os.path.abspath(root.removeprefix("file:"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = None
                if length <= most_bytes:
                    with store.open_input_stream(f"{top.rstrip('/')}/{path}") as f:
                        data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([length], pa.int64())], names=["path", "bytes", "length"])

    paths = walked(root)
    listed = spark.createDataFrame(paths, "path string, length long").repartition(max(1, min(len(paths) // 16, 10_000)))
    return listed.mapInArrow(read, "path string, bytes binary, length long").select("path", language(F.col("path")).alias("language"), "bytes", "length")


def normalised(prefixes: list[str]) -> list[str]:
    """Include prefixes with forward slashes, sorted, each once; absolute ones and `.` or `..` parts are refused."""
    out = sorted({p.strip().replace("\\", "/").rstrip("/") for p in prefixes})
    bad = [p for p in out if not p or p.startswith("/") or any(x in ("", ".", "..") for x in p.split("/"))]
    if bad:
        raise ValueError(f"not a relative path inside the root: {bad[0]!r}")
    return out


def check_includes(found: DataFrame, prefixes: list[str]) -> None:
    """Every prefix must select a file."""
    for p in prefixes:
        if included(found, [p]).isEmpty():
            raise ValueError(f"no source file at {p!r}")


def sources(found: DataFrame, includes: list[str] | None = None, manifest: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts to parse (path, language, text, digest) and issues (class, path, message). Filters act before any text is parsed."""
    rows = included(found, normalised(includes or []))
    issue = lambda df, kind, message: df.select(F.lit(kind).alias("class"), "path", message.alias("message"))
    issues = issue(rows.where("bytes is null"), "parse", F.lit("the file is too large"))
    if manifest is not None:
        placed = roles(rows, manifest)
        issues = issues.unionByName(issue(placed.where("scope_issue is not null"), "scope", F.col("scope_issue")))
        rows = placed.where("role = 'application'").drop("role", "scope_issue")
    issues = issues.unionByName(issue(rows.where(~valid_path(F.col("path"))), "scope", F.lit("not a valid path")))
    good = F.is_valid_utf8(F.col("bytes").cast("string"))
    issues = issues.unionByName(issue(rows.where(F.col("bytes").isNotNull() & ~good), "parse", F.lit("the file is not UTF-8")))
    texts = rows.where(F.col("bytes").isNotNull() & good)
    return texts.select("path", "language", F.col("bytes").cast("string").alias("text"), F.sha2("bytes", 256).alias("digest")), issues


def tree_digest(found: DataFrame) -> DataFrame:
    """One row: digest over the set of all readable files' paths and contents, whatever their order."""
    each = found.where("bytes is not null").select("path", F.sha2("bytes", 256).alias("content"))
    return set_digest(each, ["path", "content"]).select(F.concat(F.lit("sha256:"), "digest").alias("digest"))
