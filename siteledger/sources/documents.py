"""Strict readers of JSON, JSON lines, and TOML configuration."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.plans.lineage import cut, numbered

ROLES = ("application", "test", "generated", "vendored", "tooling", "excluded")


def strict_json(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """rows with value (null if refused) and problem. Duplicate keys at any level are refused, as are NaN and infinities."""
    whole = F.try_parse_json(text)
    problem = F.when(F.col(text).isNull(), "missing").when(whole.isNull(), "not strict JSON")
    value = F.from_json(text, T._parse_datatype_string(schema), {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    return rows.withColumn("problem", problem).withColumn("value", F.when(F.col("problem").isNull(), value))


def ends_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the file's last byte is a line end; an empty file counts as ended."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    n = store.getFileStatus(at).getLen()
    if not n:
        return True
    stream = store.open(at)
    try:
        stream.seek(n - 1)
        return stream.read() == 10
    finally:
        stream.close()


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """number, line, complete of a captured log: only a last line without a line end is incomplete.

    Tasks read the file in splits; numbers come from a prefix sum over them, and the driver looks at the last byte alone.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.lit(0).alias("all"))
    placed = cut(numbered(rows, ["all"], ["block", "id"]), "lines")
    n = placed.count()
    ended = F.lit(ends_a_line(spark, path))
    return placed.select((F.col("position") - 1).alias("number"), "line", (ended | (F.col("position") < n)).alias("complete"))


def manifest(text: str) -> tuple[list[tuple[str, str]], bool]:
    """Entries (prefix, role) and closed_world of a scope manifest. Unknown keys, roles and conflicts are refused."""
    data = tomllib.loads(text)
    unknown = set(data) - {"schema_version", "closed_world", "source_sets"}
    if unknown:
        raise ValueError(f"unknown key {sorted(unknown)[0]!r}")
    out: dict[str, tuple[str, str | None]] = {}
    for entry in data.get("source_sets", []):
        extra = set(entry) - {"path", "paths", "role", "reason"}
        if extra:
            raise ValueError(f"unknown key {sorted(extra)[0]!r}")
        role, reason = entry.get("role"), entry.get("reason")
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        if role == "excluded" and not (reason or "").strip():
            raise ValueError("an excluded source set needs a reason")
        for p in entry.get("paths", [entry["path"]] if "path" in entry else []):
            if out.setdefault(p, (role, reason)) != (role, reason):
                raise ValueError(f"two roles or reasons for {p!r}")
    if not any(r == "application" for r, _ in out.values()):
        raise ValueError("no application source set")
    return sorted((p, r) for p, (r, _) in out.items()), bool(data.get("closed_world", False))


REGISTRY = "id string, fingerprint string, language string, path string, kind string, disposition string, reason string, evidence struct<typed_context string, named_rules string, outcomes_tested string, trace_tested string>"


def registry(spark: SparkSession, text: str | None) -> DataFrame:
    """Reviewed sites of a registry; none if there is no file."""
    schema = REGISTRY
    sites = tomllib.loads(text).get("sites", []) if text else []
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    parts = ("typed_context", "named_rules", "outcomes_tested", "trace_tested")
    rows = [tuple(tuple(s.get("evidence", {}).get(p) for p in parts) if n == "evidence" else s.get(n, "unreviewed" if n == "disposition" else None) for n in names) for s in sites]
    return spark.createDataFrame(rows, schema)


def load_registry(spark: SparkSession, path: str, must_exist: bool = False) -> DataFrame:
    """The registry in a TOML file; none if there is no such file, unless it must exist."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        if must_exist:
            raise
        text = None
    return registry(spark, text)


def save_registry(sites: DataFrame, path: str) -> None:
    """Write a registry as TOML, sites by fingerprint. A registry is a reviewed file of the tree, so the driver writes it."""
    shown = lambda x: json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")  # noqa: E731  TOML's basic strings escape as JSON's do
    names = [f.name for f in T._parse_datatype_string(REGISTRY).fields]
    out = []
    for r in sites.select(*names).orderBy("fingerprint", "id").toLocalIterator():
        out.append("[[sites]]\n" + "".join(f"{n} = {shown(r[n])}\n" for n in names if n != "evidence" and r[n] is not None))
        if r.evidence and any(v is not None for v in r.evidence):
            out.append("[sites.evidence]\n" + "".join(f"{k} = {shown(v)}\n" for k, v in r.evidence.asDict().items() if v is not None))
    with open(path, "w", encoding="utf-8") as f:
        f.write("schema_version = 1\n\n" + "\n".join(out))


#: What comparisons need of a collected snapshot.
COLLECTION = "schema_version int, project string, contract_digest string, status string, primary struct<specification_definitions: long, remaining_opportunities: long, ratio: double, counting_rule_version: int, provisional: boolean>, supplementary map<string, struct<status: string, versions: map<string, string>, summary: map<string, double>>>"


def load_collection(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots in JSON files, one object a file; a file that doesn't read as one fails."""
    return spark.read.schema(COLLECTION).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def comparable(before: DataFrame, after: DataFrame) -> DataFrame:
    """project, problem, definitions_delta, opportunities_delta of two loaded collections; deltas are null where there is a problem."""
    pick = lambda df, p: df.select("project", *[F.col(c).alias(f"{p}_{c.rpartition('.')[2]}") for c in ("schema_version", "contract_digest", "primary.specification_definitions", "primary.remaining_opportunities")])
    both = pick(before, "b").join(pick(after, "a"), "project", "full_outer")
    problem = (
        F.when(F.col("b_schema_version").isNull() | F.col("a_schema_version").isNull(), "one_side").when((F.col("b_schema_version") != 1) | (F.col("a_schema_version") != 1), "unsupported_version")
        .when(~F.col("b_contract_digest").eqNullSafe(F.col("a_contract_digest")), "incompatible_contracts")
    )
    delta = lambda c: F.when(problem.isNull(), F.col(f"a_{c}") - F.col(f"b_{c}"))
    return both.select("project", problem.alias("problem"), delta("specification_definitions").alias("definitions_delta"), delta("remaining_opportunities").alias("opportunities_delta"))
