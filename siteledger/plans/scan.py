"""From a source tree to candidates, definitions, liveness and the measure, by joins over facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions import text as T
from siteledger.operators import closure, measure, scope
from siteledger.plans.lineage import cut, numbered
from siteledger.plans.python_facts import facts
from siteledger.sources import trees, versions


@dataclass
class Scan:
    """candidates, definitions (with status and evidence), issues, one-row header."""

    candidates: DataFrame
    definitions: DataFrame
    issues: DataFrame
    digest: DataFrame


def resolved(found: DataFrame, classes: DataFrame) -> DataFrame:
    """module, name, def_module, def_name, ambiguous: names of modules that lead to a class, along imports.

    A round follows each import one step further; re-exports in a cycle end as no new name appears. A name is ambiguous if
    it is bound more than once or inside a compound statement anywhere along the way, or comes by a wildcard.
    """
    bound = found.where("fact = 'binder'").groupBy("module", "name").agg(((F.count(F.lit(1)) != 1) | F.bool_or("flag")).alias("unsure"))
    bound = cut(bound, "binders")
    start = classes.groupBy("module", "name").agg((F.count(F.lit(1)) != 1).alias("many")).join(bound, ["module", "name"], "left")
    names = start.select("module", "name", F.col("module").alias("def_module"), F.col("name").alias("def_name"), (F.col("many") | F.coalesce("unsure", F.lit(False))).alias("ambiguous"))
    edges = cut(found.where("fact = 'import'").select("module", "name", "target_module", "target_name", "flag").distinct(), "imports")
    named = edges.where("target_name != '*'").join(bound, ["module", "name"], "left").select("module", "name", "target_module", "target_name", (F.col("flag") | F.coalesce("unsure", F.lit(True))).alias("edge_unsure"))
    stars = edges.where("target_name = '*'").select("module", "target_module").distinct()
    front = all_ = cut(names, "names")
    key = ["module", "name", "def_module", "def_name"]
    while not front.isEmpty():
        back = front.select(F.col("module").alias("target_module"), F.col("name").alias("target_name"), "def_module", "def_name", "ambiguous")
        one = named.join(back, ["target_module", "target_name"]).select("module", "name", "def_module", "def_name", (F.col("ambiguous") | F.col("edge_unsure")).alias("ambiguous"))
        star = stars.join(back, "target_module").select("module", F.col("target_name").alias("name"), "def_module", "def_name", F.lit(True).alias("ambiguous"))
        step = one.unionByName(star).groupBy(*key).agg(F.bool_or("ambiguous").alias("ambiguous"))
        front = cut(step.join(all_.select(*key), key, "left_anti"), "names")
        all_ = all_.unionByName(front)
    # a name that leads to two classes is ambiguous for both
    several = all_.groupBy("module", "name").agg((F.count(F.lit(1)) > 1).alias("several"))
    return cut(all_.join(several, ["module", "name"]).select(*key, (F.col("ambiguous") | F.col("several")).alias("ambiguous")), "resolved")


def references(found: DataFrame, names: DataFrame) -> DataFrame:
    """def_module, def_name, direct, ambiguous, path, name, use kind of each reference that leads to a class."""
    uses = found.where("fact = 'use'").select("path", "module", "name", "kind", "flag", "line", "column").distinct()
    runtime = F.col("kind").isin("runtime", "factory", "inherit")
    own = uses.where(~F.col("name").contains(".")).join(names, ["module", "name"])
    out = own.select("path", "name", "kind", "line", "def_module", "def_name", (runtime & ~F.col("flag") & ~F.col("ambiguous")).alias("direct"))
    modules = found.where("fact = 'file'").select(F.col("module").alias("full")).distinct()
    sub = found.where("fact = 'import'").withColumn("full", F.concat_ws(".", "target_module", "target_name")).join(modules, "full").select("module", F.col("name").alias("alias"), F.col("full").alias("to"))
    plain = found.where("fact = 'module_import'").select("module", F.col("name").alias("alias"), F.col("target_module").alias("to"))
    aliases = plain.unionByName(sub).distinct()
    several = aliases.groupBy("module", "alias").agg(F.count(F.lit(1)).alias("n"))
    bound = found.where("fact = 'binder'").groupBy("module", F.col("name").alias("head")).agg((F.count(F.lit(1)) != 1).alias("rebound"))
    aliases = cut(aliases.join(several, ["module", "alias"]).withColumn("head", F.substring_index("alias", ".", 1)).join(bound, ["module", "head"], "left").select("module", "head", "alias", "to", ((F.col("n") > 1) | F.coalesce("rebound", F.lit(False))).alias("unsure")), "aliases")
    long = uses.where(F.col("name").contains(".")).withColumn("head", F.substring_index("name", ".", 1)).withColumn("front", F.regexp_replace("name", r"\.[^.]*$", ""))
    via = long.join(aliases, ["module", "head"]).where((F.col("front") == F.col("alias")) | F.col("front").startswith(F.concat("alias", F.lit("."))))
    via = via.withColumn("t_module", F.concat("to", F.substring(F.col("front"), F.length("alias") + 1, F.length("front")))).withColumn("t_name", F.substring_index("name", ".", -1))
    far = names.select(F.col("module").alias("t_module"), F.col("name").alias("t_name"), "def_module", "def_name", "ambiguous")
    out = out.unionByName(via.join(far, ["t_module", "t_name"]).select("path", "name", "kind", "line", "def_module", "def_name", (runtime & ~F.col("flag") & ~F.col("ambiguous") & ~F.col("unsure")).alias("direct")))
    # a module that goes somewhere as a value may be used for anything in it
    bare = uses.where(~F.col("kind").isin("part", "factory")).join(aliases.where("alias = head").select("module", F.col("alias").alias("name"), "to"), ["module", "name"])
    inside = names.select("def_module", "def_name").distinct()
    parts = F.split("def_module", r"\.")
    below = inside.withColumn("to", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    loose = bare.join(below, "to").select("path", "name", "kind", "line", "def_module", "def_name", F.lit(False).alias("direct"))
    return out.unionByName(loose)


def unresolved(definitions: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """def_module, def_name of specifications that an import without a known end may mean.

    A name that is imported from anywhere but leads to no specification may be any of that name; if its module computes
    it, also any of that module or below it; and a wildcard, even of an unknown module, may bring in all.
    """
    own = definitions.where("kind = 'declaration'").select(F.col("module").alias("def_module"), F.col("name").alias("def_name")).distinct()
    imports = found.where("fact = 'import'").select("target_module", "target_name").distinct()
    if imports.where("target_name = '*'").limit(1).count():
        return own
    files = found.where("fact = 'file'").groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    known = names.select(F.col("module").alias("target_module"), F.col("name").alias("target_name")).distinct()
    whole = files.select(F.substring_index("module", ".", -1).alias("target_name"), F.regexp_replace("module", r"\.?[^.]*$", "").alias("target_module"))
    lost = imports.join(known.unionByName(whole), ["target_module", "target_name"], "left_anti")
    same = lost.select(F.col("target_name").alias("def_name")).distinct().join(own, "def_name").select("def_module", "def_name")
    values = found.where("fact = 'assign' and kind != 'literal'").select("module", "name", F.col("target_name").alias("def_name"), F.col("module").alias("def_module"))
    values = values.join(files.where("n = 1"), "module").join(own, ["def_module", "def_name"], "left_anti").select(F.col("module").alias("target_module"), F.col("name").alias("target_name"))
    computed = lost.join(values, ["target_module", "target_name"], "left_semi").select(F.col("target_module").alias("to")).distinct()
    parts = F.split("def_module", r"\.")
    below = own.withColumn("to", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    return same.unionByName(below.join(computed, "to", "left_semi").select("def_module", "def_name")).distinct()


def statuses(definitions: DataFrame, found: DataFrame, names: DataFrame, complete: bool, closed_world: bool) -> DataFrame:
    """definitions with status and evidence, by the first rule that holds."""
    maybe = unresolved(definitions, found, names).withColumn("direct", F.lit(False))
    used = references(found, names).select("def_module", "def_name", "direct").unionByName(maybe).groupBy("def_module", "def_name").agg(F.bool_or("direct").alias("direct"), F.bool_or(~F.col("direct")).alias("unclear"))
    dynamic = bool(found.where("fact = 'file' and flag").limit(1).count())
    own = definitions.where("kind = 'declaration'").groupBy("module", "name").agg((F.count(F.lit(1)) != 1).alias("many"))
    exported = found.where("fact = 'export'").select(F.col("module").alias("e_module"), F.col("name").alias("e_name")).distinct()
    joined = definitions.join(own, ["module", "name"], "left").join(used, (F.col("module") == F.col("def_module")) & (F.col("name") == F.col("def_name")), "left")
    parent = F.regexp_replace("module", r"\.?[^.]*$", "")
    both = exported.select("e_module", "e_name", F.lit(True).alias("listed"))
    joined = joined.join(both, (F.col("name") == F.col("e_name")) & ((F.col("e_module") == F.col("module")) | (F.col("e_module") == parent)), "left").dropDuplicates(["path", "name", "kind", "line", "column"])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules: list[tuple[Column, str, str]] = [
        (F.col("kind") == "factory", "live", "a factory call makes a specification at run time"),
        (F.lit(not complete), "unknown", "the scan has issues, so uses may be missing"),
        (yes("many"), "unknown", "the name is declared more than once in its module"),
        (yes("unclear"), "unknown", "a reference may be shadowed, conditional or not a run-time use"),
        (yes("direct") | yes("flag"), "live", "a resolved constructor, base class, consumer or registration uses it"),
        (F.lit(dynamic), "unknown", "a dynamic lookup may use it"),
        (~F.col("name").startswith("_") | yes("listed"), "unknown", "it can be imported from outside"),
        (F.lit(not closed_world), "unknown", "the sources are not declared a closed world"),
    ]
    status, why = F.lit("dead"), F.lit("private, and nothing in the closed sources uses it")
    for condition, s, w in reversed(rules):
        status, why = F.when(condition, s).otherwise(status), F.when(condition, w).otherwise(why)
    return joined.select("language", "path", "module", "name", "kind", "line", "column", status.alias("status"), why.alias("evidence"))


def scan(spark: SparkSession, root: str, includes: list[str] | None = None, manifest: list[tuple[str, str]] | None = None, closed_world: bool = False) -> Scan:
    """Parse once; everything after works on the written facts."""
    tree = trees.files(spark, root)
    trees.check_includes(tree, trees.normalised(includes or []))
    return scanned(tree, includes, manifest, closed_world)


def kept_facts(texts: DataFrame, keep: str) -> tuple[DataFrame, int]:
    """The facts of texts (path, text, digest), and how many files were parsed for them.

    Facts are kept under keep, a table of versions, by path and digest of the content; only contents that it lacks are parsed. Every
    file has a row at least, so each one is known by its rows. Names are resolved anew from all facts.
    """
    key = ["path", "digest"]
    parsed = 0

    def missing(known: DataFrame | None) -> DataFrame:
        nonlocal parsed
        new = texts if known is None else texts.join(known.select(*key).distinct(), key, "left_anti")
        new = cut(new.select("path", "text", "digest"), "changed")
        parsed = new.count()
        return facts(new).join(new.select(*key), "path")

    versions.append(texts.sparkSession, keep, missing)
    known = versions.read(texts.sparkSession, keep)
    return cut((facts(texts.limit(0)) if known is None else known.join(texts.select(*key), key, "left_semi").drop("digest")), "facts"), parsed


def scanned(tree: DataFrame, includes: list[str] | None = None, manifest: list[tuple[str, str]] | None = None, closed_world: bool = False, keep: str | None = None) -> Scan:
    """The scan of files given as rows: path, language, bytes, length. With keep, facts of contents that were scanned before are read from there."""
    texts, issues = trees.sources(tree, includes, manifest)
    python = texts.where("language = 'python'")
    return derived(kept_facts(python, keep)[0] if keep else cut(facts(python), "facts"), issues, trees.tree_digest(tree), closed_world)


def derived(found: DataFrame, issues: DataFrame, digest: DataFrame, closed_world: bool = False) -> Scan:
    """The scan that follows from facts, wherever they come from; found should be written."""
    issues = cut(issues.unionByName(found.where("fact = 'issue'").select(F.col("kind").alias("class"), "path", F.col("text").alias("message"))), "issues")
    native = found.where("fact = 'definition'")
    classes = native.where("kind = 'declaration'").unionByName(found.where("fact = 'class'"))
    names = resolved(found, classes)
    # classes whose base leads to a specification are specifications too, and so on
    base = found.where("fact = 'base'").select("module", "name", F.col("target_name").alias("base"))
    direct = base.join(names.where("not ambiguous").withColumnRenamed("name", "base"), ["module", "base"]).select("module", "name", "def_module", "def_name")
    id_ = lambda m, n: F.concat_ws(":", m, n)
    seeds = native.where("kind = 'declaration'").select(id_("module", "name").alias("node"))
    reached = closure.reached(seeds, direct.select(id_("def_module", "def_name").alias("a"), id_("module", "name").alias("b")), "node", "a", "b")
    new = found.where("fact = 'class'").join(reached.where("depth > 0").select(F.col("node")), id_("module", "name") == F.col("node"), "left_semi")
    definitions = cut(native.unionByName(new).select(F.lit("python").alias("language"), "path", "module", "name", "kind", "line", "column", "flag"), "definitions")
    complete = issues.isEmpty()
    known = names.join(definitions.where("kind = 'declaration'").select(F.col("module").alias("def_module"), F.col("name").alias("def_name")).distinct(), ["def_module", "def_name"], "left_semi")
    live = cut(statuses(definitions, found, known, complete, closed_world), "liveness")
    place = F.col("line") * 1_000_000 + F.col("column")
    sites = found.where("fact = 'candidate'").select(F.lit("python").alias("language"), "path", "kind", "line", "column", "seq", T.excerpt(F.col("text")).alias("excerpt"), F.col("flag").alias("native"), place.alias("at"), T.base_key(F.lit("python"), F.col("path"), F.col("kind"), F.col("text")).alias("base"))
    sites = numbered(sites, ["base"], ["line", "column", "seq"]).withColumn("fingerprint", F.concat_ws(":", "base", "position"))
    sites = cut(sites, "sites")
    spans = new.select("path", place.alias("start"), (F.col("end_line") * 1_000_000 + F.col("end_column")).alias("stop"))
    inside = scope.contained(sites, spans, "fingerprint", "path", "at", "start", "stop")
    sites = sites.join(inside, "fingerprint").select("fingerprint", "language", "path", "kind", "line", "column", "excerpt", (F.col("native") | F.col("inside")).alias("inside_specification"))
    return Scan(sites, live, issues, digest)


def import_closure(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """module, depth: the modules of the tree that the seed modules import, whole or by name, and those that these import."""
    own = found.where("fact = 'file'").select(F.col("module").alias("b")).distinct()
    named = found.where("fact = 'import'").select("module", F.explode(F.array("target_module", F.concat_ws(".", "target_module", "target_name"))).alias("b"))
    whole = found.where("fact = 'module_import'").select("module", F.col("target_module").alias("b"))
    edges = named.unionByName(whole).join(own, "b", "left_semi").select(F.col("module").alias("a"), "b").distinct()
    return closure.reached(seeds, edges, "module", "a", "b")


def at_position(branches: DataFrame, candidates: DataFrame) -> DataFrame:
    """branches with the fingerprint of the `if` candidate at exactly their place, the first by fingerprint; null where there is none."""
    place = ["path", "line", "column"]
    first = candidates.where("kind = 'if'").groupBy(*place).agg(F.min("fingerprint").alias("fingerprint"))
    return branches.join(first, place, "left")


def ordered(result: Scan) -> tuple[DataFrame, DataFrame]:
    """Candidates and definitions in the order of reports: by language, path and place. Sort at the output only."""
    return result.candidates.orderBy("language", "path", "line", "column", "kind", "fingerprint"), result.definitions.orderBy("language", "path", "line", "column", "name", "kind")


def measured(result: Scan, registry: DataFrame | None = None) -> DataFrame:
    """The one-row measure of a scan: S, U, ratio, state, provisional, digest."""
    out = result.candidates.select("fingerprint", "inside_specification")
    excluded = registry.where("disposition = 'excluded'").select("fingerprint") if registry is not None else out.limit(0).select("fingerprint")
    parts = measure.placed(out, F.col("inside_specification"), excluded, "fingerprint")
    one = measure.report(parts, result.definitions, "status", result.issues)
    return one.withColumn("_one", F.lit(1)).join(result.digest.withColumn("_one", F.lit(1)), "_one").drop("_one")
