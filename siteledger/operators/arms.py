"""Scores of answers that came in arms and repeats: one row for each case, arm and repeat, one column for each axis.

All of them group first, so a case, an arm or a label of any size travels as one row for each task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.plans.lineage import numbered


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def usable(status: Column, ambiguous: Column, duplicate: Column) -> Column:
    """Valid, sent without doubt, and not perhaps run twice; nulls don't count as good."""
    return _yes((status == "valid") & (ambiguous == 0) & ~duplicate)


def assigned(planned: DataFrame, observed: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """key, problem of each planned or observed request; null where one answer meets one plan with the same values."""
    tagged = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"), *[F.min(c).alias(f"{name}_{c}") for c in same])
    both = tagged(planned, "planned").join(tagged(observed, "observed"), key, "full_outer")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"planned_{c}").eqNullSafe(F.col(f"observed_{c}"))
    problem = (
        F.when(F.col("n_planned").isNull(), "unexpected").when(F.col("n_planned") > 1, "planned_twice").when(F.col("n_observed").isNull(), "missing")
        .when(F.col("n_observed") > 1, "duplicate").when(differs, "assignment_differs")
    )
    return both.select(*key, problem.alias("problem"))


def _referenced(answers: DataFrame, reference: DataFrame, case: str, axes: list[str]) -> DataFrame:
    return answers.join(reference.select(case, *[F.col(a).alias(f"ref_{a}") for a in axes]), case)


def axis_matches(answers: DataFrame, reference: DataFrame, case: str, arm: str, valid: str, axes: list[str]) -> DataFrame:
    """arm, axis, matches, compared (valid answers), planned (all)."""
    rows = _referenced(answers, reference, case, axes)
    good = _yes(F.col(valid))
    per = rows.groupBy(arm).agg(F.count_if(good).alias("compared"), F.count(F.lit(1)).alias("planned"), *[F.count_if(good & (F.col(a) == F.col(f"ref_{a}"))).alias(a) for a in axes])
    return per.select(arm, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("matches")) for a in axes])), "compared", "planned")


def arm_delta(matches: DataFrame, arm: str, first: str, second: str) -> DataFrame:
    """One row: all matches of two arms, and the second less the first, which is null unless every planned answer is valid."""
    side = lambda name: F.sum(F.when(F.col(arm) == name, F.col("matches")))
    complete = F.bool_and(F.col("compared") == F.col("planned"))
    out = matches.agg(side(first).alias("first"), side(second).alias("second"), complete.alias("complete"))
    return out.withColumn("delta", F.when(F.col("complete"), F.col("second") - F.col("first")))


def pair_correctness(answers: DataFrame, reference: DataFrame, case: str, pair: str, role: str, roles: tuple[str, str], valid: str, axes: list[str], score: str) -> DataFrame:
    """pair, complete (both roles usable), an `axis`_correct for each axis, jointly_correct, delta of score (second less first role)."""
    rows = _referenced(answers, reference, case, axes).where(_yes(F.col(valid)))
    have = [F.count_if(F.col(role) == r) for r in roles]
    value = lambda r: F.max(F.when(F.col(role) == r, F.col(score)))
    out = rows.where(F.col(role).isin(*roles)).groupBy(pair).agg(
        ((have[0] == 1) & (have[1] == 1)).alias("complete"), *[F.bool_and(_yes(F.col(a) == F.col(f"ref_{a}"))).alias(f"{a}_correct") for a in axes], (value(roles[1]) - value(roles[0])).alias("delta"),
    )
    joint = F.col("complete")
    for a in axes:
        out = out.withColumn(f"{a}_correct", F.col("complete") & F.col(f"{a}_correct"))
        joint = joint & F.col(f"{a}_correct")
    return out.withColumn("jointly_correct", joint).withColumn("delta", F.when(F.col("complete"), F.col("delta")))


def _two(answers: DataFrame, key: list[str], arm: str, first: str, second: str, axes: list[str]) -> DataFrame:
    """key, first_`axis`, second_`axis` of keys that both arms have exactly once."""
    pick = lambda name, a: F.max(F.when(F.col(arm) == name, F.col(a)))
    n = lambda name: F.count_if(F.col(arm) == name)
    out = answers.groupBy(*key).agg(n(first).alias("_n1"), n(second).alias("_n2"), *[pick(s, a).alias(f"{p}_{a}") for p, s in (("first", first), ("second", second)) for a in axes])
    return out.where("_n1 = 1 and _n2 = 1").drop("_n1", "_n2")


def changed_labels(answers: DataFrame, reference: DataFrame, case: str, arm: str, first: str, second: str, axes: list[str]) -> DataFrame:
    """case, axis, change (first_only_correct, second_only_correct or changed) of labels that differ between two arms."""
    both = _referenced(_two(answers, [case], arm, first, second, axes), reference, case, axes)
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"first_{a}").alias("x"), F.col(f"second_{a}").alias("y"), F.col(f"ref_{a}").alias("r")) for a in axes]))
    kind = F.when(F.col("x").eqNullSafe(F.col("r")), "first_only_correct").when(F.col("y").eqNullSafe(F.col("r")), "second_only_correct").otherwise("changed")
    return both.select(case, each).where("x is not null and y is not null and x != y").select(case, "axis", kind.alias("change"))


def differing_axes(answers: DataFrame, case: str, arm: str, first: str, second: str, axes: list[str], inconsistent: Column) -> DataFrame:
    """case, differing (axes whose labels differ between the arms, in order), review (an answer breaks the consistency rule)."""
    marked = answers.withColumn("_odd", _yes(inconsistent).cast("int"))
    both = _two(marked, [case], arm, first, second, [*axes, "_odd"])
    differing = F.array_compact(F.array(*[F.when(~F.col(f"first_{a}").eqNullSafe(F.col(f"second_{a}")), F.lit(a)) for a in axes]))
    return both.select(case, differing.alias("differing"), (F.greatest("first__odd", "second__odd") > 0).alias("review"))


def label_histograms(answers: DataFrame, cell: list[str], axes: list[str], abstain: dict[str, str]) -> DataFrame:
    """cell, axis, label, n, decisive; the axis `joint` counts all labels together, and is decisive where every axis is."""
    sure = {a: F.col(a) != abstain[a] for a in axes}
    all_sure = reduce(and_, sure.values())
    items = [F.struct(F.lit(a).alias("axis"), F.col(a).alias("label"), sure[a].alias("decisive")) for a in axes]
    items.append(F.struct(F.lit("joint").alias("axis"), F.concat_ws("/", *axes).alias("label"), all_sure.alias("decisive")))
    long = answers.select(*cell, F.inline(F.array(*items))).where("label is not null")
    return long.groupBy(*cell, "axis", "label").agg(F.count(F.lit(1)).alias("n"), F.bool_and("decisive").alias("decisive"))


def two_rounds(answers: DataFrame, key: list[str], repeat: str, rounds: tuple, axes: list[str], abstain: dict[str, str], control: Column) -> DataFrame:
    """axis, matched, total, decisive_matched, decisive_total (both rounds decisive), control_abstentions; joint over all axes."""
    both = _two(answers, key, repeat, *rounds, axes)
    same = {a: F.col(f"first_{a}").eqNullSafe(F.col(f"second_{a}")) for a in axes}
    sure = {a: (F.col(f"first_{a}") != abstain[a]) & (F.col(f"second_{a}") != abstain[a]) for a in axes}
    away = {a: (F.col(f"first_{a}") == abstain[a]).cast("int") + (F.col(f"second_{a}") == abstain[a]).cast("int") for a in axes}
    joint = lambda d: reduce(and_, (d[a] for a in axes))
    row = lambda name, s, d, lost: F.struct(F.lit(name).alias("axis"), F.count_if(s).alias("matched"), F.count(F.lit(1)).alias("total"), F.count_if(s & d).alias("decisive_matched"), F.count_if(d).alias("decisive_total"), F.coalesce(F.sum(F.when(control, lost)), F.lit(0)).cast("bigint").alias("control_abstentions"))
    rows = [row(a, same[a], sure[a], away[a]) for a in axes]
    rows.append(row("joint", joint(same), joint(sure), sum(away.values(), F.lit(0))))
    return both.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def ablation(answers: DataFrame, reference: DataFrame, case: str, arm: str, repeat: str, label: str, baseline: str, excluded: str) -> DataFrame:
    """arm, repeat, cases, agreement, false_exclusions, errors, supported.

    supported: in every repeat the arm agrees more often than the baseline's same repeat, excludes wrongly less often, and has no errors.
    """
    rows = _referenced(answers, reference, case, [label])
    x, r = F.col(label), F.col(f"ref_{label}")
    per = rows.groupBy(arm, repeat).agg(F.count(F.lit(1)).alias("cases"), F.count_if(x == r).alias("agreement"), F.count_if((x == excluded) & (r != excluded)).alias("false_exclusions"), F.count_if(x.isNull()).alias("errors"))
    base = per.where(F.col(arm) == baseline).select(repeat, F.col("agreement").alias("_a"), F.col("cases").alias("_n"), F.col("false_exclusions").alias("_f"))
    joined = per.join(base, repeat, "left")
    better = _yes((F.col("agreement") * F.col("_n") > F.col("_a") * F.col("cases")) & (F.col("false_exclusions") < F.col("_f")) & (F.col("errors") == 0))
    whole = joined.groupBy(arm).agg(F.bool_and(better).alias("supported"))
    return per.join(whole, arm).select(arm, repeat, "cases", "agreement", "false_exclusions", "errors", F.when(F.col(arm) != baseline, F.col("supported")).alias("supported"))


def arm_usage(answers: DataFrame, reference: DataFrame, case: str, arm: str, valid: str, axes: list[str], tokens: str) -> DataFrame:
    """arm, planned, valid, matching_axes, complete_views, metered, tokens (null, not 0, if nothing is metered)."""
    rows = _referenced(answers, reference, case, axes)
    good = _yes(F.col(valid))
    hits = sum((_yes(F.col(a) == F.col(f"ref_{a}")).cast("int") for a in axes), F.lit(0))
    return rows.groupBy(arm).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(good).alias("valid"), F.coalesce(F.sum(F.when(good, hits)), F.lit(0)).cast("bigint").alias("matching_axes"), F.count_if(good & (hits == len(axes))).alias("complete_views"),
        F.count_if(good & F.col(tokens).isNotNull()).alias("metered"), F.sum(F.when(good, F.col(tokens))).cast("bigint").alias("tokens"),
    )


def repeatability(answers: DataFrame, case: str, arm: str, valid: str, axes: list[str]) -> DataFrame:
    """arm, cases, twice (observed exactly two times), same (of those, with equal labels)."""
    per = answers.where(_yes(F.col(valid))).groupBy(case, arm).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*axes)).eqNullSafe(F.max(F.struct(*axes))).alias("same"))
    return per.groupBy(arm).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if((F.col("n") == 2) & F.col("same")).alias("same"))


def option_change(answers: DataFrame, key: list[str], repeat: str, rounds: tuple, options: str) -> DataFrame:
    """One row: pairs, largest change of any option's probability between two rounds. options: a map from label to probability."""
    long = answers.where(F.col(repeat).isin(*rounds)).select(*key, repeat, F.explode(options).alias("label", "p"))
    pick = lambda r: F.max(F.when(F.col(repeat) == r, F.col("p")))
    per = long.groupBy(*key, "label").agg(pick(rounds[0]).alias("x"), pick(rounds[1]).alias("y")).where("x is not null and y is not null")
    cases = per.groupBy(*key).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("change"))
    return cases.agg(F.count(F.lit(1)).alias("pairs"), F.max("change").alias("max_change"))


def sparse_confusion(answers: DataFrame, reference: DataFrame, case: str, label: str) -> DataFrame:
    """reference, predicted, n of the pairs that occur; planned cases without an answer have a null prediction."""
    rows = reference.select(case, F.col(label).alias("reference")).join(answers.select(case, F.col(label).alias("predicted")), case, "left")
    return rows.groupBy("reference", "predicted").agg(F.count(F.lit(1)).alias("n"))


def best_variant(scores: DataFrame, name: str, recall: str, precision: str, abstention: str) -> DataFrame:
    """The one variant with the highest recall, then precision, then the lowest abstention, then name; nulls last."""
    return scores.orderBy(F.col(recall).desc_nulls_last(), F.col(precision).desc_nulls_last(), F.col(abstention).asc_nulls_last(), F.col(name).asc()).limit(1)


def anchored(cases: DataFrame, sites: DataFrame, key: list[str], case: str, category: str) -> DataFrame:
    """case, status, category: matched if exactly one site lies at the case's anchor, else missing or duplicate."""
    found = sites.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(category).alias("_category"))
    joined = cases.select(case, *key).join(found, key, "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("matched")
    return joined.select(case, status.alias("status"), F.when(F.col("_n") == 1, F.col("_category")).alias("category"))


def paired_resolutions(cases: DataFrame, case: str, arm: str, labels: dict[str, Column], truth: dict[str, Column], first: str, second: str) -> DataFrame:
    """One row over cases with both arms: net, gains, losses of resolved facts, new_unsupported owners, adjudicable cases and the mean net of these.

    labels, truth: concern_kind, evidence_confidence, ownership. A role is resolved if it is known, supported and found as such; an owner if it is
    known and found. An owner is unsupported if it is said and wrong; it is new in the second arm if the first arm had none, or another one.
    """
    role = (truth["concern_kind"] != "unknown") & (truth["evidence_confidence"] == "supported")
    rows = cases.select(
        F.col(case).alias("_case"), F.col(arm).alias("_arm"), (role & (labels["concern_kind"] == truth["concern_kind"]) & (labels["evidence_confidence"] == "supported")).cast("int").alias("_role"),
        ((truth["ownership"] != "unknown") & (labels["ownership"] == truth["ownership"])).cast("int").alias("_owner"), ((labels["ownership"] != "unknown") & (labels["ownership"] != truth["ownership"])).alias("_wrong"),
        labels["ownership"].alias("_said"), (role | (truth["ownership"] != "unknown")).alias("_usable"),
    )
    of = lambda c, a: F.max(F.when(F.col("_arm") == a, F.col(c)))
    both = rows.groupBy("_case").agg(*[of(c, a).alias(f"{c}_{k}") for k, a in ((1, first), (2, second)) for c in ("_role", "_owner", "_wrong", "_said")], F.bool_or("_usable").alias("_usable"))
    both = both.where("_role_1 is not null and _role_2 is not null")
    steps = [F.col(f"{c}_2") - F.col(f"{c}_1") for c in ("_role", "_owner")]
    new = F.col("_wrong_2") & (~F.col("_wrong_1") | (F.col("_said_1") != F.col("_said_2")))
    count = lambda test: F.coalesce(F.sum(sum((test(s).cast("long") for s in steps), F.lit(0))), F.lit(0))
    out = both.agg(count(lambda s: s).alias("net"), count(lambda s: s > 0).alias("gains"), count(lambda s: s < 0).alias("losses"), F.count_if(new).alias("new_unsupported"), F.count_if("_usable").alias("adjudicable"))
    return out.withColumn("mean_net", F.try_divide(F.col("net").cast("double"), F.col("adjudicable").cast("double")))


def counterbalanced(cases: DataFrame, case: str, order: Column, repeats: list[int], first: str, second: str) -> DataFrame:
    """case, repeat, first_arm: which arm comes first alternates along the cases' order and between repeats. order must be unique."""
    placed = numbered(cases.select(case, order.alias("_order"), F.lit(0).alias("_all")), ["_all"], ["_order"])
    each = placed.withColumn("repeat", F.explode(F.array(*map(F.lit, repeats))))
    return each.select(case, "repeat", F.when((F.col("position") - 1 + F.col("repeat")) % 2 == 1, first).otherwise(second).alias("first_arm"))


def pair_counts(rows: DataFrame, view: str, group: list[str]) -> DataFrame:
    """view, groups, pairs: unordered pairs of rows of a group, counted from the groups' sizes and never made."""
    sizes = rows.groupBy(view, *group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(view).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))
