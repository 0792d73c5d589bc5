"""Rules in order, validation of captured answers, and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.functions.text import unit_interval


def first_match(rules: list[tuple[str, Column]], fallback: str) -> Column:
    """The name of the first rule that holds; a null condition doesn't hold."""
    out = None
    for name, condition in rules:
        out = F.when(F.coalesce(condition, F.lit(False)), name) if out is None else out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(fallback) if out is not None else F.lit(fallback)


def findings(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def mass(probabilities: Column) -> Column:
    """Exact decimal sum of a map's probabilities."""
    zero = F.lit("0").cast("decimal(38,18)")
    return F.aggregate(F.map_values(probabilities), zero, lambda s, p: (s + p.cast("string").cast("decimal(38,18)")).cast("decimal(38,18)"))


def choice_problem(choice: Column, confidence: Column, probabilities: Column, labels: list[str], allowance: float) -> Column:
    """Why an answer is refused, by the first reason; null for a good one."""
    domain = F.array(*map(F.lit, labels))
    values = F.map_values(probabilities)
    off = F.abs(mass(probabilities) - F.lit("1").cast("decimal(38,18)")) > F.lit(str(allowance)).cast("decimal(38,18)")
    top = F.array_max(values)
    return (
        F.when(probabilities.isNull() | choice.isNull(), "missing").when(~F.array_contains(domain, choice), "unknown_choice")
        .when((F.size(F.array_except(F.map_keys(probabilities), domain)) > 0) | (F.size(F.map_keys(probabilities)) != len(labels)), "wrong_labels")
        .when(~F.forall(values, unit_interval), "not_a_probability").when(off, "wrong_mass")
        .when(~unit_interval(confidence), "wrong_confidence").when(F.try_element_at(probabilities, choice) < top, "not_the_best")
    )


def strict_majority(choice: Column, probabilities: Column) -> Column:
    """Whether the chosen label has more than all others together, in exact decimals."""
    mine = F.try_element_at(probabilities, choice).cast("string").cast("decimal(38,18)")
    return mine > (mass(probabilities) - mine)


def suggestion(choice: Column, confidence: Column, labels: list[str], threshold: float, fallback: str) -> Column:
    """The choice, if it is one of the labels with enough confidence; else the fallback."""
    good = choice.isin(*labels) & unit_interval(confidence) & (confidence >= threshold)
    return F.when(F.coalesce(good, F.lit(False)), choice).otherwise(fallback)


OWNED = ("existing_specification", "simple_composition")


def conflicting(ownership: Column, tool: Column, intent: Column, conflicts: Column | None = None) -> Column:
    """Whether facts contradict each other: said so, marked so, or a rule that both a specification and a tool own."""
    marked = (ownership == "conflicting") | (tool == "conflicting") | (intent == "conflicting")
    both = ownership.isin(*OWNED) & (tool == "yes")
    said = F.coalesce(conflicts, F.lit(False)) if conflicts is not None else F.lit(False)
    return said | F.coalesce(marked, F.lit(False)) | F.coalesce(both, F.lit(False))


def recommendation(role: Column, support: Column, ownership: Column, tool: Column, intent: Column, conflicts: Column | None = None) -> Column:
    """action, basis, status and unresolved: the first rule that holds decides.

    Where an owner was found, reuse is final; every other action stays provisional until no fact is open.
    """
    # fixed values: the rules' order, and the names of actions, bases and open facts
    conflict, sure = conflicting(ownership, tool, intent, conflicts), F.coalesce(support == "supported", F.lit(False))
    rules = [
        ("none/conflicting_facts", conflict), ("reuse_specification/existing_specification", ownership.isin(*OWNED)), ("use_tool_rules/tool_responsibility", tool == "yes"),
        ("formalize/domain_contract", sure & role.isin("policy", "variant_behavior")), ("keep_procedural/mechanics", (role == "mechanics") & sure), ("formalize/formalization_preference", ~sure & (intent == "completed")),
    ]
    chosen = first_match(rules, "none/missing_facts")
    action = F.nullif(F.substring_index(chosen, "/", 1), F.lit("none"))
    open_ = findings([
        ("role_not_established", ~sure), ("same_decision_ownership_not_checked", ownership == "unknown"),
        ("tool_responsibility_not_checked", tool == "unknown"), ("bounded_intent_lookup_not_completed", intent == "not_done"), ("conflicting_facts", conflict),
    ])
    status = F.when(action.isNull(), "needs_review").when((action == "reuse_specification") | (F.size(open_) == 0), "recommended_in_scope").otherwise("provisional")
    return F.struct(action.alias("action"), F.substring_index(chosen, "/", -1).alias("basis"), status.alias("status"), open_.alias("unresolved"))


def routed(operational: list[tuple[str, Column]], semantic: list[tuple[str, Column]]) -> Column:
    """findings (all observations that hold), route and status: an operational one stops, a semantic one asks for review."""
    found, stops, asks = findings([*operational, *semantic]), findings(operational), findings(semantic)
    route = first_match([("stop_incomplete", F.size(stops) > 0), ("ordinary_review", F.size(asks) > 0)], "retain_proposal")
    status = F.when(route == "stop_incomplete", "analysis_incomplete").when(route == "ordinary_review", "needs_review").otherwise("proposed_not_accepted")
    return F.struct(found.alias("findings"), route.alias("route"), status.alias("status"))


def ownership_transition(facts: dict[str, Column]) -> Column:
    """accepted value (null if review is needed) and status; a blocked transition accepts nothing, and null facts don't hold.

    facts: conflict, owned (ownership is known already), tool, source_proof, same_decision, and what is known of the search and the review of its finds.
    """
    f = {k: F.coalesce(c, F.lit(False)) for k, c in facts.items()}
    blocked = f["conflict"] | f["owned"] | (f["tool"] & (f["source_proof"] | f["same_decision"]))
    reviewed = f["search_approved"] & f["review_approved"] & f["review_complete"] & ~f["review_limitations"] & ~f["comparison_conflict"]
    verified = f["source_proof"] | (reviewed & ~f["search_failed"] & f["same_decision"])
    absent = reviewed & f["search_complete"] & f["inventory_complete"] & ~f["search_limitations"] & f["comparisons_complete"] & f["catalogue_closed"] & ~f["ranked"] & f["all_different"]
    value = F.nullif(first_match([("none", blocked), ("existing_specification", verified), ("absent_in_scope", absent)], "none"), F.lit("none"))
    return F.struct(value.alias("accepted"), F.when(value.isNull(), "needs_review").otherwise("accepted").alias("status"))


def fact_violations(role: Column, support: Column, ownership: Column, tool: Column) -> Column:
    """Names of the rules of consistency that a tuple of facts breaks."""
    return findings([
        ("role_support", (role == "unknown") != (support == "insufficient")),
        ("responsibilities", ownership.isin(*OWNED) & (tool == "yes")),
    ])


def cited(code: Column, first_line: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether quote is exactly lines start to end of code, line ends kept; first_line is the number of code's first line."""
    lines = F.split(code, "(?<=\n)")
    n = F.size(F.filter(lines, lambda x: x != ""))
    inside = (start >= first_line) & (start <= end) & (end < first_line + n)
    span = F.array_join(F.slice(lines, F.greatest(start - first_line, F.lit(0)) + 1, F.greatest(end - start, F.lit(0)) + 1), "")
    return F.coalesce(inside & (F.trim(F.regexp_replace(quote, r"\s+", " ")) != "") & (quote == span), F.lit(False))


def cascade(majority: Column, uncertain: Column, reviewed: Column) -> Column:
    """The label that stands: the review's where the answer was uncertain and reviewed, else the answer's; and what is left to do."""
    ask = F.coalesce(uncertain, F.lit(True))
    return F.struct(F.when(~ask, majority).otherwise(reviewed).alias("label"), F.when(~ask, "not_needed").when(reviewed.isNull(), "not_run").otherwise("completed").alias("review_status"))


def limits(checks: list[tuple[str, Column]]) -> Column:
    """Names of the limits that a packet or profile breaks; a null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks]))


def packet_problems(questions: Column, state: Column, most_questions: int = 16, criteria: tuple[int, int] = (2, 32), most_bytes: int = 65_536) -> Column:
    """questions: a map from question to its criteria; state: the packet's text."""
    sizes = F.transform(F.map_values(questions), lambda c: F.size(c))
    return limits([
        ("questions", F.size(questions).between(1, most_questions)), ("criteria", F.forall(sizes, lambda n: n.between(*criteria))),
        ("empty_criterion", F.forall(F.flatten(F.map_values(questions)), lambda c: F.trim(c) != "")), ("bytes", F.octet_length(state) <= most_bytes),
    ])


def profile_problems(lists: dict[str, Column], most_items: int = 4, most_bytes: int = 4096) -> Column:
    """lists: name to array of ids; every list is short, has no empty or repeated id, and all together are small."""
    checks = [(f"{n}_items", F.size(c) <= most_items) for n, c in lists.items()]
    checks += [(f"{n}_ids", F.forall(c, lambda x: F.trim(x) != "") & (F.size(F.array_distinct(c)) == F.size(c))) for n, c in lists.items()]
    return limits([*checks, ("bytes", F.octet_length(F.to_json(F.struct(*[c.alias(n) for n, c in lists.items()]))) <= most_bytes)])


#: Actions that rest on an owner, and what a claim must say to bear each action out (relation, axis, value; null: any or the answer's own).
OWNER_ACTIONS = ("reuse_specification", "exclude_owned")


def review_observations(answered: Column, missing: Column, labels: dict[str, Column], action: Column, required: Column, claims: Column) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """The eight observations for routed(): what stops (first list) and what asks for review.

    labels: concern_kind, evidence_confidence, ownership, tool_responsibility; null where there is no answer, and then nothing is said of
    them. required: names of axes that must be known; claims: checked ones, an array of structs of axis, relation and value.
    """
    # fixed values: the names of observations, axes, actions and relations
    there = labels["concern_kind"].isNotNull()
    role, support, owner, tool = (labels[k] for k in ("concern_kind", "evidence_confidence", "ownership", "tool_responsibility"))
    needs = F.concat(F.array(F.lit("concern_kind")), F.coalesce(required, F.array().cast("array<string>")), F.when(action.isin(*OWNER_ACTIONS), F.array(F.lit("ownership"))).when(action == "delegate_tool", F.array(F.lit("tool_responsibility"))).otherwise(F.array().cast("array<string>")))
    unknown = F.array_compact(F.array(*[F.when(c == "unknown", F.lit(k)) for k, c in labels.items()]))
    said = lambda test: F.exists(F.coalesce(claims, F.array().cast("array<struct<axis:string,relation:string,value:string>>")), test)
    borne = (
        F.when(action.isin(*OWNER_ACTIONS), said(lambda c: (c["axis"] == "ownership") & (c["relation"] == "exact_decision") & (c["value"] == owner)))
        .when(action == "delegate_tool", said(lambda c: (c["axis"] == "tool_responsibility") & (c["relation"] == "tool_rule")))
        .when(action == "create_specification", said(lambda c: (c["axis"] == "ownership") & (c["relation"] == "scoped_absence") & (c["value"] == "absent_in_scope"))).otherwise(F.lit(True))
    )
    apart = said(lambda a: said(lambda b: (a["axis"] == b["axis"]) & (a["value"] != b["value"])))
    against = said(lambda c: F.exists(F.array(*[F.struct(F.lit(k).alias("axis"), v.alias("value")) for k, v in labels.items()]), lambda x: (x["axis"] == c["axis"]) & (x["value"] != "unknown") & (x["value"] != c["value"])))
    clashing = F.size(fact_violations(role, support, owner, tool)) > 0
    when = lambda c: there & F.coalesce(c, F.lit(False))
    return [("analysis_unavailable", ~F.coalesce(answered, F.lit(False)) | ~there)], [
        ("missing_premises", F.coalesce(missing, F.lit(False))), ("inconsistent_answers", when(clashing)), ("unresolved_role", when(role == "unknown")), ("insufficient_evidence", when(support != "supported")),
        ("required_axis_unknown", when(F.size(F.array_intersect(needs, unknown)) > 0)), ("required_evidence_missing", when(~borne)), ("evidence_conflict", when(against) | F.coalesce(apart, F.lit(False))),
    ]


def reuse_answer(choice: Column, confidence: Column, probabilities: Column, labels: list[str], model: Column, allowance: str = "0.02") -> Column:
    """choice and diagnostic of an answer on reuse: all labels and no others, each with a probability, which add up to 1 within less than the
    allowance, and a model's name of 1 to 128 characters; else needs_review and malformed_provider_output. The choice needn't be the most probable."""
    dec = "decimal(38,18)"
    near = F.abs(mass(probabilities) - F.lit("1").cast(dec)) < F.lit(allowance).cast(dec)
    whole = (F.size(F.map_keys(probabilities)) == len(labels)) & (F.size(F.array_except(F.array(*map(F.lit, labels)), F.map_keys(probabilities))) == 0)
    good = choice.isin(*labels) & F.length(model).between(1, 128) & unit_interval(confidence) & whole & F.forall(F.map_values(probabilities), unit_interval) & near
    good = F.coalesce(good, F.lit(False))
    return F.struct(F.when(good, choice).otherwise("needs_review").alias("choice"), F.when(~good, "malformed_provider_output").alias("diagnostic"))


def suggested(answers: dict[str, tuple[Column, Column, Column, list[str], str]], threshold: float) -> Column:
    """A value for each axis, and diagnostics. answers: axis to choice, confidence, probabilities, labels and fallback.

    One malformed answer (a choice that is no label or has no probability, none at all, or a number outside 0 to 1) makes all axes fall back; one
    under the threshold only its own. Sums and the most probable label aren't looked at.
    """
    whole, low = F.lit(True), {}
    for axis, (choice, confidence, probabilities, labels, _) in answers.items():
        good = choice.isin(*labels) & unit_interval(confidence) & (F.size(probabilities) > 0) & F.forall(F.map_values(probabilities), unit_interval) & F.array_contains(F.map_keys(probabilities), choice)
        whole, low[axis] = whole & F.coalesce(good, F.lit(False)), F.coalesce(confidence < threshold, F.lit(False))
    under = F.exists(F.array(*low.values()), lambda x: x)
    values = [F.when(~whole | low[axis], a[4]).otherwise(a[0]).alias(axis) for axis, a in answers.items()]
    return F.struct(*values, findings([("malformed_provider_output", ~whole), ("close_decision", under)]).alias("diagnostics"))
