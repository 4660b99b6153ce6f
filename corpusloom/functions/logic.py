"""Three-valued condition evaluation, label reconciliation, modality, verdicts, rewards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SATISFIED, NOT_SATISFIED, UNKNOWN, INVALID = "SATISFIED", "NOT_SATISFIED", "UNKNOWN", "INVALID"

# Operators by kind, and their other names.
NUMERIC = ("eq", "ne", "gt", "gte", "lt", "lte", "between_inclusive", "between_exclusive")
STRING = ("equals", "not_equals", "in", "not_in")
BOOLEAN = ("is_true", "is_false")
EXISTENCE = ("exists", "not_exists")
ALIASES = {"이상": "gte", "이하": "lte", "초과": "gt", "미만": "lt", "동일": "eq", "같다": "eq", "같지 않다": "ne"}
# Words that leave a condition to judgement.
QUALITATIVE = ("인정하는 경우", "충분한", "가능한 한", "적절한", "필요하다고 판단", "동등한 수준", "통상적인", "현저한", "만족스럽", "특별히 고려")
# Units by dimension, each with its factor to the base unit.
UNITS = {
    "length": {"mm": 0.001, "cm": 0.01, "m": 1.0},
    "mass": {"kg": 1.0, "t": 1000.0},
    "time": {"sec": 1.0, "s": 1.0, "min": 60.0, "hour": 3600.0, "h": 3600.0},
    "angle": {"degree": 1.0, "deg": 1.0, "도": 1.0},
    "ratio": {"percent": 0.01, "%": 0.01, "decimal": 1.0},
    "power": {"w": 1.0, "kw": 1000.0, "mw": 1000000.0},
    "gross_tonnage": {"gt": 1.0, "톤": 1.0, "ton": 1.0},
    "deadweight": {"dwt": 1.0},
    "speed": {"kn": 1.0, "knot": 1.0},
    "pressure": {"mpa": 1.0},
    "temperature": {"°c": 1.0, "℃": 1.0},
    "count": {"조": 1.0, "개": 1.0, "기": 1.0, "척": 1.0},
}
# Words for true and false.
BOOLEAN_WORDS = {"true": True, "false": False, "yes": True, "no": False, "예": True, "아니오": False}
# Expressions of each modality, in the order in which they take their part of a sentence.
MODALITIES = (
    ("prohibition", r"하여서는\s*아니\s*된다|사용하지\s*아니하여야|금지한다|허용되지\s*않는다|사용하여서는\s*아니"),
    ("exemption", r"그러하지\s*아니하다|적용하지\s*아니한다|면제할\s*수\s*있다|생략할\s*수\s*있다"),
    ("recommendation", r"권고한다|바람직하다|가능한\s*한"),
    ("permission", r"(?:할|사용할|허용할|간주할|인정할)\s*수\s*있다"),
    ("mandatory", r"하여야\s*(?:한다|하며|하고)|비치하여야|설치하여야|이어야\s*한다|따라야\s*한다"),
    ("applicability", r"에\s*적용한다|적용\s*대상은|다음\s*선박에\s*적용|적용범위"),
    ("definition", r"라\s*함은|을\s*말한다|를\s*말한다|다음과\s*같이\s*정의"),
    ("procedure", r"검사를\s*받아야|승인을\s*받아야|제출하여야|신청하여야"),
)
NORMATIVE = ("mandatory", "prohibition", "permission", "recommendation")


def _map(values: dict) -> Column:
    flat = []
    for k, v in values.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def unit_form(unit: Column) -> Column:
    return F.nullif(F.lower(F.trim(unit)), F.lit(""))


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """value in the target unit; null between dimensions or for unknown units, unchanged for equal ones."""
    factor = _map({u: f for units in UNITS.values() for u, f in units.items()})
    dimension = _map({u: d for d, units in UNITS.items() for u in units})
    s, t = unit_form(source), unit_form(target)
    same = F.try_element_at(dimension, s) == F.try_element_at(dimension, t)
    return F.when(s.eqNullSafe(t), value).when(same, value * F.try_element_at(factor, s) / F.try_element_at(factor, t))


def as_number(text: Column) -> Column:
    """A plain number, thousands separators allowed; null for anything else."""
    return F.expr("null").cast("double") if text is None else F.when(F.trim(text).rlike(r"^[-+]?[\d,]*\.?\d+([eE][-+]?\d+)?$"), F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double"))


def number_with_unit(text: Column) -> tuple[Column, Column]:
    """(number, unit) of texts such as '10,000 kW': one unit of six characters at most after the number."""
    pattern = r"^\s*([-+]?[\d,]+(?:\.\d+)?)\s*([^\s\d,]{0,6})\s*$"
    number = F.replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    return number, F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))


def number_in(text: Column, unit: Column) -> Column:
    """The number of a text in a unit: plain, or converted from the unit it names."""
    number, own = number_with_unit(text)
    return F.coalesce(as_number(text), F.when(own.isNull() | unit_form(unit).isNull(), number).otherwise(convert_unit(number, own, unit)))


def scalar_form(text: Column) -> Column:
    """'b:true', 'n:12.0' or 's:snake_case': values compare only within their kind."""
    low = F.lower(F.trim(text))
    word = F.try_element_at(_map({k: str(v).lower() for k, v in BOOLEAN_WORDS.items()}), low)
    number = as_number(text)
    return F.when(text.isNull(), F.lit(None)).when(word.isNotNull(), F.concat(F.lit("b:"), word)).when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat(F.lit("s:"), F.regexp_replace(low, r"\s+", "_")))


def evaluate_condition(field: Column, operator: Column, expected: Column, unit: Column, actual: Column, actual_unit: Column, known: Column, evidence: Column | None = None) -> Column:
    """SATISFIED, NOT_SATISFIED, UNKNOWN or INVALID for one condition and one fact.

    expected: array of strings (one value, the two bounds of a range, or the list of 'in'); known: whether the
    fact is there at all. Order: structure, judgement words, operator, existence, missing value, comparison.
    """
    op = F.coalesce(F.try_element_at(_map(ALIASES), F.trim(operator)), F.trim(operator))
    blob = F.concat_ws(" ", field, F.array_join(expected, " "), evidence if evidence is not None else F.lit(""))
    qualitative = F.lit(False)
    for word in QUALITATIVE:
        qualitative = qualitative | F.contains(blob, F.lit(word))
    said = lambda ok: F.when(ok.isNull(), UNKNOWN).when(ok, SATISFIED).otherwise(NOT_SATISFIED)
    # Units: where one side names none, the value is taken as it is.
    plain = number_in(actual, unit)
    converted = F.when(unit_form(unit).isNull() | unit_form(actual_unit).isNull(), plain).otherwise(convert_unit(plain, actual_unit, unit))
    numeric = op.isin(*NUMERIC)
    parts = F.struct(
        F.when(numeric, converted).alias("value"), F.when(numeric, number_in(F.get(expected, F.lit(0)), unit)).alias("low"), F.when(numeric, number_in(F.get(expected, F.lit(1)), unit)).alias("high"),
        F.when(~numeric, scalar_form(actual)).alias("form"), F.when(~numeric, F.transform(expected, scalar_form)).alias("wanted"), op.alias("op"),
    )

    def decide(p: Column) -> Column:
        value, low, high, form, wanted, op = (p[c] for c in ("value", "low", "high", "form", "wanted", "op"))
        compared = F.when(op == "eq", value == low).when(op == "ne", value != low).when(op == "gt", value > low).when(op == "gte", value >= low).when(op == "lt", value < low).when(op == "lte", value <= low)
        between = F.when(op == "between_inclusive", (value >= low) & (value <= high)).when(op == "between_exclusive", (value > low) & (value < high))
        one = F.get(wanted, F.lit(0))
        equal = F.when(F.left(form, F.lit(2)) == F.left(one, F.lit(2)), F.when(op == "equals", form == one).otherwise(form != one))
        listed = F.when(op == "in", F.array_contains(wanted, form)).otherwise(~F.array_contains(wanted, form))
        truth = F.when(F.startswith(form, F.lit("b:")), F.when(op == "is_true", form == "b:true").otherwise(form == "b:false"))
        return (
            F.when(op.isin("between_inclusive", "between_exclusive"), F.when(F.size(expected) != 2, INVALID).otherwise(said(between)))
            .when(op.isin(*NUMERIC), F.when(low.isNull(), INVALID).otherwise(said(compared)))
            .when(op.isin(*BOOLEAN), said(truth)).when(op.isin("in", "not_in"), F.when(expected.isNull(), INVALID).otherwise(said(listed))).otherwise(said(equal))
        )

    # The parts are bound once, by a list of one, and read often.
    decided = F.get(F.transform(F.array(parts), decide), F.lit(0))
    return (
        F.when(F.coalesce(F.trim(field), F.lit("")) == "", INVALID).when(F.coalesce(op, F.lit("")) == "", UNKNOWN).when(qualitative, UNKNOWN)
        .when(~op.isin(*NUMERIC, *STRING, *BOOLEAN, *EXISTENCE), UNKNOWN)
        .when(op == "exists", F.when(known, SATISFIED).otherwise(NOT_SATISFIED)).when(op == "not_exists", F.when(known, NOT_SATISFIED).otherwise(SATISFIED))
        .when(~known | (F.coalesce(F.trim(actual), F.lit("")) == ""), UNKNOWN).otherwise(decided)
    )


def combine(statuses: Column, logic: Column) -> Column:
    """AND or ALL, OR or ANY over an array of statuses; INVALID counts as UNKNOWN, no statuses are UNKNOWN."""
    has = lambda s: F.exists(statuses, lambda x: x == s)
    open_ = has(UNKNOWN) | has(INVALID)
    return (
        F.when(F.size(statuses) == 0, UNKNOWN)
        .when(F.upper(logic).isin("AND", "ALL"), F.when(has(NOT_SATISFIED), NOT_SATISFIED).when(open_, UNKNOWN).otherwise(SATISFIED))
        .when(F.upper(logic).isin("OR", "ANY"), F.when(has(SATISFIED), SATISFIED).when(open_, UNKNOWN).otherwise(NOT_SATISFIED))
        .otherwise(UNKNOWN)
    )


def rule_label(applicability: Column, requirement: Column, exception: Column) -> Column:
    """One label from the statuses of a rule's three condition groups (null: the rule has no such group)."""
    return (
        F.when(exception == SATISFIED, "EXCEPTION_APPLIES")
        .when(applicability == NOT_SATISFIED, "NOT_APPLICABLE")
        .when(F.coalesce(applicability, F.lit(SATISFIED)).isin(UNKNOWN, INVALID) | F.coalesce(exception, F.lit(NOT_SATISFIED)).isin(UNKNOWN, INVALID) | requirement.isin(UNKNOWN, INVALID), "INSUFFICIENT_INFORMATION")
        .when(requirement == NOT_SATISFIED, "NON_COMPLIANT").when(requirement == SATISFIED, "COMPLIANT").otherwise("APPLICABLE")
    )


def compare_labels(generation: Column, verifier: Column, program: Column) -> Column:
    """(agreement, action) of three labels; without a program label the existing policy stays."""
    g, v = F.coalesce(generation, F.lit("UNKNOWN")), F.coalesce(verifier, F.lit("UNKNOWN"))
    p = F.coalesce(F.nullif(program, F.lit("NOT_ASSESSED")), F.lit("UNKNOWN"))
    pair = lambda a, b: F.struct(F.lit(a).alias("agreement"), F.lit(b).alias("action"))
    return (
        F.when(p == "UNKNOWN", pair("PROGRAM_UNEVALUABLE", "KEEP_EXISTING_POLICY"))
        .when((g == v) & (v == p), pair("THREE_WAY_MATCH", "ACCEPT"))
        .when(v == p, pair("GENERATOR_DISAGREES", "REJECT"))
        .when(g == p, pair("VERIFIER_DISAGREES", "REVERIFY"))
        .when(g == v, pair("PROGRAM_DISAGREES", "INSPECT_EVALUATOR"))
        .otherwise(pair("ALL_DISAGREE", "EXPERT_REVIEW_HIGH"))
    )


def training_decision(verdict: Column, agreement: Column, verifier: Column, program: Column, policy: str) -> Column:
    """(include, reason) under the policy strict, verifier-preferred or report-only."""
    out = lambda keep, why: F.struct(F.lit(keep).alias("include"), why.alias("reason") if isinstance(why, Column) else F.lit(why).alias("reason"))
    strict = policy == "strict"
    held = lambda name: out(not strict, name if strict else f"{name}_non_strict")
    rows = F.when(verdict == "REJECT", out(False, "verifier_rejected")).when(agreement == "VERIFIER_PENDING", held("verifier_pending")).when(agreement == "SEMANTIC_AXIS_MISMATCH", held("semantic_axis_mismatch"))
    for name in ("VERIFIER_ABSTENTION_CONFLICT", "FACT_REALIZATION_OR_EXTRACTION_CONFLICT"):
        rows = rows.when(agreement == name, held(name.lower()))
    rows = rows.when(agreement.isNull() | (agreement == "PROGRAM_UNEVALUABLE"), out(True, "program_unevaluable_keep_existing"))
    if policy == "report-only":
        return rows.otherwise(out(True, "report_only"))
    rows = rows.when(agreement == "GENERATOR_DISAGREES", out(False, "generator_label_mismatch"))
    if strict:
        rows = rows.when(~verifier.eqNullSafe(program), out(False, "program_verifier_label_mismatch"))
    return rows.when(agreement == "ALL_DISAGREE", out(False, "all_labels_disagree")).otherwise(out(True, "accepted"))


def modality_hits(text: Column) -> Column:
    """The modalities whose expressions a sentence shows. Each takes its first match away, so that later ones don't
    see it again."""
    rest, found = F.coalesce(text, F.lit("")), []
    for name, pattern in MODALITIES:
        found.append(F.when(rest.rlike(pattern), name))
        rest = F.regexp_replace(rest, rf"(?s)^(.*?)(?:{pattern})", "$1 ")
    return F.array_compact(F.array(*found))


def modality(text: Column) -> Column:
    """The modality of a normative sentence: two normative ones leave it unknown, one goes before the descriptive ones."""
    hits = modality_hits(text)
    normative = F.filter(hits, lambda h: h.isin(*NORMATIVE))
    return F.when(F.size(normative) > 1, "unknown").otherwise(F.coalesce(F.get(normative, F.lit(0)), F.get(hits, F.lit(0)), F.lit("unknown")))


# The modality words of rule cards.
CARD_MODALITY = {"의무": "mandatory", "금지": "prohibition", "허용": "permission", "권고": "recommendation"}


def requirement_modality(card: Column, text: Column) -> Column:
    """The card's modality, else the text's; unknown where they contradict each other."""
    said, read = F.try_element_at(_map(CARD_MODALITY), F.trim(card)), modality(text)
    return F.when(said.isNotNull() & (read != "unknown") & (said != read), "unknown").otherwise(F.coalesce(said, read))


# The labels of each question's intent, positive and negative; and the intent that each modality asks for.
INTENT_LABELS = {
    "rule_applies": ("APPLICABLE", "NOT_APPLICABLE"),
    "obligation_triggered": ("OBLIGATION_TRIGGERED", "OBLIGATION_NOT_TRIGGERED"),
    "action_prohibited": ("PROHIBITED", "NOT_PROHIBITED"),
    "action_permitted": ("PERMITTED", "NOT_PERMITTED"),
    "exception_applies": ("EXCEPTION_APPLIES", "EXCEPTION_NOT_APPLIES"),
    "requirement_satisfied": ("REQUIREMENT_SATISFIED", "REQUIREMENT_NOT_SATISFIED"),
    "compliance_judgment": ("COMPLIANT", "NON_COMPLIANT"),
}
DEFAULT_INTENT = {
    "applicability": "rule_applies", "mandatory": "obligation_triggered", "prohibition": "action_prohibited", "permission": "action_permitted", "exemption": "exception_applies",
    "recommendation": "requirement_satisfied", "definition": "information_extraction", "procedure": "requirement_satisfied", "unknown": "rule_applies",
}


def default_intent(modality_: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(DEFAULT_INTENT), modality_), F.lit("rule_applies"))


def normative_label(applicability: Column, modality_: Column) -> Column:
    """What a rule of some modality says where it applies, doesn't, or can't be told."""
    axis = {"mandatory": "obligation_triggered", "prohibition": "action_prohibited", "permission": "action_permitted"}
    by = lambda k: F.coalesce(F.try_element_at(_map({m: INTENT_LABELS[i][k] for m, i in axis.items()}), modality_), F.lit(INTENT_LABELS["rule_applies"][k]))
    plain = F.when(applicability == "APPLICABLE", by(0)).when(applicability == "NOT_APPLICABLE", by(1)).when(applicability.isin("EXCEPTION_APPLIES", "INSUFFICIENT_INFORMATION"), applicability)
    exempt = F.when(applicability.isin("EXCEPTION_APPLIES", "INSUFFICIENT_INFORMATION"), applicability).when(applicability.isin("APPLICABLE", "NOT_APPLICABLE"), "EXCEPTION_NOT_APPLIES")
    return F.coalesce(F.when(modality_ == "exemption", exempt).otherwise(plain), F.lit("UNKNOWN"))


def compliance_label(normative: Column, modality_: Column, performed: Column) -> Column:
    """Compliance where a prohibited or required act is known to be done or not; else not assessed."""
    bad = ((modality_ == "prohibition") & (normative == "PROHIBITED") & performed) | ((modality_ == "mandatory") & (normative == "OBLIGATION_TRIGGERED") & ~performed)
    judged = performed.isNotNull() & (((modality_ == "prohibition") & (normative == "PROHIBITED")) | ((modality_ == "mandatory") & (normative == "OBLIGATION_TRIGGERED")))
    return F.when(~F.coalesce(judged, F.lit(False)), "NOT_ASSESSED").when(bad, "NON_COMPLIANT").otherwise("COMPLIANT")


def primary_label(intent: Column, applicability: Column, normative: Column, compliance: Column) -> Column:
    """The label of the axis that a question asks about."""
    return F.when(intent == "rule_applies", applicability).when(intent == "compliance_judgment", compliance).when(intent == "information_extraction", "NOT_ASSESSED").otherwise(normative)


# Names of labels and the label that each stands for.
CANONICAL = {
    "applicable": "APPLICABLE", "compliant": "APPLICABLE", "적용": "APPLICABLE", "적합": "APPLICABLE", "not_applicable": "NOT_APPLICABLE", "non_compliant": "NOT_APPLICABLE", "미적용": "NOT_APPLICABLE", "부적합": "NOT_APPLICABLE",
    "exception_applies": "EXCEPTION_APPLIES", "예외 적용": "EXCEPTION_APPLIES", "insufficient_information": "INSUFFICIENT_INFORMATION", "uncertain": "INSUFFICIENT_INFORMATION", "판단 불가": "INSUFFICIENT_INFORMATION", "unknown": "UNKNOWN",
}


def canonical_label(label: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(CANONICAL), F.lower(F.trim(label))), F.lit("UNKNOWN"))


def compare_primary_labels(intent: Column, generation: Column, verifier: Column, program: Column, understood: Column) -> Column:
    """(agreement, action) on the axis of a question; a verifier that understood another question is no comparison."""
    other = F.coalesce(F.nullif(understood, F.lit("")) != intent, F.lit(False))
    unread = F.when(F.coalesce(program, F.lit("")).isin("", "UNKNOWN", "NOT_ASSESSED"), F.lit("UNKNOWN")).otherwise(program)
    mismatch = F.struct(F.lit("SEMANTIC_AXIS_MISMATCH").alias("agreement"), F.lit("REVERIFY").alias("action"))
    return F.when(other, mismatch).otherwise(compare_labels(generation, verifier, unread))


# The checks without which a verdict is a rejection.
CRITICAL = ("faithfulness", "numeric_unit_consistency", "logical_validity")


def verdict(target: Column, derived: Column, checks: Column) -> Column:
    """(verdict, priority, reasons) from a target label, the verifier's label and its checks (map name -> PASS or
    another); an unknown label is rejected."""
    failed = lambda k: ~F.coalesce(F.try_element_at(checks, F.lit(k)) == "PASS", F.lit(False))
    mismatch = ~derived.eqNullSafe(target)
    reasons = F.array_compact(F.array(F.when(mismatch, F.concat(F.lit("label_mismatch:"), target, F.lit("->"), derived)), *[F.when(failed(k), F.lit(f"{k}_fail")) for k in CRITICAL]))
    out = lambda v, p, r: F.struct(F.lit(v).alias("verdict"), p.alias("priority"), r.alias("reasons"))
    known = F.coalesce(derived.isin("compliant", "non_compliant", "uncertain"), F.lit(False))
    return (
        F.when(~known, out("REJECT", F.lit("HIGH"), F.array(F.lit("invalid_verifier_output"))))
        .when(F.size(reasons) > 0, out("REJECT", F.when(mismatch, "HIGH").otherwise("MEDIUM"), reasons))
        .when(failed("style_quality"), out("ACCEPT_WITH_EDIT", F.lit("LOW"), F.array(F.lit("style_quality_fail"))))
        .otherwise(out("ACCEPT", F.lit("LOW"), F.array().cast("array<string>")))
    )


def literal_condition(operator: str, expected: list[str], actual: Column, unit: str | None = None, actual_unit: str | None = None) -> Column:
    """evaluate_condition for a numeric column against an operator, values and units known beforehand: everything but
    the comparison is worked out here, so rows are compared as the numbers they are."""
    op = ALIASES.get(operator.strip(), operator.strip())
    dimension = {u: d for d, units in UNITS.items() for u in units}
    factor = {u: f for units in UNITS.values() for u, f in units.items()}
    form = lambda u: (u or "").strip().lower() or None

    def number(text: str) -> float | None:
        m = re.fullmatch(r"\s*([-+]?[\d,]*\.?\d+(?:[eE][-+]?\d+)?)\s*([^\s\d,]{0,6})\s*", text)
        if not m:
            return None
        value, own = float(m[1].replace(",", "")), form(m[2])
        if own is None or form(unit) is None or own == form(unit):
            return value
        return value * factor[own] / factor[form(unit)] if dimension.get(own) is not None and dimension.get(own) == dimension.get(form(unit)) else None

    if any(w in " ".join(expected) for w in QUALITATIVE) or op not in NUMERIC:
        return F.lit(UNKNOWN)
    if op.startswith("between") and len(expected) != 2:
        return F.lit(INVALID)
    wanted, value = [number(e) for e in expected], actual.cast("double")
    if not op.startswith("between") and (not wanted or wanted[0] is None):
        return F.when(actual.isNull(), UNKNOWN).otherwise(INVALID)
    if form(unit) and form(actual_unit) and form(unit) != form(actual_unit):
        if dimension.get(form(unit)) is None or dimension.get(form(unit)) != dimension.get(form(actual_unit)):
            return F.lit(UNKNOWN)
        value = value * F.lit(factor[form(actual_unit)]) / F.lit(factor[form(unit)])
    if None in wanted[:2]:
        return F.lit(UNKNOWN)
    low, high = F.lit(wanted[0]), F.lit(wanted[1]) if len(wanted) > 1 else None
    ok = {
        "eq": lambda: value == low, "ne": lambda: value != low, "gt": lambda: value > low, "gte": lambda: value >= low, "lt": lambda: value < low, "lte": lambda: value <= low,
        "between_inclusive": lambda: (value >= low) & (value <= high), "between_exclusive": lambda: (value > low) & (value < high),
    }[op]()
    return F.when(ok.isNull(), UNKNOWN).when(ok, SATISFIED).otherwise(NOT_SATISFIED)


def length_reward(text: Column, target: int) -> Column:
    """1 at the target length, falling to 0 at none and at twice as long."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.length(text) - target) / F.lit(float(target)))


def coverage_reward(answer: Column, facts: Column) -> Column:
    """The share of facts that an answer holds."""
    return F.when(F.size(facts) == 0, 0.0).otherwise(F.size(F.filter(facts, lambda f: F.contains(answer, f))) / F.size(facts))
