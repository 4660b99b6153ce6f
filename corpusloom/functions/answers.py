"""Answers in sections: building, reading, scoring; decisions in words and as labels; rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.logic import INTENT_LABELS, canonical_label

# The sections in the order of an answer, and the decision that nothing can be decided.
SECTIONS = {"evidence": "근거", "condition_review": "조건 검토", "decision": "판단", "required_action": "필요한 조치", "missing_information": "추가 확인 정보"}
UNDECIDED = "판단 불가"
# Labels as an answer shows them.
SHOWN = {
    "APPLICABLE": "적용", "NOT_APPLICABLE": "비적용", "OBLIGATION_TRIGGERED": "의무 발생", "OBLIGATION_NOT_TRIGGERED": "의무 미발생", "PROHIBITED": "금지됨", "NOT_PROHIBITED": "금지되지 않음", "PERMITTED": "허용됨",
    "NOT_PERMITTED": "허용되지 않음", "EXCEPTION_APPLIES": "예외 적용", "EXCEPTION_NOT_APPLIES": "예외 미적용", "REQUIREMENT_SATISFIED": "요건 충족", "REQUIREMENT_NOT_SATISFIED": "요건 미충족", "COMPLIANT": "적합", "NON_COMPLIANT": "부적합",
    "INSUFFICIENT_INFORMATION": UNDECIDED,
}
# Other ways of saying them.
SAID = {"미적용": "NOT_APPLICABLE", "적용되지 않음": "NOT_APPLICABLE", "적용 대상이 아님": "NOT_APPLICABLE", "적용됨": "APPLICABLE", "의무 없음": "OBLIGATION_NOT_TRIGGERED", "예외가 적용": "EXCEPTION_APPLIES"}
# Older phrases, tried last.
OLDER = (("판단 불가", "INSUFFICIENT_INFORMATION"), ("예외가 적용", "EXCEPTION_APPLIES"), ("적용되지 않", "NOT_APPLICABLE"))
# Tasks whose answers take the sections, and tasks that are answered freely.
JUDGMENT_TASKS = ("applicability", "compliance_judgment", "exception_judgment", "condition_verification", "insufficient_information", "violation_judgment", "requirement_satisfaction")
FREE_TASKS = ("definition", "summary", "direct_qa", "extractive_qa", "comparison", "procedure", "calculation", "requirement_extraction", "cross_reference_lookup")

HEADING = "(?m)^(" + "|".join(SECTIONS.values()) + r")\s*[:：]\s*"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def bullets(items: Column) -> Column:
    """A list as lines with hyphens, blank items left out."""
    kept = F.filter(F.transform(items, trimmed), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")


def build_answer(parts: dict[str, Column]) -> Column:
    """The sections that are there, in their order; null without a decision."""
    body = {k: F.nullif(trimmed(F.coalesce(c, F.lit(""))), F.lit("")) for k, c in parts.items()}
    blocks = [F.concat(F.lit(f"{label}:\n"), body[k]) for k, label in SECTIONS.items() if k in body]
    return F.when(body["decision"].isNotNull(), F.concat_ws("\n\n", *blocks))


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, by a list of one, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_answer(text: Column) -> Column:
    """struct(keys in order of their first place, bodies of these, keys that come again)."""
    key = F.create_map(*[F.lit(x) for k, v in SECTIONS.items() for x in (v, k)])
    labels = lambda t: F.transform(F.regexp_extract_all(t, F.lit(HEADING), F.lit(1)), lambda label: key[label])
    pieces = lambda t: F.transform(F.split(t, HEADING), trimmed)

    def told(p: Column) -> Column:
        found, order = p["found"], F.array_distinct(p["found"])
        own = F.transform(order, lambda k: F.get(p["pieces"], F.array_position(p["found"], k).cast("int")))  # the first piece goes before any heading
        again = F.array_compact(F.transform(found, lambda k, i: F.when(F.array_position(p["found"], k) < i + 1, k)))
        return F.struct(order.alias("order"), own.alias("bodies"), again.alias("duplicates"))

    return bound(bound(F.coalesce(text, F.lit("")), lambda t: F.struct(labels(t).alias("found"), pieces(t).alias("pieces"))), told)


def section(parsed: Column, key: str) -> Column:
    """A section's text; empty where it is missing."""
    at = F.array_position(parsed["order"], key)
    return F.coalesce(F.when(at > 0, F.get(parsed["bodies"], (at - 1).cast("int"))), F.lit(""))


def format_score(text: Column) -> Column:
    """0.4 for a decision, 0.2 each for the order, for no section twice, and for what a decision must rest on."""

    def points(parsed: Column) -> Column:
        order, decision = parsed["order"], section(parsed, "decision")
        right = order == F.filter(F.array(*[F.lit(k) for k in SECTIONS]), lambda k: F.array_contains(parsed["order"], k))
        rests = F.when(F.contains(decision, F.lit(UNDECIDED)), section(parsed, "missing_information") != "").otherwise(section(parsed, "evidence") != "")
        sum_ = F.when(decision != "", 4).otherwise(0) + F.when(right, 2).otherwise(0) + F.when(F.size(parsed["duplicates"]) == 0, 2).otherwise(0) + F.when(rests, 2).otherwise(0)
        return F.when(F.size(order) == 0, 0.0).otherwise(sum_ / 10)

    return bound(parse_answer(text), points)


def display_label(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), label), label)


def decision_label(decision: Column) -> Column:
    """The label that a decision says: as a whole, or by the longest phrase that it holds."""
    said = sorted([*((v, k) for k, v in SHOWN.items()), *SAID.items()], key=lambda x: -len(x[0]))
    phrases = lambda rows: F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(label).alias("label")) for p, label in rows])
    first = lambda rows, holds: F.get(F.filter(phrases(rows), holds), F.lit(0))["label"]
    return bound(trimmed(decision), lambda t: F.coalesce(first(said, lambda x: x["phrase"] == t), first([*said, *OLDER], lambda x: F.contains(t, x["phrase"]))))


def answer_label(text: Column) -> Column:
    return decision_label(bound(parse_answer(text), lambda p: F.nullif(section(p, "decision"), F.lit(""))))


def answer_format(task: Column) -> Column:
    """The format of a task's answers; null for free and for unknown ones."""
    return F.when(task.isin(*JUDGMENT_TASKS), "regulation_judgment_v1")


def format_reward(text: Column, task: Column) -> Column:
    """The format's score where the task asks for it; 1 elsewhere."""
    return F.when(answer_format(task).isNotNull(), format_score(text)).otherwise(1.0)


def label_reward(text: Column, gold: Column, evaluable: Column) -> Column:
    """1 where the answer's label is the wanted one, or stands for the same of the four older labels; 0 for rows that
    can't be evaluated."""
    older = gold.isin("APPLICABLE", "NOT_APPLICABLE", "EXCEPTION_APPLIES", "INSUFFICIENT_INFORMATION", "compliant", "non_compliant", "uncertain")
    counts = F.coalesce(evaluable, F.lit(False)) & ~F.coalesce(gold, F.lit("UNKNOWN")).isin("UNKNOWN", "NOT_ASSESSED")
    alike = lambda said: older & (canonical_label(said) == canonical_label(gold)) & (canonical_label(gold) != "UNKNOWN")
    return bound(answer_label(text), lambda said: F.when(F.coalesce(counts & ((said == gold) | alike(said)), F.lit(False)), 1.0).otherwise(0.0))


def intent_reward(text: Column, intent: Column) -> Column:
    """1 for a label of the question's own axis or for none decided, 0.25 for one of another axis, 0 for none."""
    own = F.create_map(*[x for name, pair in INTENT_LABELS.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in (*pair, "INSUFFICIENT_INFORMATION")]))])
    known = F.coalesce(intent.isin(*INTENT_LABELS), F.lit(False))
    return bound(answer_label(text), lambda said: F.when(said.isNull() | ~known, 0.0).when(F.array_contains(F.try_element_at(own, intent), said), 1.0).otherwise(0.25))


def condition_coverage(text: Column, conditions: Column) -> Column:
    """The share of conditions (array of struct field, value) whose field or value a text names; those that a case
    builder put in don't count."""
    plain = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" "))
    kept = F.filter(F.coalesce(conditions, F.array().cast("array<struct<field:string,value:string>>")), lambda c: c["field"] != "applicability_asserted")
    named = lambda t: (plain(t) != "") & F.contains(plain(text), plain(t))
    hits = F.size(F.filter(kept, lambda c: named(c["field"]) | named(c["value"])))
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.round(hits / F.size(kept), 4))
