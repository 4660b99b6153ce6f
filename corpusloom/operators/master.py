"""The master set of a rule corpus: joins of excerpts, cases and questions with their rules, groups and splits, reports,
readiness, boundary cases, reprocessing, distractors, pairs across publishers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.logic import ALIASES, BOOLEAN, EXISTENCE, NUMERIC, STRING, compare_labels
from corpusloom.functions.text import hex_number, nfkc

# Tasks by kind of excerpt, publishers known by the beginning of an id, and the variants of a boundary.
TASK_OF_KIND = {"compliant": "compliance_judgment", "subtle_nc": "compliance_judgment", "clear_nc": "compliance_judgment", "insufficient": "insufficient_information", "boundary_c": "condition_verification", "exception_nm": "exception_judgment"}
PUBLISHERS = ("KR", "ABS", "DNV", "LR", "BV", "IACS", "NK", "CLASSNK")
BOUNDARIES = {
    "gte": (("below", -1, "NOT_APPLICABLE"), ("at", 0, "APPLICABLE"), ("above", 1, "APPLICABLE")), "gt": (("below", -1, "NOT_APPLICABLE"), ("at", 0, "NOT_APPLICABLE"), ("above", 1, "APPLICABLE")),
    "lte": (("below", -1, "APPLICABLE"), ("at", 0, "APPLICABLE"), ("above", 1, "NOT_APPLICABLE")), "lt": (("below", -1, "APPLICABLE"), ("at", 0, "NOT_APPLICABLE"), ("above", 1, "NOT_APPLICABLE")),
}
# Criteria that a corpus must meet before more of it is made.
CRITERIA = {
    "program_verifier_match_rate": (">=", 0.95), "prohibition_match_rate": (">=", 0.95), "exception_match_rate": (">=", 0.90), "semantic_axis_mismatch_rate": ("<=", 0.01), "fact_realization_pass_rate": (">=", 0.98),
    "verifier_abstention_conflict_rate": ("<=", 0.02), "expert_review_queue_rate": ("<=", 0.10), "strict_derivable_rate": (">=", 0.80), "canonical_group_leakage": ("==", 0.0), "exact_duplicate_leakage": ("==", 0.0),
    "suite_overall_accept_rate": (">=", 0.85), "suite_review_rate": ("<=", 0.03), "suite_error_count": ("==", 0.0), "suite_min_track_samples": (">=", 100.0), "suite_track_gates_ok": ("==", 1.0),
}


def last_of_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the last by order: found before the shuffle where copies lie together."""
    return rows.groupBy(F.col(key).alias("key of last")).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def judgment_samples(excerpts: DataFrame, rules: DataFrame, profiles: DataFrame, annotations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """excerpts (id, rule_id, kind, target_label) with their rule (id, ...; excerpts without one go), and where they have
    them their profile, annotation and verdict (id, ord, ...) as structs; the last of repeated ids counts."""
    block = lambda rows, name: last_of_id(rows, "id", "ord").select(F.col("id").alias(f"id of {name}"), F.struct(*[c for c in rows.columns if c not in ("id", "ord")]).alias(name))
    out = excerpts.join(block(rules, "rule"), F.col("rule_id") == F.col("id of rule")).drop("id of rule")
    for rows, name in ((profiles, "profile"), (annotations, "annotation"), (verdicts, "verdict")):
        out = out.join(block(rows, name), F.col("id") == F.col(f"id of {name}"), "left").drop(f"id of {name}")
    kinds = F.create_map(*[F.lit(x) for kv in TASK_OF_KIND.items() for x in kv])
    compared = compare_labels(F.col("target_label"), F.col("verdict.derived_label"), F.lit(None).cast("string"))
    return out.select(F.col("id").alias("sample_id"), "rule_id", F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("compliance_judgment")).alias("task_type"), "kind", "target_label", "rule", "profile", "annotation", "verdict", compared["agreement"].alias("agreement"))


def judgment_counts(excerpts: DataFrame, rules: DataFrame, profiles: DataFrame, annotations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: excerpts without a rule, and of those with one without profile, annotation, verdict; repeated rule ids."""
    has = lambda rows, name: rows.select(F.col("id").alias(f"id of {name}")).distinct().withColumn(name, F.lit(1))
    joined = excerpts.join(has(rules, "r"), F.col("rule_id") == F.col("id of r"), "left")
    for rows, name in ((profiles, "p"), (annotations, "a"), (verdicts, "v")):
        joined = joined.join(has(rows, name), F.col("id") == F.col(f"id of {name}"), "left")
    ruled = F.col("r").isNotNull()
    counts = joined.agg(F.count_if(~ruled).alias("orphan_excerpt_no_rule"), F.count_if(ruled & F.col("p").isNull()).alias("orphan_excerpt_no_profile"), F.count_if(ruled & F.col("a").isNull()).alias("excerpt_no_annotation"), F.count_if(ruled & F.col("v").isNull()).alias("excerpt_no_verdict"))
    return counts.crossJoin(F.broadcast(rules.agg((F.count("id") - F.count_distinct("id")).alias("duplicate_rule_cards"))))  # one row each


def case_samples(cases: DataFrame, rules: DataFrame, verifications: DataFrame) -> DataFrame:
    """cases (case_id, rule_id, intended_label, program_label, ...) whose rule (id) is there, with the agreement of their
    verification (case_id, agreement, verifier_label); without one they wait for it."""
    found = cases.join(rules.select(F.col("id").alias("id of rule")).distinct(), F.col("rule_id") == F.col("id of rule"), "left_semi")
    joined = found.join(verifications.select("case_id", F.col("agreement").alias("said"), "verifier_label"), "case_id", "left")
    return joined.withColumn("agreement", F.coalesce("said", F.lit("VERIFIER_PENDING"))).drop("said")


def suite_samples(questions: DataFrame, rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """questions (question_id, chunk_id, section_path, needs_review) with the first rule of their evidence's chunk (rules:
    id, ord, chunk_id, section_path), or the chunk itself, and their verdict; a rejected one needs review."""
    first = rules.groupBy("chunk_id").agg(F.min_by(F.struct("id", "section_path"), "ord").alias("rule"))
    said = verdicts.select("question_id", F.col("verdict").alias("suite_verdict"))
    joined = questions.join(first, "chunk_id", "left").join(said, "question_id", "left")
    return joined.select("question_id", F.coalesce("rule.id", "chunk_id").alias("rule_id"), F.col("rule").isNotNull().alias("joined"), F.coalesce(F.nullif("section_path", F.lit("")), "rule.section_path").alias("section_path"), "suite_verdict", (F.coalesce("needs_review", F.lit(False)) | F.coalesce(F.col("suite_verdict") == "REJECT", F.lit(False))).alias("needs_review"))


def publisher_of(publisher: Column, *ids: Column) -> tuple[Column, Column]:
    """(publisher, how it is known): as given, by the beginning of an id, by the form of the older ids, or unknown."""
    who, how = F.nullif(publisher, F.lit("")), F.when(F.nullif(publisher, F.lit("")).isNotNull(), "source.publisher")
    for id_ in ids:
        for pattern, name in ((r"^([A-Za-z]+)__", "rule_uid_prefix"), (r"^([A-Za-z]+)_", "chunk_id_prefix")):
            said = F.regexp_extract(id_, pattern, 1)
            known = F.when(F.upper(said).isin(*PUBLISHERS), said)
            how = F.coalesce(how, F.when(known.isNotNull(), name))
            who = F.coalesce(who, known)
        older = id_.rlike("^(RULE|GUIDE|APPX)_")
        who, how = F.coalesce(who, F.when(older, "KR")), F.coalesce(how, F.when(older, "kr_rule_uid_convention"))
    return who, F.coalesce(how, F.lit("unknown"))


def key_part(value: Column) -> Column:
    """A part of a group's key: compatible characters, small letters, one sign for all separators, single blanks."""
    text = F.lower(F.trim(nfkc(F.coalesce(value, F.lit("")))))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*(?:>|/|::|—|–)\s*", "-"), r"\s+", " "), F.lit("- "))


def canonical_group(publisher: Column, document: Column, edition: Column, rule_uid: Column, article: Column, path: Column, parent: Column, chunk: Column) -> Column:
    """struct(id, source, key) of the first of rule, article, section, parent that is there, within its document; a chunk
    stands by itself."""
    or_ = lambda c, name: F.coalesce(F.nullif(key_part(c), F.lit("")), F.lit(name))
    prefix = F.concat_ws("|", or_(publisher, "unknown-publisher"), or_(document, "unknown-document"), or_(edition, "unknown-edition"))
    bare = F.regexp_replace(F.coalesce(rule_uid, F.lit("")), r"(?i)^[a-z0-9]+__[^_].*?__", "")
    out = F.lit(None).cast("struct<source:string,key:string>")
    named = lambda source, key: F.struct(F.lit(source).alias("source"), key.alias("key"))
    for source, part in (("rule_uid", bare), ("article_id", article), ("section_path", path), ("parent_rule_id", parent)):
        value = F.nullif(key_part(part), F.lit(""))
        out = F.coalesce(out, F.when(value.isNotNull(), named(source, F.concat(prefix, F.lit("|"), value))))
    out = F.coalesce(out, F.when(F.coalesce(chunk, F.lit("")) != "", named("chunk_id", key_part(chunk))))
    return F.struct(F.concat(F.lit("crg_"), F.substring(F.sha2(out["key"], 256), 1, 16)).alias("id"), out["source"].alias("source"), out["key"].alias("key"))


def split_of_group(group: Column, seed: int, train: float, validation: float) -> Column:
    """train, validation or test of a group, by a hash of it: no group is torn."""
    bucket = hex_number(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group), 256), 1, 8)) / F.lit(4294967295.0)
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def build_report(samples: DataFrame, dimensions: list[str], group: str = "group_id", split: str = "split") -> DataFrame:
    """(dimension, value, n, n_groups): samples and their groups by each dimension and split, and in all, in one pass."""
    named = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in [*dimensions, split]], F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    return samples.select(group, F.explode(named).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"))


def card_class(conditions: Column) -> Column:
    """How far a rule's conditions (array of struct requirement, operator, value) can be evaluated by program."""
    op = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), c["operator"]), c["operator"])
    ok = lambda c: F.coalesce(op(c).isin(*NUMERIC, *STRING, *BOOLEAN, *EXISTENCE), F.lit(False)) & (F.trim(F.coalesce(c["value"], F.lit(""))) != "")
    names = F.array_distinct(F.transform(conditions, lambda c: c["requirement"]))
    whole = F.exists(names, lambda r: F.forall(F.filter(conditions, lambda c: c["requirement"] == r), ok))
    return F.when(conditions.isNull(), "INVALID_RULE_CARD").when(F.size(conditions) == 0, "MISSING_STRUCTURE").when(whole, "PROGRAM_EVALUABLE").when(F.exists(conditions, ok), "PROGRAM_PARTIALLY_EVALUABLE").otherwise("QUALITATIVE_ONLY")


def evaluator_report(rules: DataFrame, samples: DataFrame) -> DataFrame:
    """(counter, key, n): classes of rules (conditions), their operators and units, agreements of samples (task_type,
    agreement) in all and by task."""
    flat = rules.select(F.explode("conditions").alias("c"))
    count = lambda rows, name, key: rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "key", "n")
    out = count(rules, "class", card_class(F.col("conditions")))
    out = out.unionByName(count(flat, "operator", F.coalesce(F.nullif("c.operator", F.lit("")), F.lit("?")))).unionByName(count(flat, "unit", F.nullif("c.unit", F.lit(""))))
    return out.unionByName(count(samples, "agreement", F.col("agreement"))).unionByName(count(samples, "task agreement", F.concat("task_type", F.lit(" "), "agreement")))


def modality_report(cases: DataFrame) -> DataFrame:
    """For each modality of cases (modality, intent, agreement, compliance): cases, judged ones, the share of these in
    which all three labels agree, and those whose compliance can be told."""
    judged = F.coalesce(F.col("agreement") != "VERIFIER_PENDING", F.lit(False))
    match = F.avg(F.when(judged, (F.col("agreement") == "THREE_WAY_MATCH").cast("double")))
    return cases.groupBy("modality").agg(F.count("*").alias("n"), F.count_if(judged).alias("judged"), F.round(match, 4).alias("match_rate"), F.count_if(F.coalesce("compliance", F.lit("NOT_ASSESSED")) != "NOT_ASSESSED").alias("assessable"))


def readiness(metrics: DataFrame, criteria: dict[str, tuple[str, float]] = CRITERIA) -> DataFrame:
    """(criterion, value, met) for metrics (name, value); a missing one is not met."""
    wanted = F.map_from_arrays(F.array(*[F.lit(k) for k in criteria]), F.array(*[F.struct(F.lit(op).alias("op"), F.lit(float(v)).alias("limit")) for op, v in criteria.values()]))
    rows = metrics.sparkSession.range(1).select(F.explode(wanted).alias("criterion", "w")).join(metrics, F.col("criterion") == F.col("name"), "left")
    value, limit = F.col("value"), F.col("w.limit")
    met = F.when(F.col("w.op") == ">=", value >= limit).when(F.col("w.op") == "<=", value <= limit).otherwise(value == limit)
    return rows.select("criterion", "value", F.coalesce(met, F.lit(False)).alias("met"))


def readiness_metrics(cases: DataFrame) -> DataFrame:
    """(name, value) from cases (modality, kind, agreement, verifier_label, program_label, group_id, split): rates leave out
    what can't be judged, leaks are counted."""
    judged = ~F.coalesce("agreement", F.lit("VERIFIER_PENDING")).isin("VERIFIER_PENDING", "PROGRAM_UNEVALUABLE") & ~F.coalesce("program_label", F.lit("UNKNOWN")).isin("UNKNOWN", "NOT_ASSESSED")
    match = F.when(judged, F.col("verifier_label").eqNullSafe(F.col("program_label")).cast("double"))
    one = cases.agg(
        F.round(F.avg(match), 4).alias("program_verifier_match_rate"), F.round(F.avg(F.when(F.col("modality") == "prohibition", match)), 4).alias("prohibition_match_rate"),
        F.round(F.avg(F.when(F.col("kind").startswith("exception"), match)), 4).alias("exception_match_rate"), F.round(F.avg((F.coalesce("agreement", F.lit("")) == "SEMANTIC_AXIS_MISMATCH").cast("double")), 4).alias("semantic_axis_mismatch_rate"),
    )
    leaks = cases.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("canonical_group_leakage"))
    both = one.crossJoin(F.broadcast(leaks))  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in both.columns])).alias("m")).select("m.*")


def boundary_cases(conditions: DataFrame) -> DataFrame:
    """(rule_id, requirement_id, field, variant, value, label, facts) for conditions (rule_id, requirement_id, n, field,
    operator, value): cases below, at and above each whole threshold, the other conditions of its requirement being met;
    a requirement with one that can't be met by a whole number has none."""
    op, v = F.col("operator"), F.col("value")
    whole = v == F.floor(v)
    meets = F.when(op.isin("gte", "lte", "eq"), v).when((op == "gt") & whole, v + 1).when((op == "lt") & whole, v - 1)
    rows = conditions.withColumn("meets", meets)
    own = rows.groupBy("rule_id", "requirement_id").agg(F.array_sort(F.collect_list(F.struct("n", "field", "meets"))).alias("all"))
    plan = F.create_map(*[x for k, vs in BOUNDARIES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("variant"), F.lit(d).alias("delta"), F.lit(b).alias("label")) for a, d, b in vs]))])
    variants = rows.where(whole).select("rule_id", "requirement_id", "n", "field", "value", F.explode(F.try_element_at(plan, op)).alias("p")).join(own, ["rule_id", "requirement_id"])
    others = F.filter("all", lambda x: x["n"] != F.col("n"))
    met = variants.withColumn("others", others).where(F.forall("others", lambda x: x["meets"].isNotNull()))
    facts = F.concat(F.transform("others", lambda x: F.struct(x["field"].alias("field"), x["meets"].alias("value"))), F.array(F.struct(F.col("field"), (F.col("value") + F.col("p.delta")).alias("value"))))
    return met.select("rule_id", "requirement_id", "field", F.col("p.variant").alias("variant"), (F.col("value") + F.col("p.delta")).alias("value"), F.col("p.label").alias("label"), facts.alias("facts"))


def resolution(kind: Column, before: Column, after: Column, removed: Column) -> Column:
    """How a case whose labels disagreed came out when it was verified again."""
    exception = kind.startswith("exception")
    solved = F.when(exception, "RESOLVED_EXCEPTION_STRUCTURE").when(kind == "compliance_behavior", "RESOLVED_FACT_REALIZATION").when(kind == "numeric_boundary", "RESOLVED_NUMERIC_REASONING").otherwise("RESOLVED_BY_INTENT_REWRITE")
    return (
        F.when(removed, F.when(exception, "RULE_CARD_REJECTED").otherwise("CASE_REJECTED")).when(after.isNull(), "NOT_REVERIFIED").when(after == "THREE_WAY_MATCH", solved)
        .when(after == "VERIFIER_ABSTENTION_CONFLICT", F.when(before != after, "RESOLVED_VERIFIER_ABSTENTION").otherwise("EXPERT_REVIEW_REQUIRED"))
        .when(after == "SEMANTIC_AXIS_MISMATCH", "STILL_AMBIGUOUS").when(after == "PROGRAM_DISAGREES", "PROGRAM_EVALUATOR_ERROR").otherwise("EXPERT_REVIEW_REQUIRED")
    )


def reprocess_report(before: DataFrame, after: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, before, after, resolution) of the cases of before (case_id, case_kind, agreement) that didn't agree;
    after: (case_id, agreement); cases: the case_ids that are still there."""
    open_ = before.where("agreement <> 'THREE_WAY_MATCH'").select("case_id", "case_kind", F.col("agreement").alias("before"))
    joined = open_.join(after.select("case_id", F.col("agreement").alias("after")), "case_id", "left").join(cases.select("case_id").distinct().withColumn("there", F.lit(True)), "case_id", "left")
    return joined.select("case_id", "before", "after", resolution(F.coalesce("case_kind", F.lit("")), F.col("before"), F.col("after"), F.col("there").isNull()).alias("resolution"))


def evaluation_pivot(cases: DataFrame, answers: DataFrame, judged: DataFrame, tags: tuple[str, ...] = ("tuned", "base")) -> DataFrame:
    """cases (source, ...) with the last answer (tag, source, ord, gen) and the last score that isn't below zero (tag,
    source, ord, score) of each tag."""
    last = lambda rows, value: rows.groupBy("source").agg(*[F.max_by(F.when(F.col("tag") == t, F.col(value)), F.when(F.col("tag") == t, F.col("ord"))).alias(f"{t}_{value}") for t in tags])
    return cases.join(last(answers, "gen"), "source", "left").join(last(judged.where("score >= 0"), "score"), "source", "left")


def cross_publisher_pairs(members: DataFrame, articles: DataFrame, own: str = "KR", most: int | None = None) -> DataFrame:
    """(cluster, own_id, other_id): of each cluster of two to six members (cluster, ord, soc, chunk_id) with one's own
    publisher and another, the first of each, where articles (chunk_id) has either once; the smallest clusters first."""
    first = lambda mine: F.min_by("chunk_id", F.when((F.col("soc") == own) == mine, F.col("ord")))
    mixed = members.groupBy("cluster").agg(F.count("*").alias("n"), first(True).alias("own_id"), first(False).alias("other_id")).where("n BETWEEN 2 AND 6 AND own_id IS NOT NULL AND other_id IS NOT NULL")
    single = articles.groupBy("chunk_id").count().where("count = 1").select("chunk_id")
    out = mixed.join(single.withColumnRenamed("chunk_id", "own_id"), "own_id", "left_semi").join(single.withColumnRenamed("chunk_id", "other_id"), "other_id", "left_semi")
    return (out if most is None else out.orderBy("n", "cluster").limit(most)).select("cluster", "own_id", "other_id")


def distractors(rules: DataFrame, n: int, seed: int = 42, rows_a_task: int = 50_000) -> DataFrame:
    """(chunk_id, distractor, rank): for each rule (chunk_id, publisher, chapter) one other of its chapter and publisher,
    where there is one, and others from outside it, n in all or as many as there are; rank from 1, that of the own
    chapter first. A rule without a chapter has none to share. chunk_id must be distinct.

    Rules stand on a ring, chapter by chapter, by a keyed hash within. All that isn't of one's chapter is then one
    stretch of it, from which places at even steps are taken from a hashed start on: no rule is looked at in vain, and
    rules are joined by place. Chapters of any size are numbered in slices of about rows_a_task rows.
    """
    mark = lambda salt: F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("chunk_id").cast("string"))), F.lit(8)), 16, 10).cast("long")
    total = rules.count()
    slices = max(1, math.ceil(total / rows_a_task))
    alone = F.col("chapter").isNull()
    group = F.concat_ws(":", F.when(alone, "1").otherwise("0"), F.coalesce(F.col("publisher").cast("string"), F.lit("")), F.coalesce(F.col("chapter").cast("string"), F.col("chunk_id").cast("string")))
    dealt = rules.select("chunk_id", group.alias("g"), mark("at").alias("at"), mark("own").alias("own"), mark("out").alias("out")).withColumn("part", F.floor(F.col("at") * slices / 2**32).cast("int"))
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("g", "part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each slice of a chapter
    starts = counts.withColumn("part_start", F.coalesce(before, F.lit(0))).withColumns({"start": F.min("part_start").over(Window.partitionBy("g")), "size": F.sum("n").over(Window.partitionBy("g"))}).drop("n")
    placed = dealt.join(starts, ["g", "part"]).withColumn("place", F.col("part_start") + F.row_number().over(Window.partitionBy("g", "part").orderBy("at", "chunk_id")) - 1)
    shares = F.when(F.col("size") > 1, 1).otherwise(0)
    outside = F.lit(total) - F.col("size")
    take = F.least(outside, F.lit(n) - shares)
    own = F.when(shares == 1, F.array(F.col("start") + F.pmod(F.col("place") - F.col("start") + 1 + F.pmod(F.col("own"), F.col("size") - 1), F.col("size")))).otherwise(F.array().cast("array<long>"))
    step = F.greatest(F.floor(outside / F.greatest(take, F.lit(1))), F.lit(1))
    far = F.when(take > 0, F.transform(F.sequence(F.lit(0), F.greatest(take - 1, F.lit(0))), lambda j: F.pmod(F.col("start") + F.col("size") + F.pmod(F.col("out") + j * step, outside), F.lit(total)))).otherwise(F.array().cast("array<long>"))
    asked = placed.where(F.lit(n > 0)).select("chunk_id", F.posexplode(F.concat(own, far)).alias("pos", "place"))
    held = placed.select("place", F.col("chunk_id").alias("distractor"))
    return asked.join(held, "place").select("chunk_id", "distractor", (F.col("pos") + 1).alias("rank"))


def hard_distractors(hits: DataFrame, golden: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """(query_id, parent_id, rank): the best hits (query_id, parent_id, rank) of each query that aren't its golden article
    (query_id, parent_id) nor excluded for it (equals, mirrors)."""
    left = hits.join(golden, ["query_id", "parent_id"], "left_anti").join(excluded, ["query_id", "parent_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "parent_id"))).where(F.col("rank") <= n)


def even_flips(plans: DataFrame, least: float = 0.15, most: float = 0.25, order: str = "ord", include: str = "include_golden") -> DataFrame:
    """plans with `include` turned, at even intervals, for as many as it takes to bring the share without into the band,
    and a tag on those."""
    counts = plans.agg(F.count("*").alias("n"), F.count_if(~F.col(include)).alias("misses")).first()  # two numbers
    n, misses = counts["n"], counts["misses"]
    low, high = round(n * least), round(n * most)
    side = False if misses > high else True if misses < low else None
    if side is None:
        return plans.withColumn("tag", F.lit(None).cast("string"))
    flips = misses - high if side is False else low - misses
    step = max(1, (misses if side is False else n - misses) // flips)
    place = F.row_number().over(Window.partitionBy(include).orderBy(order)) - 1
    turned = (F.col(include) == F.lit(side)) & (F.col("place of flips") % step == 0) & (F.col("place of flips") / step < flips)
    rows = plans.withColumn("place of flips", place)
    return rows.withColumn("tag", F.when(turned, "ng_forced" if side else "golden_forced")).withColumn(include, F.when(turned, F.lit(not side)).otherwise(F.col(include))).drop("place of flips")


def incumbent(runs: DataFrame, metric: str) -> DataFrame:
    """runs (run_id, name, status, finished) with the metric of the run before of the same name that succeeded."""
    before = Window.partitionBy("name").orderBy("finished", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("incumbent", F.last(F.when(F.col("status") == "succeeded", F.col(metric)), ignorenulls=True).over(before))


def requirement_articles(parents: DataFrame, least_tokens: int) -> DataFrame:
    """Parents that state requirements: long enough, not definitions, scopes or lists, and of the rules, not of their
    guidance; other publishers' without contents and introductions."""
    stop = r"(?i)정의|용어|일반사항$|적용$|제출도면|^(Scope|General|Objective|Definitions?|Application|Introduction|Contents|Abbreviations?|References?|Terminology)\s*$"
    title, own = F.coalesce("article_title", F.lit("")), F.col("publisher") == "KR"
    ruled = F.when(F.coalesce("document_type", F.lit("")) != "", F.col("document_type") == "rule").otherwise(F.col("chunk_id").startswith("RULE_"))
    other = ~F.col("chunk_id").rlike("(INTRO|TOC)$") & title.rlike("[A-Za-z가-힣]")
    return parents.where((F.col("chunk_level") == "parent") & (F.coalesce("content_tokens", F.lit(0)) >= least_tokens) & ~title.rlike(stop) & F.when(own, ruled).otherwise(other))


def one_per_document(parents: DataFrame, most_tokens: int = 1500) -> DataFrame:
    """The richest article of each document up to most_tokens, else its smallest."""
    fits = F.col("content_tokens") <= most_tokens
    order = Window.partitionBy("publisher", "source_file").orderBy(fits.desc(), F.when(fits, -F.col("content_tokens")).otherwise(F.col("content_tokens")), "chunk_id")
    return parents.withColumn("rank of one", F.row_number().over(order)).where(F.col("rank of one") == 1).drop("rank of one")


def chapter_first(parents: DataFrame, chapters: list[str], n: int) -> DataFrame:
    """The first n articles, chapters in the order given, then by document, section and article."""
    place = F.array_position(F.array(*[F.lit(c) for c in chapters]), F.col("chapter_no"))
    return parents.where(place > 0).orderBy(place, "source_file", "section_no", "article_no").limit(n)
