"""Loaders, ingest and resume on small files; the pieces that the supplied tables don't show."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import answers, html, logic, verification
from corpusloom.operators import curation, drift, master, references, retrieval, structure
from corpusloom.sources import loaders


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) if r is not None else "" for r in rows), encoding="utf-8")
    return str(path)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_loaders(spark, tmp_path):
    cases = lines(tmp_path / "cases.jsonl", [{"question": "q", "expected": "e"}, None, {"id": "x", "text": "t", "response": "r"}, {"expected": "nothing asked"}])
    assert [(r["id"], r["question"], r["expected"]) for r in loaders.load_cases(spark, cases).collect()] == [("c0", "q", "e"), ("x", "t", "r")]
    rows = lines(tmp_path / "rows.jsonl", [{"messages": [{"role": "user", "content": "a"}]}, {"text": "b", "response": "c"}, {"text": "no answer", "response": ""}, {"prompt": "p", "chosen": "1", "rejected": "2"}, {"prompt": "p", "chosen": "1", "rejected": ""}])
    assert [[m["content"] for m in r["messages"]] for r in loaders.load_chats(spark, rows).collect()] == [["a"], ["b", "c"]]
    assert [tuple(r) for r in loaders.load_preferences(spark, rows).collect()] == [("p", "1", "2")]
    prompts = loaders.load_prompts(spark, lines(tmp_path / "p.jsonl", [{"prompt": "p", "gold": 1}, {"text": "t", "extra": "x"}, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, {"gold": 2}]))
    assert sorted(r["prompt"] for r in prompts.collect()) == ["p", "t", "u"] and set(prompts.columns) == {"prompt", "gold", "extra"}


def test_ingest_and_resume(spark, tmp_path):
    source = lines(tmp_path / "in.jsonl", [{"id": "1", "text": " a  b "}, {"id": "2", "text": "a b"}, {"id": "3", "text": "c"}])
    assert loaders.ingest(spark, source, str(tmp_path / "out")) == 2
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "a b"), ("3", "c")]
    for ids in ([1, 2], [2, 3], [3]):
        loaders.append_new(spark.createDataFrame([(i,) for i in ids], "id int"), str(tmp_path / "done"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "done")).collect()) == [1, 2, 3]
    chunks = spark.createDataFrame([("b", "b1", "parent", None, 1), ("a", "a1", "parent", None, 1), ("a", "a2", "child", "a1", 2)], "doc string, chunk_id string, chunk_level string, parent_chunk_id string, ord int")
    documents, numbered = loaders.review_tables(chunks)
    assert [(r["doc"], r["idx"], r["n_chunks"], r["n_articles"]) for r in documents.orderBy("idx").collect()] == [("a", 0, 2, 1), ("b", 1, 1, 1)]
    assert {(r["chunk_id"], r["seq"]) for r in numbered.collect()} == {("a1", 0), ("a2", 1), ("b1", 0)} and {(r[0], r[1]) for r in loaders.article_units(chunks).collect()} == {("a1", 1), ("b1", 0)}


def test_exact_dedup_edges(spark):
    """Records without an id stay, repeated rows go, and a copy goes wherever its id is first elsewhere."""
    rows = [(0, "zz"), (1, "aa"), (1, "zz"), (1, "aa"), (None, "unique"), (None, "zz")]
    got = curation.exact_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(0, "zz"), (1, "aa"), (None, "unique")]))


def test_rows_of_tables(spark):
    text = lambda header, row: one(spark, html.row_text(F.array(*[F.lit(h) for h in header]), F.array(*[F.lit(c) for c in row])))
    assert text(["Operation", "Load"], ["Seagoing", "Seagoing"]) == "Seagoing"
    assert text(["A", "B"], ["A", "235"]) == "B: 235" and text(["A", "B", "C"], ["x", "", "y"]) == "A: x | C: y"
    assert text(["A"], ["x", "y", " "]) == "x y" and text(["", "B"], ["x", "y"]) == "x | B: y"


def test_scores_captions_modalities_masks(spark):
    n = [F.lit(float(v)) for v in (200, 10, 0, 0, 50, 20)]
    assert abs(one(spark, structure.spatial_score(*n)) - 0.2708) < 1e-3
    assert one(spark, curation.confabulated_caption(F.col("t")), t="the mermaid swims") is False and one(spark, curation.confabulated_caption(F.col("t")), t="graph TD a-->b") is True
    assert one(spark, curation.degenerate_caption(F.col("t")), t="a b c d e f g h " * 5) is True and one(spark, curation.degenerate_caption(F.col("t")), t=" ".join(map(str, range(40)))) is False
    assert one(spark, logic.modality(F.col("t")), t="생략할 수 있다") == "exemption" and one(spark, logic.modality(F.col("t")), t="설치하여야 한다. 다만 사용할 수 있다") == "unknown"
    assert one(spark, logic.requirement_modality(F.lit("금지"), F.col("t")), t="설치하여야 한다") == "unknown" and one(spark, logic.requirement_modality(F.lit("금지"), F.col("t")), t="x") == "prohibition"
    assert one(spark, curation.mask_personal(F.col("t")), t="전화010-1234-5678번, 010-1234-5678 번") == "전화010-1234-5678번, <KR_PHONE> 번"


def test_answers_and_checks(spark):
    built = answers.build_answer({"decision": F.lit("금지되지 않음"), "evidence": answers.bullets(F.array(F.lit("a"), F.lit("")))})
    assert one(spark, built) == "근거:\n- a\n\n판단:\n금지되지 않음" and one(spark, answers.answer_label(built)) == "NOT_PROHIBITED" and one(spark, answers.format_score(built)) == 1.0
    assert one(spark, answers.build_answer({"decision": F.lit(" ")})) is None and one(spark, answers.display_label(F.lit("X"))) == "X"
    parsed = spark.range(1).select(answers.parse_answer(F.lit("판단: a\n근거: b\n판단: c")).alias("p")).first()["p"]
    assert (parsed["order"], parsed["bodies"], parsed["duplicates"]) == (["decision", "evidence"], ["a", "b"], ["decision"])
    assert abs(one(spark, verification.edit_similarity(F.lit("abcd"), F.lit("bcde"))) - 0.75) < 1e-9 and one(spark, verification.edit_similarity(F.lit("abcd"), F.lit("bc"))) == 0.5
    assert one(spark, verification.best_sentence(F.lit("이 문장은 두께에 관한 요건을 정한다. 이 문장은 높이에 관한 다른 요건을 정한다."), F.lit("높이에 관한"))).startswith("이 문장은 높이")


def test_graded_expansion(spark):
    body = lambda n, tables="": "y" * n + (retrieval.TABLES + tables if tables else "")
    parents = spark.createDataFrame([("p1", body(100)), ("p2", body(300, "t" * 900)), ("p3", body(5000, "u" * 500))], "chunk_id string, content string")
    child = [("p3", f"c{k}", str(k // 2), str(k), "text", k, f"path\n{'z' * 150}") for k in range(4)] + [("p1", "d", "", "", "text", 1, "path\nd"), ("p2", "e", "1", "", "text", 1, "path\ne")]
    children = spark.createDataFrame(child, "parent_chunk_id string, chunk_id string, paragraph_no string, item_no string, chunk_type string, chunk_order int, content string")
    got = {r["chunk_id"]: (r["level"], r["expanded"]) for r in retrieval.expand_graded(children, parents, children, 600).collect()}
    assert got["d"] == ("article", "y" * 100) and got["e"][0] == "article" and got["e"][1].endswith("(표 일부 생략 — 분량 제한)") and got["e"][1].startswith("y" * 300 + "\n\n[인용된 표]")
    assert got["c2"][0] == "paragraph" and got["c2"][1].startswith("path\n" + "z" * 150 + "\n" + "z" * 150 + "\n\n[인용된 표]\nuuu")
    tight = {r["chunk_id"]: r["level"] for r in retrieval.expand_graded(children, parents, children, 200).collect()}
    assert tight["c2"] == "item" and {r["chunk_id"]: r["level"] for r in retrieval.expand_graded(children, parents, children, 90).collect()}["c2"] == "leaf"


def test_trimming_keeps_order(spark):
    units = F.array(*[F.lit(c * 200) for c in "abcd"])
    text = F.array_join(units, "\n")
    trim = lambda limit, scores: one(spark, retrieval.trim_relevant(text, F.lit(limit), units, scores))
    scores = F.array(*[F.lit(float(s)) for s in (1, 9, 2, 8)])
    assert trim(500, scores) == "b" * 200 + f"\n{retrieval.GAP}\n" + "d" * 200 and trim(2000, scores) == "\n".join(c * 200 for c in "abcd")
    assert trim(250, scores) == "a" * 200 + "\n" + "b" * 49 and trim(500, F.lit(None).cast("array<double>"))[:3] == "aaa"


def test_references_edges(spark):
    rows = [("a", "1편_x", "rule", "1", "101", "", "2장 301.의 2항에 따른다. 9장 999. 도 본다"), ("b", "1편_x", "rule", "2", "301", "", "1. 하나\n2. 둘"), ("c", "1편_x", "rule", "3", "301", "", "저인화점연료선박규칙 1장 101.을 본다"), ("d", "저인화점연료선박규칙", "rule", "1", "101", "", "값")]
    articles = spark.createDataFrame(rows, "chunk_id string, source_file string, document_type string, chapter_no string, article_no string, article_title string, content string")
    assert [(r["chunk_id"], r["target"]) for r in references.chapter_references(articles).collect()] == [("a", "b")]
    assert [(r["chunk_id"], r["target"]) for r in references.named_document_references(articles).collect()] == [("c", "d")]
    assert references.cross_document_references(articles).count() == 0 and references.bare_references(articles.limit(0)).count() == 0


def test_triggers_and_distractors(spark):
    checks = spark.createDataFrame([("m", t, "drift") for t in (0, 100, 600, 1100, 1200)] + [("m", 50, "stable")], "baseline string, s long, verdict string").withColumn("at", F.timestamp_seconds("s"))
    got = [r["triggered"] for r in drift.retrain_triggers(checks).orderBy("at").collect()]
    assert got == [True, False, False, True, False, True]
    rules = spark.createDataFrame([(i, "KR", i % 4) for i in range(40)], "chunk_id int, publisher string, chapter int")
    rows = master.distractors(rules, 3, blocks=1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["chunk_id"], []).append(r["distractor"])
    assert len(by) == 40 and all(len(set(d)) == 3 and i not in d and sum(x % 4 == i % 4 for x in d) == 1 for i, d in by.items())
