"""Each family's own rules on a small book."""

import pytest

from corpusloom.operators import grammars

BLOCKS = "doc_id long, family string, pos int, page int, type string, level int, text string, html string, caption string"


def book(family, *blocks, doc=1):
    """Blocks as (text, level) or (text, level, type, page, html, caption)."""
    rows = []
    for i, b in enumerate(blocks):
        text, level, kind, page, html, caption = (*b, *(None, "text", 0, None, None)[len(b) - 1 :])
        rows.append((doc, family, i, page, kind, level, text, html, caption))
    return rows


def articles(spark, *books):
    rows = grammars.family_articles(spark.createDataFrame([r for b in books for r in b], BLOCKS))
    return {r["article_id"]: r for r in rows.collect()}


def test_kr_segments_are_mirrored(spark):
    blocks = book("kr", ("규칙 제 2 편", None), ("제 1 장 총칙", 1), ("101. 적용 ..... 3", 2), ("제 2 절 재료", 2), ("101. 용어의 정의", 2), ("말", None), ("지침 제 2 편", None), ("제 1 장 총칙", 1), ("제 2 절 재료", 2), ("머리말", None), ("101. 용어", 2), ("글", None), ("부록 1-17 그 밖", 2), ("101. 끝", 2), ("더", None))
    got = articles(spark, blocks)
    assert {k: r["text"] for k, r in got.items()} == {"1/rule/C1/S2/A101": "말", "1/guidance/C1/S2/AINTRO": "머리말", "1/guidance/C1/S2/A101": "글", "1/appendix/C1-17/A101": "더"}
    links = grammars.mirrored_articles(grammars.family_articles(spark.createDataFrame(blocks, BLOCKS))).collect()
    assert {(r["article_id"], r["mirror_id"]) for r in links} == {("1/rule/C1/S2/A101", "1/guidance/C1/S2/A101"), ("1/guidance/C1/S2/A101", "1/rule/C1/S2/A101")}


def test_kr_decimal_books_take_sections_from_running_heads(spark):
    clauses = [x for i in range(1, 13) for x in ((f"1.{i} 조항", 2, "text", 1 + i // 7), (f"본문 {i}", None, "text", 1 + i // 7))]
    got = articles(spark, book("kr", *clauses, ("11 편 1 장 1 절", None, "header", 1), ("1 부 2 장 3 절", None, "header", 2)))
    assert got["1/rule/C1/S1/A1.1"]["text"] == "본문 1" and got["1/rule/C1.2/S3/A1.12"]["text"] == "본문 12" and len(got) == 12


def test_nk_letters_and_stars(spark):
    got = articles(spark, book("nk", ("Contents", 1), ("1.1 of the contents", None), ("RULES FOR SHIPS", 1), ("Chapter 1 GENERAL", 1), ("1.1.1 Application*", 2), ("1 one", None), ("GUIDANCE FOR SHIPS", 1), ("K1 GENERAL", 1), ("K1.1.1 Application", 2), ("two", None)))
    assert {k: (r["text"], r["marked"], r["article_title"]) for k, r in got.items()} == {"1/rule/C1/A1.1.1": ("1 one", True, "Application"), "1/guidance/C1/A1.1.1": ("two", False, "Application")}


def test_lr_titles_watermarks_and_relaxed_clauses(spark):
    title = ("LR-RU-001 Rules, July 2024 - Part 3 Ship - Chapter 2 Materials - Section 4 Steel", 1)
    strict = book("lr", title, ("4.1 Grades", 2), ("4.1.1 first\nTaken from Regs4ships Ltd", None), ("r4s.oneocean.com", None), ("Section 5 Other", 2), ("5.1 More", 2), ("4.9 stays a text", None))
    relaxed = book("lr", title, ("4.1 Grades of steel\nand more", None), ("7.2 of another section", None), doc=2)
    got = articles(spark, strict, relaxed)
    assert {k: r["text"] for k, r in got.items()} == {"1/P3/C2/S4/A4.1": "4.1.1 first", "1/P3/C2/S5/A5.1": "4.9 stays a text", "2/P3/C2/S4/A4.1": "4.1 Grades of steel\nand more\n7.2 of another section"}
    assert got["2/P3/C2/S4/A4.1"]["article_title"] == "Grades of steel"


def test_dnv_numbers_restart_and_front_matter_goes(spark):
    got = articles(spark, book("dnv", ("FOREWORD", 2), ("words", None), ("SECTION 1 GENERAL", 1), ("1 Scope", 2), ("a", None), ("Contents", None), ("SECTION 2 MORE", 1), ("1 Scope", 2), ("b", None), ("x = y", None, "equation"), ("APPENDIX A END", 1), ("1 Scope", 2), (None, None, "table", 0, "<table/>", "Table 1"), ("1 Scope", 2), ("again", None)))
    assert {k: (r["text"], r["n_tables"]) for k, r in got.items()} == {"1/section/S1/A1": ("a", 0), "1/section/S2/A1": ("b\nx = y", 0), "1/appendix/SA/A1": ("", 1), "1/appendix/SA/A1~2": ("again", 0)}


def test_bv_contents_tables_and_leaves(spark):
    contents = "<table><tr><td>General 3</td><td>Hull 14</td></tr></table>"
    got = articles(spark, book("bv", ("1 too early", 2), ("Part A Ships", 1), ("Chapter 2 Hull", 1), ("Section 1 General", 2), (None, None, "table", 0, contents, "Section 1"), ("1 Group", 2), ("[1.1] The whole text is here", 2), ("1.2 Next", 2), ("body", None), (None, None, "table", 0, contents, "Table 1 : Loads")))
    assert {k: (r["text"], r["n_tables"]) for k, r in got.items()} == {"1/PA/C2/S1/A1.1": ("1.1 The whole text is here", 0), "1/PA/C2/S1/A1.2": ("body", 1)}
    assert articles(spark, book("bv", ("1. no band", None), ("1 Scope", 2), ("old note", None)))["1/A1"]["text"] == "old note"


def test_iacs_named_sections_years_and_running_heads(spark):
    got = articles(spark, book("iacs", ("G1.2 Scope of it", 2), ("1990 a year", 2), ("52 (cont)", None), ("(Rev.1", None), ("read No. 73 (cont) on", None), ("Interpretation:", 2), ("means this", None), ("Regulation 28.3", 2), ("text", None), ("G1 (cont)", 2), ("End of Document", None)))
    assert {k: r["text"] for k, r in got.items()} == {"1/AG1.2": "1990 a year\nread on", "1/AInterpretation": "means this", "1/A28.3": "text"}
    csr = articles(spark, book("iacs", ("Common Structural Rules", 1), ("CHAPTER 1 GENERAL", 1), ("1 Scope", 2), ("a", None), ("CHAPTER 2 MORE", 1), ("1 Scope", 2), ("b", None)))
    assert csr["1/C1/A1"]["text"] == "a" and csr["1/C2/A1"]["text"] == "b"


def test_abs_sections_by_page_spaced_capitals_and_dates(spark):
    got = articles(spark, book("abs", ("before", None, "text", 1), ("1 General", 2, "text", 1), ("text a", None, "text", 1), ("Section 1 Scope 3", None, "header", 1), ("S E C T I O N 2 Notations", 1, "text", 2), ("1.1 Marks (1 June 2025)", 2, "text", 2), ("12", None, "text", 2), ("text b", None, "text", 3), ("Appendix 1 Forms A1", None, "header", 4), ("1 Form", 2, "text", 4), ("text c", None, "text", 4)))
    assert {k: (r["text"], r["effective_date"]) for k, r in got.items()} == {"1/section/S1/A1": ("text a", None), "1/section/S2/A1.1": ("text b", "1 June 2025"), "1/appendix/S1/A1": ("text c", None)}


@pytest.mark.parametrize("family", grammars.FAMILIES)
def test_nothing_and_nulls(spark, family):
    assert articles(spark, book(family, (None, None), ("", 2), (None, 1))) == {}
    empty = spark.createDataFrame([], BLOCKS)
    assert grammars.family_articles(empty).count() == 0 and grammars.mirrored_articles(grammars.family_articles(empty)).count() == 0
