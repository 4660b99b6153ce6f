"""Probes, references and swapped terms, against loops over the same texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import verification
from corpusloom.operators import probes, references

TEXT = "chunk_id string, content string"


def outline(content):
    first = second = None
    for pos, line in enumerate((content or "").split("\n")):
        if m := re.match(r"\s{0,3}(\d{1,2})\.\s", line):
            first, second = m.group(1), None
        elif m := re.match(r"\s{0,3}\((\d{1,2})\)\s?", line):
            second = m.group(1)
        elif (m := re.match(r"\s{0,3}\(([가-힣])\)\s?", line)) and first and second:
            yield pos, first, second, m.group(1), line.strip()[:300]


def texts(seed, n):
    rng = random.Random(seed)
    lines = ["1. 일반", "2. 적용 x", " 3. 구조", "(1) 첫째", "  (2) 둘째", "(가) 가", "(나)나", "    (다) 깊다", "text", "", "[인용된 표]", "12) no"]
    return [(f"c{k}", "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for k in range(n)] + [("null", None), ("empty", "")]


def test_outline_leaves_and_hierarchy(spark):
    rows = texts(1, 300)
    docs = spark.createDataFrame(rows, TEXT)
    got = sorted(tuple(r) for r in probes.outline_leaves(docs).collect())
    assert got == sorted((c, *leaf) for c, t in rows for leaf in outline(t))
    want = {}
    for c, t in rows:
        body = (t or "").split("[인용된 표]")[0]
        if leaf := next(outline(body), None):
            want[c] = (3, f"{leaf[1]}항 ({leaf[2]})호 ({leaf[3]})목", leaf[4])
            continue
        n1 = n2 = 0
        owner, ho = "1", None
        for line in body.split("\n"):
            if m := re.match(r"\s{0,3}(\d{1,2})\.\s", line):
                owner, n1 = m.group(1), n1 + 1
            elif m := re.match(r"\s{0,3}\((\d{1,2})\)\s?", line):
                n2 += 1
                ho = ho or (f"{owner}항 ({m.group(1)})호", line.strip())
        if n1 >= 2 and n2 >= 2:
            want[c] = (2, *ho)
    assert {r["chunk_id"]: tuple(r)[1:] for r in probes.hierarchy(docs).collect()} == want
    assert {d for d, *_ in want.values()} == {2, 3}


@pytest.mark.parametrize(
    "text,want",
    [
        ("판의 두께는 9 mm 이상이어야 한다.", (9.0, "mm", "gte", "이상", "m", "두께")),
        ("폭은 600 mm 미만이어서는 아니 된다.", (600.0, "mm", "gte", "이상", "m", "폭")),
        ("1,200 kW 초과의 출력을 가진다.", (1200.0, "kw", "gt", "초과", "mw", "출력")),
        ("다만, 높이를 낮출 경우에는 그 판은 2.4 m 이상이어야 한다.", (2.4, "m", "gte", "이상", "mm", "높이")),
        ("길이 150 m 미만의 선박에 적용한다.", None),
        ("두께가 9 mm 이하일 때에는 생략하여도 좋으며 그 밖에는 따른다.", None),
        ("높이가 1.5 m 이상인 스크린은 선루로 간주한다.", None),
        ("길이가 230 m 이상을 넘을 때에는 230 m 로 한다.", None),
        ("높이가 2 m 이상일 때 : 3", None),
        ("개구의 면적은 50 cm 이상이어야 한다.", None),
        ("크기는 600 mm × 600 mm 이상이어야 한다.", None),
        ("두께는 9 mm 이상으로 한다.\n두께가 9 mm 이하인 때", None),
        ("그것은 9 mm 이상이다.", None),
        ("두께는 다음 식에 따라 9 mm 이상이어야 한다.", None),
        ("두께는 9 mm² 이상, 9 mm3 이상", None),
        ("시간은 3 시간 이상으로 한다. 두께는 5 mm 이상으로 한다.", (3.0, "시간", "gte", "이상", "min", "시간")),
        ("길이 150 m 미만의 선박에서는 두께를 5 mm 이상으로 한다.", (5.0, "mm", "gte", "이상", "m", "두께")),
    ],
)
def test_thresholds_and_their_guards(spark, text, want):
    got = probes.threshold(text)
    assert (got and (*got[:5], got[6])) == want
    if want:
        assert got[5] == text[:300].split("\n")[0].strip()


def test_columns_of_probes(spark):
    rows = [
        ("a", "x $$a+b=c$$ y $$ $$ $$\n\\sum_i x_i$$ $$q$$ $$12345$$ $$99999$$"),
        ("b", "[인용된 그림] " + "설명 " * 30),
        ("c", "[인용된 그림] short"),
        ("d", "[인용된 표] <table><tr><th></th><th>두께</th><th>폭</th></tr><tr><td>1<td>2</tr><tr><td>3</tr></table>"),
        ("e", "[인용된 표] <table><tr><th>()</th><th></th><th>폭</th></tr><tr></tr><tr></tr></table>"),
        ("f", "판의 두께는 9 mm 이상이어야 한다."),
        ("g", None),
    ]
    got = {r["chunk_id"]: r for r in probes.probed(spark.createDataFrame(rows, TEXT)).collect()}
    assert got["a"]["formulas"] == ["$$a+b=c$$", "$$\n\\sum_i x_i$$", "$$12345$$"] and got["g"]["formulas"] == []
    assert got["b"]["figure_block"].startswith("[인용된 그림]") and got["c"]["figure_block"] is None and got["g"]["figure_block"] is None
    assert got["d"]["table_schema"]["n_rows"] == 3 and got["d"]["table_schema"]["header_cells"] == ["", "두께", "폭"]
    assert got["e"]["table_schema"] is None and got["g"]["table_schema"] is None
    assert got["f"]["unit_threshold"]["threshold"] == 9.0 and got["g"]["unit_threshold"] is None and got["a"]["unit_threshold"] is None


def listed(text):
    out, seen = [], set()
    for kind, pattern in references.CITED:
        for m in re.finditer(pattern, text):
            t = re.sub(r"\s+", " ", m.group()).strip(" ,.")
            if t and t not in seen:
                seen.add(t)
                out.append((kind, t))
    out.sort(key=lambda r: -len(r[1]))
    return [r for r in out if not any(r[1] != o[1] and r[1] in o[1] for o in out)]


def test_cited_targets(spark):
    rng = random.Random(3)
    parts = ["규칙 2편 1장 301.의 7항", "2편  1장 301.", "1장 301.의 7항", "104.의 3항", "표 2.1.1", "표 2.1", "그림 8.2", "SOLAS II-1/3-2, x", "MARPOL Annex VI", "IACS UR S10", "IACS Rec. 한글 12", "적용지침 2편 1장 203.의 1항", "지침 203.", "부록 1-2", "규칙 3장 2절 401.", "3.2편 1장 102.", "따른다", "\n", ", "]
    rows = [(f"c{k}", " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for k in range(200)] + [("null", None)]
    got = {r["chunk_id"]: [tuple(x) for x in r["x"]] for r in spark.createDataFrame(rows, TEXT).select("chunk_id", references.cited(F.col("content")).alias("x")).collect()}
    assert got == {c: listed(t or "") for c, t in rows}
    assert listed("규칙 2편 1장 301.의 7항과 2편 1장 301.") == [("internal_rule", "규칙 2편 1장 301.의 7항")]


def test_numbers_with_the_other_term(spark):
    article = "타두재가 없는 선박은 97 %로 하여야 한다. 타주가 있는 선박은 85 %로 한다.\nZb의 값은 1,250 이다.\n면재측 두께는 12 mm 이다.\n<table><tr><td>타두재 55 %</td></tr></table>"
    rows = [
        ("swapped", "?", "타주가 없는 선박은 97%이다."),
        ("right", "?", "타두재가 없는 선박은 97 %로 한다."),
        ("reference", "?", "타주는 97항에 따른다. 타주는 97. 조"),
        ("digit", "?", "타주가 9이다."),
        ("other number", "?", "타주가 있는 선박은 85 %이다."),
        ("symbol", "?", "Zs 는 1,250 이다."),
        ("side", "?", "부착판측 두께는 12 mm 이다."),
        ("table row", "?", "타주는 55 %이다."),
        ("null", None, None),
    ]
    made = spark.createDataFrame([(*r, article) for r in rows] + [("no article", "?", "타주 97 %", None)], "id string, q string, a string, t string")
    got = {r["id"]: [tuple(x)[:3] for x in r["x"]] for r in made.select("id", verification.numeric_term_mismatches(F.col("q"), F.col("a"), F.col("t")).alias("x")).collect()}
    assert ("타주가", "타두재가", "97%") in got["swapped"]
    assert got["symbol"] == [] and got["side"] == []
    for name in ("right", "reference", "digit", "other number", "table row", "null", "no article"):
        assert got[name] == [], name
