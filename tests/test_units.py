"""Units of articles, against a plain fold over their pieces."""

import random
import re

import pytest

from corpusloom.operators import units

PIECE = "art long, pos long, text string, page long"


def styles(t):
    for name, pattern in units.STYLES:
        if re.match(pattern, t):
            return name
    return None


def folded(pieces):
    """The rule said as a loop: what opens a unit, and what it inherits."""
    out, held = [], []
    scope = {"para": "", "title": "", "item_style": None, "sub_style": None, "item": "", "sub": ""}
    note = False
    after = True
    for place, (text, page) in enumerate(pieces):
        t = text or ""
        if re.match(units.NOTE, t):
            scope = dict(scope, para="Note", title="Note", item_style=None, sub_style=None, item="", sub="")
            note, after = True, True
            held.append((t, page))
            continue
        token, bare, hard = t.split()[0] if t.split() and not t[0].isspace() else "", re.match(units.BARE, t), re.match(units.DECIMAL, t)
        style, new = styles(t), None
        if hard or (bare and not note):
            line = t.split("\n", 1)[0]
            scope = {"para": token.rstrip("."), "title": re.sub(r"^\S+\s*", "", line).strip()[:70], "item_style": None, "sub_style": None, "item": "", "sub": ""}
            note = False
            new = (scope["para"], "", "")
        elif bare:
            scope["item"], scope["sub"] = token, ""
            new = (token, token, "")
        elif style:
            scope["item_style"] = scope["item_style"] or style
            if style == scope["item_style"]:
                scope.update(item=token, sub="", sub_style=None)
                new = (token, token, "")
            elif scope["sub_style"] in (None, style):
                scope.update(sub_style=style, sub=token)
                new = (token, scope["item"], token)
            else:
                new = (token, scope["item"], f"{scope['sub']}.{token}" if scope["sub"] else token)
        elif after:
            new = ("", "", "")
        if new:
            out.append([new[0], scope["para"], scope["title"], new[1], new[2], place, [*held, (t, page)]])
            held = []
        else:
            out[-1][-1].append((t, page))
        after = False
    if held:
        out.append(["", "Note", "Note", "", "", len(pieces), held])
    return [(k, *u[:5], "\n".join(t for t, _ in u[6]), u[5], len(u[6]), sorted({p for _, p in u[6] if p is not None})) for k, u in enumerate(out, 1)]


def resolved(spark, articles, parts=3):
    rows = [(a, pos, t, p) for a, pieces in articles.items() for pos, (t, p) in enumerate(pieces)]
    random.Random(1).shuffle(rows)
    got = {}
    for r in units.resolve_units(spark.createDataFrame(rows, PIECE).repartition(parts), ["art"], page="page").collect():
        got.setdefault(r["art"], []).append((r["unit"], r["heading"], r["para_no"], r["para_title"], r["item_no"], r["sub_item_no"], r["text"], r["first_piece"], r["n_pieces"], r["pages"]))
    return {a: sorted(u) for a, u in got.items()}


@pytest.mark.parametrize(
    "texts,want",
    [
        (["1. General Rules", "text", "(1) one", "(2) two"], [("1", "1", "", ""), ("(1)", "1", "(1)", ""), ("(2)", "1", "(2)", "")]),
        (["1) first", "a) below", "b) below", "2) next", "a) again"], [("1)", "", "1)", ""), ("a)", "", "1)", "a)"), ("b)", "", "1)", "b)"), ("2)", "", "2)", ""), ("a)", "", "2)", "a)")]),
        (["2.1 Scope of it", "(a) x", "(i) y", "1) deep", "(ii) z", "(b) w"], [("2.1", "2.1", "", ""), ("(a)", "2.1", "(a)", ""), ("(i)", "2.1", "(a)", "(i)"), ("1)", "2.1", "(a)", "(i).1)"), ("(ii)", "2.1", "(a)", "(ii)"), ("(b)", "2.1", "(b)", "")]),
        (["3 Strength", "Note:", "1 Loads are", "2 Plates are", "3.1 Next para"], [("3", "3", "", ""), ("1", "Note", "1", ""), ("2", "Note", "2", ""), ("3.1", "3.1", "", "")]),
        (["Note: alone"], [("", "Note", "", "")]),
        (["m. : a factor", "p. 45", "i. Word", "- dash"], [("", "", "", ""), ("i.", "", "i.", "")]),
        (["(가) 첫째", "(1) 아래", "(나) 둘째"], [("(가)", "", "(가)", ""), ("(1)", "", "(가)", "(1)"), ("(나)", "", "(나)", "")]),
    ],
)
def test_depths_follow_the_order_of_styles(spark, texts, want):
    got = resolved(spark, {1: [(t, None) for t in texts]})[1]
    assert [(u[1], u[2], u[4], u[5]) for u in got] == want
    assert got == folded([(t, None) for t in texts])


def test_a_label_goes_to_what_follows_it(spark):
    got = resolved(spark, {1: [("1 One para", 1), ("Note:", 2), ("running text", 3), ("Notes.", 4), ("Note:", 5), ("(1) a", 5), ("Note:", 6)]})[1]
    assert [u[6] for u in got] == ["1 One para", "Note:\nrunning text", "Notes.\nNote:\n(1) a", "Note:"]
    assert [u[9] for u in got] == [[1], [2, 3], [4, 5], [6]]
    assert got[-1][7] == 7


def test_random_articles_against_the_fold(spark):
    rng = random.Random(9)
    marks = ["1. General", "2.1 Scope", "2.1.1 a", "7 Plates", "(1) x", "(2) y", "(a) x", "(i) y", "(X) z", "(가) 가", "1) x", "12) y", "iv) x", "b) y", "i. Word", "c. Word", "m. : f", "- dash", "text", "Note: n", "NOTES. m", "", None, "3 가나", "\n4 x", "5"]
    articles = {a: [(rng.choice(marks), rng.choice([None, 1, 2, 3])) for _ in range(rng.randrange(1, 40))] for a in range(150)}
    articles[200] = [(rng.choice(marks), k) for k in range(3000)]
    assert resolved(spark, articles) == {a: folded(p) for a, p in articles.items()}
    assert units.resolve_units(spark.createDataFrame([], PIECE), ["art"]).count() == 0
