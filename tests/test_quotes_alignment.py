"""Spans of quotes, snapped quotes and alignments against plain searches."""

import hashlib
import random
from difflib import SequenceMatcher

import pytest

from corpusloom.operators import alignment, quotes

ROW = "quote string, article_text string, chunk_id string, snapped string"
ARTICLE = "1. 판두께는  9 mm 이상으로\n하여야 한다. The plate thickness is not to be less than 9 mm. 다만, 선장이 인정하는 경우에는 그러하지 아니하다."


def plain_span(quote, text):
    """Every window of the text, from the shortest, white space aside."""
    if quote in text:
        return text.index(quote), text.index(quote) + len(quote)
    flat = "".join(quote.split())
    for i in range(len(text)):
        if text[i].isspace():
            continue
        for j in range(i + 1, len(text) + 1):
            if not text[j - 1].isspace() and "".join(text[i:j].split()) == flat:
                return i, j
    return -1, -1


def test_spans_against_every_window():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n　é") for _ in range(rng.randrange(1, 30)))
        a, b = sorted(rng.sample(range(len(text) + 1), 2)) if len(text) > 1 else (0, 1)
        quote = rng.choice([" ", "\n", ""]).join(text[a:b].split()) or "a"
        assert quotes.find_span(quote, text) == plain_span(quote, text)


@pytest.mark.parametrize(
    "quote,want",
    [
        ("판두께는 9 mm 이상으로 하여야 한다", "판두께는  9 mm 이상으로\n하여야 한다"),
        ("판두께는 ... 하여야 한다", "판두께는  9 mm 이상으로\n하여야 한다"),
        ("하여야 한다 … 판두께는", None),
        ("The plate…less than 9 mm", "The plate thickness is not to be less than 9 mm"),
        ("", None),
        ("   ", None),
    ],
)
def test_spans_of_quotes(quote, want):
    a, b = quotes.find_span(quote, ARTICLE)
    assert (ARTICLE[a:b] if a >= 0 else None) == want


def plain_snap(quote, text):
    hay = [(c, i) for i, c in enumerate(text) if not c.isspace()]
    needle = "".join(quote.split())
    if len(needle) < 10 or not hay:
        return None
    blocks = [b for b in SequenceMatcher(None, "".join(c for c, _ in hay), needle, autojunk=False).get_matching_blocks() if b.size >= 4]
    if not blocks or sum(b.size for b in blocks) < 0.85 * len(needle):
        return None
    first, last = blocks[0].a, blocks[-1].a + blocks[-1].size
    return text[hay[first][1] : hay[last - 1][1] + 1] if last - first <= 1.5 * len(needle) else None


def test_snapping_takes_the_articles_wording():
    rng = random.Random(7)
    words = ARTICLE.split() + ["thickness", "선장이", "plates"]
    hits = 0
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(40))
        a = rng.randrange(len(text) - 30)
        quote = list(text[a : a + rng.randrange(12, 60)])
        for _ in range(rng.randrange(4)):
            quote[rng.randrange(len(quote))] = rng.choice("xyz가 ")
        got = quotes.snap("".join(quote), text)
        assert got == plain_snap("".join(quote), text)
        hits += got is not None
    assert hits > 100


def test_evidence_of_rows(spark):
    rows = [
        ("판두께는 9 mm 이상으로 하여야 한다.", ARTICLE, "KR_RULE_P10_C7_S1"),
        ("판두깨는 9 mm 이상으로 하여야 한다. The plate thickness", ARTICLE, "x"),
        ("The plate thickness", ARTICLE, None),
        ("nothing of this kind is here", ARTICLE, "LR_RULE_A_RULE_B"),
        (None, ARTICLE, "x"),
        ("", ARTICLE, "x"),
        ("short", None, "x"),
        ("😀 b", "a 😀  b c", "x"),
    ]
    docs = spark.createDataFrame([(*r, "own") for r in rows], ROW)
    got = quotes.evidence_meta(docs).collect()
    assert [r["snapped"] for r in got] == ["own"] * len(rows)
    for r, (quote, text, _) in zip(got, rows, strict=True):
        start, end = quotes.find_span(quote, text) if quote and text else (-1, -1)
        if start < 0 and quote and text and (snapped := plain_snap(quote, text)):
            assert r["quote_snapped"] and r["quote"] == snapped and r["quote_raw"] == quote
            start, end = text.index(snapped), text.index(snapped) + len(snapped)
        else:
            assert not r["quote_snapped"] and r["quote"] == quote and r["quote_raw"] is None
        assert (r["char_start"], r["char_end"]) == (start, end)
        flat = "".join((r["quote"] or "").split())
        assert r["normalized_quote"] == flat and r["quote_hash"] == (hashlib.sha1(flat.encode()).hexdigest()[:12] if flat else "")
    assert got[1]["quote_snapped"] and [r["provision_id"] for r in got[:4]] == ["KR:P10:C7:S1", "", "", "LR:A:RULE:B"]
    hangul, latin = sum("가" <= c <= "힣" for c in ARTICLE), sum(c.isascii() and c.isalpha() for c in ARTICLE)
    assert got[0]["evidence_language"] == ("ko" if hangul >= latin else "en") and got[6]["evidence_language"] == "unknown"
    assert got[7]["char_end"] == 6


def words(rng, n):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_rising_chain_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        pairs = [(i, rng.randrange(12)) for i in range(rng.randrange(0, 14))]
        best = [1] * len(pairs)
        for i in range(len(pairs)):
            best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
        got = alignment.rising(pairs)
        assert len(got) == max(best, default=0)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_units_find_their_blocks():
    rng = random.Random(5)
    blocks = [words(rng, rng.randrange(6, 20)) for _ in range(60)]
    units, want, i = [], [], 0
    while i < len(blocks):
        n = min(rng.randrange(1, 4), len(blocks) - i)
        units.append("\n".join(blocks[i : i + n]))
        want.append((i, i + n - 1, "whole"))
        i += n
    assert alignment.place_units(units, blocks) == want
    marked = [f"## {b} $x$ ![i](u)" for b in blocks]
    assert [p[:2] for p in alignment.place_units(units, marked)] == [p[:2] for p in want]


def test_repeated_blocks_go_in_order_and_moved_ones_are_found():
    rng = random.Random(6)
    a, b, c, d = (words(rng, 12) for _ in range(4))
    same = "the same heading"
    blocks = [a, same, b, same, c, same, d]
    units = [a, same, b, same, c, same, d]
    assert [p[0] for p in alignment.place_units(units, blocks)] == list(range(7))
    # A short unit that stands far ahead only must not carry the cursor past what follows it.
    assert [p[0] for p in alignment.place_units([a, d[:12], b, c, d], [a, b, c, d])] == [0, 3, 1, 2, 3]
    # One unit of the end of the source comes first: the others keep their order.
    got = alignment.place_units([d, a, b, c], [a, b, c, d])
    assert [p[0] for p in got] == [3, 0, 1, 2]
    # Changed after its beginning, and not there at all.
    got = alignment.place_units([a, b[:40] + " changed and longer than before", "nowhere at all, this one", c], [a, b, c])
    assert [p and p[0] for p in got] == [0, 1, None, 2] and got[1][2] == "begins"
    assert alignment.place_units(["", "x y z"], []) == [None, None]


def test_documents_are_aligned_each_by_itself(spark):
    rng = random.Random(8)
    texts = {d: [words(rng, 8) for _ in range(10)] for d in range(5)}
    units = spark.createDataFrame([(d, f"{d}-{k}", k, t) for d, ts in texts.items() for k, t in enumerate(ts)] + [(9, "9-0", 0, "no source"), (None, "n", 0, None)], "doc_id long, unit_id string, ord long, text string")
    sources = spark.createDataFrame([(d, "\n\n".join(ts)) for d, ts in texts.items()] + [(7, None)], "doc_id long, text string")
    got = {r["unit_id"]: (r["doc_id"], r["first_block"], r["last_block"], r["how"]) for r in alignment.align_units(units, sources).collect()}
    assert got == {f"{d}-{k}": (d, k, k, "whole") for d in texts for k in range(10)} | {"9-0": (9, None, None, None), "n": (None, None, None, None)}


def test_source_blocks_part_at_blank_lines_and_numbers():
    assert alignment.source_blocks("a\nb\n\nc\n(1) d\n e\n- f\n\n\n") == ["a\nb", "c", "(1) d\n e", "- f"]
