"""Figures, formulas and logs on small fixtures."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import layout

FIGURE = "doc_id long, seq long, page long, anchor long, captions array<string>, footnotes array<string>, img_path string, content string, sub_type string"


def test_fragments_merge_around_one_number(spark):
    rows = [
        (1, 0, 1, 4, ["5%", "same note"], ["f1"], "a.png", " left ", None),
        (1, 1, 1, 4, ["Fig. 3 Curves", "same note"], None, "b.png", None, "chart"),
        (1, 2, 1, 5, ["Figure 4"], [], "c.png", "x", None),
        (2, 0, 1, 1, ["Figure 5.4 Figure 5.5"], [], "d.png", "", None),
        (2, 1, 1, 1, None, None, "e.png", None, None),
        (3, 0, None, 1, ["panel"], [], "f.png", "", None),
        (3, 1, None, 1, ["표 2"], [], "", "", None),
    ]
    got = {(r["doc_id"], r["seq"]): r for r in layout.merge_figure_fragments(spark.createDataFrame(rows, FIGURE)).collect()}
    assert sorted(got) == [(1, 0), (1, 2), (2, 0), (2, 1), (3, 0)]
    first = got[1, 0]
    assert first["captions"] == ["5% same note Fig. 3 Curves"] and first["img_path"] == "b.png" and first["img_paths"] == ["a.png", "b.png"]
    assert first["content"] == "left" and first["footnotes"] == ["f1"] and first["sub_type"] == "chart" and first["n_parts"] == 2
    assert got[1, 2]["captions"] == ["Figure 4"] and got[1, 2]["img_paths"] is None
    assert got[2, 1]["captions"] is None and got[2, 0]["n_parts"] == 1
    assert got[3, 0]["img_path"] == "" and got[3, 0]["img_paths"] == ["f.png"]
    assert layout.merge_figure_fragments(spark.createDataFrame([], FIGURE)).count() == 0


def test_atoms_stand_before_the_text_of_their_place(spark):
    kind = "doc_id long, pos long, seq long, content string"
    texts = spark.createDataFrame([(1, 0, 0, "t0"), (1, 2, 1, "t2")], kind)
    atoms = spark.createDataFrame([(1, 2, 0, "a"), (1, 2, 1, "b"), (1, 9, 2, "c"), (2, 0, 0, "d")], kind)
    got = layout.interleave(texts, atoms).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["ord"], r["content"]) for r in got] == [(1, 0, "t0"), (1, 1, "a"), (1, 2, "b"), (1, 3, "t2"), (1, 4, "c"), (2, 0, "d")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("no formula a b", "no formula a b"),
        ("$ t _ {a s - b u i l t} $", "$t_{as-built}$"),
        ("at $1 . 8 \\times 1 0 ^ {6}$ or", "at $1.8\\times10^{6}$ or"),
        ("$$\\frac {a} {b}$$", "$$ \\frac{a}{b} $$"),
        ("$\\alpha x + \\beta 2$", "$\\alpha x+\\beta2$"),
        ("$\\text {two words a b} = x$", "$\\text{two words ab}=x$"),
        ("$면 적 = 전체 비율$", "$면적=전체 비율$"),
        ("5 $ and no end", "5 $ and no end"),
        ("a $$x\ny$$ b $ p q $", "a $$ xy $$ b $pq$"),
        ("", ""),
        (None, None),
    ],
)
def test_formula_spaces(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(layout.tidy_math(F.col("t"))).first()[0] == want


def test_loss_and_stats_of_logs(spark):
    lines = [
        ("r", 1, "loading"),
        ("r", 2, " {'loss': 1.23456, 'epoch': 0.5}"),
        ("r", 3, "{'eval_loss': 9.0}"),
        ("r", 4, "{'loss': 2e-05, 'grad': nan}"),
        ("r", 5, "{'loss': nan}"),
        ("r", 6, "x {'loss': 3.0}"),
        ("r", 7, None),
        ("r", 8, "{'loss': 1.2.3}"),
        ("s", 1, "{'trainable_params': 10, 'all': 100}"),
        ("s", 2, "{'adapter_delta_norm': 0.25, 'trainable_params': 12}"),
        ("s", 3, "{'other': 1}"),
    ]
    df = spark.createDataFrame(lines, "run_id string, ord long, line string")
    assert sorted(tuple(r) for r in layout.loss_curve(df).collect()) == [("r", 1, 1.2346, 0.5), ("r", 2, 0.0, None)]
    assert sorted(tuple(r) for r in layout.train_stats(df).collect()) == [("s", "adapter_delta_norm", "0.25"), ("s", "all", "100"), ("s", "trainable_params", "12")]
