"""The stages keep what they must, each on its own input, and the whole equals the stages in a row."""

import os
import random

import pyarrow as pa
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_five_stages_in_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]


def test_stages_on_a_fixture(spark, tmp_path):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, item = words(90), words(30)
    near = list(base)
    near[50] = "zz"
    texts = [" ".join(base), " ".join(near), " ".join([*words(40), *item, *words(20)]), "plain words token: abcdef123 and more " + " ".join(words(30)), None, ""]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    stage = dict(corpus_pipeline.STAGES)
    kept = lambda name, d: stage[name](spark, d, str(tmp_path))
    assert kept("quality_classifier", docs).count() == 6
    assert sorted(r["doc_id"] for r in kept("ngram_jaccard_join", docs).collect()) == [0, 2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in kept("benchmark_decontamination", docs).collect()) == [0, 1, 3, 4, 5]
    red = {r["doc_id"]: r for r in kept("secret_scans", docs).collect()}
    assert red[3]["text"].startswith("plain words [SECRET] and more") and red[3]["n_chars"] == len(red[3]["text"]) and red[4]["text"] is None
    for name in list(stage)[:-1]:
        assert kept(name, docs).columns == docs.columns
        assert kept(name, docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want and 0 < len(want) <= 200


def test_workers_of_a_stage_give_memory_back(spark):
    """Workers kept what their largest batch took through all stages, and an executor went beyond its memory."""
    docs = spark.createDataFrame([(1, "plain words", "en", "s", 11)], SCHEMA)
    dict(corpus_pipeline.STAGES)["secret_scans"](spark, docs, SF).collect()

    def settings(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"v": [os.environ.get("MALLOC_TRIM_THRESHOLD_", "")] * batch.num_rows})

    assert {r["v"] for r in spark.range(2).mapInArrow(settings, "v string").collect()} == {"1048576"}
