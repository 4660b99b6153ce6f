"""Streams against the batch forms: triggers, growing files, the ingest register; table functions against columns."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html, table_functions
from corpusloom.operators.drift import retrain_triggers
from corpusloom.sources.tail import tail_jsonl
from corpusloom.streaming import ingest
from corpusloom.streaming.triggers import trigger_stream

CHECK = "baseline string, at timestamp, verdict string"


def checks(n=120, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c"]), f"2024-01-01 {k // 60 + 1:02d}:{k % 60:02d}:00", rng.choice(["drift", "drift", "stable", "started", "finished", "insufficient_sample"])) for k in range(n)]


def plain(rows, cooldown):
    out, state = [], {}
    for b, at, said in sorted(rows):
        last, running = state.get(b, (None, False))
        second = int(at[11:13]) * 3600 + int(at[14:16]) * 60
        goes = said == "drift" and not running and (last is None or second - last >= cooldown)
        if said in ("started", "finished"):
            running = said == "started"
        state[b] = (second if goes else last, running)
        out.append((b, at, said == "drift", goes))
    return sorted(out)


def told(df):
    return sorted((r["baseline"], str(r["at"]), r["drift"], r["triggered"]) for r in df.collect())


@pytest.mark.parametrize("cooldown", [0, 600, 4000])
def test_batch_triggers(spark, cooldown):
    rows = checks()
    df = spark.createDataFrame(rows, "baseline string, at string, verdict string").withColumn("at", F.col("at").cast("timestamp"))
    assert told(retrain_triggers(df.repartition(5), cooldown)) == plain(rows, cooldown)
    assert retrain_triggers(df.limit(0), cooldown).count() == 0


def test_stream_triggers_equal_the_batch_after_a_restart(spark, tmp_path):
    rows, source, out = checks(), tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def put(k, part):
        lines = "\n".join(json.dumps({"baseline": b, "at": at, "verdict": v}) for b, at, v in part)
        (tmp_path / f"part{k}").write_text(lines)
        os.utime(tmp_path / f"part{k}", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
        (tmp_path / f"part{k}").rename(source / f"{k:03d}.json")

    def run():
        stream = spark.readStream.schema(CHECK).option("maxFilesPerTrigger", 1).json(str(source))
        query = trigger_stream(stream, 600).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(3):
        put(k, rows[k * 30 : (k + 1) * 30])
    run()
    put(3, rows[90:])
    run()  # a new query from the same checkpoint: cooldowns of the first hold
    got = spark.read.parquet(str(out))
    assert told(got) == plain(rows, 600)
    assert sum(t for *_, t in told(got)) > 3


def test_growing_files_are_read_to_their_last_whole_line(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    first, second = folder / "a.jsonl", folder / "b.jsonl"
    (folder / "ignored.txt").write_text('{"k": 99}\n')

    def run():
        stream = tail_jsonl(spark, str(folder), "k int, text string", piece_bytes=50, max_bytes=400)
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        for _ in range(100):
            query.processAllAvailable()
            if query.lastProgress and query.lastProgress["numInputRows"] == 0:
                break
            time.sleep(0.1)
        query.stop()
        return sorted((r["k"], r["text"]) for r in spark.read.parquet(str(out)).collect())

    line = lambda k, n=5: json.dumps({"k": k, "text": "é" * n}, ensure_ascii=False)
    first.write_text("".join(line(k) + "\n" for k in range(20)) + line(20)[:10])
    want = [(k, "é" * 5) for k in range(20)]
    assert run() == want
    with first.open("a") as f:
        f.write(line(20)[10:] + "\n\n" + line(21, 300) + "\n" + line(22))
    second.write_text(line(100) + "\n")
    want += [(20, "é" * 5), (21, "é" * 300), (100, "é" * 5)]
    assert run() == sorted(want)
    with first.open("a") as f:
        f.write("\n")
    assert run() == sorted([*want, (22, "é" * 5)])


ROW = "doc_id string, version int, status string, sha string, error string, ord long"


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    path, dead = str(tmp_path / "register"), str(tmp_path / "dead")
    put = ingest.upsert(path, dead)
    batch = lambda rows: spark.createDataFrame(rows, ROW)
    state = lambda: sorted((r["doc_id"], r["version"], r["status"]) for r in ingest.current(spark, path).collect())
    letters = lambda: sorted((str(r["doc_id"]), r["reason"]) for r in spark.read.parquet(dead).collect())
    assert ingest.current(spark, path).count() == 0
    one = batch([("a", 1, "queued", "s1", None, 1), ("a", 1, "running", "s1", None, 2), ("b", 1, "done", "s", None, 1), (None, 1, "queued", None, None, 1), ("c", 1, "queued", "s", None, 1), ("c", 1, "queued", "s", None, 1)])
    put(one, 0)
    assert state() == [("a", 1, "running"), ("c", 1, "queued")]
    assert letters() == [("None", "invalid"), ("b", "nothing to done")]
    two = batch([("a", 1, "done", "s1", None, 3), ("a", 1, "queued", "s1", None, 4), ("a", 1, "running", "s1", None, 5), ("c", 1, "running", "s", None, 2), ("c", 1, "failed", "s", "boom", 3), ("a", 2, "queued", "s2", None, 1)])
    for _ in range(2):
        put(two, 1)
        assert state() == [("a", 1, "done"), ("a", 2, "queued"), ("c", 1, "failed")]
        assert letters() == [("None", "invalid"), ("a", "done to queued"), ("a", "queued to running"), ("b", "nothing to done")]
    put(one, 0)
    assert state() == [("a", 1, "done"), ("a", 2, "queued"), ("c", 1, "failed")]
    put(batch([("c", 1, "queued", "s", None, 9)]), 2)
    assert ("c", 1, "queued") in state()
    assert ingest.changes(spark, path).count() == 8


def test_failing_rows_are_worked_on_again(spark, tmp_path):
    path, bad = str(tmp_path / "register"), {"b"}
    work = lambda rows: rows.select("doc_id", "version", F.when(F.col("doc_id").isin(*bad) if bad else F.lit(False), "parse error").alias("error"))
    docs = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, version int")
    run = ingest.work_off(path, work)
    state = lambda: {(r["doc_id"], r["status"], r["error"]) for r in ingest.current(spark, path).collect()}
    for _ in range(2):
        run(docs, 0)
        assert state() == {("a", "done", None), ("b", "failed", "parse error")}
    bad.clear()
    run(docs, 1)
    assert state() == {("a", "done", None), ("b", "done", None)}
    assert ingest.changes(spark, path).where("epoch = 1").count() == 3


def test_transitions_as_columns(spark):
    names = [None, "queued", "running", "done", "failed", "cancelled"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = {(r["a"], r["b"]): r["ok"] for r in pairs.select("a", "b", ingest.allowed(F.col("a"), F.col("b")).alias("ok")).collect()}
    assert got == {(a, b): b in ingest.TRANSITIONS[a] for a in names for b in names}


def test_table_functions(spark):
    table_functions.register(spark)
    pages = [(1, "<table><tr><th>A<th>B</tr><tr><td>1<td>2</tr><tr><td>x<td></tr><tr><td colspan=2>all</tr><tr><td>A<td>b</tr></table>"), (2, None), (3, "no table"), (4, "<table><tr><td>only header</tr></table>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = [tuple(r) for r in spark.sql("SELECT page_id, r.* FROM {p}, LATERAL table_rows(html) r ORDER BY page_id, pos", p=df).collect()]
    assert got == [(1, 1, "A: 1 | B: 2"), (1, 2, "A: x"), (1, 3, "all"), (1, 4, "B: b")]
    grids = df.select("page_id", html.table_grid(F.coalesce("html", F.lit(""))).alias("g")).select("page_id", F.get("g", F.lit(0)).alias("h"), F.posexplode("g").alias("pos", "row")).where("pos > 0")
    assert got == sorted(tuple(r) for r in grids.select("page_id", "pos", html.row_text(F.col("h"), F.col("row")).alias("t")).collect())
    texts = spark.createDataFrame([(1, "SECTION 1\n1 General\n1.1 a\ntext"), (2, None)], "doc_id long, text string")
    chunks = spark.sql("SELECT doc_id, c.* FROM {t}, LATERAL chunk_units(doc_id, text, 'dnv') c ORDER BY chunk_order", t=texts).collect()
    assert [(r["chunk_level"], r["label"]) for r in chunks] == [("section", "1"), ("article", "1"), ("paragraph", "1.1")]
    windows = spark.sql("SELECT doc_id, w.* FROM {t}, LATERAL word_windows(text, 3, 1) w ORDER BY doc_id, pos", t=texts).collect()
    assert [(r["word_start"], r["text"]) for r in windows] == [(0, "SECTION 1 1"), (2, "1 General 1.1"), (4, "1.1 a text")]
