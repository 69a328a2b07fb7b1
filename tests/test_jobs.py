"""Index jobs, run listings, catalogs with runs: literal cases and odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from narrata.operators import jobs as J

JOBS = "book_id string, status string, stage string, message string, current long, total long, percent int, error string"


def test_job_views(spark):
    books = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "book_id string")
    jobs = spark.createDataFrame([("b", "running", "embed", "half", 2, 4, 50, None)], JOBS)
    j = J.with_defaults(books, jobs)
    index = spark.createDataFrame([("a", 7, "m"), ("c", 0, "m")], "book_id string, passage_count long, embedding_model string")
    got = {r.book_id: (r.status, r.message, r.current, r.percent) for r in J.status_view(j, index).collect()}
    assert got == {"a": ("done", "Passage index ready (7 passages)", 7, 100), "b": ("running", "half", 2, 50), "c": ("idle", "No passage index yet.", 0, 0)}
    done = J.completed(spark.createDataFrame([("a", -3, " "), ("b", 5, "m")], "book_id string, passage_count long, embedding_model string")).collect()
    assert [(r.message, r.embedding_model) for r in done] == [("Passage index ready (0 passages)", "unknown"), ("Passage index ready (5 passages)", "m")]
    assert [r.message for r in J.failed(spark.createDataFrame([("a", " "), ("b", "boom")], "book_id string, error string")).collect()] == ["Indexing failed", "boom"]
    assert J.with_defaults(books.where("false"), jobs).count() == 0


def test_run_folders(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [("out/a/status.json", t(1)), ("out/a/events.jsonl", t(5)), ("out2/b/chapters/001/x.wav", t(3)), ("out/c/events.jsonl", t(9)), ("library/runs/k/r/manifest.json", t(4)), ("elsewhere/z/status.json", t(8)), (None, t(8))]
    d = J.run_dirs(spark.createDataFrame(rows, "path string, modified timestamp"))
    assert sorted((r.path, r.updated_at.day, r.legacy) for r in d.collect()) == [("library/runs/k/r", 4, True), ("out/a", 5, False), ("out2/b", 3, True)]
    assert J.default_run(d).first().path == "out/a" and J.chosen_run(d, "out2/b").count() == 1
    assert J.default_run(d.where("false")).count() == 0


def test_chunk_reuse_and_live_order(spark):
    chunks = spark.createDataFrame([("a", 1, i) for i in range(1, 5)], "book_id string, chapter_index int, chunk_index int")
    files = spark.createDataFrame([("a", 1, "chunk-001.wav", 9), ("a", 1, "chunk-002.wav", 0), ("a", 1, "chunk-003.txt", 9), ("a", 2, "chunk-004.wav", 9)], "book_id string, chapter_index int, name string, size long")
    assert [r.chunk_index for r in J.chunk_reuse(chunks, files).where("reused").collect()] == [1]
    ready = chunks.withColumn("ready", F.col("chunk_index") != 3)
    assert sorted((r.chunk_index, r.position) for r in J.live_order(ready).collect()) == [(1, 1), (2, 2)]


def test_rewrites(spark):
    rows = [(" ", "d", "s", "p"), ("x", "d", "s", "p"), (None, "", "s", "p"), ("", "", "", "p")]
    df = spark.createDataFrame(rows, "a string, d string, s string, p string")
    got = [tuple(r.r) for r in df.select(J.rewritten(*[F.col(c) for c in "adsp"]).alias("r")).collect()]
    assert got == [("d", True), ("x", False), ("s", True), ("p", True)]


def test_sound_facts(spark):
    wav = bytes.fromhex("52494646") + (36 + 96000).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("100000000100010080bb000000770100") + bytes.fromhex("02001000") + b"data" + (96000).to_bytes(4, "little")
    df = spark.createDataFrame([(wav, '{"sample_rate": 22050}'), (b"RIFF", '{"audio": {"sample_rate": "16000"}}'), (None, "x"), (b"", '{"sampleRate": 0}')], "h binary, j string")
    got = df.select(J.wav_seconds(F.col("h")).alias("s"), J.sample_rate(F.col("j")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(1.0, 22050), (None, 16000), (None, None), (None, None)]
