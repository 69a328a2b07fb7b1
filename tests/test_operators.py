import pytest
from pyspark.sql import functions as F

from narrata.functions import vectors as V
from narrata.operators import joins as J
from narrata.operators import library as B
from narrata.operators import memory as M
from narrata.operators import retrieval as A
from narrata.operators import runs as R
from narrata.operators import timeline as L


def test_timeline(spark):
    c = spark.createDataFrame([("b", 1, 10, 12.5), ("b", 2, 11, 30.0), ("b", 3, 12, 7.25), ("b", 4, 13, None), ("b", 5, 14, -1.0), ("c", 1, 15, 2.0)], "book_id string, chapter_index int, chapter_id long, duration_s double")
    t = L.timeline(c)
    assert [(r.start_s, r.end_s) for r in t.where("book_id = 'b'").orderBy("chapter_index").collect()] == [(0, 12.5), (12.5, 42.5), (42.5, 49.75), (None, None), (None, None)]
    p = spark.createDataFrame([("x", "b", 12.5), ("y", "b", 0.0), ("z", "c", 9.0), ("w", "b", 99.0), ("v", "d", 1.0)], "point_id string, book_id string, abs_time_s double")
    got = {r.point_id: (r.chapter_index, r.chapter_time_s) for r in L.chapter_at(p, t).collect()}
    # The last chapter of b has no offsets, so times past the end find nothing.
    assert got == {"x": (2, 0.0), "y": (1, 0.0), "z": (1, 2.0), "w": (None, None), "v": (None, None)}
    marks = L.ffmetadata_marks(spark.createDataFrame([("b", 1, 0.0001), ("b", 2, 1.5)], "book_id string, chapter_index int, duration_s double")).orderBy("chapter_index").collect()
    assert [(r.start_ms, r.end_ms) for r in marks] == [(0, 1), (1, 1501)]


def test_client_timeline(spark):
    rows = [("b", 1, 1, 10.0, None, None), ("b", 2, 2, 5.0, 100.0, None), ("b", 3, 3, 5.0, 20.0, 30.0), ("b", 4, 4, 5.0, None, None), ("b", 5, 5, 0.0, 7.0, None)]
    c = spark.createDataFrame(rows, "book_id string, chapter_index int, chapter_id long, duration_s double, given_start_s double, given_end_s double")
    got = {r.chapter_id: (r.start_s, r.end_s) for r in L.client_timeline(c).collect()}
    assert got == {1: (0, 10), 2: (100, 105), 3: (20, 30), 4: (105, 110), 5: (7, None)}


def test_playlists(spark):
    c = spark.createDataFrame([("b", 1, 1, 3, 2.2), ("b", 1, 2, 3, None), ("b", 1, 3, 3, 1.0)], "book_id string, chapter_index int, chunk_index int, chunk_total int, duration_s double")
    e = L.with_gaps(c)
    assert [r.name for r in e.orderBy("pos").collect()] == ["chapter-001-gap-000.aac", "chunk-001.aac", "chapter-001-gap-001.aac", "chunk-003.aac"]
    text = L.playlists(e, ["book_id", "chapter_index"], finished=True).first().text
    assert text.startswith("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:3\n") and "#EXTINF:0.450,\n" in text and text.endswith("#EXT-X-ENDLIST\n")
    again = spark.createDataFrame([(text,), ("#EXTM3U\n",)], "t string").select(L.finalized(F.col("t")).alias("t")).collect()
    assert again[0].t == text and again[1].t == "#EXTM3U\n#EXT-X-ENDLIST\n"


CASES = [
    ([("s1", 3)], [("chapters/s1/chunk-00%d.wav" % i, 9) for i in (1, 2, 3)] + [("s1.wav", 1), ("s1.m4a", 1)], {1}),
    ([("s1", 3)], [("chapters/s1/chunk-001.wav", 9), ("s1.m4a", 1)], set()),
    ([("s1", 2)], [("chapters/s1/chunk-001.wav", 9), ("chapters/s1/chunk-002.wav", 9), ("chapter-001.m3u8", 5)], {1}),
    ([("new", 3)], [("chapters/old/chunk-00%d.wav" % i, 9) for i in (1, 2, 3)] + [("chapters/new/chunk-001.wav", 9), ("old.m4a", 1)], set()),
    ([("s1", 1)], [("chapters/s1/chunk-001.wav", 0), ("s1.m4a", 1)], set()),
]


@pytest.mark.parametrize(("expected", "files", "want"), CASES)
def test_resume(spark, expected, files, want):
    e = spark.createDataFrame([("b", i + 1, *x) for i, x in enumerate(expected)], "book_id string, chapter_index int, slug string, total_chunks int")
    f = spark.createDataFrame([("b", *x) for x in files], "book_id string, path string, size long")
    assert {r.chapter_index for r in J.resumable(e, f).collect()} == want


def test_titles(spark):
    toc = spark.createDataFrame([("b", 0, "text/a.xhtml#x", " Chapter  1 ", None), ("b", 1, "text/a.xhtml", "Later", None), ("b", 2, "c.xhtml", "Link", "Section")], "book_id string, pos int, href string, label string, section_title string")
    docs = spark.createDataFrame([("b", "text/a.xhtml"), ("b", "other/c.xhtml"), ("b", "z.xhtml")], "book_id string, source string")
    assert {r.source: r.toc_title for r in J.toc_titles(docs, toc).collect()} == {"text/a.xhtml": "Chapter 1", "other/c.xhtml": "Section", "z.xhtml": None}
    c = spark.createDataFrame([("b", 1, 1, "Benn_978_epub_c11_r1", "t/Benn_978_epub_c11_r1.html", "001-benn-978-epub-c11-r1"), ("b", 2, 2, "Own", "q.html", "002-own"), ("b", 3, 3, "Benn_978_epub_c12_r1", "r.html", "003-x")], "book_id string, chapter_id long, chapter_index int, title string, source string, slug string")
    titles = spark.createDataFrame([("b", "Benn_978_epub_c11_r1", "Chapter 1: Westward")], "book_id string, key string, title string")
    assert [r.display_title for r in J.display_titles(c, titles).orderBy("chapter_id").collect()] == ["Chapter 1: Westward", "Own", "Chapter 3"]


def test_selection_and_citations(spark):
    c = spark.createDataFrame([(i,) for i in range(1, 20)], "chapter_index int")
    assert sorted(r[0] for r in J.selected_chapters(c, "5-7, 1,3,12-10").collect()) == [1, 3, 5, 6, 7, 10, 11, 12]
    cit = spark.createDataFrame([("b", "Chapter 1"), ("b", "the CHAPTER 2: end"), ("b", None), ("z", "Chapter 1")], "book_id string, chapter string")
    toc = spark.createDataFrame([("b", 1, "a", "Chapter 1: Start"), ("b", 2, "c", "chapter 2"), ("b", 3, "d", "")], "book_id string, pos int, href string, label string")
    assert {(r.book_id, r.chapter): r.toc_href for r in J.citation_targets(cit, toc).collect()} == {("b", "Chapter 1"): "a", ("b", "the CHAPTER 2: end"): "c", ("b", None): None, ("z", "Chapter 1"): None}


def test_library(spark):
    b = spark.createDataFrame([("1", "A", 1.5, True), ("2", "B", 2.5, None)], "id string, title string, n double, favorite boolean")
    p = spark.createDataFrame([("1", None, True, "x", True), ("2", "Z", False, "7", True)], "id string, title string, set_title boolean, n string, set_n boolean")
    assert [tuple(r) for r in B.patched(b, p, ["title", "n"]).orderBy("id").collect()] == [("1", None, 1.5, True), ("2", "B", 7.0, None)]
    s = spark.createDataFrame([("  bm_fable ", "full", None), (None, "not-valid", "small")], "kokoro_voice string, rewrite_policy string, output_retention string")
    assert [tuple(r)[:4] for r in B.settings(s).collect()] == [("bm_fable", "full", "delete_intermediates_after_complete", 2), ("af_heart", "script-only", "small", 2)]
    n = spark.createDataFrame([([("1", "a"), ("2", "b")],)], "notes array<struct<id:string,text:string>>")
    r = n.select(B.removed(F.col("notes"), F.lit("1")).alias("a"), B.replaced_text(F.col("notes"), F.lit("2"), F.lit("new")).alias("b"), B.appended(F.col("notes"), F.struct(F.lit("3").alias("id"), F.lit("c").alias("text"))).alias("c")).first()
    assert [x.id for x in r.a] == ["2"] and [x.text for x in r.b] == ["a", "new"] and len(r.c) == 3
    i = spark.createDataFrame([([(None, "9781234567890"), ("ISBN", "x"), ("DOI", "10.1"), (None, "abc")],)], "e array<struct<scheme:string,value:string>>").select(B.identifiers(F.col("e")).alias("m")).first().m
    assert i == {"isbn": "9781234567890", "doi": "10.1", "id": "abc"}
    m = spark.range(1).select(B.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"), F.lit("c"), F.lit(None).cast("string"))).alias("m")).first().m
    assert m == {"a": "9", "b": "2"}
    k = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0000"),), (bytearray(b"GIF89a"),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"\xff\xd8"),)], "d binary").select(B.cover_type(F.col("d")).alias("k")).collect()
    assert [r.k for r in k] == ["png", "gif", "webp", "jpg"]


def test_memories(spark):
    schema = "memory_id string, text string, source string, title string, question string, action string, citations array<struct<passage_id:string,chapter:string,snippet:string,source:string,href:string,chapter_index:int,chunk_index:int>>"
    rows = [("1", " t ", "user", " ", None, "x ", [("p", " ", "s" * 1200, None, None, None, None), (None, " ", None, None, None, None, None)]), ("2", "t", "bogus", None, None, None, None), ("3", " ", "user", None, None, None, None), ("4", "t", "insight", None, None, None, [(None, None, None, None, None, None, None)])]
    got = {r.memory_id: r for r in M.saved(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"1", "4"} and got["1"].text == "t" and got["1"].title is None and got["1"].action == "x"
    assert len(got["1"].citations) == 1 and len(got["1"].citations[0].snippet) == 1000 and got["4"].citations is None


def test_retrieval(spark):
    t = spark.createDataFrame([("p0", "discipline and habits"), ("p1", "sleep and recovery"), ("q", "building discipline through habits"), ("e", ""), ("u", "世界")], "id string, t string").select("id", V.hash_embedding(F.col("t"), 8).alias("v"))
    v = {r.id: r.v for r in t.collect()}
    assert abs(sum(x * x for x in v["p0"]) - 1) < 1e-9 and len(v["e"]) == 8 and any(v["u"])
    p = spark.createDataFrame([("p0", "b", 0, "c", "text", v["p0"]), ("p1", "b", 1, "c", "text", v["p1"]), ("p2", "b", 2, "c", "text", None), ("p3", "b", 3, "c", "text", [1.0])], "id string, book_id string, pos long, chapter string, text string, embedding array<double>")
    q = spark.createDataFrame([("q", "b", v["q"])], "query_id string, book_id string, q array<double>")
    top = A.ranked(q, p, 1).first()
    assert top.id == "p0" and top.score > 0.5
    assert A.ranked(q, p, 9).count() == 3
    asked = spark.createDataFrame([("q", " Why? ", "socratic"), ("none", "Why?", None)], "query_id string, question string, action string")
    d = {r.query_id: r.draft for r in A.drafts(asked, A.ranked(q, p, 3)).collect()}
    assert d["none"] == A.NO_HITS and "Question: Why?" in d["q"] and d["q"].count("What would change") == 2
    pr = {r.query_id: r.prompt for r in A.prompts(asked, A.ranked(q, p, 3)).collect()}
    assert "(No passages retrieved.)" in pr["none"] and "[p0] (c)\ntext" in pr["q"] and "Answer mode: socratic" in pr["q"]


def test_runs(spark):
    e = spark.createDataFrame([("r", i, f'{{"n":{i}}}' if i != 3 else "{bad") for i in range(60)], "run string, pos int, line string")
    assert len(R.tail_or_nothing(e, "run", "pos", "line", 40).first().events) == 40
    assert R.tail_or_nothing(e, "run", "pos", "line", 60).first().events == []
    j = spark.createDataFrame([("b", "idle", "", "", 0, 4)], "book_id string, status string, stage string, message string, current int, total int")
    u = spark.createDataFrame([("b", "running", None, None, 2, None)], j.schema)
    assert R.upsert_job(j, u).first().percent == 50
    f = spark.createDataFrame([("b", "c", n, s) for n, s in (("1.txt", 0), ("1.wav", 5), ("1-gap.wav", 5), ("2.txt", 3))], "book_id string, chapter string, name string, size long")
    r = R.rollup(f).first()
    assert (r.n_txt, r.n_wav, r.n_empty, r.n_total) == (2, 1, 1, 2)


def test_player(spark):
    from narrata.functions import labels as B
    from narrata.operators import player as P

    e = spark.createDataFrame([("u", t) for t in (0, 1000, 4900, 5100, 7300, 12_400, 13_000)], "u string, ms long").select("u", F.timestamp_millis("ms").alias("ts"))
    # 5,100 comes less than 5,000 after the first save was written (2,200), 7,300 does not.
    assert [(r.ms, r.saved_ms) for r in P.throttled(e, "u", "ts").orderBy("ms").collect()] == [(0, 2200), (7300, 9500)]
    c = spark.createDataFrame([("b", 0, "x.png", 9000, False, False, True), ("b", 1, "Front.jpg", 6000, False, False, True), ("c", 0, "a.jpg", 10, False, False, True), ("c", 1, "b.jpg", 20, False, False, True), ("d", 0, "a", 1, False, True, False), ("d", 1, "b", 1, True, False, False)], "book_id string, item_pos int, name string, size long, is_cover boolean, is_meta_cover boolean, is_image boolean")
    assert {r.book_id: r.name for r in P.covers(c).collect()} == {"b": "Front.jpg", "c": "b.jpg", "d": "b"}
    r = spark.createDataFrame([("/api/library", None), ("/media", "a/b.EPUB"), ("/media", "a.png"), ("/assets/x.js", None), ("/", None)], "p string, m string").select(B.cache_route(F.col("p"), F.col("m")).alias("k")).collect()
    assert [x.k for x in r] == ["network_first", "cache_first", "network_first", "cache_first", "network_first"]
    v = B.voices(spark).collect()
    assert len(v) == 54 and v[3].label == "Af Heart — American English · Female"
    i = spark.createDataFrame([("a/b",), ("a",), ("ab",), ("a/../b",)], "p string").select(B.inside(F.col("p"), F.lit("a")).alias("k")).collect()
    assert [x.k for x in i] == [True, True, False, False]
    assert P.cache_sizes(spark.createDataFrame([("p", 2), ("p", 3), ("q", None)], "cache string, bytes long")).where("cache = 'p'").first().bytes == 5
    pts = spark.createDataFrame([("1", "book", 2, 90.0, 1, 5.0, None), ("2", "chapter", 2, 90.0, 1, 5.0, None), ("3", "chapter", 1, None, 1, 5.0, None), ("4", "chapter", 9, 90.0, 1, 5.0, None)], "point_id string, transport string, chapter_index int, abs_time_s double, saved_chapter int, saved_time_s double, saved_abs_s double")
    at = spark.createDataFrame([("2", 2, 30.0), ("4", 2, 30.0)], "point_id string, chapter_index int, chapter_time_s double")
    assert {x.point_id: x.resume_s for x in P.resume_times(pts, at).collect()} == {"1": 90.0, "2": 30.0, "3": 5.0, "4": None}
    f = spark.range(1).select(B.fingerprint(F.lit("p"), F.lit(None).cast("long"), F.lit(None).cast("timestamp")).alias("a"), B.metrics(F.lit(0), F.lit(0)).alias("m")).first()
    assert f.a == "p|missing" and f.m.percent == 0.0
