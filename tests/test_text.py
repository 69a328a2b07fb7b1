import pytest
from pyspark.sql import functions as F

from narrata.functions import chunking as K
from narrata.functions import classify as C
from narrata.functions import html as H
from narrata.functions import text as T


def one(spark, col, value, type_="string"):
    return spark.createDataFrame([(value,)], f"t {type_}").select(col(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.CLEANUP, " a\xa0 b\t c\n\n\n\nd ", "a b c\n\nd"),
        (T.NARRATION, "Well , ( as he said ) [ so ] it is .", "Well, (as he said) [so] it is."),
        (T.SANITIZE, "He spoke. *brief pause* Then (short pause here) [sigh] a tiny pause came. _Yes_ *no* .", "He spoke. Then a came. Yes no."),
        (T.GLOSSARY, "She had read it. Had READ by them; is read, bread by me. As you read the page.", "She had red it. had red by them; is red, bread by me. as you red the page."),
        (T.normalize_text, "A wrap-\nped line\nends.\r\n\r\n12\n\nNext\tpara", "A wrapped line ends.\n\nNext para"),
        (T.slugify, "  Äny -- Title: 2! ", "ny-title-2"),
        (T.slugify, "世界", "chapter"),
        (T.snippet, "x" * 300, "x" * 239 + "…"),
        (T.snippet, " a \n b ", "a b"),
        (T.tagged_output, "x <OUT> kept </out> y", "kept"),
        (T.tagged_output, "<out></out>tail", ""),
        (T.tagged_output, " none ", "none"),
        (T.without_session_header, "session_id: 1\nanswer", "answer"),
        (T.without_session_header, "session_id: 1", ""),
        (T.answer_action, None, "answer"), (T.answer_action, "", "answer"), (T.answer_action, " SOCRATIC", "socratic"), (T.answer_action, "explain", "explain"), (T.answer_action, "not-a-mode", "answer"),
        (T.ffmetadata_value, "a=b;c#d\\e\nf", "a\\=b\\;c\\#d\\\\e\\nf"),
        (T.content_type, "x/list.m3u8", "application/vnd.apple.mpegurl"), (T.content_type, "x/y", "application/octet-stream"),
        (T.chapter_label, " Chapter 1: The-End! ", "chapter 1 the end"),
    ],
)
def test_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def test_structs(spark):
    g = lambda v: tuple(one(spark, T.filename_guess, v))
    assert g("The Book (Ann Author).epub") == ("The Book", "Ann Author")
    assert g("The Book - Part - Ann.epub") == ("The Book - Part", "Ann")
    assert g("Plain.epub") == ("Plain", "")
    r = lambda h, n=16: one(spark, lambda c: T.range_header(c, F.lit(n)), h)
    assert tuple(r("bytes=2-5")) == (2, 5) and tuple(r("bytes=10-")) == (10, 15) and tuple(r("bytes=-4")) == (12, 15)
    assert r("bytes=20-30") is None and r("bytes=-") is None and r("items=1-2") is None
    assert one(spark, lambda c: T.playlist_with_urls(c, F.lit("runs/book-a/chapters/001")), "#EXTM3U\n#EXTINF:1.0,\nchunk-0001.ts\n/abs a.ts") == "#EXTM3U\n#EXTINF:1.0,\n/media?path=runs/book-a/chapters/001/chunk-0001.ts\n/abs a.ts"
    assert one(spark, lambda c: T.quoted_path(c), "a b/ü+.ts") == "a%20b/%C3%BC%2B.ts"
    assert one(spark, T.is_packaging_title, "Benn_9781_epub_c11_r1") and not one(spark, T.is_packaging_title, None)
    assert [one(spark, T.clock, v, "double") for v in (None, 5.9, 65.0, 3661.0)] == ["—", "0:05", "1:05", "1:01:01"]
    assert one(spark, lambda c: T.percent(c, F.lit(4)), 2, "int") == 50 and one(spark, lambda c: T.percent(c, F.lit(0)), 2, "int") == 0
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert [one(spark, lambda c: T.ago(c.cast("timestamp"), now), v) for v in ("2024-01-01 23:59:30", "2024-01-01 23:00:00", "2024-01-01 22:59:59", None)] == ["30s ago", "1h ago", "1h ago", "—"]
    times = ("2024-06-10T23:41:40+00:00", "2024-06-10T23:41:40Z", "2024-06-11T01:41:40+0200", "2024-06-10T23:41:40.000000+00:00", "nonsense")
    assert [one(spark, lambda c: F.unix_timestamp(T.parsed_time(c)), v) for v in times] == [1718062900] * 4 + [None]


def test_insight_titles(spark):
    def title(q, a="", act=None):
        return spark.createDataFrame([(q, a, act)], "q string, a string, c string").select(T.insight_title(F.col("q"), F.col("a"), F.col("c")).alias("t")).first()["t"]

    assert title("How do I deal with a lazy coworker?") == "Influencing Difficult Coworkers"
    assert title("What is the old bridge near town?") == "Old Bridge Near Town"
    assert title("Why?", "## Heading here\nmore") == "Heading here"
    assert title("", "x" * 80, "deep_dive") == "Deep Dive"
    assert title(None, None, None) == "Saved Book Insight"


def test_classifiers(spark):
    toc = lambda t, s, x: spark.createDataFrame([(t, s, x)], "t string, s string, x string").select(C.is_contents_page(F.col("t"), F.col("s"), F.col("x")).alias("o")).first()["o"]
    assert toc("Contents", "a.xhtml", "x") and toc("A", "naval.xhtml", "x") and toc("A", None, "One .... 3\nTwo .... 5\nThree ... 9") and not toc("A", "a.xhtml", "One\nTwo")
    head = lambda x: one(spark, C.is_heading_or_fragment, x)
    assert head("THE LONG ROAD HOME IN THE WINTER OF THE YEAR") and head("A short one.") and head("Describe the scene in which the keeper of the house at last meets the sailor again.")
    assert not head("The keeper of the house met the sailor again after many years and they talked for a long while.")
    assert head("The Keeper Of The House Met Old Sailor Dog-House")
    why = lambda x: tuple(one(spark, C.rewrite_decision, x))
    assert why("  ") == (False, "empty_after_cleanup") and why("Short.") == (False, "short_or_heading")
    base = "the keeper of the house met the sailor again after many years and they talked "
    assert why(base * 5) == (True, "few_sentence_breaks")
    assert why("The keeper (of the house met the sailor again after many years and they \"talked for a while. yes.") == (True, "lowercase_after_sentence_end,unbalanced_parentheses,unbalanced_quotes")
    ok = lambda a, b, f=None: spark.createDataFrame([(a, b, f)], "a string, b string, f string").select(C.rewrite_verdict(F.col("a"), F.col("b"), F.col("f")).alias("o")).first()["o"]
    assert [ok("a b", ""), ok("a b", "x <out>"), ok("a b", "a b", "length"), ok("word " * 50, "word " * 20), ok("a b", "a b")] == ["empty", "tag_leak", "truncated_by_token_limit", "too_short", "ok"]


def test_chunkers(spark):
    units = one(spark, K.sentence_units, "One; two. Three — four! Five")
    assert units == ["One;", "two.", "Three", "four!", "Five"]
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    chunks = one(spark, lambda c: K.chunks(c, 650), text)
    assert " ".join(chunks) == text and all(len(c) <= 650 for c in chunks)
    assert one(spark, lambda c: K.chunks(c, 100), "x" * 300) == ["x" * 300]
    assert one(spark, lambda c: K.merged_tiny(F.split(c, "/")), "a" * 90 + "/bb/" + "c" * 90 + "/ /d") == ["a" * 90 + " bb", "c" * 90 + " d"]
    assert one(spark, lambda c: K.merged_tiny(F.split(c, "/")), "aa/bb") == ["aa bb"]
    df = spark.createDataFrame([("Word " * 400, "clash"), (None, "x"), ("short", "y")], "text string, piece string")
    rows = K.overlapping(df, "text", 200, 30).collect()
    assert len(rows) > 10 and rows[0].chunk_index == 0 and all(len(r.piece) <= 280 for r in rows)
    assert K.window_pieces("", 10, 2) == [] and K.window_pieces("abc", 10, 2) == ["abc"]


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>skip</nav><h1>3</h1><h2>The <i>Name</i></h2><p>One<p>Two &amp; more<ul><li>x</li><li>y</ul><blockquote><p>inner</p></blockquote></body></html>"
    r = spark.createDataFrame([(page,)], "t string").select(H.document_text(F.col("t")).alias("x")).select("x.*").first()
    # A line of digits alone is taken for a page number.
    assert r.text.split("\n\n") == ["The Name", "One", "Two & more", "x", "y", "inner"] and r.headings == ["3", "The Name"]
    df = spark.createDataFrame([(["3", "The Name"], "T", "x", 7), (["Head"], "", "x", 7), ([], "Page", "x", 7), ([], "", "line\nb", 7), ([], "", "", 7)], "h array<string>, t string, x string, n int")
    assert [x.o for x in df.select(H.chapter_title(F.col("h"), F.col("t"), F.col("x"), F.col("n")).alias("o")).collect()] == ["3 The Name", "Head", "Page", "line", "Chapter 7"]


def test_headings_and_lines(spark):
    cut = lambda x, t: spark.createDataFrame([(x, t)], "x string, t string").select(T.without_heading(F.col("x"), F.col("t")).alias("o")).first()["o"]
    assert cut("CHAPTER 1.\n\nThe sun.\nIt rose.", "Chapter 1") == "The sun.\n\nIt rose."
    assert cut("Chapter 1 The sun rose.", "Chapter 1") == "The sun rose."
    assert cut("The sun rose.", "Chapter 1") == "The sun rose." and cut("The sun.", None) == "The sun." and cut("Chapter 1", "Chapter 1") == ""
    df = spark.createDataFrame([("aa bb-cc dd",), ("x" * 9,), ("a",)], "t string")
    assert [r.line for r in K.wrapped(df, "t", 5).collect()] == ["aa", "bb-cc", "dd", "x" * 9, "a"]
