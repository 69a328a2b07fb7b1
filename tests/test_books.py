"""From EPUB files to chapters and passages, by any embedder."""

import zipfile

from pyspark.sql import functions as F

from narrata.operators import books as B
from narrata.sources import epub
from tests.test_sources import tiny_epub


def test_chapters_of_files(spark, tmp_path):
    tiny_epub(tmp_path / "a.epub", [("Two", "Beta text here."), ("Contents", "Table of contents"), ("One", "Alpha text here.")])
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "empty.epub", "w") as z:
        z.writestr("x", "y")
    c = B.extracted_chapters(epub.scan(spark, str(tmp_path)))
    got = c.orderBy("chapter_index").select("chapter_index", "title", "source", "text").collect()
    assert [tuple(r) for r in got] == [(1, "One", "chapter_3.xhtml", "One\n\nAlpha text here."), (2, "Two", "chapter_1.xhtml", "Two\n\nBeta text here.")]
    assert B.extracted_chapters(epub.scan(spark, str(tmp_path)).where("false")).count() == 0


def test_passages(spark):
    rows = [("b", 1, "One", "a.xhtml", "Word " * 400), ("b", 2, "Two", "b.xhtml", "short text"), ("b", 3, "Three", "c.xhtml", " "), ("b", 4, "Four", "d.xhtml", None), (None, 1, "X", "x", "text")]
    c = spark.createDataFrame(rows, "book_id string, chapter_index int, title string, source string, text string")
    p = B.passages(c, most=200, overlap=30).orderBy("pos").collect()
    assert [r.pos for r in p] == list(range(len(p))) and all(len(r.text) <= 220 for r in p)
    assert p[0].chunk_index == 0 and p[-1].id == f"passage_b_{len(p) - 1}" and (p[-1].chapter, p[-1].href, p[-1].text) == ("Two", "b.xhtml", "short text")
    assert all(r.embedding_model == "hashvec-16" and len(r.embedding) == 16 for r in p)
    mine = B.embedder("lengths", 2, lambda: lambda texts: [[len(t), 1] for t in texts])
    q = B.passages(c, mine, most=200, overlap=30).orderBy("pos").collect()
    assert [r.embedding for r in q] == [[float(len(r.text)), 1.0] for r in q] and q[0].embedding_model == "lengths"
    assert B.passages(c.where(F.lit(False))).count() == 0
