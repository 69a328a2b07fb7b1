import json
import os
import zipfile

import pytest

from narrata import schemas
from narrata.functions import html as H
from narrata.operators import joins as J
from narrata.sources import readers, sinks
from narrata.sources.epub import EpubSource
from narrata.streaming import events as S


def tiny_epub(path, chapters, title="Test Book"):
    names = [f"chapter_{i}.xhtml" for i in range(1, len(chapters) + 1)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names)) + '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        spine = "".join(f'<itemref idref="c{i}"/>' for i in reversed(range(len(names))))
        z.writestr("EPUB/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        nav = "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{n}#top"/></navPoint>' for n, (t, _) in zip(names, chapters, strict=True))
        z.writestr("EPUB/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{nav}</navMap></ncx>')
        for n, (t, b) in zip(names, chapters, strict=True):
            z.writestr(f"EPUB/{n}", f"<html><body><h1>{t}</h1><p>{b}</p></body></html>")


def test_epub(spark, tmp_path):
    tiny_epub(tmp_path / "a.epub", [("One", "Alpha text."), ("Two", "Beta text.")])
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    spark.dataSource.register(EpubSource)
    df = spark.read.format("epub").load(str(tmp_path))
    rows = df.orderBy("spine_pos").select("book_title", "href", "spine_pos", H.document_text(df.html).alias("x"), "toc", "metadata").collect()
    assert [(r.href, r.x.text) for r in rows] == [("chapter_2.xhtml", "Two\n\nBeta text."), ("chapter_1.xhtml", "One\n\nAlpha text.")]
    assert rows[0].book_title == "Test Book" and rows[0].metadata["language"] == "en" and [t.label for t in rows[0].toc] == ["One", "Two"]


def test_jsonl(spark, tmp_path):
    lines = ['{"memory_id":"1","text":"a","extra":1}', "", "not json", "[1]", "3", '{"memory_id":"2"}', '{"memory_id":5,"text":"c"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = readers.jsonl(spark, str(tmp_path / "m.jsonl"), schemas.MEMORY).orderBy("pos").collect()
    assert [r.text for r in rows] == ["a", None, "c"]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), schemas.MEMORY).count() == 0
    assert readers.jsonl_strict(spark, str(tmp_path / "m.jsonl"), schemas.MEMORY).count() >= 2


def test_documents(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"version": 1, "books": [{"id": "a", "title": "T", "metadata": {"k": "v"}}, {"id": "b"}]}))
    assert [r.id for r in readers.catalog(spark, str(tmp_path / "catalog.json")).orderBy("id").collect()] == ["a", "b"]
    assert readers.catalog(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "s.json").write_text("broken {")
    assert readers.json_document(spark, str(tmp_path / "s.json"), schemas.SETTINGS).count() == 1
    (tmp_path / "x.wav").write_bytes(b"12345")
    f = readers.files(spark, str(tmp_path), "*.wav").first()
    assert f["size"] == 5 and f["path"].endswith("x.wav")


def test_index_is_replaced_by_book(spark, tmp_path):
    out = str(tmp_path / "index")
    rows = lambda *x: spark.createDataFrame(x, "book_id string, text string")
    sinks.replace_by_book(rows(("a", "one"), ("b", "other")), out)
    sinks.replace_by_book(rows(("a", "two only")), out)
    assert sorted((r.book_id, r.text) for r in spark.read.parquet(out).collect()) == [("a", "two only"), ("b", "other")]
    sinks.append_events(rows(("a", "e1")), str(tmp_path / "log"))
    sinks.append_events(rows(("a", "e2")), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_texts(rows(("a", "#EXTM3U\nx\n")), str(tmp_path / "texts"), "book_id")
    part = [os.path.join(r, n) for r, _, names in os.walk(tmp_path / "texts") for n in names if n.endswith(".txt")]
    assert open(part[0]).read() == "#EXTM3U\nx\n"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, 1, "click", float(i), "{}", f"2024-01-01 00:{i:02d}:00") for i in range(5)] + [(9, 1, "view", 1.0, "{}", "2024-01-01 01:00:00"), (10, 2, "click", 2.0, "{}", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, t string").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "event_type", "value", "props")
    path = str(tmp_path / "events")
    df.where("event_id < 9").write.mode("append").parquet(path)
    df.where("event_id >= 9").write.mode("append").parquet(path)
    kinds = {"click": "click", "view": "view"}
    live = S.run_to_end(S.live_counters(S.stream(spark, path), ["user_id"], kinds), "t_counters", "complete")
    assert {r.user_id: (r.n_events, r.n_click, r.sum_click) for r in live.collect()} == {1: (6, 5, 10.0), 2: (1, 1, 2.0)}
    quiet = S.run_to_end(S.silences(S.stream(spark, path)), "t_quiet", "append").collect()
    assert any(r.user_id == 1 and r.quiet_s >= 120 for r in quiet)
    assert S.run_to_end(S.windowed_counts(S.stream(spark, path)), "t_windows", "append") is not None


def test_spine_order(spark):
    items = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("b", "z", 3)], "book_id string, item string, pos int")
    spine = spark.createDataFrame([("b", "z", 0), ("b", "x", 1)], "book_id string, item string, sp int")
    assert [r.item for r in J.spine_order(items, spine, "item", "pos", "sp").orderBy("position").collect()] == ["z", "x", "y"]
