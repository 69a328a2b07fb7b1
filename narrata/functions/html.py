"""Readable text of XHTML documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import text as T

# Elements whose text is dropped, and elements that make a block.
SKIPPED = ("script", "style", "nav", "header", "footer", "aside")
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "figcaption")


class _Reader(HTMLParser):
    """Outermost blocks in order; an open paragraph ends where any block begins, an open list item at the next or at the list's end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.loose: list[str] = []
        self.headings: list[str] = []
        self.title = ""
        self._skip, self._open, self._buf, self._in_title = 0, list[str](), list[str](), False

    def _flush(self) -> None:
        t = " ".join(x.strip() for x in self._buf if x.strip())
        if t:
            self.blocks.append(t)
            if self._open and self._open[0] in ("h1", "h2", "h3"):
                self.headings.append(t)
        self._buf, self._open = [], []

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in SKIPPED:
            self._skip += 1
        elif tag == "title":
            self._in_title = True
        elif tag in BLOCKS and not self._skip:
            if self._open == ["p"] or self._open == [tag] == ["li"]:
                self._flush()
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag == "title":
            self._in_title = False
        elif tag in ("ul", "ol") and self._open == ["li"]:
            self._flush()
        elif tag in self._open:
            while self._open and self._open[-1] != tag:
                self._open.pop()
            if len(self._open) == 1:
                self._flush()
            elif self._open:
                self._open.pop()

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif not self._skip:
            (self._buf if self._open else self.loose).append(data)

    def done(self) -> tuple[str, list[str], str]:
        self.close()
        self._flush()
        return "\n\n".join(self.blocks) if self.blocks else "\n".join(x.strip() for x in self.loose if x.strip()), self.headings, self.title.strip()


def _parsed(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in html:
        rows = []
        for x in s:
            r = _Reader()
            r.feed(x or "")
            rows.append(r.done())
        yield pd.DataFrame(rows, columns=["text", "headings", "title"])


def document_text(html: Column) -> Column:
    """``struct<text, headings, title>``, the text normalised."""
    p = F.pandas_udf(_parsed, "text string, headings array<string>, title string")(html)
    return F.struct(T.normalize_text(p["text"]).alias("text"), p["headings"].alias("headings"), p["title"].alias("title"))


def chapter_title(headings: Column, title: Column, text: Column, number: Column) -> Column:
    """The title of a document: a bare number with the next heading, the first heading, the page title, or the first line."""
    first = lambda i: F.try_element_at(headings, F.lit(i))
    line = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x != ""), F.lit(1))
    return F.substring(
        F.coalesce(F.when((F.size(headings) >= 2) & first(1).rlike(r"^\p{Nd}+$"), F.concat(first(1), F.lit(" "), first(2))), F.nullif(first(1), F.lit("")), F.nullif(title, F.lit("")), F.nullif(line, F.lit("")), F.concat(F.lit("Chapter "), number.cast("string"))), 1, 120
    )
