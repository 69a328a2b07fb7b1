"""A Spark data source for EPUB files: ``spark.read.format("epub").load(folder)``."""

from __future__ import annotations

import glob
import io
import os
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from narrata import schemas

_DC = "{http://purl.org/dc/elements/1.1/}"
_HTML = ("application/xhtml+xml", "text/html")


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _toc(z: zipfile.ZipFile, manifest: list[tuple[str, str, str, str]], folder: str) -> list[tuple[int, str, str, str | None]]:
    """Entries of the NCX or navigation document, in order, with their section's title."""
    out: list[tuple[int, str, str, str | None]] = []
    for _, href, kind, props in manifest:
        if kind != "application/x-dtbncx+xml" and "nav" not in props.split():
            continue
        try:
            root = ET.fromstring(z.read(posixpath.normpath(posixpath.join(folder, href))))
        except (KeyError, ET.ParseError):
            continue

        def walk(node: ET.Element, section: str | None) -> None:
            for child in node:
                if _local(child) in ("navPoint", "li"):
                    label = " ".join("".join(x.itertext()) for x in child if _local(x) in ("navLabel", "a", "span")).strip()
                    link = next((x.get("src") or x.get("href") for x in child if _local(x) in ("content", "a")), None)
                    inner = [x for x in child if _local(x) in ("navPoint", "ol")]
                    if link:
                        out.append((len(out), link, " ".join(label.split()), section))
                    for x in inner:
                        walk(child if _local(x) == "navPoint" else x, " ".join(label.split()) or section)
                        if _local(x) == "navPoint":
                            break
                else:
                    walk(child, section)

        walk(root, None)
        if out:
            break
    return out


def read_epub(path: str, content: bytes | None = None) -> Iterator[tuple]:
    """Rows of one file (or of its ``content``): its documents with spine places, contents and metadata. A broken file gives none."""
    try:
        z = zipfile.ZipFile(path if content is None else io.BytesIO(content))
        opf = ET.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        package = ET.fromstring(z.read(opf))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError, AttributeError):
        return
    with z:
        folder = posixpath.dirname(opf)
        manifest = [(e.get("id"), e.get("href"), e.get("media-type") or "", e.get("properties") or "") for e in package.iter() if _local(e) == "item"]
        spine = {e.get("idref"): i for i, e in enumerate(x for x in package.iter() if _local(x) == "itemref")}
        meta: dict[str, str] = {}
        for e in package.iter():
            if e.tag.startswith(_DC) and (e.text or "").strip():
                meta.setdefault(_local(e), e.text.strip())
        toc = _toc(z, manifest, folder)
        for pos, (id_, href, kind, _) in enumerate(manifest):
            if kind in _HTML:
                try:
                    html = z.read(posixpath.normpath(posixpath.join(folder, href))).decode("utf-8", "replace")
                except KeyError:
                    continue
                yield (path, meta.get("title"), id_, href, pos, spine.get(id_), html, toc, meta)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.epub"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(p) for p in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            yield from read_epub(partition.value)


class EpubSource(DataSource):
    """One partition a file; one row a document."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> object:
        return schemas.EPUB_ITEM

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://").removeprefix("file:"))


def scan(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """The same rows from any file system Spark reads: files come as binary rows and are taken apart where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in schemas.EPUB_ITEM.fields]
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(read_epub(name, content)), columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, schemas.EPUB_ITEM)
