"""E-book archives as tables. Archives arrive as bytes (binaryFile); a table function unpacks each where it is."""

from __future__ import annotations

import html as H
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import blocks_of

# Names of files that aren't read aloud.
SERVICE = r"(?i)cover|title[-_]?page|copyright|colophon|nav\b|toc\b|contents|index|acknowledg"
LEAST_CHARS = 200

SPINE = "path string, pos int, name string, title string, html string"
BODY = "path string, pos int, name string, title string, paragraphs array<string>"
META = "path string, title string, creator string, language string, year string, cover string"


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _package(z: zipfile.ZipFile):
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    name = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    return posixpath.dirname(name), ElementTree.fromstring(z.read(name))


def _toc(z: zipfile.ZipFile, base: str, items: dict[str, tuple[str, str, str]]) -> dict[str, str]:
    """href without fragment: the first title that the table of contents gives it."""
    titles: dict[str, str] = {}
    for href, kind, _ in items.values():
        if kind != "application/x-dtbncx+xml" and not href.endswith("nav.xhtml"):
            continue
        try:
            tree = ElementTree.fromstring(z.read(posixpath.join(base, href)))
        except (KeyError, ElementTree.ParseError):
            continue
        for e in tree.iter():
            if _local(e) == "navPoint":
                label = next((t.text or "" for t in e.iter() if _local(t) == "text"), "")
                link = next((c.get("src", "") for c in e if _local(c) == "content"), "")
            elif _local(e) == "a":
                label, link = "".join(e.itertext()), e.get("href", "")
            else:
                continue
            titles.setdefault(unquote(link.split("#")[0]), " ".join(label.split()))
    return titles


def _open(path: str, raw: bytes) -> tuple[list[tuple], tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        base, package = _package(z)
        items = {e.get("id"): (unquote(e.get("href", "")), e.get("media-type", ""), e.get("properties") or "") for e in package.iter() if _local(e) == "item"}
        titles = _toc(z, base, items)
        spine = []
        for e in package.iter():
            href, kind, _ = items.get(e.get("idref"), ("", "", "")) if _local(e) == "itemref" else ("", "", "")
            if "html" in kind:
                title = titles.get(href) or next((t for h, t in titles.items() if h and href.endswith(h)), None)
                spine.append((path, len(spine), href, title, z.read(posixpath.join(base, href)).decode("utf-8", "replace")))
        said = {}
        for e in package.iter():
            if _local(e) in ("title", "creator", "language", "date") and e.text:
                said.setdefault(_local(e), e.text.strip())
        by_meta = next((e.get("content") for e in package.iter() if _local(e) == "meta" and e.get("name") == "cover"), None)
        images = {i: h for i, (h, kind, _) in items.items() if kind.startswith("image/")}
        ranked = [
            images.get(by_meta), next((h for h in images.values() if by_meta and h.endswith(by_meta)), None),
            next((h for h, _, p in items.values() if "cover-image" in p), None),
            next((h for i, h in images.items() if "cover" in (i + h).lower()), None),
            next((m[1] for *_, html in spine[:1] if (m := re.search(r'<img[^>]+src="([^"]+)"', html))), None),
        ]
        year = (said.get("date") or "")[:4]
        creator = re.sub(r"^([^,]+),\s*([^,]+)$", r"\2 \1", said.get("creator", "")) or None
        return spine, (path, said.get("title"), creator, (said.get("language") or "")[:2] or None, year or None, next((r for r in ranked if r), None))


def packed(title: str, creator: str, language: str, date: str, documents: list[tuple[str, str | None, str]]) -> bytes:
    """An archive of documents (name, title in the contents or None, markup), in this order."""
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    items = "".join(f'<item id="d{i}" href="{escaped(n)}" media-type="application/xhtml+xml"/>' for i, (n, _, _) in enumerate(documents))
    refs = "".join(f'<itemref idref="d{i}"/>' for i in range(len(documents)))
    about = "".join(f"<dc:{k}>{escaped(v)}</dc:{k}>" for k, v in (("title", title), ("creator", creator), ("language", language), ("date", date)))
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>' + about + "</metadata>"
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>'
    )
    links = "".join(f'<li><a href="{escaped(n)}#top">{escaped(t)}</a></li>' for n, t, _ in documents if t is not None)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf"/></rootfiles></container>')
        z.writestr("OEBPS/package.opf", package)
        z.writestr("OEBPS/nav.xhtml", f"<html><body><nav><ol>{links}</ol></nav></body></html>")
        for name, _, markup in documents:
            z.writestr(f"OEBPS/{name}", markup)
    return out.getvalue()


#: Bytes of texts that are told before they go on; an archive's own documents are held at once.
TOLD_BYTES = 1 << 20


def _each(rows_of, columns: str):
    """A function over batches of archives (path, content): the rows that rows_of makes of each opened one. Archives are opened one by one."""
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for path, raw in zip(b.column("path"), b.column("content")):
                try:
                    found = _open(path.as_py(), raw.as_py())
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, TypeError):
                    continue  # not an e-book
                rows += rows_of(*found)
                size += len(raw.as_buffer())
                if size >= TOLD_BYTES and rows:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    return run


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def spine(archives: DataFrame) -> DataFrame:
    """path, pos, name, title, html of every document of the spine, in reading order."""
    return archives.select("path", "content").mapInArrow(_each(lambda spine, _: spine, SPINE), SPINE)


def metadata(archives: DataFrame) -> DataFrame:
    """path, title, creator, language, year, cover of every archive; what it doesn't say is null."""
    return archives.select("path", "content").mapInArrow(_each(lambda _, said: [said], META), META)


def chapters(archives: DataFrame, references: Callable[[str], str] = H.unescape) -> DataFrame:
    """path, pos, name, title, paragraphs: documents that are read, without service files that the contents don't list and without short ones.

    Paragraphs are read where the archive is opened, once each, so mark-up doesn't go from worker to worker;
    references: what reads their character references.
    """
    body = archives.select("path", "content").mapInArrow(_each(lambda spine, _: [(*d[:4], blocks_of(d[4], references)) for d in spine], BODY), BODY)
    size = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p))
    listed = F.col("title").isNotNull()
    return body.where((listed | ~F.col("name").rlike(SERVICE)) & (size >= LEAST_CHARS)).select("path", "pos", "name", "title", "paragraphs")
