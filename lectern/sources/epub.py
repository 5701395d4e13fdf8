"""Packaged books. A Python data source reads each archive in one task; what is inside comes out as rows of a table.

    spark.dataSource.register(EpubSource)
    spark.read.format("epub").option("table", "blocks").load("books/*.epub")

Tables: metadata, manifest, spine, toc, blocks; each row has the path of its book. ``books(df)`` does the same for a
DataFrame of archives (``binaryFile``), which also reads stores that only Spark reaches.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..shared import SLICE
from .html import Node, blocks_of, parse

OPF_TYPE, NCX_TYPE = "application/oebps-package+xml", "application/x-dtbncx+xml"
HTML_TYPES = ("application/xhtml+xml", "application/x-dtbxhtml", "text/html")


class BookError(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if _local(c.tag) == name]


def _text(node: ElementTree.Element | None) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


class Book:
    """An archive with its package document read."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise BookError(f"not an archive: {e}") from None
        self.names = self.zip.namelist()
        self.opf_path = self._container()
        self.base = posixpath.dirname(self.opf_path)
        self._package(self._xml(self.read(self.opf_path), "package"))

    def read(self, name: str) -> bytes:
        """An entry by its exact name, else the first that differs in case only."""
        if name in self.names:
            return self.zip.read(name)
        for n in self.names:
            if n.lower() == name.lower():
                return self.zip.read(n)
        raise BookError(f"no entry {name}")

    def _xml(self, data: bytes, what: str) -> ElementTree.Element:
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise BookError(f"{what} is not XML: {e}") from None

    def _container(self) -> str:
        root = self._xml(self.read("META-INF/container.xml"), "container")
        files = [n for n in root.iter() if _local(n.tag) == "rootfile"]
        typed = [n for n in files if n.get("media-type") == OPF_TYPE]
        if not files:
            raise BookError("no rootfile in the container")
        return (typed or files)[0].get("full-path", "")

    def _package(self, root: ElementTree.Element) -> None:
        meta = next(iter(_children(root, "metadata")), None)
        of = lambda name: [_text(n) for n in (meta.iter() if meta is not None else ()) if _local(n.tag) == name]
        first = lambda name: next(iter(of(name)), "")
        self.metadata = {"title": first("title"), "creators": of("creator"), "language": first("language"), "identifier": first("identifier"), "description": first("description"), "publisher": first("publisher"), "subjects": of("subject"), "date": first("date")}
        items = [i for m in _children(root, "manifest") for i in _children(m, "item")]
        self.manifest = {i.get("id", ""): {"id": i.get("id", ""), "href": i.get("href", ""), "media_type": i.get("media-type", ""), "properties": [p for p in i.get("properties", "").split(" ") if p]} for i in items}
        refs = [r for s in _children(root, "spine") for r in _children(s, "itemref")]
        if not refs:
            raise BookError("the spine is empty")
        # A reference without a manifest item is dropped; positions count what stays.
        known = [(r, self.manifest[r.get("idref", "")]) for r in refs if r.get("idref", "") in self.manifest]
        self.spine = [{"spine_index": k, "id": i["id"], "href": i["href"], "media_type": i["media_type"], "linear": r.get("linear") != "no"} for k, (r, i) in enumerate(known)]

    def resolve(self, href: str) -> str:
        path = href.partition("#")[0]
        return posixpath.normpath(posixpath.join(self.base, path)) if path or self.base else path

    def toc(self) -> list[dict]:
        """From the navigation document, in manifest order; from the NCX if there is none or it has no entries."""
        nav = next((i for i in self.manifest.values() if "nav" in i["properties"]), None)
        found = nav_entries(self.read(self.resolve(nav["href"])).decode("utf-8", "replace")) if nav else []
        if not found:
            ncx = next((i for i in self.manifest.values() if i["media_type"] == NCX_TYPE), None)
            found = ncx_entries(self._xml(self.read(self.resolve(ncx["href"])), "ncx")) if ncx else []
        return [e | {"SrcFile": self.resolve(e["SrcFile"])} for e in found]

    def blocks(self) -> list[dict]:
        out = []
        for i in self.spine:
            if i["media_type"] in HTML_TYPES:
                path = self.resolve(i["href"])
                out.append({"spine_index": i["spine_index"], "item_id": i["id"], "href": i["href"], "zip_path": path, "raw_file": f"item{i['spine_index']:03d}.xhtml", "blocks": blocks_of(self.read(path))})
        return out

    def rows(self, table: str) -> list[dict]:
        if table == "metadata":
            return [self.metadata]
        if table == "manifest":
            return list(self.manifest.values())
        return {"spine": lambda: self.spine, "toc": self.toc, "blocks": self.blocks}[table]()


def _entry(title: str, href: str, order: int, depth: int, kind: str) -> dict:
    path, _, anchor = href.partition("#")
    return {"Title": title.strip(), "SrcFile": path, "SrcAnchor": anchor, "Order": order, "Depth": depth, "SourceKind": kind}


def nav_entries(html: str) -> list[dict]:
    """Links of the navigation typed as toc, else of the first one. A list item's link is the first below it, so a group with a
    label only takes its first child's link, and the child has it again."""
    navs = [n for n in parse(html).walk() if n.tag == "nav"]
    nav = next((n for n in navs if n.attrs.get("epub:type") == "toc"), navs[0] if navs else None)
    out: list[dict] = []

    def walk(items: Node, depth: int) -> None:
        for li in items.children:
            if li.tag != "li":
                continue
            link, nested = li.find("a"), li.find("ol")
            if link is not None:
                out.append(_entry(link.content(), link.attrs.get("href", ""), len(out) + 1, depth, "nav"))
            if nested is not None:
                walk(nested, depth + (link is not None))

    if nav is not None and (top := nav.find("ol")) is not None:
        walk(top, 1)
    return out


def ncx_entries(root: ElementTree.Element) -> list[dict]:
    """Points in document order, with their depth."""
    out: list[dict] = []

    def walk(points, depth: int) -> None:
        for p in points:
            label = next((t for n in _children(p, "navLabel") for t in _children(n, "text")), None)
            content = next(iter(_children(p, "content")), None)
            out.append(_entry(_text(label), content.get("src", "") if content is not None else "", len(out) + 1, depth, "ncx"))
            walk(_children(p, "navPoint"), depth + 1)

    for m in _children(root, "navMap"):
        walk(_children(m, "navPoint"), 1)
    return out


TABLES = {"metadata": schemas.METADATA, "manifest": schemas.MANIFEST, "spine": schemas.SPINE, "toc": schemas.TOC, "blocks": schemas.ITEM_BLOCKS}


def books(archives: DataFrame, table: str) -> DataFrame:
    """One of TABLES from a DataFrame (path, content) of archives."""
    schema = "path string, " + TABLES[table]
    spark = archives.sparkSession
    arrow = _arrow_schema(spark, schema)

    return archives.select("path", "content").mapInArrow(lambda batches: parsed(batches, table, arrow), schema)


def parsed(batches: Iterable[pa.RecordBatch], table: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a table of the books (path, content) in batches of books of about ``SLICE`` bytes, as small books are many."""
    for batch in batches:
        rows, held = [], 0
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = content.as_py()
            rows += [{"path": path} | r for r in Book(data).rows(table)]
            held += len(data)
            if rows and held >= SLICE:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_books(spark: SparkSession, path: str, table: str) -> DataFrame:
    return books(spark.read.format("binaryFile").load(path), table)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


class EpubSource(DataSource):
    """format("epub"): option table (default blocks), path with wildcards, on a file system that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return "path string, " + TABLES[self.options.get("table", "blocks")]

    def reader(self, schema) -> DataSourceReader:
        return EpubReader(self.options.get("path", ""), self.options.get("table", "blocks"))


class EpubReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path.removeprefix("file://")))]

    def read(self, partition):
        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            for r in Book(f.read()).rows(self.table):
                values = list(r.values())
                if self.table == "blocks":
                    values[-1] = [tuple(b.values()) for b in values[-1]]
                yield (partition.value, *values)
