"""A data source of document elements: ``spark.read.format("sparkloom_elements").load(folder)`` (SRC2, SRC5, SRC6, SRC8, SRC9).

TXT, Markdown and DOCX files under a folder give text, table and image elements in reading order, with page (form feeds; page breaks in DOCX), position on
the page, window of pages and section path. A heading isn't an element: one of level n cuts the path to n - 1 parts and is the next. A
file that can't be read gives one row of kind ERROR that says why, and the others go on.

Planning lists files only. A file beyond `split_bytes` is several partitions, each of which gives every n-th window of pages. Only the columns of the
reader's schema are made, and filters on path and kind leave out files and elements. Paths may be any that pyarrow.fs opens.
Options: window (pages, 5), split_bytes (8 MB), kinds.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from sparkloom.sources.files import WORD, WORD_PART

SCHEMA = "path string, page int, position int, window int, kind string, section_path array<string>, text string, error string"
SUFFIXES = (".txt", ".md", ".docx")
MIN_PART = 8 << 20


def open_folder(path: str):
    """(file system, path in it) of a folder's address."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/").rstrip("/")
    store, at = fs.FileSystem.from_uri(path)
    return store, at.rstrip("/")


def found_files(path: str) -> list:
    """pyarrow's FileInfo of the files under a folder (or of the one file), by path; hidden ones are left out."""
    from pyarrow import fs

    store, at = open_folder(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    some = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in some if f.type == fs.FileType.File and not any(x[:1] in "._" for x in f.path[len(at) + 1 :].split("/"))), key=lambda f: f.path)


def text_items(text: str, markdown: bool) -> Iterator[tuple[str, int, str]]:
    """(kind, level, text) in order; PAGE for a page break. A level above 0 is a heading's."""
    for n, page in enumerate(text.split("\f")):
        if n:
            yield "PAGE", 0, ""
        for block in re.split(r"\n[^\S\n]*\n", page) if markdown else page.split("\n\n"):
            yield from _markdown_block(block) if markdown else [("TEXT", 0, block.strip())]


def _markdown_block(block: str) -> Iterator[tuple[str, int, str]]:
    lines: list[str] = []
    for line in block.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            yield from _markdown_lines(lines)
            lines = []
            yield "TEXT", len(m[1]), m[2].strip()
        else:
            lines.append(line)
    yield from _markdown_lines(lines)


def _markdown_lines(lines: list[str]) -> Iterator[tuple[str, int, str]]:
    text = "\n".join(lines).strip()
    if m := re.fullmatch(r"!\[(.*?)\]\(.*?\)", text, re.S):
        yield "IMAGE", 0, m[1]
    else:
        yield "TABLE" if text.startswith("|") else "TEXT", 0, text


def docx_elements(raw: bytes) -> Iterator[tuple[str, int, str]]:
    """The same of a DOCX file; tables as markdown, images by their description."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read(WORD_PART)).find(f"{WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()
    for node in body if body is not None else ():
        for b in node.iter(f"{WORD}br"):
            if b.get(f"{WORD}type") == "page":
                yield "PAGE", 0, ""
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            m = re.match(r"heading\s*(\d*)", (style.get(f"{WORD}val") or "") if style is not None else "", re.I)
            yield "TEXT", int(m[1] or 1) if m else 0, said(node)
            for picture in node.iter():
                if picture.tag.endswith("}docPr"):
                    yield "IMAGE", 0, picture.get("descr") or picture.get("name") or ""
        elif node.tag == f"{WORD}tbl":
            rows = [[said(c) for c in r.findall(f"{WORD}tc")] for r in node.findall(f"{WORD}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            yield "TABLE", 0, "\n".join([*lines[:1], "|" + "---|" * len(rows[0]), *lines[1:]]) if rows else ""


def elements(items: Iterable[tuple[str, int, str]], window: int) -> Iterator[dict]:
    """Elements with page, position, window and section path. Blank ones but images go."""
    page, position, path = 1, 0, []
    for kind, level, text in items:
        if kind == "PAGE":
            page, position = page + 1, 0
        elif level:
            path = [*path[: level - 1], text]
        elif text or kind == "IMAGE":
            yield {"page": page, "position": position, "window": -(-page // window), "kind": kind, "section_path": path, "text": text, "error": None}
            position += 1


@dataclass
class Part(InputPartition):
    """Every `of`-th window of pages of a file, from the `nth`."""

    path: str
    nth: int
    of: int


class ElementReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.root, self.names = options["path"], schema.fieldNames()
        self.window, self.split = int(options.get("window", 5)), int(options.get("split_bytes", MIN_PART))
        self.kinds = set(filter(None, options.get("kinds", "").split(","))) or None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {f.value} if self.kinds is None else self.kinds & {f.value}
            yield f  # Spark checks them again

    def partitions(self) -> list[Part]:
        out = []
        for f in found_files(self.root):
            if f.path.lower().endswith(SUFFIXES) and (self.only is None or f.path in self.only):
                n = max(1, -(-f.size // self.split))
                out += [Part(f.path, i, n) for i in range(n)]
        return out or [Part("", 0, 1)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        try:
            with open_folder(self.root)[0].open_input_stream(part.path) as stream:
                raw = stream.read()
            items = docx_elements(raw) if part.path.lower().endswith(".docx") else text_items(raw.decode("utf-8", "replace"), part.path.lower().endswith(".md"))
            for e in elements(items, self.window):
                if (e["window"] - 1) % part.of == part.nth and (self.kinds is None or e["kind"] in self.kinds):
                    yield tuple(part.path if c == "path" else e[c] for c in self.names)
        except Exception as x:  # a file that can't be read is told, the others go on
            if part.nth == 0:
                row = {"kind": "ERROR", "error": f"{type(x).__name__}: {x}"[:200], "path": part.path}
                yield tuple(row.get(c) for c in self.names)


class ElementSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkloom_elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ElementReader:
        return ElementReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has the session hand filters to Python sources, as this one takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ElementSource)
