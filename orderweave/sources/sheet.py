"""Spreadsheet files as cells: HTML tables saved as workbooks, and XLSX, by a Python data source.

``spark.read.format("sheet").load(folder)`` gives ``cells(doc_id, row, col, text, fill)``, one record a non-empty
cell. The files are read by ``binaryFile`` first where they lie in a store that only Spark reaches (``cells_of``).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "doc_id string, row int, col int, text string, fill string"
# What the first bytes of each format are.
HTML_PREFIXES, ZIP_MAGIC, OLE_MAGIC = (b"<html", b"<!doctype", b"<table", b"<?xml"), b"PK\x03\x04", b"\xd0\xcf\x11\xe0"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sniff(text: Column) -> Column:
    """The format of a document by its first characters."""
    head = F.lower(F.ltrim(F.substring(text, 1, 200)))
    return F.when(head.rlike(r"^(<html|<!doctype|<table|<\?xml)"), "html").when(F.substring(text, 1, 2) == "PK", "xlsx").otherwise("unknown")


def kind_of(data: bytes, name: str = "") -> str:
    head = data[:200].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if head.startswith(HTML_PREFIXES):
        return "html"
    if data.startswith(OLE_MAGIC):
        return "xls"
    if data.startswith(ZIP_MAGIC):
        return "xlsx"
    suffix = name.lower().rpartition(".")[2]
    if suffix in ("xlsx", "xls", "html", "htm"):
        return "html" if suffix == "htm" else suffix
    raise ValueError(f"unknown format: {name}")


def decode(data: bytes) -> str:
    """UTF-8, else the Cyrillic code page that gives more Cyrillic letters."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        ways = [data.decode(c, errors="replace") for c in ("cp1251", "cp866")]
        return max(ways, key=lambda t: len(re.findall("[а-яё]", t)))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_cells(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """Cells of the table with most rows times columns."""
    p = _Tables()
    p.feed(decode(data))
    for r, row in enumerate(max(p.tables, key=lambda t: len(t) * max(map(len, t), default=0), default=[]), 1):
        for c, text in enumerate(row, 1):
            if text and text.lower() not in ("nan", "none"):
                yield r, c, text, ""


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def xlsx_cells(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """Cells of the first sheet: stored values, and the fill colour of each cell's style."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        root = lambda path: ElementTree.fromstring(z.read(path)) if path in names else None
        shared, styles = root("xl/sharedStrings.xml"), root("xl/styles.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in shared.iter(f"{_NS}si")] if shared is not None else []
        fills, formats = [], []
        if styles is not None:
            fills = [next((x.get("rgb", "") for x in f.iter(f"{_NS}fgColor")), "") for f in styles.iter(f"{_NS}fill")]
            xfs = styles.find(f"{_NS}cellXfs")
            formats = [int(x.get("fillId", 0)) for x in xfs] if xfs is not None else []
        sheet = root(min(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)))
        for c in sheet.iter(f"{_NS}c"):
            v, kind = c.find(f"{_NS}v"), c.get("t", "n")
            text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else v.text if v is not None and v.text else ""
            if kind == "s" and text:
                text = strings[int(text)]
            elif kind == "n" and re.fullmatch(r"\d+\.0+", text):
                text = text.partition(".")[0]
            style = int(c.get("s", 0))
            fill = fills[formats[style]] if style < len(formats) and formats[style] < len(fills) else ""
            if text.strip():
                ref = c.get("r")
                yield int(re.search(r"\d+", ref)[0]), _column(ref), text.strip(), fill


def cells(data: bytes, name: str) -> Iterator[tuple[int, int, str, str]]:
    kind = kind_of(data, name)
    if kind == "xls":
        from orderweave.sources.biff import biff_cells

        return biff_cells(data)
    return html_cells(data) if kind == "html" else xlsx_cells(data)


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of ``binaryFile`` rows; a file is one task's work, as a workbook is read whole."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(path, *c) for path, data in zip(b["path"], b["content"], strict=True) for c in cells(bytes(data), path)]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "col", "text", "fill"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return cells_of(spark.read.format("binaryFile").load(path))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        p = Path(self.path)
        return [_File(str(f)) for f in (sorted(p.iterdir()) if p.is_dir() else [p])]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for c in cells(f.read(), partition.path):
                yield (partition.path, *c)


class SheetSource(DataSource):
    """``spark.dataSource.register(SheetSource)``; for folders that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)
