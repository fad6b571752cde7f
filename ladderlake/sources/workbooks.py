"""Workbooks and archives: their content as rows, and sheets loaded by a declared list of specifications."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlake.sources import readers

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, sheet string, row int, col int, text string"
KINDS = ("table", "wide", "pairs", "headerless", "sections", "cities")


@dataclass(frozen=True)
class SheetSpec:
    """How one sheet is loaded.

    ``kind``: 'table' (headers by alias), 'wide' (a server column, every other
    column a metric), 'pairs' (server and value in neighbouring cells),
    'headerless' (server and value by column), 'sections' (rows below a row
    that names their server) or 'cities' (rows whose first cell names a server).
    """

    sheet: str
    kind: str = "table"
    header_row: int = 1
    required: tuple[str, ...] = ("server", "value")
    server: int = 0
    value: int = 1

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of sheet: {self.kind}")


def _column(reference: str) -> int:
    """Column number from 0 of a reference such as 'AB12'."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row from 1, column from 0, text) of all filled cells of a workbook, in the order of its sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_ID)]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            row = 0
            for _, node in ElementTree.iterparse(io.BytesIO(book.read(path))):
                if node.tag != f"{_MAIN}row":
                    continue
                row = int(node.get("r") or row + 1)
                col = -1
                for cell in node.iter(f"{_MAIN}c"):
                    col = _column(cell.get("r")) if cell.get("r") else col + 1
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    text = _text(cell.find(f"{_MAIN}is")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind is None or kind == "n":
                        text = re.sub(r"\.0+$", "", text)
                    if text.strip():
                        yield sheet.get("name"), row, col, text
                node.clear()


def workbook_cells(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """(file, sheet, row, col, text) of all workbooks below ``path``.

    Each workbook is read by one task, whatever their number; blank cells give
    no rows and a file that is no workbook none at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = list(cells_of(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=["sheet", "row", "col", "text"]).assign(file=file.rsplit("/", 1)[-1])[["file", "sheet", "row", "col", "text"]]

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, CELLS)


def sheet_table(cells: DataFrame, sheet: str, header_row: int | None = 1) -> DataFrame:
    """One sheet as a table: its header row gives the names (empty and repeated ones are numbered), further columns are c0, c1, …"""
    mine = cells.where(F.col("sheet") == sheet)
    width = mine.agg(F.max("col")).first()[0]
    head = {r["col"]: r["text"].strip() for r in mine.where(F.col("row") == header_row).select("col", "text").collect()} if header_row else {}  # one row of a sheet
    names: list[str] = []
    for c in range(-1 if width is None else width + 1):
        name = head.get(c) or f"c{c}"
        names.append(name if name not in names else f"{name}_{c}")
    body = mine.where(F.col("row") > (header_row or 0))
    wide = body.groupBy("file", "row").agg(F.first("sheet").alias("sheet"), *[F.max(F.when(F.col("col") == c, F.col("text"))).alias(n) for c, n in enumerate(names)])
    return wide


def load_sheet(cells: DataFrame, spec: SheetSpec) -> DataFrame:
    """The rows of one sheet by its specification."""
    mine = cells.where(F.col("sheet") == spec.sheet)
    if spec.kind == "pairs":
        return readers.adjacent_pairs(mine)
    if spec.kind in ("table", "wide"):
        body = sheet_table(cells, spec.sheet, spec.header_row).drop("file", "row", "sheet")
        if spec.kind == "table":
            return readers.canonical_sheet(body, spec.required)
        server = next((c for c in body.columns if readers.canonical_header(c) == "server"), None)
        if server is None:
            raise ValueError("sheet lacks columns: server")
        numbers = body.select(F.regexp_extract(F.col(f"`{server}`"), "([0-9]{1,5})", 1).try_cast("int").alias("server"), *[F.regexp_replace(F.col(f"`{c}`"), "[., ]", "").try_cast("bigint").alias(c) for c in body.columns if c != server])
        return readers.wide_metrics(numbers.where("server is not null"), ["server"])
    body = sheet_table(cells, spec.sheet, None)
    plain = [c for c in body.columns if c not in ("file", "row", "sheet")]
    if spec.kind == "headerless":
        return readers.headerless_block(body.select(*plain), spec.server, spec.value)
    return readers.cities_block(body.select(*plain), plain[0]) if spec.kind == "cities" else readers.section_rows(body, first=plain[0])


def load_workbooks(spark: SparkSession, path: str, specs: list[SheetSpec]) -> dict[str, DataFrame]:
    """A table for every specification over all workbooks below ``path``."""
    cells = workbook_cells(spark, path)
    return {s.sheet: load_sheet(cells, s) for s in specs}


def archive_entries(spark: SparkSession, path: str, endings: tuple[str, ...] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """(archive, name, length, sha256) of the files in all zip archives below ``path`` with one of the endings; folders and hidden files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.infolist():
                            name = entry.filename.rsplit("/", 1)[-1]
                            if name.lower().endswith(endings) and not name.startswith("."):
                                data = z.read(entry)
                                out.append((file.rsplit("/", 1)[-1], entry.filename, len(data), hashlib.sha256(data).hexdigest()))
                except zipfile.BadZipFile:
                    continue
            if out:
                yield pd.DataFrame(out, columns=["archive", "name", "length", "sha256"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInPandas(run, "archive string, name string, length bigint, sha256 string")
