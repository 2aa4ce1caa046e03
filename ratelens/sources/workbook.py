"""Sheets of a workbook (Office Open XML) as tables of texts."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ranged

#: Name spaces and member names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BOOK, LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, all of its runs (phonetic hints aside)."""
    own = [t.text or "" for t in element.findall(f"{MAIN}t")]
    return "".join(own + [t.text or "" for r in element.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")])


def _elements(archive: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one after another; what has been read is let go."""
    with archive.open(member) as source:
        root = None
        for event, element in ElementTree.iterparse(source, ("start", "end")):
            root = element if root is None else root
            if event == "end" and element.tag == f"{MAIN}{tag}":
                yield element
                element.clear()
                if tag == "row":
                    root.find(f"{MAIN}sheetData").clear()


def _member(archive: zipfile.ZipFile, sheet: str) -> str:
    """The member that holds a sheet, given by name or by number from 0."""
    sheets = [(e.get("name"), e.get(LINK)) for e in _elements(archive, BOOK, "sheet")]
    named = {n: link for n, link in sheets}
    if sheet not in named and not (sheet.isdigit() and int(sheet) < len(sheets)):
        raise ValueError(f"the workbook has the sheets {[*named]}, not {sheet}")
    link = named[sheet] if sheet in named else sheets[int(sheet)][1]
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read(LINKS))}
    return links[link].lstrip("/") if links[link].startswith("/") else f"xl/{links[link]}"


def column_number(reference: str) -> int:
    """The number from 0 of the column of a cell such as AB12."""
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def sheet_rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts: numbers as they are stored, booleans as 1 and 0, errors and blanks as null. The
    workbook's shared strings are held, rows are streamed."""
    with ranged.opened(path) as source, zipfile.ZipFile(source) as archive:
        shared = [_text(e) for e in _elements(archive, STRINGS, "si")] if STRINGS in archive.namelist() else []
        for row in _elements(archive, _member(archive, sheet), "row"):
            cells: list[str | None] = []
            for cell in row.findall(f"{MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                text = None if value is None else value.text
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = _text(cell.find(f"{MAIN}is")) if cell.find(f"{MAIN}is") is not None else None
                elif kind == "e":
                    text = None
                cells[at] = text
            yield cells


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.path, self.sheet, self.width = options["path"], options.get("sheet", "0"), width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a sheet is one stream of XML

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(self.path, self.sheet)
        next(rows, None)
        for number, cells in enumerate(rows, 1):
            if any(c is not None for c in cells):
                yield (number, *(cells + [None] * self.width)[: self.width])


class Workbook(DataSource):
    """Rows of a sheet below its header, with their number as line; columns without a name are called by their number."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        names = [h.strip() if h and h.strip() else f"column_{i}" for i, h in enumerate(next(sheet_rows(self.options["path"], self.options.get("sheet", "0")), []))]
        if len(set(names)) < len(names):
            raise ValueError(f"columns have equal names: {names}")
        return ", ".join(["line bigint", *[f"`{n.replace('`', '``')}` string" for n in names]])

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader(self.options, len(schema.fields) - 1)


def workbook(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of a workbook as texts by column, with its rows' numbers as line."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").options(path=str(path), sheet=str(sheet)).load()
