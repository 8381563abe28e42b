"""Spreadsheets as a Spark data source: a partition a sheet, rows read from the zipped XML as they come.

    spark.dataSource.register(SheetSource)
    spark.read.format("sheets").load("folder/or/file.xlsx")
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import NAME_HEADERS, read_names

ROWS = "file string, sheet string, place int, row_number int, cells array<string>"
#: Rows of a sheet that go to Spark at once.
BATCH = 4096
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def kind_of(head: bytes) -> str:
    """The format by a file's first bytes: ``sheets`` (a zip archive), ``old sheets`` (a compound file, which isn't read) or ``text``."""
    return "sheets" if head[:2] == b"PK" else "old sheets" if head[:4] == b"\xd0\xcf\x11\xe0" else "text"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets in their order, with their parts."""
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name", ""), targets.get(s.get(_RELATION), "")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in found if t]


def _column(reference: str | None, fallback: int) -> int:
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return fallback
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The workbook's shared texts."""
    try:
        part = book.open("xl/sharedStrings.xml")
    except KeyError:
        return []
    out = []
    with part:
        for _, node in ElementTree.iterparse(part):
            if _local(node.tag) == "si":
                out.append("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))
                node.clear()
    return out


def rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """The sheet's rows with their numbers: cells by column as text, null where there is none; one row in memory at a time."""
    shared = _texts(book)
    number = 0
    with book.open(part) as data:
        for event, node in ElementTree.iterparse(data, events=("start", "end")):
            if event == "start" and _local(node.tag) == "sheetData":
                above = node
            if event == "start" or _local(node.tag) != "row":
                continue
            number = int(node.get("r") or number + 1)
            cells: list[str | None] = []
            for cell in node:
                at = _column(cell.get("r"), len(cells))
                cells += [None] * (at + 1 - len(cells))
                kind, value = cell.get("t"), next((v.text for v in cell if _local(v.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                elif kind == "s" and value is not None:
                    value = shared[int(value)] if int(value) < len(shared) else None
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                cells[at] = value
            yield number, cells
            above.clear()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Workbooks at a path: the file, or those in the folder by their ending."""
    system, inner = _opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".xlsx", ".xlsm")))


def _book(path: str) -> tuple[zipfile.ZipFile, IO]:
    system, inner = _opened(path)
    data = system.open_input_file(inner)
    return zipfile.ZipFile(data), data


class Sheet(InputPartition):
    def __init__(self, file: str, name: str, place: int, part: str):
        super().__init__((file, name, place, part))


class SheetReader(DataSourceReader):
    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def partitions(self) -> list[Sheet]:
        """A partition for each sheet; of a file only its list of sheets is read here."""
        out = []
        for file in _files(self.path):
            book, data = _book(file)
            with data, book:
                found = sheets(book)
            out += [Sheet(file, name, place, part) for place, (name, part) in enumerate(found) if self.only is None or name == self.only or (self.only == "first" and place == 0)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        file, name, place, part = partition.value
        book, data = _book(file)
        with data, book:
            held: list[tuple[int, list[str | None]]] = []

            def told():
                return pa.RecordBatch.from_pydict({"file": [file] * len(held), "sheet": [name] * len(held), "place": pa.array([place] * len(held), pa.int32()), "row_number": pa.array([n for n, _ in held], pa.int32()), "cells": pa.array([c for _, c in held], pa.list_(pa.string()))})

            for row in rows(book, part):
                held.append(row)
                if len(held) == BATCH:
                    yield told()
                    held.clear()
            if held:
                yield told()


class SheetSource(DataSource):
    """Rows of spreadsheets: ``file``, ``sheet``, ``place`` of the sheet, ``row_number`` from 1, ``cells`` as text. Option ``sheet``: a sheet's name, or ``first``."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("sheet"))


def sheet_names(cells: DataFrame) -> DataFrame:
    """Product names (``file``, ``sheet``, ``row_number``, ``name``) of sheet rows: the first column whose header says so, or the only column; the header is the sheet's first row.

    Sheets with several columns and no such header have no names; blank names are left out.
    Only each sheet's header goes around, by sheet.
    """
    label = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    head = cells.groupBy("file", "sheet").agg(F.min_by(label, "row_number").alias("labels"), F.min("row_number").alias("first"))
    known = F.array_position(F.transform("labels", lambda c: c.isin(*NAME_HEADERS)), F.lit(True))
    column = F.when(known > 0, known).when(F.size("labels") == 1, 1)
    head = head.select("file", "sheet", "first", column.cast("int").alias("column")).where("column IS NOT NULL")
    named = cells.join(head, ["file", "sheet"]).where("row_number > first")
    return named.select("file", "sheet", "row_number", F.trim(F.get("cells", F.col("column") - 1)).alias("name")).where("name <> ''")


def read_uploaded(spark: SparkSession, path: str, head: bytes) -> DataFrame:
    """Names of one uploaded file by its ending, else by its first bytes: CSV, or the first sheet of a workbook."""
    ending = path.lower().rpartition(".")[2]
    kind = "text" if ending == "csv" else "sheets" if ending in ("xlsx", "xlsm") else kind_of(head)
    if kind == "old sheets":
        raise ValueError("a workbook of the old kind; save it as .xlsx")
    if kind == "text":
        return read_names(spark, path)
    spark.dataSource.register(SheetSource)
    return sheet_names(spark.read.format("sheets").option("sheet", "first").load(path)).select("name")
