"""Cells of spreadsheet files (XLSX), read with the standard library; one task reads one file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_no(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in held.namelist():
            for entry in ElementTree.fromstring(held.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in entry.iter(f"{_MAIN}t")))
        targets = {
            r.get("Id"): r.get("Target") for r in ElementTree.fromstring(held.read("xl/_rels/workbook.xml.rels"))
        }
        for sheet in ElementTree.fromstring(held.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            root = ElementTree.fromstring(held.read("xl/" + targets[sheet.get(f"{_REL}id")].removeprefix("/xl/")))
            for row in root.iter(f"{_MAIN}row"):
                for cell in row.iter(f"{_MAIN}c"):
                    value = cell.find(f"{_MAIN}v")
                    inline = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    text = inline if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
                    if text:
                        yield sheet.get("name"), int(row.get("r")) - 1, _column_no(cell.get("r")), text


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, column_no, text) of every filled cell."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(
                    [(file, *c) for c in _cells(content)], columns=["file", "sheet", "row_no", "column_no", "text"]
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, sheet string, row_no int, column_no int, text string")
