"""Folders of spreadsheet workbooks.

Each workbook is one row of a ``binaryFile`` scan and is opened inside a task,
so a folder of thousands of workbooks is read in parallel.  A sheet format
limit of about a million rows bounds what one task handles.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Namespaces of the open spreadsheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

CELLS = "source_file string, row int, cells array<string>"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _sheet_path(book: zipfile.ZipFile, sheet: int) -> str:
    entries = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")
    target = [e.get(REL + "id") for e in entries][sheet - 1]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    path = next(link.get("Target") for link in links if link.get("Id") == target)
    return path.lstrip("/") if path.startswith("/") else "xl/" + path


def sheet_rows(content: bytes, sheet: int):
    """Yield (row number, cell texts) of one sheet; empty cells are None."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = [_text(item) for item in root.findall(MAIN + "si")]
    with book.open(_sheet_path(book, sheet)) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != MAIN + "row":
                continue
            cells: dict[int, str] = {}
            for position, cell in enumerate(row.findall(MAIN + "c")):
                value = cell.find(MAIN + "v")
                kind = cell.get("t")
                if kind == "inlineStr":
                    text = _text(cell)
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(value.text)]
                else:
                    text = value.text
                reference = cell.get("r")
                cells[_column(reference) if reference else position] = text
            width = max(cells, default=-1) + 1
            yield int(row.get("r") or 0), [cells.get(i) for i in range(width)]
            row.clear()


def scan_cells(
    spark: SparkSession, folder: str, pattern: str, sheet: int = 1, skip: int = 0,
    glob: str = "*.xlsx",
) -> DataFrame:
    """(source_file, row, cells) of one sheet of every matching workbook,
    after ``skip`` leading rows.  The header row is still included."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        .withColumn("name", F.url_decode(F.element_at(F.split("path", "/"), -1)))
        .where(F.col("name").rlike(pattern))
        .select("name", "content")
    )

    def read(batches):
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                chunk = []
                for number, cells in sheet_rows(content, sheet):
                    if number > skip:
                        chunk.append((name, number, cells))
                    if len(chunk) == 5000:
                        yield pd.DataFrame(chunk, columns=["source_file", "row", "cells"])
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=["source_file", "row", "cells"])

    return files.mapInPandas(read, CELLS)


def read_sheets(
    spark: SparkSession, folder: str, pattern: str, columns: list[str], sheet: int = 1,
    skip: int = 0,
) -> DataFrame:
    """Text columns picked by header name, with the source file.

    Every workbook is matched through its own header row, so column order may
    differ between files; a column a file lacks is null.  Blank headers are
    named by position (``...17``).
    """
    cells = scan_cells(spark, folder, pattern, sheet, skip)
    first = cells.groupBy("source_file").agg(F.min_by("cells", "row").alias("__names"),
                                             F.min("row").alias("__header"))
    names = F.transform(
        "__names",
        lambda n, i: F.coalesce(n, F.concat(F.lit("..."), (i + 1).cast("string"))),
    )
    # one header row per workbook; joined by file name, size checked by Spark
    keyed = cells.join(first.withColumn("__names", names), "source_file").where(
        F.col("row") > F.col("__header")
    )
    picked = [
        F.get(F.col("cells"), F.array_position("__names", c).cast("int") - 1).alias(c)
        for c in columns
    ]
    return keyed.select("source_file", *picked)
