"""Spreadsheet workbooks as a data source: one task per file, rows streamed.

A workbook is a zip of compressed XML, which cannot be entered in the middle, and holds at
most 1,048,576 rows per sheet, so a file is the natural unit of work. Only the first, active
sheet is read. Date cells come out as ISO text, everything else as it is stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The built-in number formats that show a date.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))

_CELLS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("place", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])


def header_key(text: str | None) -> str:
    """What headers are compared by."""
    return (text or "").strip().upper()


def header_places(header: Sequence[str | None], duplicates: str = "first") -> dict[str, int]:
    """The place of every header; of repeated ones the ``first`` or ``last`` counts."""
    out: dict[str, int] = {}
    for i, name in enumerate(header):
        if duplicates == "last" or header_key(name) not in out:
            out[header_key(name)] = i
    return out


def read_workbooks(
    spark: SparkSession, path: str, duplicates: str = "first", required: Sequence[str] = (),
) -> DataFrame:
    """All rows below the headers of the workbooks at ``path``, one text column per header.

    Every file is read by its own header: columns are those of all files, in the order in which
    the files, by path, have them, named as first written; headers are compared trimmed and in
    upper case. A column that a file does not have is NULL there; of repeated headers of a file the
    ``first`` or ``last`` counts. Files that lack one of ``required`` give no rows. Adds
    ``row_ordinal`` (file, row).
    """
    files = spark.read.format("binaryFile").load(path)
    heads = files.mapInPandas(_head, _CELLS).groupBy("cells").agg(F.min("file").alias("file"))
    names: dict[str, str] = {}
    for head in sorted(heads.collect(), key=lambda r: r["file"]):  # one row per different header
        for name in head["cells"]:
            names.setdefault(header_key(name), name or "")
    if not names:
        raise ValueError(f"no rows in {path}")
    rows = files.mapInPandas(_rows_by(list(names), duplicates, [header_key(c) for c in required]), _CELLS)
    picked = rows.select(
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))],
        F.struct("file", "place").alias("row_ordinal"))
    return picked.toDF(*names.values(), "row_ordinal")


def _head(frames):
    import pandas as pd

    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            for cells in sheet_rows(content):
                yield pd.DataFrame({"file": [path], "place": [0], "cells": [cells]})
                break


def _rows_by(keys: list[str], duplicates: str, required: list[str]):
    """Rows of each workbook with their cells in the order of ``keys``."""
    def rows(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                sheet = sheet_rows(content)
                at = header_places(next(sheet, []), duplicates)
                if not at.keys() >= set(required):
                    continue
                places = [at.get(k, 1 << 30) for k in keys]
                place, batch = 0, []
                for cells in sheet:
                    place += 1
                    batch.append((path, place, [cells[i] if i < len(cells) else None for i in places]))
                    if len(batch) == 10_000:
                        yield pd.DataFrame(batch, columns=["file", "place", "cells"])
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=["file", "place", "cells"])
    return rows


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the active sheet as lists of texts."""
    import io
    import zipfile
    from xml.etree.ElementTree import iterparse, parse

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        members = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in members:
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in iterparse(f):
                    if node.tag == _MAIN + "si":
                        shared.append("".join(
                            t.text or "" for run in (node, *node.iter(_MAIN + "r"))
                            for t in run.findall(_MAIN + "t")))
                        node.clear()

        date_styles = set()
        if "xl/styles.xml" in members:
            with book.open("xl/styles.xml") as f:
                styles = parse(f).getroot()
            own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(_MAIN + "numFmt")}
            cell_styles = styles.find(_MAIN + "cellXfs")
            for i, style in enumerate(cell_styles if cell_styles is not None else ()):
                number = int(style.get("numFmtId", 0))
                if number in _DATE_FORMATS or _shows_date(own.get(number, "")):
                    date_styles.add(i)

        with book.open("xl/workbook.xml") as f:
            workbook = parse(f).getroot()
        views = list(workbook.iter(_MAIN + "workbookView"))
        active = int(views[0].get("activeTab", 0)) if views else 0
        sheet_id = list(workbook.iter(_MAIN + "sheet"))[active].get(_REL + "id")
        properties = workbook.find(_MAIN + "workbookPr")
        late_epoch = properties is not None and properties.get("date1904") in ("1", "true")
        epoch = datetime(1904, 1, 1) if late_epoch else datetime(1899, 12, 30)
        with book.open("xl/_rels/workbook.xml.rels") as f:
            target = next(r.get("Target") for r in parse(f).getroot() if r.get("Id") == sheet_id)
        sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

        with book.open(sheet) as f:
            data = None
            for event, node in iterparse(f, ("start", "end")):
                if event == "start":
                    data = node if node.tag == _MAIN + "sheetData" else data
                    continue
                if node.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for cell in node.findall(_MAIN + "c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at - len(cells)))
                    cells.append(_cell_text(cell, shared, date_styles, epoch))
                data.clear()
                yield cells


def _shows_date(code: str) -> bool:
    import re

    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())
    return any(c in plain for c in "ymdhs") and "general" not in plain


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell_text(cell, shared: list[str], date_styles: set[int], epoch: datetime) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(_MAIN + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in date_styles:
        return (epoch + timedelta(days=float(value.text))).strftime("%Y-%m-%d")
    return value.text
