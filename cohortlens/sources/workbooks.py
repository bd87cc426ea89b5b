"""Spreadsheets (.xlsx, which is XML in a zip) as rows of text cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "path string, sheet string, row long, cells array<string>, error string"


def column_number(reference: str) -> int:
    """A1 gives 0, B7 gives 1, AA1 gives 26."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of the first sheet or of a named one, one row at a time; an absent cell is None, and a name that isn't there an error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(_LINK)]) for s in book.iter(f"{_MAIN}sheet")]
        name, target = next((s for s in sheets if sheet in (None, s[0])), (None, None))
        if target is None:
            raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        with z.open("xl/" + target.removeprefix("/xl/").lstrip("/")) as f:
            at = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                at = int(e.get("r") or at + 1)
                cells: list[str | None] = []
                for c in e.iter(f"{_MAIN}c"):
                    k = column_number(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [None] * (k - len(cells))
                    value = c.find(f"{_MAIN}v")
                    kind = c.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                    elif value is None or value.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else value.text)
                yield name, at, cells
                e.clear()


def workbook_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """ROWS of workbooks (path, content), as the binary file source gives them; a file that can't be read is one row with its error."""
    ship(files.sparkSession)

    def run(batches):
        def batch(rows):
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols,
                (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()), strict=True)], ["path", "sheet", "row", "cells", "error"])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for name, at, cells in sheet_rows(content, sheet):
                        rows.append((path, name, at, cells, None))
                        if len(rows) == 2000:
                            yield batch(rows)
                            rows = []
                except Exception as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield batch(rows)

    return files.select("path", "content").mapInArrow(run, ROWS)


def table_of(rows: DataFrame, columns: list[str], header: int = 1) -> DataFrame:
    """Named text columns of workbook_rows() below the header row, which must begin with these names; others are left out. Rows of blanks only are dropped, and unreadable files are an error."""
    if not (bad := rows.filter("error IS NOT NULL").select("error").limit(1).collect()) == []:
        raise ValueError(bad[0]["error"])
    heads = rows.filter(F.col("row") == header).select(F.transform(F.slice("cells", 1, len(columns)), lambda c: F.trim(c)).alias("h")).distinct()
    if wrong := heads.filter(F.col("h") != F.array(*[F.lit(c) for c in columns])).limit(1).collect():
        raise ValueError(f"header {wrong[0]['h']} instead of {columns}")
    below = rows.filter((F.col("row") > header) & F.exists("cells", lambda c: F.trim(c) != ""))
    return below.select("path", "row", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small workbook with these sheets; text goes inline, numbers as they are, None leaves a cell out."""
    def cell(r, k, v):
        name, n = "", k + 1
        while n:
            n, d = divmod(n - 1, 26)
            name = chr(65 + d) + name
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{name}{r}"><v>{v}</v></c>'
        return f'<c r="{name}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = _MAIN[1:-1], _LINK[1:-3]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, k, v) for k, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
