"""Workbooks in the open spreadsheet format (XLSX), read as cells and written from tables, with the standard library alone.

A workbook is a ZIP of XML parts. Parts are read as streams, one sheet at a time, so a sheet of a million rows is never
held as a tree. Values come as text: numbers as they are stored, dates as ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss``."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The built-in formats that show dates or times, and the day that date numbers count from.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
#: Characters that a part may unpack to: more is taken for an attack.
MOST_BYTES = 2_000_000_000
MOST_SHEET_ROWS = 1_048_576


def _events(book: zipfile.ZipFile, part: str, tags: tuple[str, ...]) -> Iterator[ElementTree.Element]:
    """Finished elements of a part with one of the names, freed after use."""
    if book.getinfo(part).file_size > MOST_BYTES:
        raise ValueError(f"{part}: over the limit")
    with book.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag in tags:
                yield e
                e.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of a string item, without phonetic hints."""
    runs = [e.find(f"{_NS}t"), *(r.find(f"{_NS}t") for r in e.findall(f"{_NS}r"))]
    return "".join(t.text or "" for t in runs if t is not None)


def sheet_names(path: str) -> list[str]:
    """Names of the sheets, in their order."""
    with zipfile.ZipFile(path) as book:
        return [name for name, _ in _sheets(book)]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    place = lambda t: t.lstrip("/") if t.startswith("/") else str(PurePosixPath("xl") / t)
    return [(e.get("name"), place(targets[e.get(_REL)])) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    shown = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode") or "") for e in root.iter(f"{_NS}numFmt")}
    dates = DATE_FORMATS | {k for k, code in shown.items() if re.search("[ymdhs]", code, re.IGNORECASE) and "0" not in code.replace("00", "")}
    cells = root.find(f"{_NS}cellXfs")
    return {k for k, e in enumerate(cells if cells is not None else ()) if int(e.get("numFmtId") or 0) in dates}


def _moment(number: str, epoch: dt.datetime) -> str:
    try:
        at = epoch + dt.timedelta(seconds=round(float(number) * 86400))
    except (ValueError, OverflowError):
        return number
    return at.strftime("%Y-%m-%d %H:%M:%S" if at.time() != dt.time() else "%Y-%m-%d")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def read_cells(path: str, names: Sequence[str] | None = None) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of all cells that hold something, of all sheets or some."""
    with zipfile.ZipFile(path) as book:
        shared = [_text(e) for e in _events(book, "xl/sharedStrings.xml", (f"{_NS}si",))] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)
        epoch = EPOCH_1904 if re.search(rb'date1904="(1|true)"', book.read("xl/workbook.xml")) else EPOCH
        for sheet, part in _sheets(book):
            if names is not None and sheet not in names:
                continue
            for at, line in enumerate(_events(book, part, (f"{_NS}row",)), 1):
                row = int(line.get("r") or at)
                for k, c in enumerate(line.findall(f"{_NS}c"), 1):
                    kind, value = c.get("t") or "n", c.find(f"{_NS}v")
                    if kind == "inlineStr":
                        inner = c.find(f"{_NS}is")
                        text = _text(inner) if inner is not None else ""
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "TRUE" if value.text == "1" else "FALSE"
                    elif kind == "n" and int(c.get("s") or 0) in dates:
                        text = _moment(value.text, epoch)
                    else:
                        text = value.text
                    if text != "":
                        yield sheet, row, _column(c.get("r") or "") or k, text


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(df: DataFrame, path: str, sheet: str = "Sheet1") -> int:
    """A table as a workbook of one sheet, row by row as they come; the number of rows. More rows than a sheet holds are an error."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    name = escape(sheet, {'"': "&quot;"})
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for part, text in parts.items():
            book.writestr(part, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            line = lambda at, values: f'<row r="{at}">{"".join(_cell(f"{_letters(k)}{at}", v) for k, v in enumerate(values, 1))}</row>'.encode()
            f.write(line(1, df.columns))
            for r in df.toLocalIterator():
                n += 1
                if n >= MOST_SHEET_ROWS:
                    raise ValueError("more rows than a sheet holds")
                f.write(line(n + 1, r))
            f.write(b"</sheetData></worksheet>")
    return n
