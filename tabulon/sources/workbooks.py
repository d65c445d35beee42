"""Spreadsheet files as a long table of cells, and writing cells back.

Files are read by Spark (``binaryFile``), so any store works, and unpacked in Arrow batches with the standard library: a workbook is a zip of XML
parts. Only cached values are read, and of texts what a cell shows, not the reading aids stored beside it. A workbook is the unit of
distribution. A template is edited in place: only the cells of its sheets' XML change, all other parts are copied as they are.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable

CELLS = "doc_id string, source_file string, sheet_idx int, sheet string, state string, max_row int, max_col int, row int, col int, vtype string, str_val string, num_val double, ts_val timestamp"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_M = "{%s}" % _NS["m"]
#: Characters that XML can't hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _column(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _texts(node) -> str:
    """The text of a shared or inline string: its own or that of its runs, not phonetic runs."""
    parts = [] if node is None else [x for x in node if x.tag == f"{_M}t"] + [t for r in node.findall("m:r", _NS) for t in r.findall("m:t", _NS)]
    return "".join(t.text or "" for t in parts)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, state, part) of each sheet."""
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = rels[s.get(_R)]
        out.append((s.get("name"), s.get("state", "visible"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def read_cells(raw: bytes, sheets_only: set[str] | None = None) -> Iterator[tuple]:
    """(sheet_idx, sheet, state, max_row, max_col, row, col, vtype, text, number, time) of all cells that hold a value."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        shared = [_texts(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
            formats = styles.find("m:cellXfs", _NS)
            for x in formats if formats is not None else []:
                k = int(x.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
                dates.append(k in _DATE_FORMATS or bool(re.search("[ymdh]", code.lower())))
        for index, (name, state, part) in enumerate(sheets(book)):
            if sheets_only and name not in sheets_only:
                continue
            found, at_row = [], 0
            for row in ET.fromstring(book.read(part)).iter(f"{_M}row"):
                at_row = int(row.get("r", at_row + 1))
                at_col = 0
                for c in row.iter(f"{_M}c"):
                    ref = c.get("r")
                    at_col = _column(re.match("[A-Z]+", ref)[0]) if ref else at_col + 1
                    kind, v = c.get("t", "n"), c.find("m:v", _NS)
                    text = v.text if v is not None else None
                    if kind == "inlineStr":
                        found.append((at_row, at_col, "s", _texts(c.find("m:is", _NS)), None, None))
                    elif text is None:
                        continue
                    elif kind == "s":
                        found.append((at_row, at_col, "s", shared[int(text)], None, None))
                    elif kind == "b":
                        found.append((at_row, at_col, "b", None, float(text), None))
                    elif kind in ("str", "e", "d"):
                        found.append((at_row, at_col, "s", text, None, None))
                    else:
                        style, number = int(c.get("s", 0)), float(text)
                        if style < len(dates) and dates[style]:
                            found.append((at_row, at_col, "d", None, number, datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)))
                        else:
                            found.append((at_row, at_col, "n", None, number, None))
            max_row, max_col = max((f[0] for f in found), default=0), max((f[1] for f in found), default=0)
            for f in found:
                yield (index, name, state, max_row, max_col, *f)


def workbook_cells(spark: SparkSession, path: str, sheets_only: set[str] | None = None) -> DataFrame:
    """CELLS of all workbooks that ``path`` names (a file, a folder, or a pattern)."""
    reachable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"]):
                rows = [(name, name, *x) for x in read_cells(bytes(raw), sheets_only)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")]).astype({"num_val": "float64", "ts_val": "datetime64[us]"})

    return files.select("path", "content").mapInPandas(run, CELLS)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"[^/\\]*$", 0).alias("file_name"), F.sha2("content", 256).alias("sha256"))


def _safe(text: str) -> str:
    return escape(_FORBIDDEN.sub("", text))


def _cell_xml(row: int, col: int, text: str | None, number: float | None, style: str = "", prefix: str = "") -> str:
    """A cell; ``style`` is its style attribute, without which an empty cell is left out."""
    p, start = prefix, f'<{prefix}c r="{_letters(col)}{row}"{style}'
    if number is not None:
        shown = str(int(number)) if float(number).is_integer() else repr(float(number))
        return f"{start}><{p}v>{shown}</{p}v></{p}c>"
    if text:
        return f'{start} t="inlineStr"><{p}is><{p}t xml:space="preserve">{_safe(text)}</{p}t></{p}is></{p}c>'
    return f"{start}/>" if style else ""


def workbook_bytes(content: dict[str, list[tuple[int, int, str | None, float | None]]]) -> bytes:
    """A workbook of the given sheets: name -> (row, column, text, number)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(content) + 1))
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(content, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["m"]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(content) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        for i, cells in enumerate(content.values(), 1):
            rows: dict[int, list[tuple[int, str]]] = {}
            for r, c, text, number in cells:
                rows.setdefault(r, []).append((c, _cell_xml(r, c, text, number)))
            body = "".join(f'<row r="{r}">{"".join(x for _, x in sorted(rows[r]))}</row>' for r in sorted(rows))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _elements(xml: str, name: str) -> Iterator[tuple[str, str, str, str]]:
    """(prefix, attributes, content, whole) of the elements of a name that doesn't occur inside itself."""
    for m in re.finditer(rf"<((?:\w+:)?){name}\b([^>]*?)(?:/>|>(.*?)</\1{name}>)", xml, re.S):
        yield m[1], m[2], m[3] or "", m[0]


def _attribute(attributes: str, name: str) -> str | None:
    found = re.search(rf'(?<![\w:]){name}\s*=\s*("[^"]*"|\'[^\']*\')', attributes)
    return found[1][1:-1] if found else None


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    return int(digits), _column(letters)


def _covered(xml: str) -> set[tuple[int, int]]:
    """Cells of merged regions but their first ones."""
    out = set()
    for _, attributes, _, _ in _elements(xml, "mergeCell"):
        (top, left), (bottom, right) = (_place(x) for x in (_attribute(attributes, "ref").split(":") * 2)[:2])
        out |= {(r, c) for r in range(top, bottom + 1) for c in range(left, right + 1)} - {(top, left)}
    return out


def deepest_row(xml: str) -> int:
    """The last row that has a cell, empty ones included."""
    return max((_place(ref)[0] for _, a, _, _ in _elements(xml, "c") if (ref := _attribute(a, "r"))), default=0)


def edited_sheet(xml: str, clear: bool, writes: dict[tuple[int, int], tuple[str | None, float | None]]) -> str:
    """A sheet's XML with the values of its cells taken away (``clear``; covered cells of merged regions keep theirs) and others written.

    Cells keep their styles and rows their attributes; what stands outside the cells isn't touched."""
    found = next(_elements(xml, "sheetData"), None)
    if found is None:
        return xml
    p, _, content, whole = found
    covered = _covered(xml) if clear else set()
    rows: dict[int, tuple[str, dict[int, str]]] = {}
    styles: dict[tuple[int, int], str] = {}
    at = 0
    for _, attributes, cells, _ in _elements(content, "row"):
        at = int(_attribute(attributes, "r") or at + 1)
        kept: dict[int, str] = {}
        col = 0
        for _, own, _, raw in _elements(cells, "c"):
            ref = _attribute(own, "r")
            col = _place(ref)[1] if ref else col + 1
            style = _attribute(own, "s")
            styles[at, col] = f' s="{style}"' if style else ""
            kept[col] = raw if not clear or (at, col) in covered else _cell_xml(at, col, None, None, styles[at, col], p)
        rows[at] = re.sub(r"\s(?:r|spans)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", attributes), kept
    for (row, col), (text, number) in writes.items():
        rows.setdefault(row, ("", {}))[1][col] = _cell_xml(row, col, text, number, styles.get((row, col), ""), p)
    body = "".join(f'<{p}row r="{r}"{rows[r][0].rstrip()}>{"".join(rows[r][1][c] for c in sorted(rows[r][1]))}</{p}row>' for r in sorted(rows))
    return xml.replace(whole, f"<{p}sheetData>{body}</{p}sheetData>", 1)


def _recalculated(xml: str) -> str:
    """The workbook's XML, set to compute formulas when it is opened."""
    def again(m):
        return f'{m[1]}{re.sub(r" fullCalcOnLoad=.[^ ]*.", "", m[2])} fullCalcOnLoad="1"{m[3]}'

    if re.search(r"<(?:\w+:)?calcPr\b", xml):
        return re.sub(r"(<(?:\w+:)?calcPr\b)([^>]*?)(\s*/?>)", again, xml, count=1)
    for name in ("definedNames", "externalReferences", "functionGroups", "sheets"):
        if m := re.search(rf"</((?:\w+:)?){name}>", xml):
            return f'{xml[: m.end()]}<{m[1]}calcPr fullCalcOnLoad="1"/>{xml[m.end() :]}'
    return xml


def filled_template(template: bytes, writes: list[tuple[str, int, int, str | None, float | None]], required: list[str], cover: str, limit_sheet: str, limit) -> bytes:
    """The template with all values of the required sheets but the cover cleared and ``writes`` put in; formats, merged regions, other sheets
    and all other parts stay. ``limit(max_row)`` bounds the rows written to ``limit_sheet``; an error names missing sheets or an overflow."""
    with zipfile.ZipFile(io.BytesIO(template)) as book:
        parts = {name: part for name, _, part in sheets(book)}
        if missing := sorted(set(required) - set(parts)):
            raise ValueError(f"the template lacks sheets: {missing}")
        of: dict[str, dict[tuple[int, int], tuple[str | None, float | None]]] = {}
        for name, row, col, text, number in writes:
            of.setdefault(parts[name], {})[row, col] = (text, number)
        text_of = lambda name: book.read(name).decode("utf-8-sig")
        lowest = max((w[1] for w in writes if w[0] == limit_sheet), default=0)
        if lowest > (most := limit(deepest_row(text_of(parts[limit_sheet])))):
            raise ValueError(f"the template holds {most} rows, {lowest} are needed")
        cleared = {parts[n] for n in required if n != cover}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for info in book.infolist():
                if info.filename == "xl/calcChain.xml":  # names cells that may hold no formula any more
                    continue
                raw = book.read(info)
                if info.filename in cleared or info.filename in of:
                    raw = edited_sheet(text_of(info.filename), info.filename in cleared, of.get(info.filename, {})).encode()
                elif info.filename == "xl/workbook.xml":
                    raw = _recalculated(text_of(info.filename)).encode()
                elif info.filename in ("[Content_Types].xml", "xl/_rels/workbook.xml.rels") and b"calcChain.xml" in raw:
                    raw = re.sub(r"<(?:Override|Relationship)\b[^>]*calcChain\.xml[^>]*/>", "", text_of(info.filename)).encode()
                new.writestr(info, raw)
    return out.getvalue()
