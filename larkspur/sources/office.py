"""Workbooks and text documents as zipped XML, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    s, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def read_xlsx(data: bytes) -> dict[str, tuple[list[str], list[list[str]]]]:
    """Header and rows of every sheet, all cells strings; missing ones, and the
    text "nan", are ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            grid: list[dict[int, str]] = []
            for row in root.iter(f"{_S}row"):
                cells = {}
                for k, c in enumerate(row.iter(f"{_S}c")):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    cells[_column(c.get("r")) if c.get("r") else k] = "" if text == "nan" else text
                grid.append(cells)
            width = max((max(r, default=-1) for r in grid), default=-1) + 1
            full = [[r.get(i, "") for i in range(width)] for r in grid]
            out[sheet.get("name")] = (full[0], full[1:]) if full else ([], [])
    return out


def display(sheets: dict[str, tuple[list[str], list[list[str]]]]) -> str:
    """A workbook as text for a model: every sheet's name, header and rows, cells
    parted by bars."""
    out = []
    for name, (header, rows) in sheets.items():
        out.append("\n".join([f"=== Sheet: {name} ===", *(" | ".join(r) for r in [header, *rows] if r)]))
    return "\n\n".join(out)


def write_xlsx(sheets: dict[str, tuple[list[str], list[list[str]]]]) -> bytes:
    """A workbook of string cells; a sheet without rows keeps its header."""
    buf = io.BytesIO()
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        parts = [f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)]
        z.writestr(
            "[Content_Types].xml",
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            + "".join(parts) + "</Types>",
        )
        rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
        z.writestr("_rels/.rels", rel.format(f'<Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/>'))
        z.writestr("xl/_rels/workbook.xml.rels", rel.format("".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))))
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{kind}"><sheets>{names}</sheets></workbook>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            lines = []
            for n, r in enumerate([header, *rows] if header else [], 1):
                cells = "".join(f'<c r="{_letters(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for k, v in enumerate(r))
                lines.append(f'<row r="{n}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return buf.getvalue()


def _paragraph(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{_W}t"))


def read_docx(data: bytes) -> list[tuple[str, int, str]]:
    """(part, number, text): paragraphs that are not blank, then table rows with
    their cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := _paragraph(p)).strip()]
    rows = [" | ".join("\n".join(_paragraph(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return [("paragraph", i, t) for i, t in enumerate(paragraphs)] + [("table", i, t) for i, t in enumerate(rows)]


def rewrite_docx(data: bytes, pairs: list[tuple[str, str]]) -> bytes:
    """A document with texts replaced in all paragraphs, the longest first; a
    changed paragraph keeps the format of its first run."""
    pairs = sorted(pairs, key=lambda p: (-len(p[0]), p[0]))
    for name, uri in (("w", _W),):
        ET.register_namespace(name, uri[1:-1])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            raw = z.read(item.filename)
            if item.filename == "word/document.xml":
                root = ET.fromstring(raw)
                for p in root.iter(f"{_W}p"):
                    old = new = _paragraph(p)
                    for a, b in pairs:
                        new = new.replace(a, b) if a else new
                    if new != old:
                        for k, t in enumerate(p.iter(f"{_W}t")):
                            t.text = new if k == 0 else ""
                            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                raw = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            to.writestr(item, raw)
    return out.getvalue()


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row_index, cells) of files (path, content); a file that is
    no workbook gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                try:
                    rows = [(r.path, s, i, dict(zip(h, v)), None) for s, (h, body) in read_xlsx(bytes(r.content)).items() for i, v in enumerate(body)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows = [(r.path, None, None, None, str(e))]
                out = pd.DataFrame(rows, columns=["path", "sheet", "row_index", "cells", "error"])
                yield out.astype({"row_index": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row_index long, cells map<string,string>, error string")


def document_parts(files: DataFrame) -> DataFrame:
    """(path, part, idx, text) of files (path, content), errors as above."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                try:
                    rows = [(r.path, p, i, t, None) for p, i, t in read_docx(bytes(r.content))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows = [(r.path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "part", "idx", "text", "error"]).astype({"idx": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, part string, idx int, text string, error string")
