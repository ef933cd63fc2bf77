"""Small ``.xlsx`` files made with the standard library."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


class Date:
    """A cell with a day number in date format."""

    def __init__(self, serial: float):
        self.serial = serial


class Error:
    """A cell holding ``#N/A``."""


def _name(col: int) -> str:
    out = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(path, sheets: dict, properties: dict | None = None, chart: str = "") -> str:
    """``sheets``: name to rows of cells (None, str, bool, int, float, Date, Error); ``chart`` names a chart sheet."""
    strings: list[str] = []

    def cell(value, row, col):
        place = f'r="{_name(col)}{row + 1}"'
        if value is None:
            return ""
        if isinstance(value, Error):
            return f'<c {place} t="e"><v>#N/A</v></c>'
        if isinstance(value, bool):
            return f'<c {place} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, Date):
            return f'<c {place} s="1"><v>{value.serial}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c {place}><v>{value}</v></c>"
        if value.startswith("inline:"):
            return f'<c {place} t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
        strings.append(value)
        return f'<c {place} t="s"><v>{len(strings) - 1}</v></c>'

    parts = {}
    for i, rows in enumerate(sheets.values()):
        body = "".join(
            f'<row r="{r + 1}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>"
            for r, row in enumerate(rows)
            if any(v is not None for v in row)
        )
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'
    names = "".join(
        f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)
    )
    links = "".join(
        f'<Relationship Id="rId{i + 1}" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
        for i in range(len(sheets))
    )
    links += f'<Relationship Id="s1" Type="{_DOCUMENT}/sharedStrings" Target="/xl/sharedStrings.xml"/>'
    links += f'<Relationship Id="s2" Type="{_DOCUMENT}/styles" Target="styles.xml"/>'
    if chart:
        names = f'<sheet name="{chart}" sheetId="99" r:id="c1"/>' + names
        links += f'<Relationship Id="c1" Type="{_DOCUMENT}/chartsheet" Target="chartsheets/sheet1.xml"/>'
    parts["_rels/.rels"] = (
        f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_DOCUMENT}/officeDocument" '
        'Target="xl/workbook.xml"/></Relationships>'
    )
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets>{names}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>'
    parts["xl/sharedStrings.xml"] = (
        f'<sst xmlns="{_MAIN}">' + "".join(f"<si><r><t>{escape(s)}</t></r></si>" for s in strings) + "</sst>"
    )
    parts["xl/styles.xml"] = (
        f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    )
    core = "".join(f"<x:{k} xmlns:x='urn:x'>{escape(v)}</x:{k}>" for k, v in (properties or {}).items())
    parts["docProps/core.xml"] = f"<core>{core}</core>"
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return str(path)
