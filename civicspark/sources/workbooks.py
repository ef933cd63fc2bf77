"""Workbook files: listing, and decoding to rows, extents, properties and errors.

Decoding is one narrow pass over the binary files. Each file is read by the
task that holds it, a row at a time; nothing is gathered per file afterwards.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from civicspark import schemas
from civicspark.operators.sheets import HEADER_ROW

_ROWS_PER_BATCH = 4096

# Texts that count as a missing cell.
MISSING_TEXTS = frozenset([
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
])

# The properties of a workbook report, with the core document
# property that holds each.
PROPERTIES = [
    ("Title", "title"), ("Author", "creator"), ("Description", "description"), ("Subject", "subject"),
    ("Identifier", "identifier"), ("Version", "version"), ("Last Modified By", "lastModifiedBy"),
    ("Category", "category"), ("Keywords", "keywords"), ("Created Date", "created"),
    ("Modified Date", "modified"),
]
NOT_AVAILABLE = "N/A"

# Built-in number formats that show a date or time.
_DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])


def scan_workbooks(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Listing of the ``.xlsx`` files in ``folder``; file bytes are read only if ``content`` is used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
    return reader.option("recursiveFileLookup", recursive).load(folder)


def is_xlsx(path: str | None):
    """Column test for the exact suffix ``.xlsx``."""
    return F.col(path).endswith(".xlsx")


def decode_workbooks(files: DataFrame) -> DataFrame:
    """All parts of all files (see ``schemas.WORKBOOK_PARTS``).

    A file that the source cannot load fails the job. Decode once: write the result to a table before deriving several others.
    """
    return files.select("path", "content").mapInArrow(_decode_batches, schemas.WORKBOOK_PARTS)


def sheet_rows(parts: DataFrame) -> DataFrame:
    """``file_path, sheet_index, sheet_name, row, values, dtypes``; blank rows between others are kept."""
    rows = parts.filter(F.col("part") == "row")
    return rows.select("file_path", "sheet_index", "sheet_name", "row", "values", "dtypes")


def sheet_extents(parts: DataFrame) -> DataFrame:
    """``file_path, sheet_index, sheet_name, n_rows, n_cols, heading, header`` of every sheet, empty ones included.

    ``heading`` and ``header`` are the cells that name a sheet and its
    columns. With them no operator has to look for these cells among the rows.
    """
    sheets = parts.filter(F.col("part") == "sheet")
    return sheets.select(
        "file_path", "sheet_index", "sheet_name", "n_rows", "n_cols", "heading", F.col("values").alias("header")
    )


def workbook_rejects(parts: DataFrame) -> DataFrame:
    """``file_path, reason`` of the files that do not open."""
    return parts.filter(F.col("part") == "error").select("file_path", F.col("text").alias("reason"))


def workbook_properties(parts: DataFrame) -> DataFrame:
    """``file_path, property, value``: all eleven properties of every opened file, absent ones as ``N/A``."""
    # The decoder gives each opened file exactly one row per property.
    found = parts.filter(F.col("part") == "property")
    return found.select(
        "file_path", F.col("name").alias("property"), F.coalesce("text", F.lit(NOT_AVAILABLE)).alias("value")
    )


def workbook_cells(rows: DataFrame) -> DataFrame:
    """The cell form ``file_path, sheet_index, sheet_name, row, col, value, dtype``; null cells are left out."""
    cell = F.posexplode(F.arrays_zip("values", "dtypes")).alias("col", "cell")
    return (
        rows.select("file_path", "sheet_index", "sheet_name", "row", cell)
        .select("file_path", "sheet_index", "sheet_name", "row", "col",
                F.col("cell.values").alias("value"), F.col("cell.dtypes").alias("dtype"))
        .filter(F.col("value").isNotNull())
    )


# -- inside the tasks ---------------------------------------------------------

_PARTS = to_arrow_schema(schemas.WORKBOOK_PARTS)


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            for record in _decode_file(path.as_py(), content.as_py()):
                held.append(record)
                if len(held) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_PARTS)
                    held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_PARTS)


def _decode_file(path: str, content: bytes) -> Iterator[dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            yield from _decode_book(path, book)
    except (MemoryError, OSError):  # not the file's fault: the task is tried again
        raise
    except Exception as error:  # any damage rejects the file, the others go on
        yield {"file_path": path, "part": "error", "text": f"{type(error).__name__}: {error}"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _root(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name))


def _relations(book: zipfile.ZipFile, name: str) -> dict[str, tuple[str, str]]:
    """Kind and file of each part that ``name`` refers to, by id."""
    folder, file = posixpath.split(name)
    links = {}
    for rel in _root(book, f"{folder}/_rels/{file}.rels".lstrip("/")):
        target = rel.get("Target", "")
        place = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        links[rel.get("Id")] = (rel.get("Type", "").rsplit("/", 1)[-1], place)
    return links


def _decode_book(path: str, book: zipfile.ZipFile) -> Iterator[dict]:
    entry = "xl/workbook.xml"
    for rel in _root(book, "_rels/.rels"):
        if rel.get("Type", "").endswith("/officeDocument"):
            entry = rel.get("Target", entry).lstrip("/")
    workbook = _root(book, entry)
    names = set(book.namelist())
    links = _relations(book, entry)
    kinds = {kind: place for kind, place in links.values() if place in names}
    strings = _shared_strings(book, kinds["sharedStrings"]) if "sharedStrings" in kinds else []
    dates = _date_styles(book, kinds["styles"]) if "styles" in kinds else []
    epoch = datetime(1899, 12, 30)
    for element in workbook.iter():
        if _local(element.tag) == "workbookPr" and element.get("date1904") in ("1", "true"):
            epoch = datetime(1904, 1, 1)

    core = {}
    if "docProps/core.xml" in names:
        core = {_local(e.tag): e.text for e in _root(book, "docProps/core.xml") if e.text}
    for name, source in PROPERTIES:
        yield {"file_path": path, "part": "property", "name": name, "text": core.get(source)}

    sheets = [
        (element.get("name"), *links[next(v for k, v in element.attrib.items() if _local(k) == "id")])
        for element in workbook.iter() if _local(element.tag) == "sheet"
    ]
    # Chart sheets have no cells and are left out.
    cells = [(name, place) for name, kind, place in sheets if kind == "worksheet"]
    for index, (name, place) in enumerate(cells):
        base = {"file_path": path, "sheet_index": index, "sheet_name": name}
        n_rows = n_cols = 0
        top: dict[int, list] = {}
        last: list = []
        with book.open(place) as stream:
            for number, values, dtypes in _rows(stream, strings, dates, epoch):
                if not values:
                    continue
                last = values
                if number <= HEADER_ROW:
                    top[number] = values
                for blank in range(n_rows, number):
                    yield {**base, "part": "row", "row": blank, "values": [], "dtypes": []}
                yield {**base, "part": "row", "row": number, "values": values, "dtypes": dtypes}
                n_rows, n_cols = number + 1, max(n_cols, len(values))
        heading = [_at(top.get(0), 1), _at(top.get(1), 0), _at(top.get(2), 0), _at(last, 0)]
        yield {
            **base, "part": "sheet", "n_rows": n_rows, "n_cols": n_cols,
            "heading": heading, "values": top.get(HEADER_ROW, []),
        }


def _at(values: list | None, col: int) -> str | None:
    return values[col] if values and col < len(values) else None


def _shared_strings(book: zipfile.ZipFile, name: str) -> list[str]:
    texts = []
    with book.open(name) as stream:
        for _, element in ElementTree.iterparse(stream):
            if _local(element.tag) == "si":
                texts.append(_text(element))
                element.clear()
    return texts


def _text(element) -> str:
    """Text of a plain or rich string without phonetic hints."""
    out = []
    for child in element:
        tag = _local(child.tag)
        if tag == "t":
            out.append(child.text or "")
        elif tag == "r":
            out.extend(t.text or "" for t in child if _local(t.tag) == "t")
    return "".join(out)


def _date_styles(book: zipfile.ZipFile, name: str) -> list[bool]:
    root = _root(book, name)
    custom = {}
    for element in root.iter():
        if _local(element.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", element.get("formatCode", "").lower())
            custom[element.get("numFmtId")] = bool(re.search(r"[dmhys]", code))
    flags = []
    for element in root.iter():
        if _local(element.tag) == "cellXfs":
            for xf in element:
                ident = xf.get("numFmtId", "0")
                flags.append(custom[ident] if ident in custom else int(ident) in _DATE_FORMATS)
    return flags


def _column(reference: str) -> int:
    number = 0
    for char in reference:
        if not char.isalpha():
            break
        number = number * 26 + ord(char.upper()) - 64
    return number - 1


def _rows(stream, strings: list[str], dates: list[bool], epoch: datetime) -> Iterator[tuple[int, list, list]]:
    holder = None
    number = -1
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        tag = _local(element.tag)
        if event == "start":
            if tag == "sheetData":
                holder = element
            continue
        if tag != "row" or holder is None:
            continue
        number = int(element.get("r")) - 1 if element.get("r") else number + 1
        values: list[str | None] = []
        dtypes: list[str | None] = []
        for cell in element:
            position = _column(cell.get("r")) if cell.get("r") else len(values)
            value, dtype = _cell(cell, strings, dates, epoch)
            gap = position - len(values)
            values.extend([None] * gap + [value])
            dtypes.extend([None] * gap + [dtype])
        while values and values[-1] is None:
            values.pop()
            dtypes.pop()
        yield number, values, dtypes
        holder.clear()


def _cell(cell, strings: list[str], dates: list[bool], epoch: datetime) -> tuple[str | None, str | None]:
    kind = cell.get("t", "n")
    raw = None
    for child in cell:
        tag = _local(child.tag)
        if tag == "v":
            raw = child.text
        elif tag == "is":
            raw = _text(child)
    if raw is None or kind == "e":
        return None, None
    if kind == "s":
        raw = strings[int(raw)]
    if kind in ("s", "str", "inlineStr"):
        return (None, None) if raw in MISSING_TEXTS else (raw, "str")
    if kind == "b":
        return ("True" if raw == "1" else "False"), "bool"
    if kind == "d":
        return raw, "datetime"
    number = float(raw)
    style = int(cell.get("s", "0"))
    if style < len(dates) and dates[style]:
        moment = epoch + timedelta(milliseconds=round(number * 86_400_000))
        if 0 <= number < 1:
            return moment.strftime("%H:%M:%S"), "time"
        return moment.isoformat(timespec="milliseconds"), "datetime"
    return (str(int(number)), "int") if number == int(number) else (repr(number), "float")
