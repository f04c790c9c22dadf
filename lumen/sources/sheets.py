"""Spreadsheets in the Office Open XML format (.xlsx), read in tasks and written sheet by sheet; no library is needed.

All columns that are read are text, as from CSV: numbers as the file has them (dates are its day numbers), booleans as 0 or 1.
The first row names the columns; unnamed ones are _c0, _c1, ... by place, and a name that occurs again gets its place as a
suffix. Rows without any value are left out, and a workbook without rows gives none.
"""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS = 1_048_576
#: Rows in an Arrow batch that the reader makes.
BATCH = 4096


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, without the readings that may stand beside it."""
    runs = [node.find(f"{MAIN}t"), *(r.find(f"{MAIN}t") for r in node.findall(f"{MAIN}r"))]
    return "".join(t.text or "" for t in runs if t is not None)


def _place(ref: str) -> int:
    """The column of a cell such as AB12, from 0 on."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(content: bytes, sheet: str | int = 0) -> Iterator[dict[int, str]]:
    """{column: value} of every row of a sheet, given by name or place, that has a value."""
    book = zipfile.ZipFile(io.BytesIO(content))
    sheets = [(s.get("name"), s.get(RELATION)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    found = sheets[sheet : sheet + 1] if isinstance(sheet, int) else [s for s in sheets if s[0] == sheet]
    if not found:
        raise ValueError(f"there is no sheet {sheet}; there are {[s[0] for s in sheets]}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[found[0][1]]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{MAIN}row":
                continue
            out, at = {}, -1
            for cell in row.findall(f"{MAIN}c"):
                at = _place(cell.get("r")) if cell.get("r") else at + 1
                value, inline = cell.findtext(f"{MAIN}v"), cell.find(f"{MAIN}is")
                if inline is not None:
                    value = _text(inline)
                elif cell.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif cell.get("t") == "e":
                    value = None
                if value is not None:
                    out[at] = value
            row.clear()
            if out:
                yield out


def _names(header: dict[int, str]) -> dict[int, str]:
    names: dict[int, str] = {}
    for k in range(max(header) + 1):
        name = header.get(k, "").strip() or f"_c{k}"
        names[k] = name if name not in names.values() else f"{name}_{k}"
    return names


def read(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """The rows of one sheet of the workbook, or workbooks, at path; columns are joined by name, missing ones are null."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches):
        for b in batches:
            found = [next(rows(x.as_py(), sheet), {}) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([list(_names(h).values()) if h else [] for h in found], pa.list_(pa.string()))], ["names"])

    seen = [r[0] for r in files.mapInArrow(headers, "names array<string>").distinct().orderBy("names").collect()]
    columns = list(dict.fromkeys(n for names in seen for n in names))
    if not columns:
        raise ValueError(f"no sheet in {path} has a row that names columns")

    def run(batches):
        for b in batches:
            for x in b.column(0):
                every = rows(x.as_py(), sheet)
                names = _names(first) if (first := next(every, {})) else {}
                held: list[dict[str, str]] = []
                for row in every:
                    held.append({names[k]: v for k, v in row.items() if k in names})
                    if len(held) == BATCH:
                        yield _batch(held, columns)
                        held = []
                if held:
                    yield _batch(held, columns)

    return files.mapInArrow(run, ", ".join(f"`{c.replace('`', '``')}` string" for c in columns))


def _batch(held: list[dict[str, str]], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h.get(c) for h in held], pa.string()) for c in columns], columns)


def _cell(value) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean, {chr(13): "&#13;"})}</t></is></c>'


def write(spark: SparkSession, sheets: dict[str, DataFrame], path: str) -> list[str]:
    """Writes one workbook with a sheet for each table that has rows, and returns their names; without any it writes nothing.

    A sheet has MOST_ROWS rows at most, its header included: a longer table is an error, and is to be written as Parquet
    or CSV. Rows come to the driver partition by partition; arrays, maps and structs are JSON text.
    """
    sizes = {name: df.limit(MOST_ROWS).count() for name, df in sheets.items()}
    if long := [name for name, n in sizes.items() if n >= MOST_ROWS]:
        raise ValueError(f"too many rows for a sheet: {long}")
    done = [name for name in sheets if sizes[name]]
    if not done:
        return []
    titles = [re.sub(r"[\[\]:*?/\\]", "_", name)[:31] for name in done]
    if len({t.lower() for t in titles}) < len(titles):
        raise ValueError(f"names of sheets must differ in their first 31 characters: {titles}")
    kind, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head, numbers, held = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', range(1, len(done) + 1), io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{office}.worksheet+xml"/>' for k in numbers)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name={quoteattr(t)} sheetId="{k}" r:id="rId{k}"/>' for k, t in zip(numbers, titles))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{kind}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{kind}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for k, name in zip(numbers, done):
            df = sheets[name]
            flat = df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes))
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                f.write(f"<row>{''.join(map(_cell, df.columns))}</row>".encode())
                for row in flat.toLocalIterator():
                    f.write(f"<row>{''.join(map(_cell, row))}</row>".encode("utf-8", "replace"))
                f.write(b"</sheetData></worksheet>")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    return done
