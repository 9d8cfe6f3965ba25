"""Reading and writing tables by file type."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its extension: parquet, orc, csv, tsv, json(l), xlsx, else text. Any Hadoop URI works.

    CSV columns are text unless a schema is given, so that no file is read twice to guess types.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None and kind != "xlsx" else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    return reader.text(path)


def _cell_column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes) -> list[dict[int, str]]:
    """Rows of the first sheet as {column number: text}."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                value = cell.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else (value.text if value is not None else None)
                if text is not None and cell.get("t") == "s":
                    text = shared[int(text)]
                if text is not None:
                    cells[_cell_column(cell.get("r")) if cell.get("r") else k] = text
            rows.append(cells)
        return rows


def _letters(n: int) -> str:
    """Name of a column by its number from 0."""
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def workbook(header: Sequence[str], rows: Sequence[Sequence]) -> bytes:
    """A workbook with one sheet of texts; null cells are left out."""
    def line(k: int, values: Sequence) -> str:
        cells = (f'<c r="{_letters(i)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(values) if v is not None)
        return f'<row r="{k}">{"".join(cells)}</row>'

    kind, main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join(line(k, values) for k, values in enumerate([header, *rows], 1))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of the workbooks at `path` as text columns, named by the first row of the first workbook.

    Every workbook is parsed by the task that reads it; only one header comes to the driver.
    """
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    first = books.orderBy("path").limit(1).collect()
    if not first:
        raise FileNotFoundError(path)
    header = parse_xlsx(bytes(first[0].content))[0]
    names = [header.get(i, f"column_{i + 1}") for i in range(max(header) + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = parse_xlsx(bytes(content))[1:]
                yield pd.DataFrame([[r.get(i) for i in range(len(names))] for r in rows], columns=names, dtype=object)

    return books.select("content").mapInPandas(parse, schema)


def ensure_columns(rows: DataFrame, spec: Mapping[str, tuple[str, object]]) -> DataFrame:
    """`rows` with every column of `spec` (name -> type, default); those that it lacks are added."""
    missing = {n: F.lit(default).cast(kind) for n, (kind, default) in spec.items() if n not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def require(rows: DataFrame, *names: str) -> DataFrame:
    """`rows`, if it has the named columns; else a ValueError that names those that it lacks."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {', '.join(missing)}")
    return rows


def combined(*batches: DataFrame) -> DataFrame:
    """Rows of several deliveries; columns that one lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run hasn't done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
