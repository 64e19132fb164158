"""Workbooks: every sheet of every ``.xlsx`` file in a folder, read by Spark tasks.

A workbook is a zip of XML parts. Files are spread over tasks as binary rows;
a small reader inside the task turns each into ``(file, sheet, row, col, value)``
cells while it streams through the sheet XML.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.cells import col
from .files import name_columns

CELL_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()),
    T.StructField("row", T.LongType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.StringType()),
])
BATCH = 20_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names with their parts, in workbook order."""
    links = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    found = []
    for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(node.tag) == "sheet":
            ident = next(v for k, v in node.attrib.items() if _local(k) == "id")
            target = links[ident].lstrip("/")
            found.append((node.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_texts(item) for item in root if _local(item.tag) == "si"]


def _cell_value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _texts(cell)
    raw = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    return raw


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str | None]]:
    """Cells of one workbook as ``(sheet, row, col, value)``, zero-based."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        for sheet, part in _sheets(book):
            at = -1
            with book.open(part) as stream:
                for _, node in ElementTree.iterparse(stream):
                    if _local(node.tag) != "row":
                        continue
                    at = int(node.get("r")) - 1 if node.get("r") else at + 1
                    place = -1
                    for cell in node:
                        place = _column_index(cell.get("r")) if cell.get("r") else place + 1
                        yield sheet, at, place, _cell_value(cell, shared)
                    node.clear()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in CELL_SCHEMA.fields]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            for sheet, row, place, cell in workbook_cells(bytes(content)):
                rows.append((path, sheet, row, place, cell))
                if len(rows) >= BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks below a path: ``file, sheet, row, col, value``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_read, CELL_SCHEMA)


def sheet_list(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file", "sheet").agg((F.max("row")).alias("row_count"), (F.max("col") + 1).alias("column_count"))


def sheet_table(cells: DataFrame, sheet: str) -> DataFrame:
    """One sheet, of all files, as a table of text cells.

    The first row of a file is its header. Columns of different files are one
    column if they have the same title (the n-th of that title, if a file
    repeats it) or, without a title, the same place; no column is left out.
    They stand in the order of the first file that has them. Rows carry
    ``_file`` and ``_row``.
    """
    mine = cells.filter(col("sheet") == sheet)
    titles = mine.groupBy("file", "col").agg(F.max(F.when(F.col("row") == 0, F.nullif("value", F.lit("")))).alias("title"))
    nth = F.row_number().over(Window.partitionBy("file", "title").orderBy("col"))
    untitled = F.col("title").isNull()
    key = F.when(untitled, F.concat(F.lit("#"), "col")).otherwise(F.concat(nth, F.lit(":"), "title"))
    places = titles.select("file", "col", "title", key.alias("key"))
    found = places.groupBy("key").agg(F.first("title").alias("title"), F.min(F.struct("file", "col")).alias("at")).orderBy("at").collect()
    if not found:
        raise ValueError(f"no sheet named {sheet!r}")
    keys = [r["key"] for r in found]
    # Columns without a title are numbered by their place in their own files.
    headers = [r["title"] or f"列{r['at']['col'] + 1}" for r in found]
    wide = mine.filter("row > 0").join(places.select("file", "col", "key"), ["file", "col"])
    wide = wide.groupBy("file", "row").pivot("key", keys).agg(F.first("value")).toDF("_file", "_row", *map(str, range(len(keys))))
    named = name_columns(wide.drop("_file", "_row"), headers)
    return wide.select("_file", "_row", *[col(str(i)).alias(f.name, metadata=f.metadata) for i, f in enumerate(named.schema.fields)])


def read_workbooks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet name below a path with its table."""
    cells = read_workbook_cells(spark, path)
    names = [r["sheet"] for r in cells.select("sheet").distinct().orderBy("sheet").collect()]
    return {n: sheet_table(cells, n) for n in names}
