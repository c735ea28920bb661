"""Catalog workbooks (.xlsx): the first sheet's rows, merged first column filled down."""

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions.texts import clean
from isopleth.operators.relate import forward_fill

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(content: bytes) -> list[list[str | None]]:
    """The first sheet's rows as texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in root.iter(f"{_NS}si")]
        sheet = ElementTree.fromstring(book.read(min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
    rows = []
    for row in sheet.iter(f"{_NS}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{_NS}c"):
            at = 0
            for letter in re.match("[A-Z]+", cell.get("r", "A")).group():
                at = 26 * at + ord(letter) - 64
            value = cell.find(f"{_NS}v")
            if cell.get("t") == "s" and value is not None:
                cells[at - 1] = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
            else:
                cells[at - 1] = value.text if value is not None else None
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_catalog(spark: SparkSession, path: str, columns: list[str], dataset: str) -> DataFrame:
    """file, row_index (from 0, header left out) and the named columns of each workbook; rows without a dataset go.

    The first column is filled down, as merged cells leave it empty; blanks around values go and empty ones are null.
    """

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = _cells(content)[1:]
                data = [[r[i] if i < len(r) else None for r in rows] for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), *(pa.array(c, pa.string()) for c in data)], ["file", "row_index", *columns])

    ddl = "file string, row_index int, " + ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, ddl)
    rows = rows.select("file", "row_index", *(clean(F.col(c)).alias(c) for c in columns))
    filled = forward_fill(rows, "file", ["row_index"], columns[0], "_filled")
    return filled.withColumn(columns[0], F.col("_filled")).drop("_filled").where(F.col(dataset).isNotNull())
