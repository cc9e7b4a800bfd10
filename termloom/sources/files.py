"""Readers of single files: spreadsheets, keyword and description lists, JSON of an earlier step.

Such files hold what an analyst keeps by hand or what a step exchanges, so one file is one task's
work. Corpora are read by ``corpus``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.sources.corpus import gazetteer

# --- fixed values: texts of a spreadsheet cell that stand for a missing value, as pandas reads them ---
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# --- fixed values: sheets and columns of the workbook of places ---
PLACE_SHEET, PLACE_COLUMNS = "NUTS2024", ("Country code", "NUTS Code", "NUTS label")
SPELLING_SHEET = "Cyrillic & Greek to Latin"

CELLS = "row_id long, col_idx int, header string, value string"


def _sheet_rows(data: bytes, sheet: str, required: bool) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of every cell of a sheet that holds something, row by row."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    def local(tag: str) -> str:
        return tag.rpartition("}")[2]

    def texts(node: ElementTree.Element) -> str:
        """A text may be in several runs; how it is pronounced is none of it."""
        runs = [r for r in node if local(r.tag) in ("t", "r")]
        return "".join(t.text or "" for r in runs for t in r.iter() if local(t.tag) == "t")

    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        listed = {s.get("name"): s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"}
        if sheet not in listed:
            if required:
                raise ValueError(f"no sheet {sheet!r}; there are {sorted(listed)}")
            return
        key = next(v for k, v in listed[sheet].items() if k.endswith("}id"))
        target = next(r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == key)
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(s.tag) == "si"]
        row = -1
        with book.open(path) as body:
            for event, node in ElementTree.iterparse(body, ("start", "end")):
                if local(node.tag) != "row":
                    continue
                if event == "start":
                    row = int(node.get("r", row + 2)) - 1
                    continue
                col = -1
                for cell in node:
                    letters = re.match("[A-Z]*", cell.get("r", "")).group()
                    col = col + 1 if not letters else sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1
                    kind = cell.get("t", "n")
                    if kind == "inlineStr":
                        value = "".join(texts(x) for x in cell if local(x.tag) == "is")
                    else:
                        value = next((v.text or "" for v in cell if local(v.tag) == "v"), "")
                        if kind == "s" and value:
                            value = shared[int(value)]
                        elif kind == "b":
                            value = "True" if value == "1" else "False"
                    if kind != "e" and value not in MISSING:
                        yield row, col, value
                node.clear()


def sheet_cells(spark: SparkSession, path: str, sheet: str, required: bool = True) -> DataFrame:
    """(row_id, col_idx, header, value) of a sheet of an xlsx file; its first row names the columns.

    Cells without a value, with an error or with a mark of a missing value give no row. A sheet that
    isn't there is an error, or has no cells if it is not ``required``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                header, first, rows = {}, None, []
                for r, c, value in _sheet_rows(data.as_py(), sheet, required):
                    first = r if first is None else first
                    if r == first:
                        header[c] = value
                    else:
                        rows.append((r - first, c, header.get(c), value))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                types = [pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in CELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CELLS)


def place_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term): codes, labels and spellings of a workbook of places, and the fixed country names.

    The sheet of spellings may be missing.
    """
    places = sheet_cells(spark, path, PLACE_SHEET).filter(F.col("header").isin(*PLACE_COLUMNS))
    spellings = sheet_cells(spark, path, SPELLING_SHEET, required=False)
    return gazetteer(*[c.select(T.strip(F.col("value")).alias("term")) for c in (places, spellings)])


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file with the value of its JSON text, as ``json``."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("json"))


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """(domain, domain_idx, word, weight) of a JSON object of objects, domains in the file's order."""
    domains = _whole(spark, path, "map<string, map<string, double>>").select(F.posexplode("json").alias("domain_idx", "domain", "words"))
    return domains.select("domain", "domain_idx", F.explode("words").alias("word", "weight"))


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(domain, domain_idx, description) of a JSON object of texts, in the file's order."""
    return _whole(spark, path, "map<string, string>").select(F.posexplode("json").alias("domain_idx", "domain", "description")).select("domain", "domain_idx", "description")


def step_values(spark: SparkSession, path: str) -> DataFrame:
    """(table, dimension, value) of a step's one JSON object: tables, their dimensions, their values."""
    tables = _whole(spark, path, "map<string, map<string, array<string>>>").select(F.explode("json").alias("table", "dimensions"))
    return _flat(tables)


def nested_lines(spark: SparkSession, path: str) -> DataFrame:
    """(table, dimension, value) of what ``sinks.write_json`` wrote of ``sinks.nested_values``."""
    return _flat(spark.read.schema("table string, dimensions map<string, array<string>>").json(path))


def _flat(tables: DataFrame) -> DataFrame:
    per = tables.select("table", F.explode("dimensions").alias("dimension", "vs"))
    return per.select("table", "dimension", F.explode("vs").alias("value"))
