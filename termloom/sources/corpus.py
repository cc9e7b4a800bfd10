"""Sources: directories of wide statistical CSV tables, gazetteers, titles, lexicons, replies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T

# --- fixed values: country names that are always geography ---
COUNTRIES = (
    "Austria", "Belgium", "Bulgaria", "Cyprus", "Czechia", "Germany", "Denmark", "Estonia", "Greece",
    "Spain", "Finland", "France", "Croatia", "Hungary", "Ireland", "Italy", "Lithuania", "Luxembourg",
    "Latvia", "Malta", "Netherlands", "Poland", "Portugal", "Romania", "Sweden", "Slovenia", "Slovakia",
)

CELLS = "table string, row_id long, col_idx int, header string, value string, error string"


def scan_tables(spark: SparkSession, path: str, descriptive_only: bool = True) -> DataFrame:
    """Cells of every ``*.csv`` below ``path``: (table, row_id, col_idx, header, value, error).

    Row 0 is the header itself. Files are UTF-8 (a BOM is dropped) or else Latin-1. Empty rows are
    skipped, short and long rows tolerated. A file that can't be parsed gives one row with its
    error. ``descriptive_only`` leaves cells right of the first time column where they are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("table"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io
        import re

        time = re.compile(rf"^\s*{T.YEAR}(?:\.0|-\d{{2}}(?:-\d{{2}})?|-[Ss][12])?\s*$")
        year, quarter = re.compile(T.YEAR), re.compile("Q[1-4]", re.IGNORECASE)

        def is_time(h: str) -> bool:
            return bool(time.match(h) or year.search(h) and (quarter.search(h) or any(m in h.lower() for m in T.HEADER_MONTHS)))

        for batch in batches:
            for table, content in zip(batch.column("table").to_pylist(), batch.column("content"), strict=True):
                rows = []
                data = content.as_py()
                try:
                    try:
                        body = data.decode("utf-8-sig")
                    except UnicodeDecodeError:
                        body = data.decode("latin-1")
                    lines = (r for r in csv.reader(io.StringIO(body, newline=""), strict=True) if r)
                    header = next(lines, [])
                    times = [k for k, h in enumerate(header) if is_time(h)]
                    width = min(times, default=len(header)) if descriptive_only else len(header)
                    rows += [(table, 0, k, h, h, None) for k, h in enumerate(header)]
                    for n, r in enumerate(lines, 1):
                        rows += [(table, n, k, header[k], r[k], None) for k in range(min(width, len(r)))]
                except Exception as e:  # noqa: BLE001  any broken file is reported, and the scan goes on
                    rows = [(table, None, None, None, None, f"{type(e).__name__}: {e}")]
                types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in CELLS.split(", ")])

    return named.mapInArrow(run, CELLS)


def unpivoted(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Columns of a relational table as (table, dimension, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(F.lit(table).alias("table"), pairs).select("table", "p.dimension", "p.value")


def mangled_headers(headers: DataFrame) -> DataFrame:
    """(table, col_idx, header) with stripped names; the k-th repeat of a name becomes ``name.k``."""
    same = Window.partitionBy("table", "bare").orderBy("col_idx")
    numbered = headers.withColumn("bare", T.strip(F.col("header"))).withColumn("k", F.row_number().over(same) - 1)
    return numbered.select("table", "col_idx", F.when(F.col("k") > 0, F.concat_ws(".", "bare", "k")).otherwise(F.col("bare")).alias("header"))


def gazetteer(*columns: DataFrame) -> DataFrame:
    """(term): the distinct values of one-column frames, and the fixed country names."""
    spark = columns[0].sparkSession if columns else SparkSession.getActiveSession()
    out = spark.createDataFrame([(c,) for c in COUNTRIES], "term string")
    for c in columns:
        out = out.union(c.select(F.col(c.columns[0]).cast("string")))
    return out.filter(F.length(T.strip(F.col("term"))) > 0).distinct()


def titles(rows: DataFrame) -> DataFrame:
    """(table, title) of (filename, title, row_id): ``.csv`` is dropped, the last row of a name wins."""
    named = rows.select(F.replace("filename", F.lit(".csv"), F.lit("")).alias("table"), F.coalesce("title", F.lit("nan")).alias("title"), "row_id")
    return named.groupBy("table").agg(F.max_by("title", "row_id").alias("title"))


def lexicon(rows: DataFrame) -> DataFrame:
    """(domain, domain_idx, word, weight) with the pattern of each word."""
    return rows.withColumn("pattern", T.keyword_pattern(F.col("word")))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, if it has all these columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df
