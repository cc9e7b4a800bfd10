"""Line dedup over range-partitioned line hashes, in DataFrame operations only.

Every long enough line becomes a spot (hash, document, position). Spots are range-partitioned by
hash and sorted inside a partition by document (largest first) and position, so that a window
streams over each line's occurrences: the first document keeps the line, the others lose it. What
comes back is a run-length compressed keep bitmap per document, not text.

A line with more spots than a quarter of a partition's share (or a thousandth of all) would overfill
a range. There are fewer than four for each partition (or a thousand) of such lines by arithmetic,
so their counts and keepers come from a partially aggregated group-by and are broadcast. The window
over any other line holds less than that share, and spills.

Defined results: a null text is one empty line; a row without doc_id takes no part, and keeps all
its lines; repeated rows of a doc_id count as one document, each row has its own bitmap; equal lines
of the document that keeps them all stay; texts of any length are split whole; an empty table gives
an empty result; only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.skew import most_heavy
from termloom.llm.staging import stage

_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, and nothing else."""
    bare = F.btrim(line, F.lit(_STRIP))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOW))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, pos) of every line that goes: ``row_key`` stands for a doc_id with its text."""
    spark = docs.sparkSession
    doc, text = F.col(id_col), F.col(text_col)
    spots = stage(
        docs.filter(doc.isNotNull() & (F.length(text) >= min_chars))
        .select(doc.alias("doc"), _row_key(doc, text).alias("row_key"), F.posexplode(_lines(text)).alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "row_key", "pos"),
        "spots",
    )
    total = spots.count()
    heavy = spots.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") * most_heavy(spots) > total).select("h1", "h2")
    heavy = F.broadcast(stage(heavy, "heavy"))
    known = (
        spots.join(heavy, ["h1", "h2"], "left_semi")
        .select("h1", "h2", "doc").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    from_heavy = spots.join(F.broadcast(known), ["h1", "h2"]).filter("doc <> keeper").select("row_key", "pos")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = Window.partitionBy("h1", "h2")
    newest_first = line.orderBy(F.col("doc").desc(), "pos")
    from_light = (
        spots.join(heavy, ["h1", "h2"], "left_anti")
        .repartitionByRange(parts, "h1", "h2")
        .sortWithinPartitions("h1", "h2", F.col("doc").desc(), "pos")
        .withColumn("nth", F.dense_rank().over(line.orderBy(F.col("doc").desc())))
        .withColumn("first", F.first("doc").over(newest_first))
        .withColumn("n_docs", F.max("nth").over(line))
        .filter((F.col("n_docs") >= min_docs) & (F.col("doc") != F.col("first")))
        .select("row_key", "pos")
    )
    return from_heavy.unionByName(from_light)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, runs) of documents that lose lines.

    ``runs`` is the keep bitmap as run lengths: lines kept, dropped, kept ... in turn, from the
    first line; what follows the last run is kept.
    """
    gone = dropped_lines(docs, min_chars, min_docs, id_col, text_col).groupBy("row_key").agg(F.sort_array(F.collect_set("pos")).alias("d"))
    starts = F.expr("filter(d, (x, i) -> i = 0 OR x <> get(d, i - 1) + 1)")
    ends = F.expr("filter(d, (x, i) -> i = size(d) - 1 OR get(d, i + 1) <> x + 1)")
    runs = F.expr("flatten(transform(s, (x, i) -> array(x - coalesce(get(e, i - 1) + 1, 0), get(e, i) - x + 1)))")
    return gone.select("row_key", starts.alias("s"), ends.alias("e")).select("row_key", runs.alias("runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``tl_n_lines``, ``tl_n_dropped`` and ``tl_kept``, the text left."""
    doc, text = F.col(id_col), F.col(text_col)
    maps = bitmaps.select(F.col("row_key").alias("tl_row_key"), F.col("runs").alias("tl_runs"))
    rows = docs.withColumn("tl_row_key", F.when(doc.isNotNull(), _row_key(doc, text))).join(maps, "tl_row_key", "left").drop("tl_row_key")
    flags = "flatten(transform(tl_runs, (n, i) -> array_repeat(i % 2 = 0, n)))"
    lines = rows.withColumn("tl_lines", F.when(F.col("tl_runs").isNotNull(), _lines(text))).withColumn("tl_flags", F.expr(flags))
    kept = F.expr("array_join(filter(tl_lines, (x, i) -> coalesce(get(tl_flags, i), true)), '\n')")
    return (
        lines.withColumn("tl_n_lines", F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1)
        .withColumn("tl_n_dropped", F.expr("coalesce(aggregate(tl_runs, 0, (a, n) -> a + n) - aggregate(filter(tl_runs, (n, i) -> i % 2 = 0), 0, (a, n) -> a + n), 0)"))
        .withColumn("tl_kept", F.coalesce(kept, text, F.lit("")))
        .drop("tl_runs", "tl_lines", "tl_flags")
    )


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text left (``kept``) of every row."""
    own = docs.select("doc_id", "text")
    done = apply_bitmaps(own, keep_bitmaps(own, min_chars, min_docs))
    return done.select("doc_id", F.col("tl_n_lines").cast("long").alias("n_lines"), F.col("tl_n_dropped").cast("long").alias("n_dropped"), F.col("tl_kept").alias("kept"))
