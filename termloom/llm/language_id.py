"""Language ID with bit-sliced Bloom filters over byte 4-grams.

All languages share one table: a row is a bitmask of languages, a 4-gram sets its language's bit in
``HASHES`` rows, and the AND of those rows tells at once every language that holds the 4-gram. Per
text, each language's hits are counted and corrected for that language's false positive rate; the
highest corrected share decides.

A language holds a 4-gram if it was seen there at least ``min_count`` times and makes up one in
``RAREST`` of that language's 4-grams at least, and at no less than ``share`` of the rate it has in
the language where it is most frequent, so that a few mislabelled rows don't fill a filter. Counts
cover all training rows.

By arithmetic no language holds more than ``RAREST`` 4-grams, whatever the size of the corpus. The
table's rows follow the fullest language, at ``BITS`` or more for each of its 4-grams, so filters
never fill up and what is broadcast is at most 64 MB for each 64 languages.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text none of
whose 4-grams is known, and ties, go to the language first in the alphabet; without training rows
all is ``und``; rows with a null lang teach nothing; a null doc_id is not held out; rows
that share a doc_id are each judged by themselves; texts of any length are judged by all their
4-grams; other columns come back as they are, whatever they are called; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.staging import stage
from termloom.llm.textblocks import blocks, lean, mix

HASHES, BITS = 3, 12
RAREST = 1 << 19

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's 4-grams of lower-cased letters, gaps as one space, and where they begin."""
    low = _LETTER[body]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    inner = at[(at > 0) & (at < len(low))]
    keep[inner] = True
    left = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    first, b = left[at], low[keep].astype(np.uint32)
    size = np.diff(first)
    n = max(len(b) - 3, 0)
    g = b[:n] | (b[1 : n + 1] << np.uint32(8)) | (b[2 : n + 2] << np.uint32(16)) | (b[3 : n + 3] << np.uint32(24))
    own = np.maximum(size - 3, 0)
    short = np.flatnonzero((size > 0) & (size < 4))
    begin = np.zeros(len(at), np.int64)
    own[short] = 1
    np.cumsum(own, out=begin[1:])
    out = np.empty(begin[-1], np.uint32)
    src = np.repeat(first[:-1] - begin[:-1], own) + np.arange(begin[-1])
    whole = np.ones(begin[-1], bool)
    whole[begin[short]] = False
    out[whole] = g[src[whole]]
    for d in short:
        padded = (b[first[d] : first[d + 1]].astype(np.uint8).tobytes() + b"    ")[:4]
        out[begin[d]] = int.from_bytes(padded, "little")
    return out, begin


def _spots(grams: np.ndarray, rows: int) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(rows - 1)).astype(np.int64) for k in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def merged(parts):
        codes = np.concatenate([c for c, _ in parts])
        n = np.concatenate([x for _, x in parts])
        u, where = np.unique(codes, return_inverse=True)
        return u, np.bincount(where, n, len(u)).astype(np.int64)

    def out():
        for lang, parts in seen.items():
            u, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        seen.clear()

    for batch in batches:
        langs = np.array([x if x is not None else "" for x in batch.column("lang").to_pylist()], object)
        known = np.array([x is not None for x in batch.column("lang").to_pylist()], bool)
        for lang in sorted(set(langs[known])):
            own = batch.column("text").filter(pa.array((langs == lang) & known))
            for _, _, body, at in blocks(own):
                grams, _ = _grams(body, at)
                u, n = np.unique(grams, return_counts=True)
                seen.setdefault(lang, []).append((u, n))
                held += len(u)
                if len(seen[lang]) >= 16:
                    seen[lang] = [merged(seen[lang])]
                    held = sum(len(u) for p in seen.values() for u, _ in p)
        if held > limit:
            yield from out()
            held = 0
    yield from out()


class LanguageModel:
    """What prediction needs: the languages and the table of their bits."""

    def __init__(self, langs: list[str], table: np.ndarray) -> None:
        self.langs, self.table = langs, table
        bits = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() for k in range(len(langs))], float)
        self.false = np.minimum((bits / max(len(table), 1)) ** HASHES, 0.999)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, langs = len(texts), self.langs
        best, score = np.zeros(n, np.int64), np.zeros(n)
        for first, last, body, at in blocks(texts, 1 << 18):
            grams, begin = _grams(body, at)
            size = np.diff(begin)
            if len(grams) == 0 or not langs:
                continue
            where = _spots(grams, len(self.table))
            hits = np.empty((len(langs), last - first))
            for lane in range(self.table.shape[1]):
                column = np.ascontiguousarray(self.table[:, lane])
                mask = column[where[0]]
                for w in where[1:]:
                    mask &= column[w]
                for k in range(lane * 64, min(len(langs), lane * 64 + 64)):
                    ones = np.zeros(len(grams) + 1, np.int64)
                    np.cumsum((mask >> np.uint64(k % 64)) & np.uint64(1), out=ones[1:])
                    hits[k] = ones[begin[1:]] - ones[begin[:-1]]
            share = hits / np.maximum(size, 1)
            right = np.clip((share - self.false[:, None]) / (1 - self.false[:, None]), 0, 1)
            best[first:last] = right.argmax(0)
            score[first:last] = right.max(0)
        names = []
        for k, text in enumerate(texts.to_pylist()):
            lettered = bool(langs) and text is not None and any(c.isalpha() for c in text)
            names.append(langs[best[k]] if lettered else "und")
            if not lettered:
                score[k] = 0.0
        return names, score


def learn(labelled: DataFrame, min_count: int = 3, share: float = 0.25) -> LanguageModel:
    """Fit on every row of ``labelled`` (text, lang) whose lang is not null."""
    counts = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = [r.lang for r in totals.select("lang").orderBy("lang").collect()]
    spark = labelled.sparkSession
    if not langs:
        return LanguageModel([], np.zeros((1, 1), np.uint64))
    numbers = spark.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, k int")
    rate = counts.join(F.broadcast(totals.join(F.broadcast(numbers), "lang")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    chosen = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter((F.col("n") >= min_count) & (F.col("n") * RAREST >= F.col("total")) & (F.col("rate") >= share * F.col("top"))).select("gram", "k")
    chosen = stage(chosen, "chosen")
    fullest = chosen.groupBy("k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    rows = 1 << max(10, (fullest * BITS - 1).bit_length())
    lanes = (len(langs) + 63) // 64

    def place(batches):
        for batch in batches:
            g = np.asarray(batch.column("gram")).astype(np.uint32)
            k = np.asarray(batch.column("k"))
            for w in _spots(g, rows):
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array((k // 64).astype(np.int32)), pa.array((np.uint64(1) << (k % 64).astype(np.uint64)).astype(np.int64))], ["row", "lane", "bit"])

    placed = chosen.mapInArrow(place, "row long, lane int, bit long").groupBy("row", "lane").agg(F.bit_or("bit").alias("mask"))
    got = placed.toArrow()
    table = np.zeros((rows, lanes), np.uint64)
    table[np.asarray(got.column("row")), np.asarray(got.column("lane"))] = np.asarray(got.column("mask")).astype(np.uint64)
    return LanguageModel(langs, table)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``tl_lang`` and ``tl_score``, from their text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text = names.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    schema = T.StructType([*plain.schema.fields, T.StructField("tl_lang", T.StringType()), T.StructField("tl_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            langs, score = shared.value.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], schema.names)

    return plain.mapInArrow(lean(run), schema).toDF(*names, "tl_lang", "tl_score")


def held_out(fold: int = 2, folds: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
