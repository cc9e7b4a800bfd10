"""Corpus pipeline: language, repeated lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. Tables that a stage leaves in the shared folder are deleted when the next one
starts, as its result is written by then.

Defined results of every stage: columns other than doc_id, text, lang and n_chars go along as they
are, whatever they are called; an empty table gives no rows; rows without doc_id take no part in
what compares documents, and stay; texts of any length are worked on whole. What a stage makes of
null and empty texts, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, staging
from termloom.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose language has less than this share of their 4-grams are none of the languages.
MIN_SCORE = 0.2

_left = [0, 0]


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns as c0, c1, ..., which nothing clashes with, and the number of each name."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain, dict(zip(docs.columns, plain.columns, strict=True))


def _tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        staging.discard(spark, *_left)
        first = staging.mark()
        out = stage(spark, docs, sf_dir)
        _left[:] = [first, staging.mark()]
        return out

    return run


@_tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or like no language learned, go.

    Null and empty texts have none and go; each of repeated rows is judged by itself, and a tie is
    between languages, so it stays.
    """
    plain, at = _numbered(docs)
    model = language_id.learn(docs.filter(~language_id.held_out()).select("text", "lang"))
    judged = language_id.predict(plain, model, at["text"])
    return judged.filter((F.col("tl_lang") != "und") & (F.col("tl_score") >= MIN_SCORE)).select(*plain.columns).toDF(*docs.columns)


@_tidy
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another one keeps. A text may become empty.

    Null and empty texts stay as they are; rows that repeat a doc_id and a text lose the same lines.
    """
    own = docs.select("doc_id", "text")
    plain, at = _numbered(docs)
    done = line_dedup.apply_bitmaps(plain, line_dedup.keep_bitmaps(own), at["doc_id"], at["text"])
    changed = {at["text"]: F.when(F.col(at["text"]).isNotNull(), F.col("tl_kept"))}
    if "n_chars" in at:
        changed[at["n_chars"]] = F.when(F.col("tl_n_dropped") > 0, F.length("tl_kept").cast("long")).otherwise(F.col(at["n_chars"]))
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in plain.columns]).toDF(*docs.columns)


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near copies, once.

    Texts without words are like no other and stay. Where a doc_id has several rows, texts are told
    apart by their content: equal rows count once, and other texts under that doc_id are documents
    of their own.
    """
    plain, at = _numbered(docs)
    doc, text = F.col(at["doc_id"]), F.col(at["text"])
    keyed = plain.filter(doc.isNotNull())
    several = staging.stage(keyed.groupBy(doc.alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id"), "several")
    plainly = several.isEmpty()
    if plainly:
        keyed = keyed.withColumn("key", doc)
    else:
        again = keyed.join(several, doc == F.col("id"), "left")
        keyed = again.withColumn("key", F.when(F.col("id").isNull(), doc).otherwise(F.xxhash64(doc, text))).drop("id")
    classes = staging.stage(jaccard_join.jaccard_classes(keyed.select(F.col("key").alias("doc_id"), text.alias("text"))), "kept")
    if plainly:
        kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("key"))
        out = keyed.join(kept, "key").select(*plain.columns)
    else:
        numbers = keyed.select("key", doc.alias("id")).distinct()
        named = classes.distinct().join(numbers, F.col("doc_id") == F.col("key"))
        kept = named.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("least")).select("least.key")
        found = keyed.join(kept, "key")
        one = found.join(several, doc == F.col("id"), "left_semi").groupBy("key").agg(F.min_by(F.struct(*plain.columns), F.xxhash64(*plain.columns)).alias("row"))
        out = found.join(several, doc == F.col("id"), "left_anti").select(*plain.columns).union(one.select("row.*"))
    return out.union(plain.filter(doc.isNull())).toDF(*docs.columns)


@_tidy
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are each kept or dropped."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@_tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 4096 ids.

    A null or empty text is its end id alone; each of repeated rows is packed; rows without doc_id too.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: No stage but line dedup can be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{staging.shared_dir(spark)}/termloom-{name}-{staging.fresh()}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            staging.delete(spark, before)
        before = path
    staging.adopt(before)
    return docs
