"""Top-k similarity self-joins: dense vectors in blocks, TF-IDF by a join on terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block on the right side.
BLOCK = 4096


def vector_neighbours(vectors: DataFrame, k: int = 5, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """(id, other, sim): the k most similar other vectors, by (-sim, other).

    The vectors (id, vec) are dealt into blocks of about ``block``; each meets a block once, a pair
    of blocks is a matrix product that keeps its own k best, and the k best of those are the
    answer. ``floor`` applies after the ranking. Nothing is broadcast.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    own = vectors.filter("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = own.select(F.col("b").alias("lb"), every.alias("rb"), F.lit(0).alias("side"), "id", "vec")
    right = own.select(every.alias("lb"), F.col("b").alias("rb"), F.lit(1).alias("side"), "id", "vec")

    def best(table: pa.Table) -> pa.Table:
        side, ids = np.asarray(table.column("side")), np.asarray(table.column("id"))
        vecs = table.column("vec").combine_chunks()
        x = np.asarray(vecs.values).reshape(len(ids), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b[np.argsort(ids[b], kind="stable")]
        out_id, out_other, out_sim = [], [], []
        for at in range(0, len(a), 1024):
            part = a[at : at + 1024]
            sim = x[part] @ x[b].T
            sim[ids[part][:, None] == ids[b][None, :]] = -np.inf
            m = min(k, len(b))
            # rounding noise must not decide ties between blocks: ranks are by 12 digits
            order = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :m]
            out_id.append(np.repeat(ids[part], m))
            out_other.append(ids[b][order].ravel())
            out_sim.append(np.take_along_axis(sim, order, 1).ravel())
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0, t))
        found = pa.table({"id": cat(out_id, np.int64), "other": cat(out_other, np.int64), "sim": cat(out_sim, np.float64)})
        return found.filter(pa.array(np.isfinite(np.asarray(found.column("sim")))))

    some = left.unionByName(right).groupBy("lb", "rb").applyInArrow(best, "id long, other long, sim double")
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("sim", 12)), "other")))
    top = ranked.filter(F.col("k") <= k).drop("k")
    return top if floor is None else top.filter(F.col("sim") >= floor)


def tfidf(texts: DataFrame) -> DataFrame:
    """(id, term, w): L2-normalized weights of words and word pairs of (id, text), text normalized.

    tf is 1 + ln(count), idf is ln((1 + n) / (1 + df)) + 1; words have two characters at least.
    """
    words = F.filter(F.split("text", " "), lambda w: F.length(w) >= 2)
    pairs = F.when(F.size("ws") > 1, F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    counts = texts.select("id", words.alias("ws")).select("id", F.explode(F.concat(F.col("ws"), pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    weighted = counts.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.log("c")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighted.select("id", "term", (F.col("w") / norm).alias("w"), "df")


def tfidf_cosine(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lex) of the given pairs: a join on terms restricted to them."""
    left = weights.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"))
    right = weights.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    both = pairs.select("a", "b").distinct()
    found = both.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("lex"))
    return both.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("lex", F.lit(0.0)).alias("lex"))


def tfidf_neighbours(weights: DataFrame, k: int = 5, floor: float | None = None) -> DataFrame:
    """(id, other, sim): the k most similar other texts that share a term."""
    left = weights.select("id", "term", F.col("w").alias("wa"))
    right = weights.select(F.col("id").alias("other"), "term", F.col("w").alias("wb"))
    sims = left.join(right, "term").filter("id <> other").groupBy("id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    top = sims.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "other"))).filter(F.col("k") <= k).drop("k")
    return top if floor is None else top.filter(F.col("sim") >= floor)


def candidate_pairs(by_vector: DataFrame, by_text: DataFrame) -> DataFrame:
    """(a, b, sources): unordered pairs of both channels, a < b."""

    def sided(df: DataFrame, source: str) -> DataFrame:
        return df.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.lit(source).alias("source"))

    return sided(by_vector, "embedding_knn").unionByName(sided(by_text, "tfidf_knn")).groupBy("a", "b").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def source_counts(pairs: DataFrame) -> DataFrame:
    """(n, by_embedding, by_tfidf, both) of candidate pairs."""
    v, t = F.array_contains("sources", "embedding_knn"), F.array_contains("sources", "tfidf_knn")
    return pairs.agg(F.count("*").alias("n"), F.count_if(v).alias("by_embedding"), F.count_if(t).alias("by_tfidf"), F.count_if(v & t).alias("both"))


def near_domains(neighbours: DataFrame, domains: DataFrame, least: float = 0.84) -> DataFrame:
    """Neighbours without pairs of two known, different domains that are less similar than ``least``."""
    of = domains.select(F.col("id"), F.col("domain").alias("d1"))
    other = domains.select(F.col("id").alias("other"), F.col("domain").alias("d2"))
    joined = neighbours.join(of, "id", "left").join(other, "other", "left")
    across = F.coalesce(F.col("d1") != F.col("d2"), F.lit(False))
    return joined.filter(~across | (F.col("sim") >= least)).select("id", "other", "sim")
