"""Connected components by alternating star contraction, entirely in DataFrames.

Each round hangs every node on the smallest node it sees (large star, then small star); the edges
end as stars around each component's smallest id. Minima are aggregated before they are joined
back. The edges of a star's centre are a skewed side of that join, which adaptive execution splits:
rows are two ids and the other side has one row a node, so its parts can be read more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from termloom.llm.staging import delete, new_path


def _large_star(both: DataFrame) -> DataFrame:
    """Larger neighbours of each node hang on the smallest node that it sees, itself included."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _written(edges: DataFrame, path: str) -> tuple:
    """Write ``edges``; how many they are and a sum of their hashes come with the writing."""
    seen = Observation()
    edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return seen.get["n"], seen.get["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) for every node of ``edges``; component_id is its smallest node.

    Rows with a null end and loops link nothing. Repeated edges count once. No edges: no rows.
    """
    spark = edges.sparkSession
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path, last, before = new_path(spark, "edges"), None, None
    seen = _written(now, path)
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = _large_star(both)
        # small star: each node with its smaller neighbours
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        hung = stars.join(least, "u")
        nxt = (
            hung.filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        if last:
            delete(spark, last)
        last, path = path, new_path(spark, "edges")
        seen = _written(nxt, path)
    # now every edge is (node, smallest node); the smallest stand for themselves
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
