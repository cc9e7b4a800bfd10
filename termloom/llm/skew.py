"""Joins whose left side may have a few keys with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_heavy(df: DataFrame) -> int:
    """How many keys can be heavy: a heavy key has more rows than a quarter of a partition's share."""
    return max(1000, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``unique``, which has one row a key and, as ``count``, that key's rows.

    Keys with more than ``total / most_heavy`` rows are fewer than ``most_heavy`` by arithmetic, so
    their side is broadcast and their rows stay where they are; all others go by a shuffle.
    """
    limit = total // most_heavy(rows)
    heavy = F.broadcast(unique.filter(F.col(count) > limit))
    rest = rows.join(F.broadcast(unique.filter(F.col(count) > limit).select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).drop(count).unionByName(rest.join(unique.filter(F.col(count) <= limit), keys, how).drop(count))
