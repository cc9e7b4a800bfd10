"""Incremental vocabulary: new cells arrive as a stream, the index is merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators import vocabulary


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The index of both: arrays are united per term."""
    if old is None:
        return new
    both = old.unionByName(new)
    unite = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy("term").agg(unite("tables"), unite("contexts"))


def maintain_index(values: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the index of a stream (table, dimension, value) under ``path``, a folder per version.

    Versions are numbered by batch, so a batch that runs again writes the same folder again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        merged(old, vocabulary.inverted_index(batch)).write.mode("overwrite").parquet(f"{path}/v{number}")

    return values.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
