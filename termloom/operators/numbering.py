"""Numbers in a global order, without a partition that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.sources.shared import cut


def numbered(rows: DataFrame, *order: Column | str, name: str = "nth") -> DataFrame:
    """The rows with their place in ``order``, from 0, as the long column ``name``.

    Rows are range-partitioned and written once, as two evaluations of a range partitioning may
    draw other bounds; places are those inside a partition after the counts of the partitions
    before it, of which there are as many as partitions. Equal rows are numbered in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__before"))
    k = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return placed.withColumn("__k", k).join(F.broadcast(before), "__p").withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).drop("__p", "__k", "__before")
