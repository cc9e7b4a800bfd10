"""Sinks: nested JSON per table, blind annotation files with their hidden rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested_values(values: DataFrame) -> DataFrame:
    """(table, dimensions): (table, dimension, value) as a map from dimension to sorted values."""
    per = values.groupBy("table", "dimension").agg(F.sort_array(F.collect_set("value")).alias("vs"))
    return per.groupBy("table").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "vs")))).alias("dimensions"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8; an existing folder is an error."""
    rows.write.mode("errorifexists").json(path)


def blind(sample: DataFrame, shown: list[str], hidden: list[str], gold: str) -> tuple[DataFrame, DataFrame]:
    """What annotators see, with an empty ``gold`` column, and what they must not; both by id."""
    return sample.select("id", *shown, F.lit("").alias(gold)), sample.select("id", *hidden)


def write_blind(sample: DataFrame, shown: list[str], hidden: list[str], gold: str, path: str) -> None:
    """Both files of ``blind``. Existing ones are never overwritten, as they may hold labels."""
    seen, kept = blind(sample, shown, hidden, gold)
    seen.write.mode("errorifexists").option("header", True).csv(f"{path}/annotation")
    kept.write.mode("errorifexists").json(f"{path}/hidden")
