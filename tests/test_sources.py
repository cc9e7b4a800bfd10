"""Corpus scan, vocabulary from files, streaming index."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import evaluation as E
from termloom.operators import neighbours as N
from termloom.operators import vocabulary as V
from termloom.sources import corpus as C
from termloom.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿freq,unit,geo\\Time,2001.0,2002.0\nAnnual,\"Per cent, x\",Austria,1.0,2 p\n\nAnnual,:,Rest (of)\n".encode())
    (tmp_path / "b.csv").write_bytes("name,name,Mars 2015\nété,1,3\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b'x,y\n"broken')
    (tmp_path / "note.txt").write_text("no table")
    return str(tmp_path)


def test_scan(spark, folder):
    cells = C.scan_tables(spark, folder).cache()
    assert {r.table for r in cells.filter("error IS NOT NULL").collect()} == {"c"}
    body = cells.filter("row_id > 0").collect()
    assert {(r.table, r.header, r.value) for r in body} == {("a", "freq", "Annual"), ("a", "unit", "Per cent, x"), ("a", "geo\\Time", "Austria"), ("a", "unit", ":"), ("a", "geo\\Time", "Rest (of)"), ("b", "name", "été"), ("b", "name", "1")}
    values = V.dimension_values(cells.filter("row_id > 0")).cache()
    assert {tuple(r) for r in values.collect()} == {("a", "freq", "Annual"), ("a", "unit", "Per cent, x"), ("a", "geo", "Austria"), ("a", "geo", "Rest (of)"), ("b", "name", "été")}
    geo = V.split_geography(values, C.gazetteer(spark.createDataFrame([("REST",)], "t string")))
    assert {r.value for r in geo.filter("is_geo").collect()} == {"Austria", "Rest (of)"}


def test_streamed_index_equals_batch(spark, tmp_path):
    rows = [("t1", "d", "x"), ("t2", "d", "x"), ("t2", "e", "y")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "table string, dimension string, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table string, dimension string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.maintain_index(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    want = V.inverted_index(spark.createDataFrame(rows, "table string, dimension string, value string"))
    assert sorted(map(tuple, spark.read.parquet(str(last)).collect())) == sorted(map(tuple, want.collect()))


def test_titles_without_geography(spark):
    titles = spark.createDataFrame([("t", "Trade of New York and york in York")], "table string, title string")
    assert V.without_geography(titles, ["York", "New York"]).first().title == "Trade of  and  in "


def test_neighbours_in_several_blocks(spark):
    rows = [(k, [float((k * j) % 7 + 1) for j in range(1, 5)]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    one = {(r.id, r.other) for r in N.vector_neighbours(df, 3, block=1000).collect()}
    assert one == {(r.id, r.other) for r in N.vector_neighbours(df, 3, block=7).collect()} and len(one) == 120


def test_annotations_must_fit(spark):
    a = spark.createDataFrame([(1, "x")], "id long, text string")
    assert E.joined_annotations(a, spark.createDataFrame([(1, "x", "M")], "id long, text string, pred string")).count() == 1
    with pytest.raises(Exception, match="no row of its own"):
        E.joined_annotations(a, spark.createDataFrame([(1, "y", "M")], "id long, text string, pred string")).collect()


def test_gold_guard(spark):
    rows = spark.createDataFrame([(1, " "), (2, None)], "id long, gold string")
    assert not E.has_gold(rows, "gold") and E.has_gold(rows.union(spark.createDataFrame([(3, "M")], "id long, gold string")), "gold")


def test_requires_columns(spark):
    with pytest.raises(ValueError, match="table"):
        C.require_columns(spark.range(1).select(F.lit(1).alias("x")), "table")


def test_blind_files_are_not_overwritten(spark, tmp_path):
    from termloom.sources import sinks

    sample = spark.createDataFrame([(1, "x", "M")], "id long, term string, pred string")
    sinks.write_blind(sample, ["term"], ["term", "pred"], "gold", str(tmp_path / "s"))
    seen = spark.read.option("header", True).csv(str(tmp_path / "s/annotation"))
    assert seen.columns == ["id", "term", "gold"] and spark.read.json(str(tmp_path / "s/hidden")).first().pred == "M"
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_blind(sample, ["term"], ["pred"], "gold", str(tmp_path / "s"))


def test_requests_and_replies(spark, tmp_path):
    from termloom.operators import replies

    measures = spark.createDataFrame([("Births",), ("Gas prices",)], "measure string")
    asked = replies.domain_prompts(measures, ["energy", "population"])
    assert asked.filter(F.col("prompt").contains("- energy\n- population")).count() == 2
    answered = asked.limit(1).select("request_id", F.lit('{"domain": "energy", "confidence": 0.9}').alias("reply"))
    replies.append_replies(answered, str(tmp_path / "cache"))
    valid = replies.domain_replies(spark.read.parquet(str(tmp_path / "cache")), spark.createDataFrame([("energy",)], "domain string"))
    assert valid.count() == 1 and replies.pending(asked, valid).count() == 1


def test_vocabulary_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", "A"), ("A", "A"), ("x", "U")], "term string, category string")
    V.write_vocabulary(rows, str(tmp_path / "v"))
    assert {p.name for p in (tmp_path / "v").iterdir() if p.is_dir()} == {"category=A", "category=U"}
    assert [r.term for r in spark.read.option("header", True).csv(str(tmp_path / "v/category=A")).collect()] == ["A", "b"]
