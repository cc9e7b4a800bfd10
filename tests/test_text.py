"""Text rules against hand cases."""

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T


def apply(spark, rule, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", rule(F.col("v")).alias("r")).orderBy("k").collect()
    return [r.r for r in rows]


def test_time_headers(spark):
    yes = ["2000", "2000.0", " 2100 ", "2008-01", "2020-01-31", "1985-S1", "1985-s2", "2020-Q1", "Q1 2020", "x2020q3", "Janvier-Mars 2015", "mai 1999"]
    no = ["2101", "1899", "2020-W01", "2008M01", "2020-S3", "geo", "", None, "SITC Rev. 4, 2006", "20200"]
    assert apply(spark, T.is_time_header, yes) == [True] * len(yes)
    assert apply(spark, T.is_time_header, no) == [False] * len(no)


def test_clean_value(spark):
    given = ["a", " a\t", ":", " .. ", "...", "", " ", None, "-4.5", "+4", "1e5", "800.0 p", ": m", "4."]
    assert apply(spark, T.clean_value, given) == ["a", "a", None, None, None, None, None, None, None, "+4", "1e5", "800.0 p", ": m", "4."]


def test_geo_variants(spark):
    (one, two, none) = apply(spark, T.geo_variants, ["A (b) (c)", "(x)", "plain"])
    assert set(one) == {"A (b) (c)", "A (b)", "A (c)", "A"}
    assert two == ["(x)"] and none == ["plain"]


@pytest.mark.parametrize(
    "title, clean",
    [
        ("Prices (2015 = 100) - annual data 2001-2010", "Prices (2015 = 100) - annual data"),
        ("Trade since 2003, up to 2010", "Trade"),
        ("Survey 2011 ( ) , x", "Survey, x"),
        ("Data from 1999 to 2001", "Data"),
        ("Rate in 2010, other", "Rate, other"),
        ("mars 2010 rate 2012 juin", "rate"),
        ("a - - b", "a - b"),
    ],
)
def test_titles(spark, title, clean):
    assert apply(spark, lambda c: T.tidy_title(T.remove_dates(c)), [title]) == [clean]


def test_tokens_and_core(spark):
    assert apply(spark, T.measure_tokens, ["Activities of the classes & glass buses"]) == [["activity", "buse", "classes", "glass"]]
    assert apply(spark, T.measure_core, ["Employment by sex - annual data", "Price index", "Share in percentage"]) == ["employment", "price", "share"]


def test_signatures(spark):
    assert apply(spark, T.signature, ["Age 15-24 (EUR): B, 1,5"]) == [["1.5", "15", "15-24", "24", "b", "eur"]]
    q = spark.createDataFrame([("NUTS 2 Rev. 1.1 (%) 15-24",)], "v string").select(T.qualifiers(F.col("v")).alias("q")).first().q
    assert (q.nuts, q.rev, q.unit, q.span, q.section) == ("2", "1.1", "%", "15-24", None)


def test_json_payload(spark):
    given = ['```json\n{"a": 1}\n```', '<think>{"b"}</think> {"a": 1}', 'so {"a": 1} it is', "none"]
    assert apply(spark, T.json_payload, given) == ['{"a": 1}'] * 3 + [None]
