"""Inputs of the registered queries: frames over the tables, and literal rows for both engines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.numbering import numbered
from termloom.sources.corpus import unpivoted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rows:
    """Literal rows: a DataFrame in Spark and a subquery in SQL."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        names = [c.split() for c in self.schema.split(", ")]
        return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in self.rows], kinds[t]) for k, (n, t) in enumerate(names)}))

    @property
    def sql(self) -> str:
        def literal(x) -> str:
            if x is None:
                return "NULL"
            return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}
        cols = [c.split() for c in self.schema.split(", ")]
        values = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in self.rows)
        casts = ", ".join(f"{n}::{kinds[t]} AS {n}" for n, t in cols)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({', '.join(n for n, _ in cols)}))"


CELL_COLUMNS = {"part": ["p_brand", "p_type", "p_name"], "customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type"]}

CELLS_SQL = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS dimension, {c}::VARCHAR AS value FROM {t}" for t, cs in CELL_COLUMNS.items() for c in cs) + ")"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, dimension, value) of the descriptive columns of four tables."""
    out = None
    for name, columns in CELL_COLUMNS.items():
        one = unpivoted(table(spark, sf_dir, name), name, columns)
        out = one if out is None else out.unionByName(one)
    return out


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, measure): distinct ``name by type`` strings, numbered in order."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws(" by ", "p_name", "p_type").alias("measure")).distinct()
    return numbered(rows, "measure", name="id").select((F.col("id") + 1).alias("id"), "measure")


MEASURES_SQL = "(SELECT row_number() OVER (ORDER BY measure)::BIGINT AS id, measure FROM (SELECT DISTINCT p_name || ' by ' || p_type AS measure FROM part))"

HEADERS = Rows(
    "tab string, col_idx int, header string",
    [
        ("t1", 0, "freq"), ("t1", 1, "unit"), ("t1", 2, "unit"), ("t1", 3, "geo\\Time"), ("t1", 4, "2001.0"), ("t1", 5, "2002.0"),
        ("t2", 0, " name "), ("t2", 1, "name"), ("t2", 2, "name"), ("t2", 3, "area\\TIME_PERIOD"), ("t2", 4, "Janvier-Mars 2015"),
        ("t3", 0, "a"), ("t3", 1, "b\\Time"), ("t3", 2, "c"), ("t4", 0, "x"), ("t4", 1, "x"), ("t4", 2, "y"),
        ("t5", 0, "Rail network segment (2010)"), ("t5", 1, "geo\\t"), ("t5", 2, "2020-Q1"), ("t5", 3, "note"),
    ],
)

LEXICON = Rows(
    "domain string, domain_idx int, word string, weight int",
    [
        ("agriculture", 0, "the", 1), ("agriculture", 0, "eauou", 5), ("agriculture", 0, "and", 1), ("transport", 1, "la", 3), ("transport", 1, "des", 2), ("transport", 1, "que", 2),
        ("industry", 2, "und", 3), ("industry", 2, "die", 2), ("industry", 2, "zu", 2), ("energy", 3, "los", 3), ("energy", 3, "para", 2), ("energy", 3, "of", 1),
        ("environment", 4, "in", 1), ("environment", 4, "this", 4), ("environment", 4, "was", 2),
    ],
)

#: Titles of the kinds that occur, made from every nation.
TITLE_SQL = """(SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE n_nationkey % 8
  WHEN 0 THEN 'Trade of ' || n_name || ' (2015 = 100) - annual data 2001-2010'
  WHEN 1 THEN 'Prices in ' || n_name || ' from 2001 to 2005, in 2010'
  WHEN 2 THEN 'Survey 2011 ( ) , ' || n_name || ' until 2014 -'
  WHEN 3 THEN 'Index March 2012 2013 juin between 2001 and 2009 ' || n_name
  WHEN 4 THEN n_name || ' data from 1999 to 2001 since 2003 up to 2004'
  WHEN 5 THEN 'Rate 2020-01-31, 2020-01, 2020-S1, 2020-Q3, Q1 2020 (' || n_name || ')'
  WHEN 6 THEN 'Flows from 2005 onwards - - ' || n_name
  ELSE 'Code 2199 and 1850 in ' || n_name END AS title FROM nation)"""


def made_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    n = F.col("n_name")
    kinds = [
        F.concat(F.lit("Trade of "), n, F.lit(" (2015 = 100) - annual data 2001-2010")),
        F.concat(F.lit("Prices in "), n, F.lit(" from 2001 to 2005, in 2010")),
        F.concat(F.lit("Survey 2011 ( ) , "), n, F.lit(" until 2014 -")),
        F.concat(F.lit("Index March 2012 2013 juin between 2001 and 2009 "), n),
        F.concat(n, F.lit(" data from 1999 to 2001 since 2003 up to 2004")),
        F.concat(F.lit("Rate 2020-01-31, 2020-01, 2020-S1, 2020-Q3, Q1 2020 ("), n, F.lit(")")),
        F.concat(F.lit("Flows from 2005 onwards - - "), n),
        F.concat(F.lit("Code 2199 and 1850 in "), n),
    ]
    return nation.select(F.col("n_nationkey").cast("long").alias("id"), n.alias("name"), F.get(F.array(*kinds), F.col("n_nationkey") % 8).alias("title"))


#: Texts with qualifiers, words and breakdowns of every kind that a rule looks at.
TEXTS = Rows(
    "id long, measure string",
    [
        (1, "Employment by sex & age (NUTS 2) - annual data"), (2, "Employment by age and sex (NUTS 3)"), (3, "Activities of companies, Rev. 2 (%)"),
        (4, "Activity of a company, Rev.1.1 (THS)"), (5, "Persons aged 15-24 in percentage"), (6, "Persons aged 25-64 as percent"), (7, "Consumer price index"),
        (8, "Consumer prices: A, section B"), (9, "Gross profits - C"), (10, "Losses of the classes 1,5 and 20.7"), (11, "employment  by SEX and AGE nuts 2"), (12, "Bus passes by region monthly data 2001"),
        (13, ""), (14, "By the by"),
    ],
)

REPLIES = Rows(
    "batch long, reply string",
    [
        (0, '```json {"results": [{"pair_id": 1, "relation": "synonym", "confidence": 0.9}, {"pair_id": 1, "relation": "related", "confidence": 0.8}, {"pair_id": 2, "relation": "none", "confidence": 0.9}]} ```'),
        (1, '<think>{}</think>{"results": [{"pair_id": 3, "relation": "subtype", "confidence": 1.5}, {"pair_id": 1, "relation": "subtype", "confidence": 0.6}, {"pair_id": 9, "relation": "subtype", "confidence": 0.6}]}'),
        (2, "no json"), (3, 'Here: {"results": [{"pair_id": 2, "relation": "same_concept", "confidence": 0.75}]} done'),
    ],
)

RELATIONS = Rows(
    "seq long, measure1 string, measure2 string, relation string, confidence double, method string",
    [
        (0, "Employment 15-24", "Employment 25-64", "same_concept", 0.95, "automatic_same_concept_token_reorder"), (1, "Employment 25-64", "Employment 15-24", "same_concept", 0.95, "llm"),
        (2, "Road freight", "Road freight by age", "subtype", 0.93, "automatic_subtype"), (3, "Rail goods", "Road passengers", "subtype", 0.9, "automatic_subtype"),
        (4, "Gas prices", "Gas price", "synonym", 0.9, "automatic_learned_variant"), (5, "Births", "Deaths", "different_aspects", 0.89, "automatic_learned_dimension"),
        (6, "Births", "Marriages", "different_aspect", 0.7, "llm"), (7, "Gas prices", "Gas price", "synonym", 0.97, "llm"), (8, "A (%)", "A (EUR)", "same_concept", 0.96, "llm"),
    ],
)
