"""Set, vector and blended similarities as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def n_common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard; 0 if a set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_ratio(n_common(a, b), F.size(F.array_union(a, b))))


def containment(a: Column, b: Column) -> Column:
    return _ratio(n_common(a, b), F.least(F.size(a), F.size(b)))


def structural(a: Column, b: Column) -> Column:
    return _ratio(n_common(a, b), F.greatest(F.size(a), F.size(b)))


def difference(a: Column, b: Column) -> Column:
    """What two token sets share and what each has alone."""
    return F.struct(F.array_intersect(a, b).alias("common"), F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def semantic_score(emb: Column, lex: Column, over: Column, cont: Column, seq: Column, cross_domain: Column) -> Column:
    """The blend of all signals, a little less for pairs across domains that are not near."""
    blend = 0.62 * emb + 0.16 * lex + 0.10 * over + 0.07 * cont + 0.05 * seq
    return clamp(blend - F.when(cross_domain & (emb < 0.76), F.lit(0.02)).otherwise(F.lit(0.0)))


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two strings."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
