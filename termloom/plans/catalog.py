"""Registered queries of the vocabulary engine, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.functions import text as T
from termloom.operators import domains as D
from termloom.operators import evaluation as E
from termloom.operators import neighbours as N
from termloom.operators import relations as R
from termloom.operators import replies as P
from termloom.operators import vocabulary as V
from termloom.operators.numbering import numbered
from termloom.plans import inputs as I
from termloom.sources import corpus as C
from termloom.sources import sinks as K
from termloom.sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- SQL pieces that several oracles share ----
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CLEAN = "(CASE WHEN trim({0}) IN ('', ':', '..', '...') OR regexp_full_match(trim({0}), '-?[0-9]+([.][0-9]+)?') THEN NULL ELSE trim({0}) END)"
VALUES_SQL = f"(SELECT DISTINCT tab, dimension, v AS value FROM (SELECT tab, dimension, {CLEAN.format('value')} AS v FROM {I.CELLS_SQL}) WHERE v IS NOT NULL)"
INDEX_SQL = f"""(SELECT term, list_sort(list(DISTINCT tab)) AS tabs, list_sort(list(DISTINCT context)) AS contexts FROM (
  SELECT value AS term, tab, dimension AS context FROM {VALUES_SQL}
  UNION ALL SELECT dimension, tab, 'DIMENSION_NAME' FROM {VALUES_SQL}) WHERE term <> '' GROUP BY term)"""
NORM = r"trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
STEM = """(CASE WHEN length({0}) > 5 AND {0} LIKE '%ies' THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 5 AND {0} LIKE '%ses' THEN {0}
 WHEN length({0}) > 4 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) ELSE {0} END)"""
_STOP = "('" + "','".join(T.STOPWORDS) + "')"


def tokens_sql(expr: str, stemmed: bool = True) -> str:
    word = f"lambda w: {STEM.format('w')}" if stemmed else "lambda w: w"
    return f"list_sort(list_distinct(list_transform(list_filter(string_split({NORM.format(expr)}, ' '), lambda w: length(w) >= 2 AND w NOT IN {_STOP}), {word})))"


def core_sql(expr: str) -> str:
    a = rf"trim(regexp_replace({NORM.format(expr)}, '\s*(annual|monthly|quarterly|bi annual|biannual)\s+data.*$', ''))"
    b = rf"trim(string_split_regex({a}, '\s+by\s+')[1])"
    return rf"trim(regexp_replace(trim(regexp_replace({b}, '\s+(in|as)\s+percent(age)?$', '')), '\s+index$', ''))"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir)
    return cells.withColumn("value", T.clean_value(F.col("value"))).filter("value IS NOT NULL").select("table", "dimension", "value").distinct()


# ---- vocabulary ----


@query(f"SELECT term, len(tabs)::BIGINT AS n_tables, array_to_string(tabs, '|') AS tables, array_to_string(contexts, '|') AS contexts FROM {INDEX_SQL}")
def vocab_index(spark, sf_dir):
    index = V.inverted_index(values(spark, sf_dir))
    return index.select("term", F.size("tables").cast("long").alias("n_tables"), F.array_join("tables", "|").alias("tables"), F.array_join("contexts", "|").alias("contexts"))


@query(f"""SELECT count(*) AS n_terms, count(*) FILTER (list_contains(contexts, 'DIMENSION_NAME')) AS n_names, count(*) FILTER (list_contains(contexts, 'TITLE')) AS n_titles,
 count(*) FILTER (len(tabs) > 1) AS n_shared, sum(len(tabs))::BIGINT AS n_postings FROM {INDEX_SQL}""")
def vocab_stats(spark, sf_dir):
    return V.index_statistics(V.inverted_index(values(spark, sf_dir)))


_YEAR = r"(19\d\d|20\d\d|2100)"
_FORMATS = ("yyyy", "yyyy'.0'", "yyyy-MM", "yyyy-MM-dd", "yyyy'-S1'", "'Q2 'yyyy", "'w 'yyyy", "'mars 'yyyy", "yyyy'-W01'", "'19'yy'M01'")
_DUCK_FORMATS = ("%Y", "%Y.0", "%Y-%m", "%Y-%m-%d", "%Y-S1", "Q2 %Y", "w %Y", "mars %Y", "%Y-W01", "19%yM01")


@query(
    "SELECT header, (regexp_matches(header, '^" + _YEAR + r"(\.0|-\d\d(-\d\d)?|-[Ss][12])?$') OR (regexp_matches(header, '" + _YEAR + "') AND (regexp_matches(header, '(?i)Q[1-4]') OR regexp_matches(lower(header), '"
    + "|".join(T.HEADER_MONTHS) + "')))) AS is_time FROM (SELECT DISTINCT unnest([" + ", ".join(f"strftime(o_orderdate, '{f}')" for f in _DUCK_FORMATS) + "]) AS header FROM orders)"
)
def time_header_classify(spark, sf_dir):
    made = F.explode(F.array(*[F.date_format("o_orderdate", f) for f in _FORMATS])).alias("header")
    return I.table(spark, sf_dir, "orders").select(made).distinct().select("header", T.is_time_header(F.col("header")).alias("is_time"))


_CLEAN_SOURCE = "(SELECT DISTINCT unnest([p_name, p_size::VARCHAR, ' ' || p_brand || ' ', p_retailprice::DECIMAL(12,2)::VARCHAR || ' p', ':', ' .. ', '-4.50', '+4', '1e5', '']) AS value FROM part)"


@query(f"SELECT value, {CLEAN.format('value')} AS cleaned, regexp_full_match(value, '-?[0-9]+([.][0-9]+)?') AS is_numeric FROM {_CLEAN_SOURCE}")
def clean_values(spark, sf_dir):
    made = [F.col("p_name"), F.col("p_size").cast("string"), F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" p"))]
    made += [F.lit(x) for x in (":", " .. ", "-4.50", "+4", "1e5", "")]
    rows = I.table(spark, sf_dir, "part").select(F.explode(F.array(*made)).alias("value")).distinct()
    return rows.select("value", T.clean_value(F.col("value")).alias("cleaned"), T.is_numeric_string(F.col("value")).alias("is_numeric"))


@query(f"SELECT tab, col_idx, CASE WHEN k > 1 THEN h || '.' || (k - 1) ELSE h END AS header FROM (SELECT tab, col_idx, trim(header) AS h, row_number() OVER (PARTITION BY tab, trim(header) ORDER BY col_idx) AS k FROM {I.HEADERS.sql})")
def header_dedup(spark, sf_dir):
    return C.mangled_headers(I.HEADERS.frame(spark).withColumnRenamed("tab", "table")).withColumnRenamed("table", "tab")


_TIME_SQL = "(regexp_matches(trim(header), '^" + _YEAR + r"(\.0|-\d\d(-\d\d)?|-[Ss][12])?$') OR (regexp_matches(header, '" + _YEAR + "') AND (regexp_matches(header, '(?i)Q[1-4]') OR regexp_matches(lower(header), '" + "|".join(T.HEADER_MONTHS) + "'))))"


@query(f"""SELECT tab, col_idx, header, string_split(header, chr(92))[1] AS dimension FROM (SELECT *, coalesce(min(CASE WHEN {_TIME_SQL} THEN col_idx END) OVER (PARTITION BY tab) - 1,
 min(CASE WHEN contains(header, chr(92)) THEN col_idx END) OVER (PARTITION BY tab), max(col_idx) OVER (PARTITION BY tab)) AS stop FROM {I.HEADERS.sql}) WHERE col_idx <= stop""")
def dimension_boundary(spark, sf_dir):
    kept = V.descriptive_columns(I.HEADERS.frame(spark).withColumnRenamed("tab", "table"))
    return kept.select(F.col("table").alias("tab"), "col_idx", "header", T.dimension_name(F.col("header")).alias("dimension"))


_PLACES_SQL = "(SELECT DISTINCT 'supplier' AS tab, n_name || ' (area ' || n_regionkey || ')' AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'customer', upper(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_GAZ_SQL = "(SELECT DISTINCT lower(n_name) AS k FROM nation WHERE n_regionkey <= 1)"
_BARE = r"lower(trim(regexp_replace(value, '\s*\([^()]*\)', '', 'g')))"


def _places(spark, sf_dir):
    nation = I.table(spark, sf_dir, "nation")
    s = I.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("supplier").alias("table"), F.concat("n_name", F.lit(" (area "), F.col("n_regionkey").cast("string"), F.lit(")")).alias("value"))
    c = I.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customer").alias("table"), F.upper("n_name").alias("value"))
    terms = nation.filter("n_regionkey <= 1").select(F.col("n_name").alias("term"))
    return V.split_geography(s.unionByName(c).distinct(), terms).withColumnRenamed("table", "tab")


@query(f"SELECT tab, value FROM {_PLACES_SQL} WHERE lower(value) IN (SELECT k FROM {_GAZ_SQL}) OR {_BARE} IN (SELECT k FROM {_GAZ_SQL})")
def geo_split_semi(spark, sf_dir):
    return _places(spark, sf_dir).filter("is_geo").select("tab", "value")


@query(f"SELECT tab, value FROM {_PLACES_SQL} WHERE NOT (lower(value) IN (SELECT k FROM {_GAZ_SQL}) OR {_BARE} IN (SELECT k FROM {_GAZ_SQL}))")
def geo_split_anti(spark, sf_dir):
    return _places(spark, sf_dir).filter("NOT is_geo").select("tab", "value")


@query()
def paren_variants(spark, sf_dir):
    # a row group's texts, which can be the whole file's, are read into the heap by parts, not a second time outside it as one range
    docs = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/documents.parquet")
    texts = docs.filter(F.col("text").contains("(")).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").contains("("))
    return V.joined_variants(texts, "line")


@query(f"""SELECT v.tab, v.dimension, v.value FROM {VALUES_SQL} v UNION ALL SELECT tab, 'TITLE', title FROM (VALUES ('part', 'Parts of 2001'), ('orders', 'Orders')) AS t(tab, title)""")
def title_join(spark, sf_dir):
    given = spark.createDataFrame([("part.csv", "old", 0), ("part.csv", "Parts of 2001", 1), ("orders.csv", "Orders", 2), ("none.csv", "x", 3)], "filename string, title string, row_id long")
    return V.add_titles(values(spark, sf_dir), C.titles(given)).withColumnRenamed("table", "tab")


def _title_sql() -> str:
    m = "|".join(T.TITLE_MONTHS)
    y = r"(?:19|20|21)\d\d"
    out = r"regexp_replace(title, '\((\s*)(\d)(\d\d\d\s*=\s*100\s*)\)', '(\1\2' || chr(1) || '\3)', 'g')"
    rules = [r"\b\d\d\d\d\s*[-–]\s*\d\d\d\d\b", r"\bbetween\s+\d\d\d\d\s+and\s+\d\d\d\d\b", r"\bfrom\s+\d\d\d\d\s+onwards\b", r"\bfrom\s+\d\d\d\d\s+to\s+\d\d\d\d\b", r"\buntil\s+\d\d\d\d\b", r"\bup\s+to\s+\d\d\d\d\b", r"\bsince\s+\d\d\d\d\b",
             rf"\b{y}-\d\d-\d\d\b", rf"\b{y}-\d\d\b", rf"\b{y}-S[12]\b", rf"\b{y}-Q[1-4]\b", rf"\bQ[1-4]\s+{y}\b", rf"\b(?:{m})\s+{y}\b", rf"\b{y}\s+(?:{m})\b"]
    for r in rules:
        out = f"regexp_replace({out}, '(?i){r}', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)\b(survey)\s+\d\d\d\d\b', '\1', 'g')"
    out = rf"regexp_replace({out}, '(?i)\bin\s+\d\d\d\d(,|\s|$)', '\1', 'g')"
    out = rf"replace(regexp_replace({out}, '\b{y}\b', '', 'g'), chr(1), '')"
    for a, b in ((r"\(\s*\)", ""), (r"\s+", " "), (r"\s+([,.;:])", r"\1"), (r"\s*-\s*-\s*", " - "), (r"\s*-\s*$", ""), (r"\(\s*,", "(")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim({out}, ' -,')"


@query(f"SELECT id, {_title_sql()} AS title FROM {I.TITLE_SQL}")
def title_clean(spark, sf_dir):
    return V.clean_titles(I.made_titles(spark, sf_dir)).select("id", "title")


@query()
def title_geo_removal(spark, sf_dir):
    names = [r.n_name for r in I.table(spark, sf_dir, "nation").select("n_name").distinct().collect()]
    return V.clean_titles(I.made_titles(spark, sf_dir), names).select("id", "title")


_CAT_VALUES = f"(SELECT tab, CASE dimension WHEN 'event_type' THEN 'Frequency' WHEN 'p_name' THEN 'TITLE' ELSE dimension END AS dimension, value FROM {VALUES_SQL})"
_CAT_INDEX = f"""(SELECT term FROM (SELECT value AS term FROM {_CAT_VALUES} UNION ALL SELECT dimension FROM {_CAT_VALUES} WHERE dimension <> 'TITLE' UNION ALL SELECT 'p_brand') GROUP BY term)"""
_CAT_SQL = f"""SELECT term, CASE WHEN lower(term) IN (SELECT lower(dimension) FROM {_CAT_VALUES} WHERE lower(dimension) <> 'title') THEN 'N'
 WHEN lower(term) IN (SELECT lower(value) FROM {_CAT_VALUES} WHERE lower(dimension) = 'frequency') THEN 'U'
 WHEN lower(term) IN (SELECT lower(value) FROM {_CAT_VALUES} WHERE lower(dimension) NOT IN ('title', 'frequency')) THEN 'A'
 WHEN lower(term) IN (SELECT lower(value) FROM {_CAT_VALUES} WHERE lower(dimension) = 'title') THEN 'M' ELSE 'O' END AS category FROM {_CAT_INDEX}"""


def _classified(spark, sf_dir):
    renamed = F.when(F.col("dimension") == "event_type", "Frequency").when(F.col("dimension") == "p_name", "TITLE").otherwise(F.col("dimension"))
    rows = values(spark, sf_dir).withColumn("dimension", renamed)
    return V.categories(V.inverted_index(rows), rows)


@query(_CAT_SQL)
def category_nuamo(spark, sf_dir):
    return _classified(spark, sf_dir).select("term", "category")


@query(f"SELECT category, count(*) AS n FROM ({_CAT_SQL}) GROUP BY category")
def category_counts(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


# ---- domains ----

_HITS_SQL = f"(SELECT doc_id, domain, domain_idx, sum(weight)::BIGINT AS raw, array_to_string(list_sort(list(word)), '|') AS words FROM documents, {I.LEXICON.sql} WHERE regexp_matches(' ' || lower(text) || ' ', '(^|[^a-z])' || word || '([^a-z]|$)') GROUP BY doc_id, domain, domain_idx)"
_CAPS_SQL = f"""(SELECT b.domain, CASE WHEN coalesce(l.raw, b.budget) <= 0 THEN 1.0 ELSE coalesce(l.raw, b.budget) END::DOUBLE AS cap FROM (SELECT domain, sum(weight)::DOUBLE AS budget FROM {I.LEXICON.sql} GROUP BY domain) b
 LEFT JOIN (SELECT domain, raw::DOUBLE AS raw FROM (SELECT domain, raw, row_number() OVER (PARTITION BY domain ORDER BY raw) AS k, count(*) OVER (PARTITION BY domain) AS n FROM {_HITS_SQL} WHERE raw > 0) WHERE n >= 15 AND k = greatest(1, floor(n * 0.95::DOUBLE)::BIGINT)) l ON l.domain = b.domain)"""
_SCORES_SQL = f"(SELECT doc_id, domain, domain_idx, least(raw / cap, 1.0) AS score FROM {_HITS_SQL} JOIN {_CAPS_SQL} USING (domain) WHERE raw >= 3)"


def _documents(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").alias("measure"))


def _keyed(spark, sf_dir):
    """Documents as measures: scores go by doc_id, since texts can be equal."""
    docs = _documents(spark, sf_dir)
    return docs, docs.select("measure").distinct()


@query(f"SELECT doc_id, domain, raw, words FROM {_HITS_SQL}")
def keyword_score(spark, sf_dir):
    docs, texts = _keyed(spark, sf_dir)
    hits = D.keyword_scores(texts, I.LEXICON.frame(spark))
    return docs.join(hits, "measure").select("doc_id", "domain", "raw", F.array_join("words", "|").alias("words"))


def _doc_scores(spark, sf_dir):
    docs, texts = _keyed(spark, sf_dir)
    hits = D.keyword_scores(texts, I.LEXICON.frame(spark))
    return docs.join(hits, "measure").select(F.col("doc_id").alias("measure"), "domain", "domain_idx", "raw")


@query(f"SELECT domain, cap FROM {_CAPS_SQL}")
def keyword_calibration(spark, sf_dir):
    return D.calibration(_doc_scores(spark, sf_dir), I.LEXICON.frame(spark))


def _normalized(spark, sf_dir):
    raw = _doc_scores(spark, sf_dir)
    caps = D.calibration(raw, I.LEXICON.frame(spark))
    return D.raw_scores(raw).join(F.broadcast(caps), "domain").select(F.col("measure").alias("doc_id"), "domain", "domain_idx", F.least(F.col("raw") / F.col("cap"), F.lit(1.0)).alias("score"))


@query(f"SELECT doc_id, domain, round(score, 6) AS score FROM {_SCORES_SQL}")
def dictionary_normalized(spark, sf_dir):
    return _normalized(spark, sf_dir).select("doc_id", "domain", F.round("score", 6).alias("score"))


#: Domain vectors: the mean of each label's vectors, of length one.
_CENTRES_SQL = """(SELECT label, list(m / norm ORDER BY k) AS vec FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS norm FROM (
 SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY label, k)) GROUP BY label)"""
_COS_SQL = f"(SELECT e.vec_id, c.label, least(1.0, greatest(0.0, list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), c.vec))) AS score FROM embeddings e, {_CENTRES_SQL} c)"


def _centres(spark, sf_dir):
    cells = I.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    mean = cells.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return vec.select("label", F.transform("v", lambda c: c["m"] / F.col("norm")).alias("vec"))


def _vector_signals(spark, sf_dir):
    vectors = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("measure"), F.col("embedding").alias("vec"))
    centres = _centres(spark, sf_dir).select(F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), F.col("label").alias("domain_idx"), "vec")
    return D.vector_scores(vectors, centres)


@query(f"""SELECT vec_id, max(CASE WHEN k = 1 THEN 'd' || label END) AS best, round(max(CASE WHEN k = 1 THEN score END), 6) AS score, round(max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END), 6) + 0.0 AS margin
 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS k FROM {_COS_SQL}) GROUP BY vec_id""")
def domain_embedding_top2(spark, sf_dir):
    best = D._best_two(_vector_signals(spark, sf_dir).withColumn("score", F.round("score", 9)), "score", "v")
    return best.select(F.col("measure").alias("vec_id"), F.col("v_best").alias("best"), F.round("v_score", 6).alias("score"), (F.round("v_margin", 6) + 0.0).alias("margin"))


_SIG_SQL = f"""(SELECT c.vec_id, c.label, round(c.score, 9) AS v, ((c.vec_id * 7 + c.label * 13) % 11) / 10.0::DOUBLE * ((c.vec_id + c.label) % 3) / 2.0 AS d FROM {_COS_SQL} c)"""


def _signals(spark, sf_dir):
    """Vector scores with a made-up dictionary score, so that every row of the decision table occurs."""
    v = _vector_signals(spark, sf_dir).withColumn("vector", F.round("score", 9))
    made = ((F.col("measure") * 7 + F.col("domain_idx") * 13) % 11) / F.lit(10.0) * ((F.col("measure") + F.col("domain_idx")) % 3) / F.lit(2.0)
    return v.select("measure", "domain", "domain_idx", made.alias("dictionary"), "vector")


def _decision_sql(select: str) -> str:
    def top(x: str, n: str) -> str:
        return f"(SELECT vec_id, max(CASE WHEN k = 1 THEN label END) AS {n}b, max(CASE WHEN k = 1 THEN s END) AS {n}s, max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END) AS {n}m FROM (SELECT vec_id, label, {x} AS s, row_number() OVER (PARTITION BY vec_id ORDER BY {x} DESC, label) AS k FROM sig) GROUP BY vec_id)"

    return f"""WITH sig AS (SELECT *, 0.4::DOUBLE * d + 0.6::DOUBLE * v AS b FROM {_SIG_SQL}),
 t AS (SELECT *, db = vb AS agree, ds >= 0.55 AND dm >= 0.15 AS dc, vs >= 0.45 AND vm >= 0.08 AS vc FROM {top('d', 'd')} JOIN {top('v', 'v')} USING (vec_id) JOIN {top('b', 'b')} USING (vec_id)),
 f AS (SELECT vec_id, CASE WHEN agree THEN db WHEN dc AND vc THEN bb WHEN vc THEN vb WHEN dc THEN db ELSE bb END AS final, CASE WHEN agree THEN NOT (dc OR vc) ELSE dc = vc END AS review,
  CASE WHEN agree AND (dc OR vc) THEN 'dictionary_embedding_agree' WHEN agree THEN 'agreement_but_signals_not_clear' WHEN dc AND vc THEN 'clear_dictionary_clear_embedding_conflict'
  WHEN vc THEN 'clear_embedding_dictionary_not_clear' WHEN dc THEN 'clear_dictionary_embedding_not_clear' ELSE 'neither_signal_clear' END AS reason FROM t),
 g AS (SELECT f.*, s.b AS conf FROM f JOIN sig s ON s.vec_id = f.vec_id AND s.label = f.final),
 o AS (SELECT g.vec_id, arg_min(s.label, -s.b * 1000 + s.label / 1e9) AS second FROM g JOIN sig s ON s.vec_id = g.vec_id AND s.label <> g.final WHERE s.b >= 0.35 AND g.conf - s.b <= 0.15 GROUP BY g.vec_id)
 {select}"""


@query(_decision_sql("SELECT g.vec_id, CASE WHEN NOT review THEN 'd' || final END AS domain, 'd' || final AS final_domain, round(conf, 6) AS confidence, review AS needs_review, reason, 'd' || o.second AS secondary_domain FROM g LEFT JOIN o USING (vec_id)"))
def domain_decision(spark, sf_dir):
    return D.decide(_signals(spark, sf_dir)).withColumnRenamed("measure", "vec_id").withColumn("confidence", F.round("confidence", 6))


@query(_decision_sql("SELECT reason, count(*) AS n FROM g GROUP BY reason"))
def domain_reason_counts(spark, sf_dir):
    return D.decide(_signals(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


# ---- measures and pairs ----

_ALL_TEXTS = f"(SELECT id, measure FROM {I.TEXTS.sql} UNION ALL SELECT 1000 + item_id, text FROM benchmark UNION ALL SELECT 100000 + id, measure FROM {I.MEASURES_SQL})"


def _all_texts(spark, sf_dir):
    b = I.table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("id"), F.col("text").alias("measure"))
    m = I.measures(spark, sf_dir).select((F.col("id") + 100000).alias("id"), "measure")
    return I.TEXTS.frame(spark).unionByName(b).unionByName(m)


@query(f"SELECT id, {NORM.format('measure')} AS norm, array_to_string({tokens_sql('measure')}, '|') AS tokens, array_to_string({tokens_sql('measure', False)}, '|') AS words FROM {_ALL_TEXTS}")
def measure_tokens(spark, sf_dir):
    m = F.col("measure")
    return _all_texts(spark, sf_dir).select("id", T.normalized_measure(m).alias("norm"), F.array_join(T.measure_tokens(m), "|").alias("tokens"), F.array_join(T.measure_tokens(m, False), "|").alias("words"))


@query(rf"SELECT id, {core_sql('measure')} AS core, regexp_matches({NORM.format('measure')}, '\sby\s') AS has_by FROM {_ALL_TEXTS}")
def measure_core(spark, sf_dir):
    return _all_texts(spark, sf_dir).select("id", T.measure_core(F.col("measure")).alias("core"), T.has_breakdown(F.col("measure")).alias("has_by"))


@query()
def signatures(spark, sf_dir):
    q = T.qualifiers(F.col("measure"))
    return _all_texts(spark, sf_dir).select("id", F.array_join(T.signature(F.col("measure")), "|").alias("signature"), *[q[k].alias(k) for k in ("nuts", "rev", "unit", "span", "section")])


_QUAL_SQL = rf"""(SELECT id, nullif(regexp_extract(measure, '(?i)\bNUTS\s*([0-9])\b', 1), '') AS nuts, nullif(regexp_extract(measure, '(?i)\bRev\.?\s*([0-9]+(\.[0-9]+)?)\b', 1), '') AS rev,
 nullif(lower(regexp_extract(measure, '\(([A-Za-z%]{{1,6}})\)', 1)), '') AS unit, nullif(lower(regexp_extract(measure, '(^|[^A-Za-z0-9])([A-Za-z0-9]{{1,3}}-[A-Za-z0-9]{{1,3}})([^A-Za-z0-9]|$)', 2)), '') AS span,
 nullif(lower(regexp_extract(measure, '[:-]\s*([A-Z]{{1,6}})(\s|$|[,.])', 1)), '') AS section FROM {I.TEXTS.sql})"""


@query(f"""SELECT a.id AS a, b.id AS b, coalesce(a.nuts <> b.nuts, false) OR coalesce(a.rev <> b.rev, false) OR coalesce(a.unit <> b.unit, false) OR coalesce(a.span <> b.span, false) OR coalesce(a.section <> b.section, false) AS conflict,
 coalesce(a.unit <> b.unit, false) OR coalesce(a.span <> b.span, false) OR coalesce(a.section <> b.section, false) AS same_conflict FROM {_QUAL_SQL} a JOIN {_QUAL_SQL} b ON a.id < b.id""")
def qualifier_conflict(spark, sf_dir):
    q = I.TEXTS.frame(spark).select("id", T.qualifiers(F.col("measure")).alias("q"))
    pairs = q.alias("l").join(q.alias("r"), F.col("l.id") < F.col("r.id"))
    return pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), T.qualifier_conflict(F.col("l.q"), F.col("r.q")).alias("conflict"), T.same_concept_conflict(F.col("l.q"), F.col("r.q")).alias("same_conflict"))


_TOK_SQL = f"(SELECT id, {tokens_sql('measure')} AS t FROM {I.MEASURES_SQL})"


def _sharing_a_token(features):
    """Pairs (a, b) of all measures with a token in common, a < b."""
    of = features.select("id", F.explode("toks").alias("t"))
    return of.select(F.col("id").alias("a"), "t").join(of.select(F.col("id").alias("b"), "t"), "t").filter("a < b").select("a", "b").distinct()


@query(f"""SELECT a, b, round(CASE WHEN u = 0 THEN 0 ELSE c / u END::DOUBLE, 6) AS overlap, round(c / least(na, nb)::DOUBLE, 6) AS containment, round(c / greatest(na, nb)::DOUBLE, 6) AS structural, na - c AS only_a, nb - c AS only_b FROM (
 SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t))::BIGINT AS c, len(list_distinct(list_concat(x.t, y.t)))::BIGINT AS u, len(x.t)::BIGINT AS na, len(y.t)::BIGINT AS nb FROM {_TOK_SQL} x JOIN {_TOK_SQL} y ON x.id < y.id AND list_has_any(x.t, y.t))""")
def pair_overlap_features(spark, sf_dir):
    f = R.measure_features(I.measures(spark, sf_dir))
    p = R.token_features(R.with_features(_sharing_a_token(f), f))
    return p.select("a", "b", F.round("overlap", 6).alias("overlap"), F.round("containment", 6).alias("containment"), F.round("structural", 6).alias("structural"), F.size("diff.only_a").cast("long").alias("only_a"), F.size("diff.only_b").cast("long").alias("only_b"))


_GRAMS_SQL = f"""(SELECT id, term, count(*) AS c FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (
 SELECT item_id AS id, list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 2) AS w FROM benchmark)) GROUP BY id, term)"""
_TFIDF_SQL = f"""(SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT g.id, g.term, (1 + ln(c)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w
 FROM {_GRAMS_SQL} g JOIN (SELECT term, count(*) AS df FROM {_GRAMS_SQL} GROUP BY term) d USING (term), (SELECT count(*) AS n FROM benchmark)))"""
_TFCOS_SQL = f"(SELECT x.id AS id, y.id AS other, sum(x.w * y.w) AS sim FROM {_TFIDF_SQL} x JOIN {_TFIDF_SQL} y ON x.term = y.term AND x.id <> y.id GROUP BY x.id, y.id)"
_TFKNN_SQL = f"(SELECT id, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS k FROM {_TFCOS_SQL}) WHERE k <= 5)"


def _weights(spark, sf_dir):
    return N.tfidf(I.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.normalized_measure(F.col("text")).alias("text"))).drop("df")


@query(f"SELECT id, term, round(w, 6) AS w FROM {_TFIDF_SQL}")
def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(f"SELECT id AS a, other AS b, round(sim, 6) AS lex FROM {_TFCOS_SQL} WHERE id < other")
def tfidf_cosine(spark, sf_dir):
    w = _weights(spark, sf_dir)
    pairs = w.select(F.col("id").alias("a"), "term").join(w.select(F.col("id").alias("b"), "term"), "term").filter("a < b").select("a", "b").distinct()
    return N.tfidf_cosine(w, pairs).withColumn("lex", F.round("lex", 6))


@query(f"SELECT id, other, round(sim, 6) AS sim FROM {_TFKNN_SQL}")
def tfidf_knn(spark, sf_dir):
    return N.tfidf_neighbours(_weights(spark, sf_dir), 5).withColumn("sim", F.round("sim", 6))


_VCOS_SQL = "(SELECT a.vec_id AS id, b.vec_id AS other, a.label AS d1, b.label AS d2, list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
_VKNN_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, other) AS k FROM {_VCOS_SQL}) WHERE k <= 5)"


def _vknn(spark, sf_dir, floor=None):
    return N.vector_neighbours(I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5, floor)


@query(f"SELECT id, other, round(sim, 6) AS sim FROM {_VKNN_SQL} WHERE sim >= 0.3")
def embedding_knn(spark, sf_dir):
    return _vknn(spark, sf_dir, 0.3).withColumn("sim", F.round("sim", 6))


@query(f"SELECT id, other, round(sim, 6) AS sim FROM {_VKNN_SQL} WHERE sim >= 0.3 AND (d1 = d2 OR sim >= 0.35)")
def embedding_knn_domain_filter(spark, sf_dir):
    domains = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("domain"))
    return N.near_domains(_vknn(spark, sf_dir, 0.3), domains, 0.35).withColumn("sim", F.round("sim", 6))


@query()
def sequence_ratio(spark, sf_dir):
    b = I.table(spark, sf_dir, "benchmark").select("item_id", T.normalized_measure(F.col("text")).alias("t"))
    p = N.tfidf_neighbours(_weights(spark, sf_dir), 5).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    p = p.join(b.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), "a").join(b.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), "b")
    return p.select("a", "b", F.round(S.sequence_ratio("ta", "tb"), 6).alias("ratio"))


_CAND_SQL = f"""(SELECT a, b, list_sort(list(DISTINCT src)) AS sources FROM (SELECT least(id, other) AS a, greatest(id, other) AS b, 'embedding_knn' AS src FROM {_VKNN_SQL} WHERE sim >= 0.3
 UNION ALL SELECT least(id, other), greatest(id, other), 'tfidf_knn' FROM {_TFKNN_SQL} WHERE sim >= 0.05) GROUP BY a, b)"""


def _candidates(spark, sf_dir):
    return N.candidate_pairs(_vknn(spark, sf_dir, 0.3), N.tfidf_neighbours(_weights(spark, sf_dir), 5, 0.05))


@query(f"SELECT a, b, array_to_string(sources, '|') AS sources FROM {_CAND_SQL}")
def candidate_union(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumn("sources", F.array_join("sources", "|"))


@query(f"SELECT count(*) AS n, count(*) FILTER (list_contains(sources, 'embedding_knn')) AS by_embedding, count(*) FILTER (list_contains(sources, 'tfidf_knn')) AS by_tfidf, count(*) FILTER (len(sources) = 2) AS both FROM {_CAND_SQL}")
def candidate_sources(spark, sf_dir):
    return N.source_counts(_candidates(spark, sf_dir))


@query("SELECT DISTINCT measure, domain FROM (SELECT p_name || ' by ' || p_type AS measure, p_brand AS domain FROM part UNION ALL SELECT p_type, p_brand FROM part) WHERE measure IN (SELECT p_name || ' by ' || p_type FROM part)")
def known_domains(spark, sf_dir):
    """Domains of a mapping for the measures that there are."""
    part = I.table(spark, sf_dir, "part")
    mapping = part.select(F.concat_ws(" by ", "p_name", "p_type").alias("measure"), F.col("p_brand").alias("domain")).union(part.select("p_type", "p_brand")).distinct()
    return D.known_domains(mapping, I.measures(spark, sf_dir))


# pairs of measures with made-up but fixed signals, which reach every rule
_PAIR_SQL = f"""(SELECT x.id AS a, y.id AS b, 0.70::DOUBLE + ((x.id * 31 + y.id * 17) % 31) / 100.0::DOUBLE AS emb, ((x.id * 5 + y.id * 3) % 11) / 10.0::DOUBLE AS lex, ((x.id + y.id * 7) % 21) / 20.0::DOUBLE AS seq,
 (x.id + y.id) % 4 = 0 AS cross_domain, x.t AS tx, y.t AS ty, x.core AS cx, y.core AS cy, x.ct AS ct, len(list_intersect(x.t, y.t))::DOUBLE AS c, len(list_distinct(list_concat(x.t, y.t)))::DOUBLE AS u, len(x.t)::DOUBLE AS na, len(y.t)::DOUBLE AS nb
 FROM (SELECT id, {tokens_sql('measure')} AS t, {core_sql('measure')} AS core, {tokens_sql(core_sql('measure'))} AS ct FROM {I.MEASURES_SQL}) x JOIN (SELECT id, {tokens_sql('measure')} AS t, {core_sql('measure')} AS core FROM {I.MEASURES_SQL}) y ON x.id < y.id AND list_has_any(x.t, y.t))"""
_BLEND_SQL = f"(SELECT *, c / u AS overlap, c / least(na, nb) AS containment, c / greatest(na, nb) AS structural, least(1.0, greatest(0.0, 0.62::DOUBLE * emb + 0.16::DOUBLE * lex + 0.10::DOUBLE * (c / u) + 0.07::DOUBLE * (c / least(na, nb)) + 0.05::DOUBLE * seq - CASE WHEN cross_domain AND emb < 0.76 THEN 0.02 ELSE 0 END)) AS score FROM {_PAIR_SQL})"


def _pairs(spark, sf_dir):
    features = R.measure_features(I.measures(spark, sf_dir))
    near = _sharing_a_token(features)
    a, b = F.col("a"), F.col("b")
    made = near.withColumns({
        "emb": F.lit(0.70) + ((a * 31 + b * 17) % 31) / F.lit(100.0), "lex": ((a * 5 + b * 3) % 11) / F.lit(10.0), "seq": ((a + b * 7) % 21) / F.lit(20.0), "cross_domain": (a + b) % 4 == 0,
        "sources": F.when((a + b) % 5 == 0, F.array(F.lit("tfidf_knn"))).otherwise(F.array(F.lit("embedding_knn"))),
    })
    p = R.token_features(R.with_features(made, features))
    return p.withColumn("score", S.semantic_score(F.col("emb"), F.col("lex"), F.col("overlap"), F.col("containment"), F.col("seq"), F.col("cross_domain")))


@query(f"SELECT a, b, round(score, 6) AS score, CASE WHEN (a + b) % 5 <> 0 AND score >= 0.64 THEN 'semantic_candidate' ELSE 'retrieval_only' END AS decision FROM {_BLEND_SQL}")
def candidate_decision(spark, sf_dir):
    return R.decide_candidates(_pairs(spark, sf_dir)).select("a", "b", F.round("score", 6).alias("score"), "decision")


_SUB_SQL = f"""(SELECT least(oa[1], ob[1]) AS term_a, greatest(oa[1], ob[1]) AS term_b, context, emb, structural FROM (SELECT list_filter(tx, lambda t: NOT list_contains(ty, t)) AS oa, list_filter(ty, lambda t: NOT list_contains(tx, t)) AS ob,
 list_sort(list_intersect(tx, ty)) AS context, emb, structural FROM {_BLEND_SQL}) WHERE len(oa) = 1 AND len(ob) = 1 AND len(context) >= 2)"""
_TERMSIM = "(0.40::DOUBLE + ((length(term_a) * 7 + length(term_b) * 11) % 60) / 100.0::DOUBLE)"


def _patterns(spark, sf_dir):
    ex = R.substitutions(_pairs(spark, sf_dir))
    sims = ex.select("term_a", "term_b").distinct().withColumn("term_similarity", F.lit(0.40) + ((F.length("term_a") * 7 + F.length("term_b") * 11) % 60) / F.lit(100.0))
    return R.learned_patterns(ex, sims)


_PATTERN_SQL = f"""(SELECT *, 0.35::DOUBLE * least(support / 10.0::DOUBLE, 1.0) + 0.25::DOUBLE * least(unique_contexts / 5.0::DOUBLE, 1.0) + 0.20::DOUBLE * cs + 0.20::DOUBLE * ts AS evidence,
  (unique_contexts >= 2 AND cs >= 0.72) AND support >= 3 AND ts BETWEEN 0.84 AND 0.985 AND cs >= 0.82 AND avg_emb >= 0.90 AS variant, valid >= 2 AND unique_contexts >= 2 AS dimension FROM (
 SELECT b.*, coalesce(m.cs, 0.0) AS cs FROM (SELECT term_a, term_b, count(*) AS support, count(DISTINCT context) AS unique_contexts, avg(emb) AS avg_emb, count(*) FILTER (structural >= 0.72 AND emb >= 0.84) AS valid, {_TERMSIM} AS ts FROM {_SUB_SQL} GROUP BY term_a, term_b) b
 LEFT JOIN (SELECT term_a, term_b, avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE) AS cs FROM (SELECT p.term_a, p.term_b, p.context AS x, q.context AS y
   FROM (SELECT *, row_number() OVER () AS k FROM {_SUB_SQL}) p JOIN (SELECT *, row_number() OVER () AS k FROM {_SUB_SQL}) q ON p.term_a = q.term_a AND p.term_b = q.term_b AND p.k < q.k) GROUP BY term_a, term_b) m USING (term_a, term_b)
 WHERE b.support >= 2 AND b.ts BETWEEN 0.45 AND 0.985))"""


@query(f"SELECT term_a, term_b, support, unique_contexts, round(cs, 6) AS context_similarity, round(evidence, 6) AS evidence_score, variant, dimension FROM {_PATTERN_SQL}")
def learned_patterns(spark, sf_dir):
    p = _patterns(spark, sf_dir)
    return p.select("term_a", "term_b", "support", "unique_contexts", F.round("context_similarity", 6).alias("context_similarity"), F.round("evidence_score", 6).alias("evidence_score"), "variant", "dimension")


def _cascaded(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    d = F.col("diff")
    changed = F.when((F.size(d["only_a"]) == 1) & (F.size(d["only_b"]) == 1), F.struct(F.least(F.get(d["only_a"], F.lit(0)), F.get(d["only_b"], F.lit(0))).alias("a"), F.greatest(F.get(d["only_a"], F.lit(0)), F.get(d["only_b"], F.lit(0))).alias("b")))
    patterns = _patterns(spark, sf_dir).select("term_a", "term_b", "support", "term_similarity", "context_similarity", "variant", "dimension")
    joined = pairs.withColumn("term_a", changed["a"]).withColumn("term_b", changed["b"]).join(patterns, ["term_a", "term_b"], "left")
    return R.route(R.cascade(joined))


_RULES_SQL = f"""(SELECT *, CASE WHEN r = 'same_concept' THEN CASE WHEN m LIKE '%token_reorder' THEN 0.995 WHEN m LIKE '%breakdown' THEN 0.84 WHEN m LIKE '%high_agreement%' THEN 0.985 ELSE 0.99 END
  WHEN r = 'subtype' THEN least(0.95, 0.72 + 0.10 * containment + 0.08 * emb + 0.05 * structural)
  WHEN r = 'synonym' THEN least(0.97, 0.78 + 0.08 * ts + 0.06 * cs + 0.03 * least(support / 10.0, 1.0))
  WHEN m = 'automatic_learned_dimension' THEN least(0.96, 0.72 + 0.10 * emb + 0.07 * structural + 0.04 * least(support / 8.0, 1.0))
  WHEN m = 'automatic_structural_aspect' THEN least(0.95, 0.60 + 0.18 * emb + 0.12 * structural + 0.08 * overlap)
  WHEN r = 'related' THEN least(0.88, 0.50 + 0.23 * score + 0.14 * emb + 0.05 * greatest(lex, overlap)) END::DOUBLE AS conf FROM (
 SELECT *, CASE WHEN m LIKE '%same_concept%' THEN 'same_concept' WHEN m LIKE '%subtype' THEN 'subtype' WHEN m LIKE '%variant' THEN 'synonym' WHEN m LIKE '%dimension' OR m LIKE '%aspect' THEN 'different_aspects' WHEN m LIKE '%related' THEN 'related' END AS r FROM (
 SELECT *, CASE WHEN na = c AND nb = c AND emb >= 0.965 THEN 'automatic_same_concept_token_reorder'
  WHEN cx <> '' AND cx = cy AND ((len(ct) >= 2 AND emb >= 0.80) OR (len(ct) = 1 AND length(cx) >= 5 AND emb >= 0.88)) THEN 'automatic_same_concept_same_measure_core_different_breakdown'
  WHEN ((na = c AND nb = c) OR (na > c AND nb > c)) AND emb >= 0.965 AND lex >= 0.90 AND overlap >= 0.88 THEN 'automatic_same_concept_high_agreement_no_qualifier_conflict'
  WHEN ((na = c AND nb = c) OR (na > c AND nb > c)) AND emb >= 0.985 AND seq >= 0.965 AND overlap >= 0.90 THEN 'automatic_same_concept_near_text_identity_no_qualifier_conflict'
  WHEN (na = c) <> (nb = c) AND emb >= 0.84 AND containment >= 0.82 AND c >= 2 AND greatest(na, nb) - c <= 6 AND structural >= 0.80 THEN 'automatic_subtype'
  WHEN na - c = 1 AND nb - c = 1 AND coalesce(variant, false) AND emb >= 0.90 AND score >= 0.82 THEN 'automatic_learned_variant'
  WHEN na - c = 1 AND nb - c = 1 AND c >= 2 AND coalesce(dimension, false) AND emb >= 0.84 AND structural >= 0.72 THEN 'automatic_learned_dimension'
  WHEN c >= 2 AND na - c BETWEEN 1 AND 3 AND nb - c BETWEEN 1 AND 3 AND structural >= 0.86 AND emb >= 0.92 AND overlap >= 0.55 AND structural >= 0.94 THEN 'automatic_structural_aspect'
  WHEN score >= 0.78 AND emb >= 0.76 AND (lex >= 0.10 OR overlap >= 0.10) THEN 'automatic_related' END AS m
 FROM (SELECT *, CASE WHEN na - c = 1 AND nb - c = 1 THEN least(list_filter(tx, lambda t: NOT list_contains(ty, t))[1], list_filter(ty, lambda t: NOT list_contains(tx, t))[1]) END AS term_a,
   CASE WHEN na - c = 1 AND nb - c = 1 THEN greatest(list_filter(tx, lambda t: NOT list_contains(ty, t))[1], list_filter(ty, lambda t: NOT list_contains(tx, t))[1]) END AS term_b FROM {_BLEND_SQL}) p
 LEFT JOIN (SELECT term_a, term_b, support, ts, cs, variant, dimension FROM {_PATTERN_SQL}) q USING (term_a, term_b))))"""


@query(f"SELECT a, b, r AS relation, round(conf, 6) AS confidence, m AS method FROM {_RULES_SQL}")
def relation_rules(spark, sf_dir):
    return _cascaded(spark, sf_dir).select("a", "b", "relation", F.round("confidence", 6).alias("confidence"), "method")


_ROUTE_SQL = f"""(SELECT *, CASE WHEN coalesce(conf >= CASE r WHEN 'same_concept' THEN 0.85 WHEN 'synonym' THEN 0.88 WHEN 'subtype' THEN 0.85 WHEN 'different_aspects' THEN 0.88 ELSE 1.01 END, false) THEN 'auto'
 WHEN (a + b) % 5 <> 0 AND score >= 0.64 AND (coalesce(r IN ('same_concept', 'synonym', 'subtype', 'different_aspects'), false) OR CASE WHEN cross_domain THEN emb >= 0.84 AND score >= 0.76 AND greatest(lex, overlap) >= 0.08 ELSE emb >= 0.76 AND score >= 0.74 AND greatest(lex, overlap) >= 0.10 END) THEN 'review'
 WHEN (a + b) % 5 <> 0 AND score >= 0.64 THEN 'insufficient_specific_semantic_evidence' ELSE 'retrieval_only_candidate' END AS route FROM {_RULES_SQL})"""


@query(f"SELECT a, b, route FROM {_ROUTE_SQL}")
def relation_routing(spark, sf_dir):
    return _cascaded(spark, sf_dir).select("a", "b", "route")


@query(f"SELECT route, coalesce(r, 'none') AS relation, count(*) AS n FROM {_ROUTE_SQL} GROUP BY ALL")
def routing_counts(spark, sf_dir):
    return _cascaded(spark, sf_dir).groupBy("route", F.coalesce("relation", F.lit("none")).alias("relation")).agg(F.count("*").alias("n"))


@query(f"SELECT a, b, (k // 40)::BIGINT AS batch, (k % 40 + 1)::BIGINT AS pair_no FROM (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM {_ROUTE_SQL} WHERE route = 'review')")
def review_batches(spark, sf_dir):
    return R.batches(_cascaded(spark, sf_dir).filter("route = 'review'").select("a", "b"))


# replies to a third of the requests, of all relations and one that is none, from a fixed rule
_REPLY_SQL = "['same_concept', 'synonym', 'subtype', 'complementary', 'different_aspects', 'related', 'unrelated'][1 + (a * 3 + b) % 7] AS rrel, ((a * 7 + b) % 11) / 10.0::DOUBLE AS rconf"


def _made_replies(rows):
    a, b = F.col("a"), F.col("b")
    relation = F.get(F.array(*[F.lit(r) for r in ("same_concept", "synonym", "subtype", "complementary", "different_aspects", "related", "unrelated")]), ((a * 3 + b) % 7).cast("int"))
    some = rows.filter((F.col("route") == "review") & ((a + 2 * b) % 3 == 0))
    return some.select("request_id", relation.alias("reply_relation"), (((a * 7 + b) % 11) / F.lit(10.0)).alias("reply_confidence"))


@query(f"""SELECT a, b, relation, confidence, method, llm FROM (SELECT a, b, r AS relation, round(conf, 6) AS confidence, m AS method, false AS llm FROM {_ROUTE_SQL} WHERE route = 'auto'
 UNION ALL SELECT a, b, rrel, round(rconf, 6), 'llm_classification', true FROM (SELECT *, {_REPLY_SQL} FROM {_ROUTE_SQL} WHERE route = 'review') WHERE (a + 2 * b) % 3 = 0 AND rconf >= 0.70 AND rrel <> 'unrelated')""")
def final_relations(spark, sf_dir):
    """Automatic relations and accepted replies, the union that the graph is made of."""
    rows = cut(_cascaded(spark, sf_dir).withColumn("request_id", F.concat_ws("-", "a", "b")))
    final = R.final_relations(rows, R.judged_replies(rows.filter("route = 'review'"), _made_replies(rows)))
    return final.select("a", "b", "relation", F.round("confidence", 6).alias("confidence"), "method", "llm")


@query(f"SELECT a, b, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, a, b) - 1 AS nth FROM {_BLEND_SQL}")
def candidate_order(spark, sf_dir):
    """All candidates by score, the best first."""
    rows = _pairs(spark, sf_dir).select("a", "b", F.round("score", 6).alias("score"))
    return numbered(rows, F.col("score").desc(), F.col("a").asc(), F.col("b").asc())


def _end_to_end(spark, sf_dir):
    """Measures with vectors from retrieval to final relations, each step on the one before it."""
    measures = cut(I.measures(spark, sf_dir))
    vectors = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("domain"))
    vectors = vectors.join(measures.select("id"), "id", "left_semi")
    texts = measures.join(vectors.select("id"), "id", "left_semi").select("id", T.normalized_measure(F.col("measure")).alias("text"))
    similarity = lambda t: F.lit(0.40) + ((F.length("term_a") * 7 + F.length("term_b") * 11) % 60) / F.lit(100.0)  # noqa: E731  term vectors come from outside
    replies = _made_replies
    return R.related_measures(measures, vectors, texts, similarity, replies)


@query()
def relations_end_to_end(spark, sf_dir):
    """All pairs that retrieval gives, with their route, and the relation of those that get one."""
    routed, final = _end_to_end(spark, sf_dir)
    own = final.select("request_id", F.col("relation").alias("final_relation"), F.col("method").alias("final_method"))
    rows = routed.join(own, "request_id", "left")
    return rows.select("a", "b", F.array_join("sources", "|").alias("sources"), F.round("score", 6).alias("score"), "decision", "route", F.col("final_relation").alias("relation"), F.col("final_method").alias("method"))


# ---- replies, ids, graph ----


@query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 'synonym', 0.9::DOUBLE), (1, 1, 'subtype', 0.6), (3, 2, 'same_concept', 0.75)) AS v(batch, pair_no, relation, confidence)")
def reply_validate(spark, sf_dir):
    expected = spark.createDataFrame([(b, k) for b in range(4) for k in range(1, 4)], "batch long, pair_no long")
    return R.batch_replies(I.REPLIES.frame(spark), expected)


@query("SELECT event_id, CASE WHEN props IS NOT NULL THEN (json_extract(props, '$.k'))::BIGINT END AS k, (json_extract(props, '$.k'))::BIGINT % 2 = 0 AS hit FROM events")
def reply_join(spark, sf_dir):
    """Replies in JSON joined on their key: pending are those without an even one."""
    events = I.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    cache = events.filter("k % 2 = 0").select("event_id", F.lit(True).alias("found"))
    return events.join(cache, "event_id", "left").select("event_id", "k", F.when(F.col("k").isNotNull(), F.coalesce("found", F.lit(False))).alias("hit"))


@query(f"SELECT id, left(sha256(trim(measure)), 16) AS request_id, left(sha256('semrel-v6c-hybrid|model|llm|' || least(trim(measure), 'Births') || '|' || greatest(trim(measure), 'Births')), 20) AS pair_id FROM {_ALL_TEXTS}")
def request_ids(spark, sf_dir):
    return _all_texts(spark, sf_dir).select("id", T.request_id(F.col("measure")).alias("request_id"), T.pair_request_id(F.col("measure"), F.lit("Births"), "model").alias("pair_id"))


_RID = "left(sha256('semrel-v6c-hybrid|m|llm|' || least(measure1, measure2) || '|' || greatest(measure1, measure2)), 20)"
_DEDUP_SQL = f"(SELECT * EXCLUDE (k) FROM (SELECT *, {_RID} AS request_id, row_number() OVER (PARTITION BY {_RID} ORDER BY confidence DESC, seq) AS k FROM {I.RELATIONS.sql}) WHERE k = 1)"


def _relations(spark):
    rows = I.RELATIONS.frame(spark)
    return R.best_relations(rows.withColumn("request_id", T.pair_request_id(F.col("measure1"), F.col("measure2"), "m")))


@query(f"SELECT seq, request_id, relation, confidence FROM {_DEDUP_SQL}")
def relation_dedup(spark, sf_dir):
    return _relations(spark).select("seq", "request_id", "relation", "confidence")


@query(f"""SELECT state, reason, count(*) AS n FROM (SELECT s.state, CASE WHEN s.state <> 'disabled' AND route = 'review' AND (a + 2 * b) % 3 = 0 THEN CASE WHEN rconf < 0.70 THEN 'llm_below_confidence' ELSE 'llm_not_accepted' END
 WHEN s.state = 'limit' THEN 'llm_daily_limit_not_processed' WHEN s.state = 'disabled' THEN 'llm_disabled' WHEN r = 'related' THEN 'generic_related_requires_llm' ELSE 'no_safe_rule' END AS reason, *
 FROM (SELECT *, {_REPLY_SQL} FROM {_ROUTE_SQL}), (VALUES ('enabled'), ('limit'), ('disabled')) s(state) WHERE (a + b) % 5 <> 0 AND score >= 0.64 AND route <> 'auto')
 WHERE NOT (state <> 'disabled' AND route = 'review' AND (a + 2 * b) % 3 = 0 AND rconf >= 0.70 AND rrel <> 'unrelated') GROUP BY state, reason""")
def unresolved_reasons(spark, sf_dir):
    """Reasons with replies, with a limit that ended asking, and without asking."""
    rows = cut(_cascaded(spark, sf_dir).withColumn("request_id", F.concat_ws("-", "a", "b")))
    semantic = R.decide_candidates(rows).filter("decision = 'semantic_candidate'")
    judged = R.judged_replies(rows.filter("route = 'review'"), _made_replies(rows))
    final = R.final_relations(rows, judged)
    auto = rows.filter("route = 'auto'")
    made = [R.unresolved(semantic, final, judged, True).withColumn("state", F.lit("enabled")), R.unresolved(semantic, final, judged, True, True).withColumn("state", F.lit("limit")), R.unresolved(semantic, auto, judged.limit(0)).withColumn("state", F.lit("disabled"))]
    return made[0].unionByName(made[1]).unionByName(made[2]).groupBy("state", "reason").agg(F.count("*").alias("n"))


_NODES_SQL = f"(SELECT row_number() OVER (ORDER BY label) - 1 AS id, label FROM (SELECT measure1 AS label FROM {_DEDUP_SQL} UNION SELECT measure2 FROM {_DEDUP_SQL}))"


def _nodes(spark):
    domains = spark.createDataFrame([("Births", "population"), ("Deaths", "population")], "measure string, domain string")
    return R.graph_nodes(_relations(spark), domains)


@query(f"SELECT id, label, CASE WHEN label IN ('Births', 'Deaths') THEN 'population' END AS domain FROM {_NODES_SQL}")
def graph_nodes(spark, sf_dir):
    return _nodes(spark)


@query(f"SELECT s.id AS source, t.id AS target, relation, confidence, method FROM {_DEDUP_SQL} r JOIN {_NODES_SQL} s ON s.label = measure1 JOIN {_NODES_SQL} t ON t.label = measure2")
def graph_edges(spark, sf_dir):
    return R.graph_edges(_relations(spark), _nodes(spark))


@query(f"SELECT relation, count(*) AS n, round(count(*) / (SELECT count(*) FROM {_DEDUP_SQL})::DOUBLE, 6) AS share, count(*) / (SELECT count(*) FROM {_DEDUP_SQL})::DOUBLE > 0.60 AS dominant FROM {_DEDUP_SQL} GROUP BY relation")
def relation_balance(spark, sf_dir):
    return R.relation_shares(_relations(spark)).withColumn("share", F.round("share", 6))


# ---- evaluation ----

_GOLD_SQL = "(SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred FROM labels)"
_MATRIX_SQL = f"(SELECT gold, pred, (SELECT count(*) FROM {_GOLD_SQL} x WHERE x.gold = m.gold AND x.pred = m.pred) AS n FROM (SELECT g.l AS gold, p.l AS pred FROM (VALUES ('0'), ('1'), ('2')) g(l), (VALUES ('0'), ('1'), ('2')) p(l)) m)"
_METRICS_SQL = f"""(SELECT label, support, tp, predicted - tp AS fp, support - tp AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM (
 SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END::DOUBLE AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END::DOUBLE AS r FROM (SELECT l AS label,
 (SELECT sum(n) FROM {_MATRIX_SQL} WHERE gold = l)::BIGINT AS support, (SELECT sum(n) FROM {_MATRIX_SQL} WHERE pred = l)::BIGINT AS predicted, (SELECT sum(n) FROM {_MATRIX_SQL} WHERE gold = l AND pred = l)::BIGINT AS tp FROM (VALUES ('0'), ('1'), ('2')) v(l))))"""


def _matrix(spark, sf_dir):
    rows = I.table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))
    return E.confusion_matrix(rows, ["0", "1", "2"])


@query(f"SELECT * FROM {_MATRIX_SQL}")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"SELECT * FROM {_METRICS_SQL}")
def class_metrics(spark, sf_dir):
    return E.class_metrics(_matrix(spark, sf_dir))


@query(f"SELECT round((SELECT sum(n) FROM {_MATRIX_SQL} WHERE gold = pred) / (SELECT sum(n) FROM {_MATRIX_SQL})::DOUBLE, 4) AS accuracy, round((SELECT avg(f1) FROM {_METRICS_SQL} WHERE support > 0), 4) AS macro_f1, (SELECT sum(n) FROM {_MATRIX_SQL})::BIGINT AS n")
def macro_f1(spark, sf_dir):
    return E.summary(_matrix(spark, sf_dir), supported_only=True)


_BUCKET_ROWS = "(SELECT (value - lo) / (hi - lo) AS score, event_type = 'click' OR event_id % 3 = 0 AS correct, event_type FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events))"


def _scored_events(spark, sf_dir):
    ev = I.table(spark, sf_dir, "events")
    span = ev.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ev.join(F.broadcast(span)).select(((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"), ((F.col("event_type") == "click") | (F.col("event_id") % 3 == 0)).alias("correct"), "event_type")


@query("SELECT b.bucket, count(s.score) AS n, count(*) FILTER (s.correct) AS correct, round(count(*) FILTER (s.correct) / nullif(count(s.score), 0)::DOUBLE, 4) AS accuracy FROM (VALUES "
       + ", ".join(f"('{a:g}-{min(b, 1):g}', {a}::DOUBLE, {b}::DOUBLE)" for a, b in E.BUCKETS) + f") b(bucket, low, high) LEFT JOIN {_BUCKET_ROWS} s ON s.score >= b.low AND s.score < b.high GROUP BY b.bucket")
def score_buckets(spark, sf_dir):
    return E.bucket_accuracy(_scored_events(spark, sf_dir))


@query(f"SELECT event_type, count(*) AS n, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 4) AS accuracy FROM {_BUCKET_ROWS} GROUP BY event_type")
def method_accuracy(spark, sf_dir):
    return E.group_accuracy(_scored_events(spark, sf_dir), "event_type")


@query("SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 100")
def sample_random(spark, sf_dir):
    return E.simple_sample(I.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT lang, doc_id, n < 25 AS short FROM (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) AS k FROM documents WHERE lang IS NOT NULL) WHERE k <= 25")
def sample_stratified(spark, sf_dir):
    return E.stratified_sample(I.table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("lang", "doc_id"), "lang", "doc_id", 25).select("lang", "doc_id", "short")


@query("SELECT doc_id, CASE WHEN k <= n // 3 THEN 'low' WHEN k <= 2 * (n // 3) THEN 'middle' ELSE 'high' END AS tertile FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) AS k, count(*) OVER () AS n FROM documents)")
def sample_tertile(spark, sf_dir):
    return E.tertiles(I.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "tertile")


@query("""WITH t AS (SELECT doc_id, CASE WHEN k <= n // 3 THEN 'low' WHEN k <= 2 * (n // 3) THEN 'middle' ELSE 'high' END AS tertile FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) AS k, count(*) OVER () AS n FROM documents))
 SELECT doc_id, tertile, n < 50 AS short FROM (SELECT *, count(*) OVER (PARTITION BY tertile) AS n, row_number() OVER (PARTITION BY tertile ORDER BY sha256('42|' || doc_id), doc_id) AS k FROM t) WHERE k <= 50""")
def sample_tertile_draw(spark, sf_dir):
    """Fifty of each tertile."""
    return E.tertile_sample(I.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "tertile", "short")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('42|' || event_id), event_id) AS k FROM events) WHERE k <= 10")
def sample_per_method(spark, sf_dir):
    """Ten of each method at most, for the judge."""
    return E.stratified_sample(I.table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 10).select("event_type", "event_id")


@query("SELECT source, count(*) AS n_rows, array_to_string(list(doc_id ORDER BY doc_id)[1:10], '|') AS examples FROM documents GROUP BY source")
def first_examples(spark, sf_dir):
    """The first ten examples of each group of a report."""
    rows = E.first_examples(I.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    return rows.select("source", "n_rows", F.array_join(F.transform("examples", lambda x: x.cast("string")), "|").alias("examples"))


@query("SELECT doc_id, gold, pred, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS nth FROM (SELECT doc_id, quality::VARCHAR AS gold, toxic::VARCHAR AS pred, (doc_id * 37 % 101) / 101.0::DOUBLE AS score FROM labels) WHERE gold <> pred")
def error_order(spark, sf_dir):
    """Wrong rows, the most confident first."""
    rows = I.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"), ((F.col("doc_id") * 37 % 101) / F.lit(101.0)).alias("score"))
    return E.primary_errors(rows, "doc_id")


@query(f"SELECT seq, relation FROM (SELECT *, row_number() OVER (PARTITION BY least(measure1, measure2), greatest(measure1, measure2) ORDER BY seq) AS k FROM {I.RELATIONS.sql} WHERE relation IN ('same_concept', 'synonym', 'subtype', 'complementary', 'different_aspects')) WHERE k = 1")
def eval_eligible(spark, sf_dir):
    """Relations that an evaluation sample is drawn from."""
    return E.eligible(I.RELATIONS.frame(spark)).select("seq", "relation")


@query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS k, 100 // (SELECT count(DISTINCT source) FROM documents) AS m FROM documents),
 f AS (SELECT doc_id, source FROM s WHERE k <= m) SELECT * FROM f UNION ALL (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY sha256('43|' || doc_id), doc_id LIMIT (SELECT 100 - count(*) FROM f))""")
def sample_balanced(spark, sf_dir):
    return E.balanced_sample(I.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source")


@query(f"SELECT least(measure1, measure2) AS measure1, greatest(measure1, measure2) AS measure2, count(*) AS n FROM {I.RELATIONS.sql} GROUP BY 1, 2 HAVING count(*) > 1")
def check_duplicates(spark, sf_dir):
    return E.duplicate_pairs(I.RELATIONS.frame(spark))


@query(f"SELECT seq, relation FROM {I.RELATIONS.sql} WHERE relation NOT IN ('" + "','".join(R.RELATIONS) + "')")
def check_labels(spark, sf_dir):
    known = spark.createDataFrame([(r,) for r in R.RELATIONS], "relation string")
    return I.RELATIONS.frame(spark).join(known, "relation", "left_anti").select("seq", "relation")


@query("SELECT * FROM (VALUES (0::BIGINT), (1), (8)) AS v(seq)")
def check_signatures(spark, sf_dir):
    return E.signature_violations(I.RELATIONS.frame(spark)).select("seq")


@query(f"SELECT seq FROM {I.RELATIONS.sql} WHERE relation = 'subtype' AND len(list_filter({tokens_sql('measure1', False)}, lambda t: NOT list_contains({tokens_sql('measure2', False)}, t))) > 0 AND len(list_filter({tokens_sql('measure2', False)}, lambda t: NOT list_contains({tokens_sql('measure1', False)}, t))) > 0")
def check_containment(spark, sf_dir):
    return E.containment_violations(I.RELATIONS.frame(spark)).select("seq")


# ---- replies, sinks and diagnostics ----

_DOMAIN_REPLIES = I.Rows(
    "request_id string, reply string",
    [("r1", '{"domain": "energy", "confidence": 0.8}'), ("r2", 'text {"domain": "none", "confidence": 0.8}'), ("r3", '{"domain": "energy", "confidence": "x"}'), ("r4", '{"domain": "transport", "confidence": 1}'), ("r5", '{"domain": "energy", "confidence": 1.2}'), ("r6", "[]")],
)


@query("SELECT * FROM (VALUES ('r1', 'energy', 0.8::DOUBLE), ('r4', 'transport', 1.0::DOUBLE)) AS v(request_id, domain, confidence)")
def domain_reply_validate(spark, sf_dir):
    return P.domain_replies(_DOMAIN_REPLIES.frame(spark), I.LEXICON.frame(spark).select("domain").distinct())


@query("""SELECT DISTINCT event_type, CASE WHEN event_type LIKE '%c%' THEN 'daily_limit' WHEN event_type LIKE '%v%' THEN 'retry' ELSE 'unknown' END AS error FROM events""")
def error_classes(spark, sf_dir):
    said = F.when(F.col("event_type").contains("c"), "Limit PER DAY").when(F.col("event_type").contains("v"), "429 Too many requests").otherwise("broken")
    return I.table(spark, sf_dir, "events").select("event_type", P.error_class(said).alias("error")).distinct()


@query(f"SELECT tab, string_agg(dimension || '=' || vs, ';' ORDER BY dimension) AS dimensions FROM (SELECT tab, dimension, string_agg(value, '|' ORDER BY value) AS vs FROM {VALUES_SQL} GROUP BY tab, dimension) GROUP BY tab")
def nested_values(spark, sf_dir):
    entries = F.transform(F.map_entries("dimensions"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return K.nested_values(values(spark, sf_dir)).select(F.col("table").alias("tab"), F.array_join(entries, ";").alias("dimensions"))


@query(f"SELECT tab, count(DISTINCT dimension) AS n_dimensions, count(*) AS n_values, count(DISTINCT value) AS n_distinct FROM {VALUES_SQL} GROUP BY tab")
def cell_statistics(spark, sf_dir):
    v = values(spark, sf_dir).withColumnRenamed("table", "tab")
    return v.groupBy("tab").agg(F.countDistinct("dimension").alias("n_dimensions"), F.count("*").alias("n_values"), F.countDistinct("value").alias("n_distinct"))


_SECOND_SQL = "(SELECT l.quality::VARCHAR AS gold, CASE WHEN l.doc_id % 3 = 0 THEN l.toxic::VARCHAR END AS gold2, l.toxic::VARCHAR AS pred, CASE WHEN l.doc_id % 2 = 0 THEN l.quality::VARCHAR END AS pred2 FROM labels l)"


@query(f"""SELECT count(*) AS n, count(pred2) AS n_secondary, count(gold2) AS n_gold_secondary, count(*) FILTER (pred2 = gold2) AS n_exact, count(*) FILTER (pred <> gold AND pred2 = gold) AS n_recovered,
 round(count(pred2) / count(*)::DOUBLE, 4) AS rate FROM {_SECOND_SQL}""")
def secondary_diagnostics(spark, sf_dir):
    rows = I.table(spark, sf_dir, "labels")
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    return E.secondary_diagnostics(rows.select(q.alias("gold"), F.when(F.col("doc_id") % 3 == 0, t).alias("gold_secondary"), t.alias("pred"), F.when(F.col("doc_id") % 2 == 0, q).alias("pred_secondary")))


@query("SELECT count(*) FILTER (quality = 1) AS agree, count(*) FILTER (quality = 0) AS disagree, round(avg(quality), 4) AS agreement FROM labels")
def judge_agreement(spark, sf_dir):
    return E.agreement(I.table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "agree").when(F.col("quality") == 0, "disagree").alias("verdict")))


@query("SELECT h.table_name, list_aggregate(list_sort(list(DISTINCT h.header)), 'string_agg', '|') AS intervals FROM (SELECT tab AS table_name, trim(header) AS header FROM " + I.HEADERS.sql + f" WHERE {_TIME_SQL}) h GROUP BY h.table_name")
def time_headers(spark, sf_dir):
    found = V.time_headers(I.HEADERS.frame(spark).withColumnRenamed("tab", "table"))
    return found.select(F.col("table").alias("table_name"), F.array_join("intervals", "|").alias("intervals"))


@query("SELECT DISTINCT 'b' || (k // 40) AS batch, true AS complete FROM (SELECT row_number() OVER () - 1 AS k FROM " + I.MEASURES_SQL + ")")
def batch_prompts(spark, sf_dir):
    m = I.measures(spark, sf_dir)
    numbered = R.batches(m.select(F.col("id").alias("a"), F.col("measure").alias("b"))).select("batch", "pair_no", F.col("b").alias("measure1"), F.col("b").alias("measure2"))
    made = P.batch_prompts(numbered, R.RELATIONS)
    return made.select(F.concat(F.lit("b"), F.col("batch").cast("string")).alias("batch"), F.col("prompt").contains("\n1. A: ").alias("complete"))
