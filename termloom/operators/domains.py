"""Domains of measures: keyword scores, calibration, vector scores and the blended decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.functions import text as T

# --- fixed values: weights and thresholds of the decision ---
DICTIONARY_WEIGHT, VECTOR_WEIGHT = 0.4, 0.6
MIN_RAW_SCORE = 3
CLEAR = {"dictionary": (0.55, 0.15), "vector": (0.45, 0.08)}
SECOND_MIN_SCORE, SECOND_MAX_GAP = 0.35, 0.15
CALIBRATION_HITS, CALIBRATION_RANK = 15, 0.95


def keyword_scores(measures: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(measure, domain, domain_idx, raw, words): summed weights of the words found, each once.

    ``lexicon`` is (domain, domain_idx, word, weight). Only words whose first letters occur in a
    text's words are tried, by an equi-join on them, so no text meets the whole lexicon.
    """
    text = F.concat(F.lit(" "), F.lower("measure"), F.lit(" "))
    words = lexicon.select("domain", "domain_idx", F.lower("word").alias("word"), "weight", T.keyword_pattern(F.col("word")).alias("pattern"))
    words = words.withColumn("key", F.regexp_extract("word", r"([a-z]+|[^a-z]+)", 1))
    keys = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-z]+|[^a-z]+)"), 1))).alias("key")
    latin = words.filter(F.col("key").rlike("^[a-z]"))
    hits = measures.select("measure", text.alias("text"), keys).join(latin, "key").filter(F.rlike("text", "pattern"))
    odd = words.filter(~F.col("key").rlike("^[a-z]"))  # such words begin with no letter: few, and tried on all
    hits = hits.select("measure", "domain", "domain_idx", "word", "weight").unionByName(
        measures.select("measure", text.alias("text")).join(odd, F.rlike("text", "pattern")).select("measure", "domain", "domain_idx", "word", "weight")
    )
    return hits.distinct().groupBy("measure", "domain", "domain_idx").agg(F.sum("weight").cast("long").alias("raw"), F.sort_array(F.collect_set("word")).alias("words"))


def raw_scores(scores: DataFrame) -> DataFrame:
    """Scores below the minimum are none."""
    return scores.filter(F.col("raw") >= MIN_RAW_SCORE)


def calibration(scores: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(domain, cap): the value at 95 % of the ordered scores if there are enough, else the sum of weights.

    All scores above 0 count, also those below the minimum. Equal scores are counted first, so a
    domain's window holds its different scores and not its measures.
    """
    budget = lexicon.groupBy("domain").agg(F.sum("weight").cast("double").alias("budget"))
    times = scores.filter("raw > 0").groupBy("domain", "raw").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("domain").orderBy("raw"))
    ranked = times.withColumn("k", upto).withColumn("n", F.sum("times").over(Window.partitionBy("domain")))
    at = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(CALIBRATION_RANK)))
    level = ranked.filter((F.col("n") >= CALIBRATION_HITS) & (F.col("k") >= at)).groupBy("domain").agg(F.min("raw").cast("double").alias("level"))
    cap = F.coalesce("level", "budget")
    return budget.join(level, "domain", "left").select("domain", F.when(cap <= 0, 1.0).otherwise(cap).alias("cap"))


def dictionary_scores(measures: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(measure, domain, domain_idx, score): normalized scores of the domains that have one."""
    raw = keyword_scores(measures, lexicon)
    caps = calibration(raw, lexicon)
    return raw_scores(raw).join(F.broadcast(caps), "domain").select("measure", "domain", "domain_idx", F.least(F.col("raw") / F.col("cap"), F.lit(1.0)).alias("score"))


def vector_scores(measures: DataFrame, domains: DataFrame) -> DataFrame:
    """(measure, domain, domain_idx, score): clamped cosine to each domain's vector.

    ``domains`` (domain, domain_idx, vec) is a short fixed list, so every measure meets each.
    """
    return measures.join(F.broadcast(domains.withColumnRenamed("vec", "domain_vec"))).select("measure", "domain", "domain_idx", S.clamp(S.dot(F.col("vec"), F.col("domain_vec"))).alias("score"))


def _best_two(scores: DataFrame, score: str, name: str) -> DataFrame:
    """Best domain, its score and its lead; a domain listed earlier wins a tie."""
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), "domain_idx", "domain"))), 1, 2)
    two = scores.groupBy("measure").agg(top.alias("t"))
    return two.select("measure", F.get("t", F.lit(0))["domain"].alias(f"{name}_best"), (-F.get("t", F.lit(0))["s"]).alias(f"{name}_score"), (F.get("t", F.lit(1))["s"] - F.get("t", F.lit(0))["s"]).alias(f"{name}_margin"))


def decide(signals: DataFrame) -> DataFrame:
    """Decision of (measure, domain, domain_idx, dictionary, vector), a row for every domain.

    Gives domain (null if review is needed), final_domain, confidence, needs_review, reason and
    secondary_domain. A measure without keywords has the first listed domain as dictionary best.
    """
    blended = signals.withColumn("blend", DICTIONARY_WEIGHT * F.col("dictionary") + VECTOR_WEIGHT * F.col("vector"))
    best = _best_two(blended, "dictionary", "dictionary").join(_best_two(blended, "vector", "vector"), "measure").join(_best_two(blended, "blend", "blend"), "measure")
    agree = F.col("dictionary_best") == F.col("vector_best")
    d = (F.col("dictionary_score") >= CLEAR["dictionary"][0]) & (F.col("dictionary_margin") >= CLEAR["dictionary"][1])
    v = (F.col("vector_score") >= CLEAR["vector"][0]) & (F.col("vector_margin") >= CLEAR["vector"][1])
    final = F.when(agree, F.col("dictionary_best")).when(d & v, F.col("blend_best")).when(v, F.col("vector_best")).when(d, F.col("dictionary_best")).otherwise(F.col("blend_best"))
    reason = (
        F.when(agree & (d | v), "dictionary_embedding_agree")
        .when(agree, "agreement_but_signals_not_clear")
        .when(d & v, "clear_dictionary_clear_embedding_conflict")
        .when(v, "clear_embedding_dictionary_not_clear")
        .when(d, "clear_dictionary_embedding_not_clear")
        .otherwise("neither_signal_clear")
    )
    review = F.when(agree, ~(d | v)).otherwise(d == v)
    chosen = best.withColumn("final_domain", final).withColumn("reason", reason).withColumn("needs_review", review)
    rows = blended.join(chosen.select("measure", "final_domain", "reason", "needs_review"), "measure")
    per = rows.groupBy("measure", "final_domain", "reason", "needs_review").agg(
        F.max(F.when(F.col("domain") == F.col("final_domain"), F.col("blend"))).alias("confidence"),
        F.sort_array(F.collect_list(F.when(F.col("domain") != F.col("final_domain"), F.struct((-F.col("blend")).alias("s"), "domain_idx", "domain")))).alias("others"),
    )
    near = F.filter("others", lambda o: (-o["s"] >= SECOND_MIN_SCORE) & (F.col("confidence") + o["s"] <= SECOND_MAX_GAP))
    return per.select(
        "measure", F.when(~F.col("needs_review"), F.col("final_domain")).alias("domain"), "final_domain", "confidence", "needs_review", "reason",
        F.get(near, F.lit(0))["domain"].alias("secondary_domain"),
    )


def signals(measures: DataFrame, lexicon: DataFrame, domains: DataFrame) -> DataFrame:
    """Both scores for every measure and domain."""
    dictionary = dictionary_scores(measures, lexicon).select("measure", "domain", F.col("score").alias("dictionary"))
    vector = vector_scores(measures, domains).withColumnRenamed("score", "vector")
    return vector.join(dictionary, ["measure", "domain"], "left").withColumn("dictionary", F.coalesce("dictionary", F.lit(0.0)))


def known_domains(mapping: DataFrame, measures: DataFrame) -> DataFrame:
    """The rows of a mapping (measure, domain) whose measure is one of ``measures``."""
    return mapping.join(measures.select("measure").distinct(), "measure", "left_semi")


def with_replies(decided: DataFrame, replies: DataFrame) -> DataFrame:
    """Decisions under review take the domain of a valid reply (request_id, domain, confidence)."""
    own = decided.withColumn("request_id", T.request_id(F.col("measure")))
    got = replies.select("request_id", F.col("domain").alias("reply_domain"), F.col("confidence").alias("reply_confidence"))
    answered = F.col("needs_review") & F.col("reply_domain").isNotNull()
    joined = own.join(got, "request_id", "left")
    return joined.select(
        "measure", "request_id", F.when(answered, F.col("reply_domain")).otherwise(F.col("domain")).alias("domain"),
        F.when(answered, F.col("reply_confidence")).otherwise(F.col("confidence")).alias("confidence"), "secondary_domain", "reason",
        F.when(answered, F.lit("reply")).when(F.col("needs_review"), F.lit("unresolved")).otherwise(F.lit("blended")).alias("method"),
    )
