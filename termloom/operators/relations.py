"""Relations of measures: pair features, learned patterns, the rule cascade, routing, replies, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.functions import text as T
from termloom.operators import neighbours as N
from termloom.operators.numbering import numbered
from termloom.sources.shared import cut

# --- fixed values: relation labels and thresholds ---
RELATIONS = ("same_concept", "synonym", "subtype", "complementary", "different_aspects", "related")
AUTO_ACCEPT = {"same_concept": 0.85, "synonym": 0.88, "subtype": 0.85, "different_aspects": 0.88, "complementary": 1.01, "related": 1.01}
SEMANTIC_SCORE = 0.64
REPLY_CONFIDENCE = 0.70
BATCH = 40


def measure_features(measures: DataFrame) -> DataFrame:
    """(id, measure, norm, toks, core, core_toks, breakdown, quals)."""
    m = F.col("measure")
    return measures.select(
        "id", "measure", T.normalized_measure(m).alias("norm"), T.measure_tokens(m).alias("toks"), T.measure_core(m).alias("core"),
        T.measure_tokens(T.measure_core(m)).alias("core_toks"), T.has_breakdown(m).alias("breakdown"), T.qualifiers(m).alias("quals"),
    )


def with_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with both sides' features as structs ``x`` and ``y``."""
    side = F.struct(*[c for c in features.columns if c != "id"])
    left = features.select(F.col("id").alias("a"), side.alias("x"))
    right = features.select(F.col("id").alias("b"), side.alias("y"))
    return pairs.join(left, "a").join(right, "b")


def token_features(pairs: DataFrame) -> DataFrame:
    """The set similarities of ``with_features`` rows."""
    a, b = F.col("x.toks"), F.col("y.toks")
    diff = S.difference(a, b)
    return pairs.select("*", S.overlap(a, b).alias("overlap"), S.containment(a, b).alias("containment"), S.structural(a, b).alias("structural"), diff.alias("diff"), T.qualifier_conflict(F.col("x.quals"), F.col("y.quals")).alias("conflict"))


def decide_candidates(pairs: DataFrame) -> DataFrame:
    """``decision`` of (sources, score): semantic or retrieval only."""
    semantic = F.array_contains("sources", "embedding_knn") & (F.col("score") >= SEMANTIC_SCORE)
    return pairs.withColumn("decision", F.when(semantic, "semantic_candidate").otherwise("retrieval_only"))


def substitutions(pairs: DataFrame) -> DataFrame:
    """Examples of one token changed for another: (term_a, term_b, context, emb, structural)."""
    d = F.col("diff")
    one = (F.size(d["common"]) >= 2) & (F.size(d["only_a"]) == 1) & (F.size(d["only_b"]) == 1)
    words = ~F.get(d["only_a"], F.lit(0)).rlike(r"^\d+$") & ~F.get(d["only_b"], F.lit(0)).rlike(r"^\d+$")
    return pairs.filter(one).filter(words & ~F.col("conflict")).select(
        F.least(F.get(d["only_a"], F.lit(0)), F.get(d["only_b"], F.lit(0))).alias("term_a"), F.greatest(F.get(d["only_a"], F.lit(0)), F.get(d["only_b"], F.lit(0))).alias("term_b"),
        F.array_sort(d["common"]).alias("context"), "emb", "structural", "a", "b",
    )


def learned_patterns(examples: DataFrame, term_similarity: DataFrame) -> DataFrame:
    """Support, contexts, similarities, evidence and what each substitution is learned as.

    The mean Jaccard of an example's contexts comes from counts of equal contexts: different
    contexts meet once, weighted, not each pair of examples.
    """
    key = ["term_a", "term_b"]
    contexts = examples.groupBy(*key, "context").agg(F.count("*").alias("m"))
    base = examples.groupBy(*key).agg(
        F.count("*").alias("support"), F.countDistinct("context").alias("unique_contexts"), F.avg("emb").alias("avg_emb"),
        F.count_if((F.col("structural") >= 0.72) & (F.col("emb") >= 0.84)).alias("valid_examples"),
    )
    base = base.filter("support >= 2").join(term_similarity, key).filter("term_similarity BETWEEN 0.45 AND 0.985")
    x = contexts.select(*key, F.col("context").alias("cx"), F.col("m").alias("mx"))
    y = contexts.select(*key, F.col("context").alias("cy"), F.col("m").alias("my"))
    unlike = x.join(y, key).filter("cx < cy").select(*key, (F.col("mx") * F.col("my")).alias("w"), S.overlap(F.col("cx"), F.col("cy")).alias("j"))
    alike = contexts.select(*key, (F.col("m") * (F.col("m") - 1) / 2).alias("w"), F.lit(1.0).alias("j"))
    mean = unlike.unionByName(alike).groupBy(*key).agg((F.sum(F.col("w") * F.col("j")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("context_similarity"))
    out = base.join(mean, key, "left").withColumn("context_similarity", F.coalesce("context_similarity", F.lit(0.0)))
    evidence = 0.35 * F.least(F.col("support") / 10.0, F.lit(1.0)) + 0.25 * F.least(F.col("unique_contexts") / 5.0, F.lit(1.0)) + 0.20 * F.col("context_similarity") + 0.20 * F.col("term_similarity")
    consolidated = (F.col("support") >= 2) & (F.col("unique_contexts") >= 2) & (F.col("context_similarity") >= 0.72)
    out = out.withColumn("evidence_score", evidence).withColumn("consolidated", consolidated)
    variant = F.col("consolidated") & (F.col("support") >= 3) & F.col("term_similarity").between(0.84, 0.985) & (F.col("context_similarity") >= 0.82) & (F.col("avg_emb") >= 0.90)
    dimension = (F.col("valid_examples") >= 2) & (F.col("unique_contexts") >= 2)
    return out.withColumn("variant", variant).withColumn("dimension", dimension)


def _rule(relation: str, when: Column, confidence: Column, method: Column) -> Column:
    return F.when(when, F.struct(F.lit(relation).alias("relation"), confidence.cast("double").alias("confidence"), method.alias("method")))


def cascade(pairs: DataFrame) -> DataFrame:
    """``relation``, ``confidence`` and ``method`` of the first rule that fires, or nulls.

    Pairs carry x, y, the token features, emb, lex, seq, score, and the pattern of their changed
    tokens: support, term_similarity, context_similarity, variant, dimension (null if none).
    """
    x, y, d = F.col("x"), F.col("y"), F.col("diff")
    emb, over, struct = F.col("emb"), F.col("overlap"), F.col("structural")
    common, only_a, only_b = F.size(d["common"]), F.size(d["only_a"]), F.size(d["only_b"])
    free = ~F.col("conflict")
    # the core of both without their breakdowns
    n_core = F.size(x["core_toks"])
    same_core = (x["core"] != "") & (x["core"] == y["core"]) & (x["breakdown"] | y["breakdown"]) & (((n_core >= 2) & (emb >= 0.80)) | ((n_core == 1) & (F.length(x["core"]) >= 5) & (emb >= 0.88)))
    equal_tokens = (only_a == 0) & (only_b == 0)
    inside = ~equal_tokens & ((only_a == 0) | (only_b == 0))

    def same(reason: str) -> Column:
        return F.lit(f"automatic_same_concept_{reason}")

    one_changed = (only_a == 1) & (only_b == 1)
    support = F.coalesce("support", F.lit(0))
    added = F.greatest(only_a, only_b)
    rules = [
        _rule("same_concept", x["norm"] == y["norm"], F.lit(0.999), same("normalized_text_identity")),
        _rule("same_concept", equal_tokens & (emb >= 0.965), F.lit(0.995), same("token_reorder")),
        _rule("same_concept", same_core, F.when(x["breakdown"] & y["breakdown"], F.lit(0.840)).otherwise(F.lit(0.820)), same("same_measure_core_different_breakdown")),
        _rule("same_concept", free & ~inside & (emb >= 0.965) & (F.col("lex") >= 0.90) & (over >= 0.88), F.lit(0.985), same("high_agreement_no_qualifier_conflict")),
        _rule("same_concept", free & ~inside & (emb >= 0.985) & (F.col("seq") >= 0.965) & (over >= 0.90), F.lit(0.990), same("near_text_identity_no_qualifier_conflict")),
        _rule(
            "subtype",
            inside & (F.size(x["toks"]) > 0) & (F.size(y["toks"]) > 0) & (emb >= 0.84) & (F.col("containment") >= 0.82) & (common >= 2) & (added <= 6) & free & (struct >= 0.80),
            F.least(F.lit(0.95), 0.72 + 0.10 * F.col("containment") + 0.08 * emb + 0.05 * struct), F.lit("automatic_subtype"),
        ),
        _rule(
            "synonym", one_changed & F.coalesce("variant", F.lit(False)) & (emb >= 0.90) & (F.col("score") >= 0.82),
            F.least(F.lit(0.97), 0.78 + 0.08 * F.least(F.col("term_similarity"), F.lit(1.0)) + 0.06 * F.least(F.col("context_similarity"), F.lit(1.0)) + 0.03 * F.least(support / 10.0, F.lit(1.0))), F.lit("automatic_learned_variant"),
        ),
        _rule(
            "different_aspects", one_changed & (common >= 2) & F.coalesce("dimension", F.lit(False)) & (emb >= 0.84) & (struct >= 0.72),
            F.least(F.lit(0.96), 0.72 + 0.10 * emb + 0.07 * struct + 0.04 * F.least(support / 8.0, F.lit(1.0))), F.lit("automatic_learned_dimension"),
        ),
        _rule(
            "different_aspects", (common >= 2) & only_a.between(1, 3) & only_b.between(1, 3) & free & (struct >= 0.86) & (emb >= 0.92) & (over >= 0.55) & ((one_changed & F.coalesce("dimension", F.lit(False))) | (struct >= 0.94)),
            F.least(F.lit(0.95), 0.60 + 0.18 * emb + 0.12 * struct + 0.08 * over), F.lit("automatic_structural_aspect"),
        ),
        _rule(
            "related", (F.col("score") >= 0.78) & (emb >= 0.76) & ((F.col("lex") >= 0.10) | (over >= 0.10)),
            F.least(F.lit(0.88), 0.50 + 0.23 * F.col("score") + 0.14 * emb + 0.05 * F.greatest(F.col("lex"), over)), F.lit("automatic_related"),
        ),
    ]
    return pairs.withColumn("rule", F.coalesce(*rules)).select("*", F.col("rule.relation").alias("relation"), F.col("rule.confidence").alias("confidence"), F.col("rule.method").alias("method")).drop("rule")


def worth_review(relation: Column, emb: Column, score: Column, lexical: Column, cross_domain: Column) -> Column:
    """Enough evidence to ask for a reply."""
    specific = F.coalesce(relation.isin("same_concept", "synonym", "subtype", "different_aspects"), F.lit(False))
    across = (emb >= 0.84) & (score >= 0.76) & (lexical >= 0.08)
    within = (emb >= 0.76) & (score >= 0.74) & (lexical >= 0.10)
    return specific | F.when(cross_domain, across).otherwise(within)


def route(pairs: DataFrame) -> DataFrame:
    """``route``: auto, review, or why a pair stays a candidate only."""
    accept = F.create_map(*[F.lit(v) for kv in AUTO_ACCEPT.items() for v in kv])
    auto = F.coalesce(F.col("confidence") >= accept[F.col("relation")], F.lit(False))
    semantic = F.array_contains("sources", "embedding_knn") & (F.col("score") >= SEMANTIC_SCORE)
    review = semantic & worth_review(F.col("relation"), F.col("emb"), F.col("score"), F.greatest("lex", "overlap"), F.col("cross_domain"))
    return pairs.withColumn("route", F.when(auto, "auto").when(review, "review").when(semantic, "insufficient_specific_semantic_evidence").otherwise("retrieval_only_candidate"))


def batches(pending: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, pair_no) of pairs (a, b), ``size`` to a batch, numbered from 1 in each."""
    n = F.col("__n")
    return numbered(pending, "a", "b", name="__n").select(*pending.columns, F.floor(n / size).cast("long").alias("batch"), (n % size + 1).cast("long").alias("pair_no"))


def batch_replies(replies: DataFrame, expected: DataFrame) -> DataFrame:
    """Valid items of batch replies (batch, reply): the first of each expected pair number."""
    schema = "results array<struct<pair_id: string, relation: string, confidence: string>>"
    parsed = replies.select("batch", F.from_json(T.json_payload(F.col("reply")), schema).alias("j"))
    items = parsed.select("batch", F.posexplode("j.results").alias("at", "item"))
    typed = items.select("batch", "at", F.col("item.pair_id").try_cast("long").alias("pair_no"), F.col("item.relation").alias("relation"), F.col("item.confidence").try_cast("double").alias("confidence"))
    good = typed.filter(F.col("relation").isin(*RELATIONS) & F.col("confidence").between(0, 1)).join(expected, ["batch", "pair_no"], "left_semi")
    return good.groupBy("batch", "pair_no").agg(F.min_by(F.struct("relation", "confidence"), "at").alias("r")).select("batch", "pair_no", "r.relation", "r.confidence")


def reply_allowed(relation: Column, x: Column, y: Column) -> Column:
    """A reply must not contradict qualifiers."""
    return ~(((relation == "same_concept") & T.same_concept_conflict(x, y)) | ((relation == "subtype") & T.qualifier_conflict(x, y)))


def best_relations(rows: DataFrame) -> DataFrame:
    """One row of each request_id: the highest confidence, the first (seq) of equal ones."""
    best = Window.partitionBy("request_id").orderBy(F.desc("confidence"), "seq")
    return rows.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


def judged_replies(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """Pairs with a reply (request_id, reply_relation, reply_confidence), its guard and acceptance.

    ``guard_rejected`` replies contradict qualifiers; ``accepted`` ones are allowed, of a known
    relation and of enough confidence. Of several replies to a request the most confident counts.
    """
    best = replies.groupBy("request_id").agg(F.max_by(F.struct("reply_relation", "reply_confidence"), F.struct("reply_confidence", "reply_relation")).alias("r")).select("request_id", "r.*")
    both = pairs.join(best, "request_id")
    allowed = reply_allowed(F.col("reply_relation"), F.col("x.quals"), F.col("y.quals"))
    accepted = allowed & F.col("reply_relation").isin(*RELATIONS) & (F.col("reply_confidence") >= REPLY_CONFIDENCE)
    return both.withColumn("guard_rejected", ~allowed).withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def final_relations(routed: DataFrame, judged: DataFrame) -> DataFrame:
    """Automatic relations and accepted replies: (request_id, a, b, relation, confidence, method, llm).

    A request that both have goes by the higher confidence, the automatic one first.
    """
    auto = routed.filter("route = 'auto'").select("request_id", "a", "b", "relation", "confidence", "method", F.lit(False).alias("llm"), F.lit(0).alias("seq"))
    said = judged.filter("accepted").select("request_id", "a", "b", F.col("reply_relation").alias("relation"), F.col("reply_confidence").alias("confidence"), F.lit("llm_classification").alias("method"), F.lit(True).alias("llm"), F.lit(1).alias("seq"))
    return best_relations(auto.unionByName(said)).drop("seq")


def unresolved(semantic: DataFrame, resolved: DataFrame, rejected: DataFrame, enabled: bool = False, daily_limit: bool = False) -> DataFrame:
    """Semantic candidates without a relation, with the reason.

    ``enabled`` says that replies were asked for, ``daily_limit`` that asking ended early.
    """
    rows = semantic.join(resolved.select("request_id"), "request_id", "left_anti").join(rejected.select("request_id", "reply_confidence", "guard_rejected"), "request_id", "left")
    reason = (
        F.when(F.coalesce("guard_rejected", F.lit(False)), "llm_guard_rejected")
        .when(F.col("reply_confidence") < REPLY_CONFIDENCE, "llm_below_confidence")
        .when(F.col("reply_confidence").isNotNull(), "llm_not_accepted")
        .when(F.lit(enabled and daily_limit), "llm_daily_limit_not_processed")
        .when(F.lit(not enabled), "llm_disabled")
        .when(F.col("relation") == "related", "generic_related_requires_llm")
        .otherwise("no_safe_rule")
    )
    return rows.withColumn("reason", reason)


def related_measures(measures: DataFrame, vectors: DataFrame, texts: DataFrame, term_similarity, replies, k: int = 5, floors: tuple[float, float] = (0.55, 0.18)) -> tuple[DataFrame, DataFrame]:
    """(routed pairs, final relations) of measures: every step works on the rows of the one before it.

    ``measures`` (id, measure), ``vectors`` (id, vec, domain) of unit length and ``texts`` (id, text)
    are retrieved by both channels; pairs of two known, different domains that retrieval by vectors
    gives need a similarity of ``near_domains``. Substitutions are learned from semantic candidates
    only. ``term_similarity`` makes a column of (term_a, term_b), ``replies`` a frame (request_id,
    reply_relation, reply_confidence) of routed pairs.
    """
    found = N.near_domains(N.vector_neighbours(vectors.select("id", "vec"), k, floors[0]), vectors.select("id", "domain"))
    weights = cut(N.tfidf(texts).select("id", "term", "w"))
    pairs = cut(N.candidate_pairs(found, N.tfidf_neighbours(weights, k, floors[1])))
    of = vectors.select("id", "vec", "domain")
    sided = pairs.join(of.toDF("a", "va", "da"), "a").join(of.toDF("b", "vb", "db"), "b").join(N.tfidf_cosine(weights, pairs), ["a", "b"])
    seen = with_features(sided, measure_features(measures))
    seen = seen.withColumns({"emb": S.clamp(S.dot(F.col("va"), F.col("vb"))), "cross_domain": F.coalesce(F.col("da") != F.col("db"), F.lit(False)), "nx": F.col("x.norm"), "ny": F.col("y.norm")}).drop("va", "vb")
    seen = token_features(seen.withColumn("seq", S.sequence_ratio("nx", "ny")).drop("nx", "ny"))
    scored = cut(decide_candidates(seen.withColumn("score", S.semantic_score(F.col("emb"), F.col("lex"), F.col("overlap"), F.col("containment"), F.col("seq"), F.col("cross_domain")))))
    examples = substitutions(scored.filter("decision = 'semantic_candidate'"))
    patterns = learned_patterns(examples, examples.select("term_a", "term_b").distinct().withColumn("term_similarity", term_similarity(None)))
    patterns = patterns.select("term_a", "term_b", "support", "term_similarity", "context_similarity", "variant", "dimension")
    one = lambda side: F.when((F.size("diff.only_a") == 1) & (F.size("diff.only_b") == 1), F.get(F.col(f"diff.{side}"), F.lit(0)))
    changed = scored.withColumns({"term_a": F.least(one("only_a"), one("only_b")), "term_b": F.greatest(one("only_a"), one("only_b"))})
    routed = cut(route(cascade(changed.join(patterns, ["term_a", "term_b"], "left"))).withColumn("request_id", T.pair_request_id(F.col("x.measure"), F.col("y.measure"), "model")))
    return routed, final_relations(routed, judged_replies(routed.filter("route = 'review'"), replies(routed)))


def graph_nodes(relations: DataFrame, domains: DataFrame) -> DataFrame:
    """(id, label, domain) of the measures in relations, numbered in order from 0."""
    labels = relations.select(F.col("measure1").alias("label")).union(relations.select("measure2")).distinct()
    return numbered(labels, "label", name="id").join(domains.withColumnRenamed("measure", "label"), "label", "left").select("id", "label", "domain")


def graph_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, method) by node ids."""
    s = nodes.select(F.col("id").alias("source"), F.col("label").alias("measure1"))
    t = nodes.select(F.col("id").alias("target"), F.col("label").alias("measure2"))
    return relations.join(s, "measure1").join(t, "measure2").select("source", "target", "relation", "confidence", "method")


def relation_shares(relations: DataFrame) -> DataFrame:
    """(relation, n, share, dominant): dominant if more than 60 % of all."""
    n = relations.groupBy("relation").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("share", share).withColumn("dominant", F.col("share") > 0.60)
