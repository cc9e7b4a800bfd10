"""Operators of the engine against brute force on small fixtures."""

import difflib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.functions import text as T
from termloom.operators import domains as D
from termloom.operators import evaluation as E
from termloom.operators import relations as R
from termloom.operators import vocabulary as V
from termloom.operators.numbering import numbered
from termloom.plans import catalog
from termloom.plans import inputs as I


def test_calibration_ranks_all_scores(spark):
    """Scores below the minimum take part in the ranking: 30 of 1 and 2 pull the cap down."""
    rng = random.Random(1)
    raw = {"many": [1] * 20 + [2] * 10 + [5, 9], "few": [1, 9], "some": [rng.randint(1, 12) for _ in range(40)], "none": []}
    rows = [(f"{d}{k}", d, x) for d, xs in raw.items() for k, x in enumerate(xs)]
    scores = spark.createDataFrame(rows, "measure string, domain string, raw long")
    lexicon = spark.createDataFrame([(d, 7) for d in raw] + [("empty", 0)], "domain string, weight int")
    want = {d: float(sorted(xs)[max(0, int(0.95 * len(xs)) - 1)]) if len(xs) >= 15 else 7.0 for d, xs in raw.items()} | {"empty": 1.0}
    assert {r.domain: r.cap for r in D.calibration(scores, lexicon).collect()} == want
    assert want["many"] == 2.0  # 5.0 or 7.0 without the scores below the minimum


def test_pair_numbers_of_a_large_table_with_more_columns(spark):
    rows = spark.range(600_000).select((F.col("id") * 7919 % 600_011).alias("a"), (F.col("id") % 17).alias("b"), F.rand(1).alias("extra"))
    got = R.batches(rows)
    n = got.select((F.col("batch") * R.BATCH + F.col("pair_no") - 1).alias("n"), "a", "b")
    assert n.select("n").distinct().count() == 600_000
    assert n.agg(F.min("n"), F.max("n")).first() == (0, 599_999)
    first = [(r.a, r.b) for r in n.filter("n < 100").orderBy("n").collect()]
    assert first == sorted((k * 7919 % 600_011, k % 17) for k in range(600_000))[:100]


def test_numbers_with_ties_nulls_and_without_rows(spark):
    rows = spark.createDataFrame([(3,), (None,), (3,), (1,), (2,)] * 20, "x int")
    got = numbered(rows, "x").orderBy("nth").collect()
    assert [r.nth for r in got] == list(range(100)) and [r.x for r in got] == [None] * 20 + [1] * 20 + [2] * 20 + [3] * 40
    assert numbered(rows.limit(0), "x").collect() == []


def variants_by_force(value):
    found, new = {value.strip()}, {value.strip()}
    while new:
        new = {w for v in new for m in re.finditer(r"\s*\([^()]*\)", v) if (w := (v[: m.start()] + v[m.end() :]).strip())} - found
        found |= new
    return sorted(found)


def test_variants_of_any_number_of_parentheses(spark):
    values = ["a", " a (b) ", "a (b (c) (d)) e (f)", "(a) (b) (c) (d) (e) (f) x", "((((((a)))))) b", "(only)", "a ) ( b", "", "(()())"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.geo_variants(F.col("v")).alias("got"))
    for r in rows.collect():
        assert r.got == variants_by_force(r.v), r.v


def test_variants_one_by_one():
    rng = random.Random(3)
    values = ["a", " a (b) ", "a (b (c) (d)) e (f)", "((((((a)))))) b", "(only)", "a ) ( b", "", " ", "(()())", "(a) (a)b", "(a)(a) (a)  (a)b ", "x (\u00e9)\u2003(z) \U0001f600", "a \u0001(b)\u0002 c"]
    values += ["".join(rng.choice("aab ()() ") for _ in range(rng.randrange(18))) for _ in range(3000)]
    for v in values:
        assert list(V.variants_in_order(v)) == variants_by_force(v), v
    assert list(V.variants_in_order("(" * 100_000)) == ["(" * 100_000]
    assert next(V.variants_in_order("x" + " (w)" * 200)) == "x"


def test_many_variants_in_rows(spark):
    """A line of 18 parentheses has 262,144 variants, 100 MB of text; lists go on in further rows."""
    wide = " ".join(f"{'w' * 20} ({k:02})" for k in range(18))
    texts = [(1, "a (b) c"), (2, wide), (3, "(a) (b"), (4, None)]
    rows = V.joined_variants(spark.createDataFrame(texts, "doc_id long, line string"), "line")
    assert rows.columns == ["doc_id", "line", "variants"]
    sizes = rows.filter("doc_id = 2").select(F.size(F.split("variants", r"\|")).alias("n"), F.length("variants").alias("size"), "line").collect()
    assert sum(r.n for r in sizes) == 1 << 18 and len(sizes) > 50 and all(r.size <= V.PART and r.line == wide for r in sizes)
    parts = [r.variants for r in V.joined_variants(spark.createDataFrame([(1, "(a) (b) (c) d")], "doc_id long, line string"), "line", 12).collect()]
    assert len(parts) > 1 and "|".join(parts) == "|".join(variants_by_force("(a) (b) (c) d"))
    assert {r.doc_id: r.variants for r in rows.filter("doc_id <> 2").collect()} == {1: "a (b) c|a c", 3: "(a) (b|(b", 4: ""}


def test_variants_are_dealt_out():
    """Lists of any length are cut into shares between bounds, whose lists make the whole one."""
    rng = random.Random(4)
    values = ["", " ", "a", "(a) (a)b", "x" + " (w)" * 14, *("".join(rng.choice("aab ()() ") for _ in range(rng.randrange(24))) for _ in range(600))]
    for v in values:
        want = list(V.variants_in_order(v))
        bounds = sorted({v[: rng.randrange(len(v) + 1)] for _ in range(3)} | {w for w in want if rng.random() < 0.2} - {""})
        if v.strip():
            cuts = [*dict.fromkeys(["", *bounds])]
            parts = [list(V.variants_in_order(v, a, b)) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
            assert [x for p in parts for x in p] == want, (v, cuts)
    wide = " ".join(f"{'w' * 20} ({k:02})" for k in range(17))
    shares = V.variant_shares(wide)
    sizes = [sum(1 for _ in V.variants_in_order(wide, *s)) for s in shares]
    assert len(sizes) > 4 and sum(sizes) == 1 << 17 and max(sizes) <= V.SHARE
    assert shares[0][0] == "" and shares[-1][1] is None and all(a[1] == b[0] for a, b in itertools.pairwise(shares))
    assert 1000 < len(V.variant_shares("x (w)" * 200)) < 10_000


def test_long_lists_are_made_by_many_tasks(spark):
    """Not by the one that reads the line: a list doubles with every parenthesis."""
    wide = " ".join(f"w{k} ({k:02})" for k in range(17))
    rows = V.joined_variants(spark.createDataFrame([(1, wide)], "doc_id long, line string").coalesce(1), "line")
    by_task = rows.groupBy(F.spark_partition_id()).agg(F.sum(F.size(F.split("variants", r"\|"))).alias("n")).collect()
    assert len(by_task) == 4 and sum(r.n for r in by_task) == 1 << 17 and max(r.n for r in by_task) < 1 << 16


def test_variants_share_their_ends():
    """2^18 variants are listed from common ends: no more than some places of the value are followed."""
    ways = V._Ways(" ".join(f"{'w' * 20} ({k:02})" for k in range(18)))
    followed, below = [], ways.below
    ways.below = lambda text, at: followed.append(at) or below(text, at)
    assert sum(1 for _ in ways.listed("", None)) == 1 << 18 and len(followed) < 10_000


def test_variants_read_row_groups_by_parts(spark):
    """A file of one row group is not held a second time outside the heap, as a vectored read does."""
    plan = catalog.QUERIES["paren_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed()
    assert plan.collectLeaves().head().relation().options().get("parquet.hadoop.vectored.io.enabled").get() == "false"


def test_sequence_ratio(spark):
    rng = random.Random(2)
    texts = ["", "a", "population by age", "population by sex and age", *("".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(40))]
    pairs = spark.createDataFrame(list(itertools.combinations(texts, 2)), "x string, y string")
    for r in pairs.select("x", "y", S.sequence_ratio("x", "y").alias("got")).collect():
        assert abs(r.got - difflib.SequenceMatcher(None, r.x, r.y).ratio()) < 1e-9


def test_replies_are_guarded(spark):
    """A reply that contradicts qualifiers, is unsure or of no known relation is not taken."""
    m = spark.createDataFrame([(1, "Prices (EUR)"), (2, "Prices (%)"), (3, "Prices of the goods"), (4, "Goods")], "id long, measure string")
    pairs = spark.createDataFrame([(1, 2, "p"), (1, 3, "q"), (3, 4, "r"), (2, 4, "s"), (2, 3, "t")], "a long, b long, request_id string")
    seen = R.with_features(pairs, R.measure_features(m)).withColumns({"route": F.when(F.col("request_id") == "t", "auto").otherwise("review"), "relation": F.lit("subtype"), "confidence": F.lit(0.9), "method": F.lit("automatic_subtype")})
    replies = [("p", "same_concept", 0.9), ("q", "same_concept", 0.6), ("q", "same_concept", 0.69), ("r", "unrelated", 0.9), ("s", "related", 0.7), ("x", "related", 0.9), ("t", "synonym", 0.95)]
    judged = R.judged_replies(seen, spark.createDataFrame(replies, "request_id string, reply_relation string, reply_confidence double"))
    got = {r.request_id: (r.guard_rejected, r.accepted, r.reply_confidence) for r in judged.collect()}
    assert got == {"p": (True, False, 0.9), "q": (False, False, 0.69), "r": (False, False, 0.9), "s": (False, True, 0.7), "t": (False, True, 0.95)}
    final = {r.request_id: (r.relation, r.confidence, r.method, r.llm) for r in R.final_relations(seen, judged).collect()}
    assert final == {"s": ("related", 0.7, "llm_classification", True), "t": ("synonym", 0.95, "llm_classification", True)}


def test_relations_end_to_end(spark):
    """Pairs are those of both channels, and what is said of a pair follows from its own signals."""
    rows = catalog.QUERIES["relations_end_to_end"](spark, "/root/testdata/sf0.001").collect()
    pairs = [(r.a, r.b) for r in rows]
    assert len(pairs) == len(set(pairs)) > 100 and all(a < b for a, b in pairs)
    for r in rows:
        semantic = "embedding_knn" in r.sources and r.score >= 0.64
        assert r.decision == ("semantic_candidate" if semantic else "retrieval_only")
        assert (r.relation is not None) >= (r.route == "auto") and (r.relation is None or r.route in ("auto", "review"))
        assert r.route != "review" or semantic


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_tertiles(spark, n):
    rows = spark.createDataFrame([(k, k % 2) for k in range(n)], "id long, score long")
    got = [r.tertile for r in E.tertiles(rows, "score", "id").orderBy("score", "id").collect()]
    assert got == ["low"] * (n // 3) + ["middle"] * (n // 3) + ["high"] * (n - 2 * (n // 3))


def without_names_by_force(title, names):
    """Each name in turn, longest first, is cut out wherever no word character touches it."""

    def word(c):
        return c.isalnum() or c == "_"

    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        at, out = 0, ""
        while at < len(title):
            end = at + len(name)
            whole = (at == 0 or not word(title[at - 1])) and (end >= len(title) or not word(title[end]))
            if whole and title[at:end].lower() == name.lower():
                at = end
            else:
                out, at = out + title[at], at + 1
        title = out
    return title


def test_geography_leaves_titles(spark):
    sf_dir = "/root/testdata/sf0.001"
    names = [r.n_name for r in I.table(spark, sf_dir, "nation").collect()] + ["of", "data from", "data"]
    made = I.made_titles(spark, sf_dir)
    want = {r.id: without_names_by_force(r.title, names) for r in made.collect()}
    got = {r.id: r.title for r in V.without_geography(made, names).collect()}
    assert got == want and len(got) == made.count()
    assert sum(want[r.id] != r.title for r in made.collect()) == len(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Prices (EUR) 1,5 and 1.5; age 15-24", {"1.5", "15", "24", "15-24", "eur"}),
        ("Output - B, C: D", {"b", "d"}),
        ("B2B 3x 4", {"4"}),
        ("C10-C12 (%)", {"c10-c12", "%"}),
        ("years \u0663 (TOOLONG)", {"\u0663"}),
        ("a-b-c abcd-e", {"a-b"}),
        ("", set()),
    ],
)
def test_signature(spark, text, want):
    rows = spark.createDataFrame([(text,)], "x string")
    assert rows.select(T.signature(F.col("x"))).first()[0] == sorted(want)
