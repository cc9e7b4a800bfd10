"""Evaluation: seeded samples, confusion matrices, class metrics, score buckets, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.numbering import numbered

# --- fixed values: core labels; score buckets, half open but for the last ---
CORE_RELATIONS = ("same_concept", "synonym", "subtype", "complementary", "different_aspects")
BUCKETS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 0.9), (0.9, 1.01))


def seeded(key: Column, seed: int = 42) -> Column:
    """A fixed random order of keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"), 256)


def simple_sample(rows: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int = 25, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, with ``short`` true where a stratum has fewer."""
    order = Window.partitionBy(stratum).orderBy(seeded(F.col(key), seed), key)
    sizes = rows.groupBy(stratum).agg((F.count("*") < n).alias("short"))
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).drop("nth").join(sizes, stratum)


def tertiles(rows: DataFrame, score: str, key: str) -> DataFrame:
    """``tertile`` low, middle or high by rank; what n / 3 leaves over is high."""
    placed = numbered(rows, score, key, name="__n")
    third = placed.count() // 3
    n = F.col("__n")
    return placed.withColumn("tertile", F.when(n < third, "low").when(n < 2 * third, "middle").otherwise("high")).drop("__n")


def tertile_sample(rows: DataFrame, score: str, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` rows of each tertile, with ``short`` true where one has fewer."""
    return stratified_sample(tertiles(rows, score, key), "tertile", key, n, seed)


def eligible(relations: DataFrame) -> DataFrame:
    """Relations with a core label, one row (the first seq) of each unordered pair."""
    core = relations.filter(F.col("relation").isin(*CORE_RELATIONS))
    one = Window.partitionBy(F.least("measure1", "measure2"), F.greatest("measure1", "measure2")).orderBy("seq")
    return core.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")


def first_examples(rows: DataFrame, by: str, key: str, n: int = 10) -> DataFrame:
    """(by, n_rows, examples): the number of rows and the ``n`` smallest keys of each group."""
    order = Window.partitionBy(by).orderBy(key)
    some = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).groupBy(by).agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return rows.groupBy(by).agg(F.count("*").alias("n_rows")).join(some, by).select(by, "n_rows", "examples")


def primary_errors(rows: DataFrame, key: str) -> DataFrame:
    """Wrong rows of (gold, pred, score), the most confident first; ``nth`` is the place from 0."""
    wrong = rows.filter("gold <> pred")
    return numbered(wrong, F.col("score").desc(), F.col(key).asc())


def balanced_sample(rows: DataFrame, stratum: str, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Equal shares of all strata, topped up to ``n`` from what is left."""
    k = rows.select(stratum).distinct().count() or 1
    shares = stratified_sample(rows, stratum, key, n // k, seed).drop("short")
    left = rows.join(shares.select(key), key, "left_anti")
    return shares.unionByName(simple_sample(left, key, n - shares.count(), seed + 1).select(*shares.columns))


def confusion_matrix(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(gold, pred, n) for all pairs of labels, zeros included; labels default to gold and pred."""
    counts = rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    known = spark.createDataFrame([(x,) for x in labels], "label string") if labels else rows.select(F.col("gold").alias("label")).union(rows.select("pred")).distinct()
    grid = known.select(F.col("label").alias("gold")).join(F.broadcast(known.select(F.col("label").alias("pred"))))
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, support, tp, fp, fn, precision, recall, f1), rounded to four places."""
    hit = F.col("gold") == F.col("pred")
    gold = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    pred = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    m = gold.join(pred, "label")
    precision, recall = _safe(F.col("tp"), F.col("predicted")), _safe(F.col("tp"), F.col("support"))
    f1 = _safe(2 * precision * recall, precision + recall)
    return m.select("label", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def summary(matrix: DataFrame, supported_only: bool = False) -> DataFrame:
    """(accuracy, macro_f1, n): the macro mean is of rounded class values."""
    metrics = class_metrics(matrix)
    macro = metrics.filter("support > 0") if supported_only else metrics
    total = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    return total.crossJoin(macro.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))).select(F.round(_safe(F.col("tp"), F.col("n")), 4).alias("accuracy"), "macro_f1", "n")


def bucket_accuracy(rows: DataFrame) -> DataFrame:
    """(bucket, n, correct, accuracy) of rows (score, correct); empty buckets have no accuracy."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(f"{a:g}-{min(b, 1):g}", a, b) for a, b in BUCKETS], "bucket string, low double, high double")
    per = rows.join(F.broadcast(grid), (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high"))).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))
    out = grid.select("bucket").join(per, "bucket", "left")
    return out.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("correct", F.lit(0)).alias("correct"), F.round(F.col("correct") / F.col("n"), 4).alias("accuracy"))


def group_accuracy(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))


def secondary_diagnostics(rows: DataFrame) -> DataFrame:
    """Of (gold, gold_secondary, pred, pred_secondary): how often a second domain is given and right."""
    has = F.col("pred_secondary").isNotNull()
    return rows.agg(
        F.count("*").alias("n"), F.count_if(has).alias("n_secondary"), F.count_if(F.col("gold_secondary").isNotNull()).alias("n_gold_secondary"),
        F.count_if(F.col("pred_secondary") == F.col("gold_secondary")).alias("n_exact"),
        F.count_if((F.col("pred") != F.col("gold")) & (F.col("pred_secondary") == F.col("gold"))).alias("n_recovered"),
        F.round(F.avg(has.cast("double")), 4).alias("rate"),
    )


def agreement(rows: DataFrame) -> DataFrame:
    """Agreement of verdicts agree and disagree; null if there are none."""
    yes, no = F.count_if(F.col("verdict") == "agree"), F.count_if(F.col("verdict") == "disagree")
    return rows.agg(yes.alias("agree"), no.alias("disagree"), F.round(F.try_divide(yes, yes + no), 4).alias("agreement"))


def joined_annotations(annotations: DataFrame, hidden: DataFrame) -> DataFrame:
    """Annotations with their hidden rows by id; an id without one, or another text, is an error."""
    both = annotations.join(hidden.withColumnsRenamed({"text": "hidden_text"}), "id", "left")
    return both.filter(F.assert_true(F.coalesce(F.col("text") == F.col("hidden_text"), F.lit(False)), F.lit("an annotation has no row of its own")).isNull()).drop("hidden_text")


def has_gold(annotations: DataFrame, column: str) -> bool:
    """Some label is filled in: such a file must not be overwritten."""
    return not annotations.filter(F.length(T.strip(F.coalesce(F.col(column), F.lit("")))) > 0).isEmpty()


def duplicate_pairs(relations: DataFrame) -> DataFrame:
    """Unordered pairs that occur more than once."""
    return relations.groupBy(F.least("measure1", "measure2").alias("measure1"), F.greatest("measure1", "measure2").alias("measure2")).agg(F.count("*").alias("n")).filter("n > 1")


def signature_violations(relations: DataFrame) -> DataFrame:
    """Same-concept pairs whose signatures are both there and differ."""
    s = relations.withColumns({"s1": T.signature(F.col("measure1")), "s2": T.signature(F.col("measure2"))})
    return s.filter((F.col("relation") == "same_concept") & (F.size("s1") > 0) & (F.size("s2") > 0) & (F.col("s1") != F.col("s2")))


def containment_violations(relations: DataFrame) -> DataFrame:
    """Subtypes of which neither side's words hold the other's."""
    t = relations.withColumns({"t1": T.measure_tokens(F.col("measure1"), False), "t2": T.measure_tokens(F.col("measure2"), False)})
    apart = (F.size(F.array_except("t1", "t2")) > 0) & (F.size(F.array_except("t2", "t1")) > 0)
    return t.filter((F.col("relation") == "subtype") & apart)
