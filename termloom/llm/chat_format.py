"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered once more with that speaker
as the assistant and all others as users with a name; the mask marks what the assistant says,
including the mark that ends a turn. Roles in ``context_roles`` are no participants: they are
rendered as they are in every perspective.

A rendering comes in blocks of at most ``block_turns`` turns, for every conversation alike, so that
no task ever holds an unbounded one: turns meet by ranges of ``block_turns`` turn numbers, and a
range with more turns than numbers is cut into as many blocks as it takes. The blocks 0 to
n_blocks - 1 of a perspective, in order, are its dialogue; most dialogues are one block.

Defined results: a null text is empty, a null role is the participant ``unknown``; rows without a
conv_id belong to no dialogue and are left out; turns are in order of number (those without one
first), then role and text; repeated rows are repeated; texts of any length are rendered whole; a
conversation of context alone has no perspective; an empty table gives an empty result; only the
named columns are read. ``<|`` inside a text is written ``< |``, so that texts can't forge marks;
names keep no white space and no ``<|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
#: The range of turns without a number, before all others.
NO_NUMBER = -(1 << 63)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def speaker_name(role: Column) -> Column:
    clean = F.regexp_replace(role, r"[ \t\n\x0B\f\r<|>]+", "_")
    return F.when(F.length(F.coalesce(clean, F.lit(""))) == 0, F.lit("unknown")).otherwise(clean)


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, block, n_blocks, n_turns, rendered, mask_runs and n_masked.

    ``mask_runs`` are the lengths, in code points, of what is not (``u``) and what is (``m``)
    masked for training, in turn from the start of ``rendered``.
    """
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn").cast("long") / block_turns), F.lit(NO_NUMBER)).alias("span"),
        F.col("turn").cast("long").alias("turn"),
        speaker_name(F.col("role")).alias("who"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    spans = rows.groupBy("conv_id", "span").agg(F.ceil(F.count("*") / block_turns).alias("k"))
    before = F.sum("k").over(Window.partitionBy("conv_id").orderBy("span")) - F.col("k")
    spans = spans.select("conv_id", "span", before.alias("before"), F.sum("k").over(Window.partitionBy("conv_id")).alias("n_blocks"))
    # window, join and grouping all go by conv_id and span: the texts are shuffled once for them
    within = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn", "who", "said")) - 1
    placed = rows.withColumn("within", within).join(spans, ["conv_id", "span"])
    block = (F.col("before") + F.floor(F.col("within") / block_turns)).alias("block")
    blocks = placed.groupBy("conv_id", "span", block, "n_blocks").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("turns"))
    context = F.col("who").isin(*context_roles) if context_roles else F.lit(False)
    people = rows.filter(~context).select("conv_id", F.col("who").alias("perspective")).distinct()
    views = blocks.join(people, "conv_id")

    def header(t: Column) -> Column:
        plain = t["who"].isin(*context_roles) if context_roles else F.lit(False)
        label = F.when(t["who"] == F.col("perspective"), F.lit("assistant")).when(plain, t["who"]).otherwise(F.concat(F.lit("user name="), t["who"]))
        return F.concat(F.lit(OPEN), label, F.lit("\n"))

    def body(t: Column) -> Column:
        return F.concat(t["said"], F.lit(CLOSE))

    def run(t: Column) -> Column:
        own = F.concat(F.lit("u"), F.char_length(header(t)).cast("string"), F.lit(" m"), F.char_length(body(t)).cast("string"), F.lit(" u1"))
        return F.when(t["who"] == F.col("perspective"), own).otherwise(F.concat(F.lit("u"), (F.char_length(header(t)) + F.char_length(body(t)) + 1).cast("string")))

    masked = F.aggregate(F.filter("turns", lambda t: t["who"] == F.col("perspective")), F.lit(0).cast("long"), lambda n, t: n + F.char_length(body(t)))
    return views.select(
        "conv_id", "perspective", "block", "n_blocks",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(header(t), body(t), F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("turns", run), " ").alias("mask_runs"),
        masked.alias("n_masked"),
    )
