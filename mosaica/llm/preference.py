"""Preference formatting: one prompt and two masked completions per pair of conversations.

The prompt of a pair is the longest common prefix of turns of its chosen and its
rejected conversation; it is rendered once. What follows is rendered for each
side. The work is done turn by turn: the prefix ends before the smallest turn
that one side has and the other hasn't (an aggregate), so no conversation, not
even one that holds a large part of all rows, is gathered into one value.
``assemble`` joins the segments of pairs whose text is wanted as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HEAD = "<|im_start|>"
TAIL = "<|im_end|>"
LAST = 2**63 - 1


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(role, F.lit("")), F.lit("\n"))


def segments(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Turns (pair_id, chosen boolean, turn, role, text) -> pair_id, part, turn, role, segment, mask_from, mask_to.

    ``part`` is prompt, chosen or rejected; a part's text is its segments by
    turn. Loss counts on the characters mask_from <= i < mask_to of a segment:
    text and end mark of a completion's trained roles (0, 0 elsewhere).

    Null texts and roles are empty; a null turn stands last; rows that repeat
    are one; several rows of one turn all belong to it, in the order of role and
    text. A pair with one side only has an empty prompt; equal sides have no
    completion; rows without pair_id or side are left out; an empty table gives
    no row.
    """
    t = turns.where(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull()).select(
        "pair_id", F.col("chosen").cast("boolean").alias("chosen"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = t.groupBy("pair_id", "turn", "role", "text").agg(F.max("chosen").alias("in_chosen"), F.max(~F.col("chosen")).alias("in_rejected"))
    # Checkpointed, so that its join below is a plain shuffled one, whose large partitions Spark can split.
    ends = materialize(rows.where(~(F.col("in_chosen") & F.col("in_rejected"))).groupBy("pair_id").agg(F.min("turn").alias("_end")))
    rows = rows.join(ends, "pair_id", "left")
    shared = F.col("_end").isNull() | (F.col("turn") < F.col("_end"))
    parts = F.when(shared, F.array(F.lit("prompt"))).otherwise(F.filter(F.array(F.when(F.col("in_chosen"), F.lit("chosen")), F.when(F.col("in_rejected"), F.lit("rejected"))), lambda p: p.isNotNull()))
    rows = rows.withColumn("part", F.explode(parts))
    learns = (F.col("part") != "prompt") & F.col("role").isin(*trained)
    start = F.length(header(F.col("role")))
    return rows.select(
        "pair_id", "part", F.nullif("turn", F.lit(LAST)).alias("turn"), "role",
        F.concat(header(F.col("role")), "text", F.lit(TAIL + "\n")).alias("segment"),
        F.when(learns, start).otherwise(0).cast("int").alias("mask_from"),
        F.when(learns, start + F.length("text") + len(TAIL)).otherwise(0).cast("int").alias("mask_to"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(F.floor(conv / 2).alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


def assemble(found: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask (arrays of from, to) for pairs that fit in one row each."""

    def text(part: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "role", "segment", "mask_from", "mask_to"))))
        return ordered

    grouped = found.groupBy("pair_id").agg(*[text(p).alias(f"_{p}") for p in ("prompt", "chosen", "rejected")])

    def mask(part: str) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))
        done = F.aggregate(f"_{part}", state, lambda s, x: F.struct(
            (s["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["mask_to"] > 0, F.concat(s["spans"], F.array(F.struct((s["at"] + x["mask_from"]).alias("from"), (s["at"] + x["mask_to"]).alias("to"))))).otherwise(s["spans"]).alias("spans"),
        ))
        return done["spans"]

    joined = [F.array_join(F.transform(f"_{p}", lambda x: x["segment"]), "").alias(p) for p in ("prompt", "chosen", "rejected")]
    return grouped.select("pair_id", *joined, mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"))
