"""Preference pairs from conversations: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"


def render_turn(role: Column, text: Column) -> tuple[Column, Column]:
    """Head and body of a turn; the body and its end mark are what a model learns to say."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n")), F.concat(text, F.lit("<|end|>\n"))


def neighbour_pairs(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs (pair_id, chosen_id, rejected_id) of conversations 2k and 2k + 1; a missing partner is null."""
    ids = turns.select(F.col(conv_col).cast("bigint").alias("id")).filter("id is not null").distinct()
    even = (F.pmod(F.col("id"), F.lit(2)) == 0)
    half = F.floor(F.col("id") / 2).cast("bigint")
    return ids.groupBy(half.alias("pair_id")).agg(F.max(F.when(even, F.col("id"))).alias("chosen_id"), F.max(F.when(~even, F.col("id"))).alias("rejected_id"))


def format_preferences(
    turns: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, status.

    The prompt is the longest run of first turns that both conversations share, role
    and text alike. A completion is the rest of its conversation; its mask lists
    (start, length) in characters of the stretches to learn, the bodies of assistant
    turns, and everything else is masked. Turns are ordered by number, then role,
    then text, nulls first, so ties and repeated turns have one result. Null roles
    and texts are empty. Status is `pair`, `equal` (both completions are empty),
    `no_chosen` or `no_rejected` (a side without turns: no prompt is shared and its
    completion is null). Turns without a conversation id belong to no pair. A
    conversation may stand in several pairs. Turns are compared by a join on pair
    and place, never gathered for it; a rendered conversation is one row. Empty
    tables give no rows, other columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    said = turns.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv")),
    )).alias("s")).select("pair_id", "s.side", "s.conv").filter("conv is not null")
    head, body = render_turn(F.col("role"), F.col("text"))
    line = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = said.filter("conv is not null").withColumns({"head": head, "body": body})
    placed = placed.select("conv", "role", "text", "head", "body", F.row_number().over(line).alias("at"))
    placed = placed.join(sides, "conv")

    # The first place where the two sides differ or one has ended.
    same = placed.groupBy("pair_id", "at").agg(
        F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high")
    )
    same = same.withColumn("shared", (F.col("n") == 2) & (F.col("low") == F.col("high")))
    shared = same.groupBy("pair_id").agg(F.min(F.when(~F.col("shared"), F.col("at"))).alias("differ"), F.max("at").alias("last"))
    shared = shared.select("pair_id", F.coalesce(F.col("differ") - 1, F.col("last")).cast("bigint").alias("prefix_turns"))

    cut = placed.join(shared, "pair_id").withColumn("part", F.when(F.col("at") <= F.col("prefix_turns"), "prompt").otherwise(F.col("side")))
    cut = cut.filter((F.col("part") != "prompt") | (F.col("side") == "chosen"))
    parts = cut.groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "head", "body"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "")
    ends = F.transform("turns", lambda t: (F.length(t["head"]) + F.length(t["body"])).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state, t):
        begin = state["at"] + F.length(t["head"])
        span = F.struct(begin.alias("start"), F.length(t["body"]).cast("bigint").alias("length"))
        spans = F.when(t["role"] == LEARNED_ROLE, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + F.length(t["body"])).alias("at"), spans.alias("spans"))

    mask = F.aggregate("turns", start, step, lambda s: s["spans"])
    parts = parts.select("pair_id", "part", whole.alias("whole"), mask.alias("mask"), F.size(ends).alias("n"))
    of = lambda part, what: F.max(F.when(F.col("part") == part, F.col(what)))
    built = parts.groupBy("pair_id").agg(
        of("prompt", "whole").alias("prompt"), of("chosen", "whole").alias("chosen"), of("rejected", "whole").alias("rejected"),
        of("chosen", "mask").alias("chosen_mask"), of("rejected", "mask").alias("rejected_mask"),
    )
    here = placed.groupBy("pair_id").agg(F.max(F.col("side") == "chosen").alias("has_chosen"), F.max(F.col("side") == "rejected").alias("has_rejected"))
    out = pairs.join(shared, "pair_id", "left").join(built, "pair_id", "left").join(here, "pair_id", "left")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(~yes("has_chosen"), "no_chosen").when(~yes("has_rejected"), "no_rejected")
        .when(F.col("chosen").isNull() & F.col("rejected").isNull(), "equal").otherwise("pair")
    )
    return out.select(
        "pair_id", "chosen_id", "rejected_id", F.coalesce("prefix_turns", F.lit(0).cast("bigint")).alias("prefix_turns"),
        F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.when(yes("has_chosen"), F.coalesce("chosen", F.lit(""))).alias("chosen"), F.when(yes("has_rejected"), F.coalesce("rejected", F.lit(""))).alias("rejected"),
        F.when(yes("has_chosen"), F.coalesce("chosen_mask", none)).alias("chosen_mask"),
        F.when(yes("has_rejected"), F.coalesce("rejected_mask", none)).alias("rejected_mask"), status.alias("status"),
    )


def mask_text(mask: Column) -> Column:
    """A mask as `start:length` pairs joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
