"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The prompt is the longest run of first turns that both conversations have alike; it is rendered
once for the pair. From the first turn that differs on, each side is a completion, in which only
assistant turns are learned from. The result is one row per rendered turn, so a conversation of
any length is never gathered: the rows of a pair and part in the order of ``turn`` are its text.
Built-in expressions only.

Turns are placed by their number, a null number first. All turns of one number count as one
step; equal rows count once. Null texts are empty, null roles are "user". Conversations that
are wholly alike, or that only one side has, give a prompt alone or completions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieweave.session import cut

LEARNED_ROLE = "assistant"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _turns(side: DataFrame, name: str) -> DataFrame:
    return side.select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(name == "chosen").alias("in_chosen"), F.lit(name == "rejected").alias("in_rejected"),
    )


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part, turn, role, rendered, n_chars, learned, masked_chars for sides with pair_id, turn, role, text.

    ``masked_chars`` first characters of a row are left out of the loss: all of them, or the
    header of a learned turn.
    """
    both = cut(
        _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"))
        .groupBy("pair_id", "turn", "role", "text").agg(F.max("in_chosen").alias("in_chosen"), F.max("in_rejected").alias("in_rejected"))
    )
    # Minima combine before the shuffle; a pair of very many turns is one number here.
    parting = both.filter("in_chosen <> in_rejected").groupBy(F.col("pair_id").alias("_pair")).agg(F.min("turn").alias("_from"))
    met = both.join(parting, F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
    prompt = F.col("_from").isNull() | (F.col("turn") < F.col("_from"))
    parts = F.when(prompt, F.array(F.lit("prompt"))).otherwise(
        F.array_compact(F.array(F.when(F.col("in_chosen"), F.lit("chosen")), F.when(F.col("in_rejected"), F.lit("rejected"))))
    )
    rows = met.select("pair_id", "turn", "role", F.concat(header(F.col("role")), F.col("text"), F.lit("\n")).alias("rendered"), F.explode(parts).alias("part"))
    learned = (F.col("part") != "prompt") & (F.col("role") == LEARNED_ROLE)
    size = F.length("rendered").cast("long")
    return rows.select("pair_id", "part", "turn", "role", "rendered", size.alias("n_chars"), learned.alias("learned"), F.when(learned, F.length(header(F.col("role"))).cast("long")).otherwise(size).alias("masked_chars"))


def cut_short_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: each one up to its last reply, against the same with that reply broken off half way.

    Conversations without a reply stand against themselves.
    """
    turn = F.coalesce(F.col("turn"), F.lit(-1))
    last = conversations.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.max(F.when(F.col("role") == LEARNED_ROLE, turn)).alias("_reply"), F.max(turn).alias("_end")
    )
    held = conversations.join(last, F.col("conv_id").eqNullSafe(F.col("_conv"))).filter(turn <= F.coalesce("_reply", "_end"))
    broken = (turn == F.col("_reply")) & (F.col("role") == LEARNED_ROLE)
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    chosen = held.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rejected = held.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(broken, half).otherwise(F.col("text")).alias("text"))
    return chosen, rejected
