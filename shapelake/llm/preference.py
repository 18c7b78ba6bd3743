"""Preference formatting: the longest common turn prefix as prompt, and two masked completions.

Works on turns gathered by conversation, the unit of the format; no group
larger than two conversations is ever held, however many share an opening.

Defined results: repeated rows of a conversation count once; turns that tie on
their number are ordered by role, then text, nulls first; a null role renders
as ``unknown`` and a null text as empty, while comparison keeps null apart from
both; rows with a null conversation id are ignored; a pair with a conversation
that has no turns is left out; identical conversations give two empty
completions; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(
        F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE)
    )


def _mask(turns: Column) -> Column:
    """Spans (start, end) of the completion's code points that are trained on: assistant texts with their closing mark."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, turn: Column) -> Column:
        to = acc["at"] + F.length(_rendered(turn))
        begin = to - F.length(F.coalesce(turn["text"], F.lit(""))) - len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), to.alias("end")))
        spans = F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(to.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """From turns (conv_id, turn, role, text) and pairs (pair_id, chosen_id, rejected_id):

    pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected,
    chosen_mask and rejected_mask (arrays of start, end).
    """
    turns = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = pairs.join(talks.toDF("chosen_id", "c"), "chosen_id").join(talks.toDF("rejected_id", "r"), "rejected_id")
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.transform(
        F.slice("c", F.lit(1), shorter),
        lambda t, i: t["role"].eqNullSafe(F.get("r", i)["role"]) & t["text"].eqNullSafe(F.get("r", i)["text"]),
    )
    both = both.withColumn("same", same)
    first_other = F.array_position("same", F.lit(False))
    both = both.withColumn("n_prompt_turns", F.when(first_other > 0, first_other - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    both = both.withColumns({"p": F.slice("c", F.lit(1), F.col("n_prompt_turns")), "cr": rest("c"), "rr": rest("r")})
    text = lambda c: F.array_join(F.transform(c, _rendered), "")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", text("p").alias("prompt"), text("cr").alias("chosen"),
        text("rr").alias("rejected"), _mask(F.col("cr")).alias("chosen_mask"), _mask(F.col("rr")).alias("rejected_mask"),
    )
