"""Chat formatting with cumulative-snapshot collapse.

Logs that write a conversation again after every turn hold each of its
prefixes as a conversation of its own. Every turn gets a rolling hash of all
turns up to it; a conversation whose last hash is met at a turn of a longer
conversation is such a snapshot. An anti-join leaves the maximal ones, of equal
ones the one with the smallest conv_id, and these are rendered.

A conversation's rows are gathered under its conv_id, so a conversation has to
fit in one task; equal conversations and common first turns need no more room,
because hashes are pre-aggregated before they are shuffled.

Defined results: turns are ordered by turn, then role and text, nulls first;
null roles and texts are rendered as empty; repeated rows are repeated turns;
rows with a null conv_id belong to no conversation and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolling_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (in order) and hashes: one for each prefix of the turns."""
    turns = conversations.where("conv_id is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    digest = lambda t: F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256)
    step = lambda acc, h: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), h), 256)))
    return turns.withColumn("hashes", F.aggregate(F.transform("turns", digest), F.array().cast("array<string>"), step))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and turns of the conversations that no other one begins with."""
    rolled = rolling_hashes(conversations).withColumn("whole", F.element_at("hashes", -1))
    inner = rolled.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("whole")).distinct()
    firsts = rolled.groupBy("whole").agg(F.min("conv_id").alias("conv_id"))
    keep = firsts.join(inner, "whole", "left_anti").select("conv_id")
    return rolled.select("conv_id", "turns").join(keep, "conv_id", "left_semi")


def render(turns: str = "turns", begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """ChatML text of an array of turns."""
    one = lambda t: F.concat(F.lit(begin), t["role"], F.lit("\n"), t["text"], F.lit(end + "\n"))
    return F.array_join(F.transform(turns, one), "")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_assistant and rendered of the maximal conversations."""
    kept = maximal(conversations)
    return kept.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["role"] == "assistant")).cast("long").alias("n_assistant"),
        render().alias("rendered"),
    )
