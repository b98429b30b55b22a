"""Conversation memory: the last turns under budgets, as ordered folds, and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import MARKERS, STRIP, WS, rewritten


def clean_turn(role: Column, text: Column) -> Column:
    """A turn's text: answers without evidence marks, questions trimmed."""
    return F.when(role == "assistant", rewritten(text, MARKERS)).otherwise(rewritten(text, STRIP))


def kept_turns(turns: Column, budget: int) -> Column:
    """From an array of (turn, role, text), newest last: those that fit ``budget`` characters counted from the newest; the
    oldest kept is cut with an ellipsis, and what trimming it gives back goes to the next, so this is a fold."""
    none = F.filter(turns, lambda t: F.lit(False))
    start = F.struct(none.alias("kept"), F.lit(budget).alias("left"))

    def step(s: Column, t: Column) -> Column:
        cut = F.concat(F.regexp_replace(F.substring(t["text"], F.lit(1), s["left"] - 1), f"{WS}+$", ""), F.lit("…"))
        text = F.when(F.length(t["text"]) <= s["left"], t["text"]).otherwise(cut)
        took = F.struct(F.concat(F.array(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text.alias("text"))), s["kept"]).alias("kept"), (s["left"] - F.length(text)).alias("left"))
        return F.when(s["left"] <= 1, s).otherwise(took)

    return F.aggregate(F.reverse(turns), start, step, lambda s: s["kept"])


def server_history(turns: DataFrame, most_turns: int, budget: int) -> DataFrame:
    """(conv_id, turn, role, text) of the turns a conversation goes on with. Blank turns go first, then all but the last
    ``most_turns``, then the budget; roles other than user and assistant take no part."""
    # Whether a turn is blank is asked of all of them, but only the last few are cleaned.
    told = F.when(F.col("role") == "assistant", F.regexp_replace("text", r"\[S\d+\]", " ")).otherwise(F.col("text")).rlike(f"[^{WS[1:]}")
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.where(F.col("role").isin("user", "assistant") & told).withColumn("__r", newest).where(F.col("__r") <= most_turns).withColumn("text", clean_turn(F.col("role"), F.col("text")))
    packed = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return packed.select("conv_id", F.explode(kept_turns(F.col("t"), budget)).alias("x")).select("conv_id", "x.*")


def client_history(turns: DataFrame, most_chars: int, keep_one: bool = True, most_turns: int = 1 << 30) -> DataFrame:
    """Whole turns from the newest while their characters stay within ``most_chars``; the newest always with keep_one.
    A running sum from the newest is exact here, as dropping the oldest never changes the others."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    sized = turns.withColumn("__n", F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.row_number().over(newest))
    fits = (F.col("__n") <= most_chars) & (F.col("__r") <= most_turns)
    return sized.where(fits | (F.lit(keep_one) & (F.col("__r") == 1))).drop("__n", "__r")


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): a line a turn with its speaker."""
    line = F.concat(F.when(F.col("role") == "user", "Visitor: ").otherwise("Assistant: "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("l"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("transcript"))
