"""Preference pairs: a shared prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is rendered
once as the prompt. What follows on each side is its completion, with the character spans
that carry loss: the assistant's texts and their end marks.

All steps are grouped or windowed by pair, so a task needs one conversation at a time.

Defined results: turns are ordered by turn, then role and text, so repeated and tied turns
keep a fixed order; a null role is ``user``, a null text is empty; if one side is a prefix
of the other its completion is empty; equal sides have two empty completions; a missing
side is an empty conversation; null pair ids form one pair; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_MARK = "<|end|>"
SIDES = ("chosen", "rejected")


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(turn: Column) -> Column:
    """One turn as text; null for no turn."""
    return F.concat(header(turn["role"]), turn["text"], F.lit(f"{END_MARK}\n"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, and per side the completion and its mask (array of start, end).

    ``turns``: pair_id, side (``chosen`` or ``rejected``), turn, role, text.
    """
    clean = turns.where(F.col("side").isin(*SIDES)).select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    numbered = clean.withColumn("nth", F.row_number().over(order))
    turn = F.struct("role", "text")
    wide = numbered.groupBy("pair_id", "nth").agg(*[F.max(F.when(F.col("side") == s, turn)).alias(s) for s in SIDES])
    upto = Window.partitionBy("pair_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    equal = F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False)).cast("int")
    marked = wide.withColumn("common", F.min(equal).over(upto) == 1)
    texts = {s: render(F.col(s)) for s in SIDES}
    placed = marked.select(
        "pair_id", "nth", "common", F.when(F.col("common"), texts["chosen"]).alias("shared"),
        *[F.when(~F.col("common"), texts[s]).alias(f"{s}_text") for s in SIDES],
        *[(~F.col("common") & (F.col(s)["role"] == "assistant")).alias(f"{s}_learned") for s in SIDES],
    )
    spans = {}
    for s in SIDES:
        text = F.col(f"{s}_text")
        after = F.sum(F.coalesce(F.length(text), F.lit(0))).over(upto)
        start = after - F.length(text) + F.length(header(F.lit("assistant")))
        spans[f"{s}_span"] = F.when(F.col(f"{s}_learned"), F.struct(start.alias("start"), (after - 1).alias("end")))
    placed = placed.withColumns(spans)

    def joined(column: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("nth", F.col(column).alias("t")))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), "")

    def masks(side: str) -> Column:
        return F.sort_array(F.collect_list(f"{side}_span"))

    return placed.groupBy("pair_id").agg(
        F.sum(F.col("common").cast("bigint")).alias("n_common"), joined("shared").alias("prompt"),
        joined("chosen_text").alias("chosen"), masks("chosen").alias("chosen_mask"),
        joined("rejected_text").alias("rejected"), masks("rejected").alias("rejected_mask"),
    )


def replies_as_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of a pair per conversation (conv_id, turn, role, text) that has an assistant turn.

    Chosen: the turns up to the last assistant turn. Rejected: the same, answered at the
    end by the assistant's turn before (an empty text if there is none).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(order))
    reply = F.when(F.col("role") == "assistant", F.col("nth"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "final": F.max(reply).over(whole),
        "before": F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(earlier),
    }).where(F.col("nth") <= F.col("final"))
    other = F.when(F.col("nth") == F.col("final"), F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text")), F.struct(F.lit("rejected").alias("side"), other.alias("text")))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("nth").alias("turn"), "role", F.explode(sides).alias("s")).select(
        "pair_id", "s.side", "turn", "role", "s.text")
