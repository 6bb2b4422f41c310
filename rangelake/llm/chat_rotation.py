"""Perspective rotation of dialogues: every participant in turn becomes the assistant, the others named users.

The rendering of a dialogue from one perspective is a sequence of pieces, one a turn, each with its place in the whole
string and the part of it to learn from. A dialogue is never gathered into one row or task: places are running sums over
stretches of turns, added to sums over the stretches before. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose running sum is computed in one window.
STRETCH = 256
SYSTEM = "system"


def rotate(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, perspective, turn, role, name, piece, start, end, mask_start, mask_end of turns (conv_id, turn, role, text).

    Participants are the distinct non-null roles except ``system``; dialogues without one give no rows. A piece is
    ``<|role|>`` or ``<|user:name|>``, a line end, the text, ``<|end|>`` and a line end. The perspective's own turns are
    ``assistant``, their text and end mark are the mask (code points, end exclusive); other pieces have a null mask.
    Turns are ordered by turn, role and text, nulls first; null texts are empty; a null role speaks as a user of no
    name; turns under a null conv_id are one dialogue. Wholly repeated rows count once. Further columns are left out.
    """
    once = turns.select("conv_id", "turn", "role", "text").distinct()
    speakers = once.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    own = F.col("role").eqNullSafe(F.col("perspective"))
    role: Column = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    head = F.when(role == "user", F.concat(F.lit("<|user:"), F.coalesce("role", F.lit("")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))
    told = F.concat(F.coalesce("text", F.lit("")), F.lit("<|end|>"))
    pieces = (
        once.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("_head", F.char_length(head))
        .withColumn("piece", F.concat(head, told, F.lit("\n")))
        .withColumn("_size", F.char_length("piece").cast("long"))
        .withColumn("_stretch", F.floor(F.col("turn") / stretch))
        .select("conv_id", "perspective", "turn", role.alias("role"), F.when(role == "user", F.col("role")).alias("name"), F.col("role").alias("_role"), "text", "piece", "_head", "_size", "_stretch", own.alias("_own"))
    )
    within = Window.partitionBy("conv_id", "perspective", "_stretch").orderBy("turn", "_role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_c", "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        pieces.groupBy(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_stretch").alias("_s")).agg(F.sum("_size").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    )
    placed = pieces.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(
        sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & F.col("_stretch").eqNullSafe(F.col("_s"))
    )
    start = F.col("_base") + F.col("_in")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "piece", start.alias("start"), (start + F.col("_size")).alias("end"),
        F.when(F.col("_own"), start + F.col("_head")).alias("mask_start"), F.when(F.col("_own"), start + F.col("_size") - 1).alias("mask_end"),
    )
