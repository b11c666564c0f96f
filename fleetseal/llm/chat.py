"""Render a dialogue once from the place of every participant.

For each participant the dialogue is told with that speaker as the assistant and everybody else as a named user; only the
assistant's words are trained on. The result is a table of segments, one per (dialogue, perspective, turn), with the place of
each in the rendered dialogue: a dialogue of any length stays spread over many tasks, and joining the segments in order of
``start`` gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.operators.ordered import running

OPEN, CLOSE = "<|turn|>", "<|end|>"


def _plain(text: Column) -> Column:
    """Marks inside a text lose their meaning."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           spectators: tuple[str, ...] = ("system",), chunk: int = 64) -> DataFrame:
    """(dialogue, speaker, turn, role, segment, start, length, body_start, body_length, trained), a row per perspective and turn.

    Roles in ``spectators`` and turns without a role appear in every perspective but have none of their own, so a dialogue of
    spectators alone yields nothing. Turns are ordered by turn number (null first), role and text; repeated turns are kept. Null
    texts are empty, a null dialogue is a dialogue. ``start`` and ``length`` count characters; the mask of a segment
    is ``trained`` over [body_start, body_start + body_length), which takes in the end mark of the assistant's turns.
    """
    rows = turns.select(
        F.col(dialogue).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), _plain(F.col(text)).alias("body"))
    speakers = rows.filter(F.col("role").isNotNull() & ~F.col("role").isin(*spectators)).select(
        F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    told = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    named = F.regexp_replace(_plain(F.col("role")), r"[\r\n]", " ")
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).when(F.col("role").isNull(), F.lit("user"))
                    .when(F.col("role").isin(*spectators), named).otherwise(F.concat(F.lit("user "), named)), F.lit("\n"))
    told = told.withColumns({"trained": own, "__head": head}).withColumn(
        "segment", F.concat("__head", "body", F.lit(CLOSE + "\n"))).withColumns({
            "length": F.length("segment").cast("long"), "__skip": F.length("__head").cast("long"), "body_length": F.length("body").cast("long") + len(CLOSE)})
    placed = running(told.drop("body", "__head"), ["conv_id", "speaker"], ["turn", "role", "segment"],
                     {"__before": ("sum", F.col("length"))}, widths=(chunk,), inclusive=False)
    start = F.coalesce("__before", F.lit(0)).cast("long")
    return placed.select("conv_id", "speaker", "turn", "role", "segment", start.alias("start"), "length",
                         (start + F.col("__skip")).alias("body_start"), "body_length", "trained")
