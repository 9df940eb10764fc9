"""Chat formatting: multi-party perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns become assistant turns, all others
become turns of named users, system turns stay. The mask lists the spans of the rendered text that belong to
the assistant and are to be learnt (its words and the end marker).

A dialogue is rendered in parts of ``PART`` turn numbers, and a part in pieces of at most ``PART`` rows, so no
group grows with a dialogue; nearly all dialogues are one piece. Spans count from the start of the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PART = 1024
SYSTEM = ("system",)
START, END = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"


def _safe(text: Column) -> Column:
    """Text that holds no marker: each ``<|`` is parted by a blank."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(role, r"[\s<>|=]", "_")


def rotate_perspectives(turns: DataFrame, system: tuple[str, ...] = SYSTEM, part: int = PART) -> DataFrame:
    """``conv_id, participant, part, piece, n_turns, text, mask`` from ``turns (conv_id, turn, role, text)``.

    ``mask`` is an array of ``start, end`` in code points, the end exclusive. Turns go by number, ties by role and
    text; NULL numbers come last, in a part of their own. A NULL role is the speaker ``unknown``, a NULL text
    is empty. A turn without ``conv_id`` is a dialogue of its own. A dialogue of system turns only has no
    participant and gives no row; a participant who is silent in a piece gets it with an empty mask. Repeated
    rows are turns like any other. White space and marker characters in names become ``_``.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        "conv_id",
        alone.alias("alone"),
        F.floor(F.col("turn") / part).alias("part"),
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id", "alone", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("piece", F.floor((F.col("n") - 1) / part))
    pieces = rows.groupBy("conv_id", "alone", "part", "piece").agg(
        F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns")
    )
    speakers = turns.filter("conv_id is not null").select("conv_id", F.coalesce("role", F.lit(UNKNOWN)).alias("role"))
    speakers = speakers.distinct().groupBy(F.col("conv_id").alias("of")).agg(F.collect_list("role").alias("roles"))
    pieces = pieces.join(speakers, F.col("conv_id") == F.col("of"), "left")
    roles = F.coalesce("roles", F.array_distinct("turns.role"))
    others = F.filter(roles, lambda r: ~r.isin(*system))
    seen = pieces.select("conv_id", "part", "piece", "turns", F.explode(others).alias("participant"))

    mine = F.col("participant")

    def head(t: Column) -> Column:
        role = F.when(t["role"].isin(*system), F.lit("system"))
        role = role.when(t["role"] == mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), _name(t["role"])))
        return F.concat(F.lit(START), role, F.lit("\n"))

    rendered = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"), F.concat(_safe(t["text"]), F.lit(END)).alias("body"), (t["role"] == mine).alias("own")
        ),
    )
    seen = seen.withColumn("shown", rendered)
    spans = "array<struct<start:bigint,end:bigint>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        # the line break after the end marker belongs to no turn
        return F.struct((end + 1).alias("at"), F.when(t["own"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    mask = F.aggregate("shown", begin, step, lambda a: a["spans"])
    return seen.select(
        "conv_id",
        "participant",
        "part",
        "piece",
        F.size("turns").cast("bigint").alias("n_turns"),
        text.alias("text"),
        mask.alias("mask"),
    )
