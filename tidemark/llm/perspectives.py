"""Chat formatting: a dialogue seen by each of its participants in turn.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named users. The
result has a row for each turn of each perspective: its rendered text, where that stands in the whole rendering, and the
part of it that is to be learned, which is what the participant says, with the end mark. A rendering is the
concatenation of its rows in order of ``position``; ``render`` makes it for dialogues of bounded length.

System turns belong to no participant and are rendered as such. A null or blank role is the participant ``unknown``; a
null text is empty. No text or role can forge a mark: a mark inside a text gets a space behind its bar, and in a role marks
and line ends become spaces. Turns are ordered by number (nulls first), then role and text, so ties have a defined order; repeated
rows are turns of their own. A dialogue of system turns alone has no perspective. Null dialogue ids are one dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, ordered_parts

START, END = "<|im_start|>", "<|im_end|>"  #: fixed marks of the chat format
FORGED, FORGED_ROLE = r"<\|(im_start|im_end)\|>", r"<\|im_start\|>|<\|im_end\|>|[\r\n]+"


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conversation, perspective, position, turn, speaker, rendered, char_start, char_end, learn_start, learn_end)."""
    scratch = Scratch(turns.sparkSession, "perspectives")
    name = F.trim(F.regexp_replace(role_col, FORGED_ROLE, " "))
    speaker = F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))
    text = F.regexp_replace(F.coalesce(text_col, F.lit("")), FORGED, "<| $1|>")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), text.alias("text"))
    order = ["turn", "speaker", "text"]
    # parts of the ordered turns keep running totals out of single tasks, however long a dialogue is
    placed = ordered_parts(scratch, rows, "conv", *order)
    seen = placed.where("speaker <> 'system'").select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    every = placed.join(seen, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("assistant")).when(F.col("speaker") == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), "speaker"))
    every = every.withColumn("rendered", F.concat(F.lit(START), head, F.lit("\n"), "text", F.lit(END + "\n")))
    every = every.withColumns({"own": own, "size": F.length("rendered").cast("long")})
    totals = every.groupBy("conv", "perspective", "part").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    w = Window.partitionBy("conv", "perspective").orderBy("part")
    before = totals.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("q"), (F.sum("chars").over(w) - F.col("chars")).alias("chars"), (F.sum("turns").over(w) - F.col("turns")).alias("turns"))
    w = Window.partitionBy("conv", "perspective", "part").orderBy(*order)
    every = every.withColumns({"here": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(w)})
    out = every.join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("q")))
    end = F.col("chars") + F.col("here")
    learn: Column = F.when(F.col("own"), end - F.length("text") - F.lit(len(END) + 1))
    return out.select(
        F.col("conv").alias(conv_col), "perspective", (F.col("turns") + F.col("k") - 1).alias("position"), F.col("turn").alias(turn_col), "speaker", "rendered",
        (end - F.col("size")).alias("char_start"), end.alias("char_end"), learn.alias("learn_start"), F.when(F.col("own"), end - 1).alias("learn_end"),
    )


def render(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The whole rendering of each perspective, with its masks as an array of (start, end): for dialogues of bounded length."""
    turns = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    spans = F.array_sort(F.collect_list(F.when(F.col("learn_start").isNotNull(), F.struct("learn_start", "learn_end"))))
    return rows.groupBy(conv_col, "perspective").agg(F.array_join(F.transform(turns, lambda t: t.rendered), "").alias("text"), spans.alias("learn"))
