"""Chat formatting by perspective rotation, as DataFrame expressions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users. A rendered dialogue is a sequence of segments with character offsets and a training mask: only
what the perspective's speaker says is trained on. Segments stay rows, so that no conversation, however long, has to fit
into one task: offsets are running sums inside ranges of turns plus the offsets of the ranges. :func:`dialogues` joins the
segments of conversations into whole texts.

System messages are no participants; they stay system segments of every perspective, and a conversation of nothing
else has no perspective. A null role is the speaker ``unknown``; a null text is empty; a null turn comes first; rows without a conversation id form one conversation. Turns that occur twice follow each other by role and text, and
repeated rows stay. Marks of headers in texts and names are escaped (``<|`` becomes ``<\\|``), so that no text forges a turn. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = ("system",)
UNKNOWN = "unknown"
#: Turn numbers that form a range.
RANGE = 128


def _escaped(text: Column) -> Column:
    """A backslash into each opening mark, and one more where there are some: no text opens a header, and taking one out gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def rendered(speaker: Column, perspective: Column, text: Column) -> tuple[Column, Column]:
    """(header, whole segment); ``text`` is escaped already. In names closing marks are escaped too."""
    name = F.regexp_replace(_escaped(speaker), r"\|(\\*)>", r"|\\$1>")
    user = F.concat(F.lit("<|user name="), name, F.lit("|>\n"))
    system = F.concat(F.lit("<|"), speaker, F.lit("|>\n"))
    header = F.when(speaker == perspective, "<|assistant|>\n").when(speaker.isin(*SYSTEM), system).otherwise(user)
    return header, F.concat(header, text, F.lit("\n"))


def segments(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, perspective, turn, speaker, segment, seg_start, seg_end, mask_start, mask_end, trained)."""
    given = {"_c": F.col(conv_col), "_t": F.col(turn_col), "_s": F.coalesce(F.col(role_col), F.lit(UNKNOWN)), "_x": _escaped(F.coalesce(F.col(text_col), F.lit("")))}
    rows = df.select(*(c.alias(n) for n, c in given.items()))
    people = rows.filter(~F.col("_s").isin(*SYSTEM)).select(F.col("_c").alias("_pc"), F.col("_s").alias("_p")).distinct()
    rows = rows.join(people, rows["_c"].eqNullSafe(people["_pc"])).drop("_pc")
    header, segment = rendered(F.col("_s"), F.col("_p"), F.col("_x"))
    rows = rows.withColumns({"_head": F.length(header), "segment": segment, "_r": F.floor(F.coalesce("_t", F.lit(-1)) / RANGE)}).withColumn("_n", F.length("segment").cast("bigint"))
    inside = Window.partitionBy("_c", "_p", "_r").orderBy(F.col("_t").asc_nulls_first(), "_s", "_x").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_c", "_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_c", "_p", "_r").agg(F.sum("_n").alias("_all")).withColumn("_o", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    offsets = offsets.select(*(F.col(c).alias("o" + c) for c in ("_c", "_p", "_r")), "_o")
    rows = rows.withColumn("_i", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    both = rows.join(offsets, rows["_c"].eqNullSafe(offsets["o_c"]) & (rows["_p"] == offsets["o_p"]) & (rows["_r"] == offsets["o_r"]))
    start, own = F.col("_o") + F.col("_i"), F.col("_s") == F.col("_p")
    return both.select(
        F.col("_c").alias(conv_col), F.col("_p").alias("perspective"), F.col("_t").alias(turn_col), F.col("_s").alias("speaker"), "segment", start.alias("seg_start"), (start + F.col("_n")).alias("seg_end"),
        F.when(own, start + F.col("_head")).alias("mask_start"), F.when(own, start + F.col("_n")).alias("mask_end"), own.alias("trained"),
    )


def dialogues(found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, perspective, text, masks): whole texts from :func:`segments`, for conversations that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("seg_start", "segment", "mask_start", "mask_end")))
    text = F.array_join(F.transform("_l", lambda x: x["segment"]), "")
    masks = F.transform(F.filter("_l", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return found.groupBy(conv_col, "perspective").agg(parts.alias("_l")).select(conv_col, "perspective", text.alias("text"), masks.alias("masks"))
