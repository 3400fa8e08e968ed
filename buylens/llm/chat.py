"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

Every participant of a dialogue gets a rendering of it in which their own turns are the assistant's and all others are named users. The result has one row per
dialogue, participant and turn, with the place of the turn in the rendered text and of the part that a model is trained on, so no dialogue has to fit into one
row. ``rendered`` puts short dialogues together.

Offsets are running sums over rows dealt out by range: each part sums its own rows, and part totals, few per dialogue, are added. A dialogue with a third of all
turns is spread over many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNNAMED = "system", "unknown"


def _clean(text: Column) -> Column:
    """Text that can't be taken for a mark of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotated(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, turn, role, name, segment, start, mask_start, mask_end), offsets in code points of the rendered dialogue.

    ``mask_start`` .. ``mask_end`` are the participant's own text and its closing mark, null on other turns. A null or blank role speaks as ``unknown``, line ends in a role are spaces;
    ``system`` is no participant, and dialogues of it alone give no rows. Null texts are empty. Turns are ordered by turn (null first), speaker and text; repeated
    rows count once. A null conv_id is a dialogue like any other. Extra columns are not read; an empty table gives no rows.
    """
    # A name stands in the head of a turn: like a text it can hold no mark, and no line end.
    speaker = F.coalesce(F.nullif(F.trim(F.regexp_replace(_clean(F.col("role")), "[\\r\\n]+", " ")), F.lit("")), F.lit(UNNAMED))
    rows = turns.select("conv_id", "turn", speaker.alias("speaker"), _clean(F.col("text")).alias("text")).distinct()
    people = stored(rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct(), "people")
    rows = rows.alias("r").join(people.alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id"))).select("r.*", "perspective")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    order = ["conv_id", "perspective", "turn", "speaker", "text"]
    dealt = stored(rows.repartitionByRange(*order).withColumns({
        "part": F.spark_partition_id(), "role": role, "name": name, "head": F.length(head), "segment": F.concat(head, F.col("text"), F.lit(CLOSE + "\n"))}), "turns")
    before = Window.partitionBy("part", "conv_id", "perspective").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment").cast("bigint")
    inside = dealt.withColumns({"n": F.count(F.lit(1)).over(before), "at": F.coalesce(F.sum(size).over(before), F.lit(0))})
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part", "conv_id", "perspective").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    bases = stored(totals.select("part", "conv_id", "perspective", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_n"),
                                 F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base")), "bases")
    i, b = inside.alias("i"), bases.alias("b")
    same = (F.col("i.part") == F.col("b.part")) & F.col("i.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("i.perspective") == F.col("b.perspective"))
    start, mine = F.col("base") + F.col("at"), F.col("role") == "assistant"
    return i.join(b, same).select(
        "i.conv_id", "i.perspective", (F.col("base_n") + F.col("i.n")).alias("position"), "turn", "role", "name", "segment", start.alias("start"),
        F.when(mine, start + F.col("head")).alias("mask_start"), F.when(mine, start + size - 1).alias("mask_end"))


def rendered(segments: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """(conv_id, perspective, chunk, text, masks): the rendered dialogue, cut between turns into chunks of about ``longest`` code points.

    Masks are offsets in the whole dialogue. Most dialogues are one chunk; a huge one has many, so no row grows without bound.
    """
    chunk = F.floor(F.col("start") / longest).alias("chunk")
    turns = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_end"))).alias("turns")
    spans = F.transform(F.filter("turns", lambda t: t["mask_start"].isNotNull()), lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")))
    return segments.groupBy("conv_id", "perspective", chunk).agg(turns).select(
        "conv_id", "perspective", "chunk", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"), spans.alias("masks"))
