"""Chat formatting by multi-party perspective rotation: for every participant the dialogue is rendered
with that speaker as the assistant and the others as named users, and only the speaker's own words
are trained on.

The output has a row for each perspective and turn, with its place in the rendered dialogue, so that a
dialogue of any length is dealt out over tasks; DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rotate(turns: DataFrame, *, block: int = 256) -> DataFrame:
    """For turns (conv_id, turn, role, text): conv_id, perspective, turn, role, seat (assistant or
    user), segment (the rendered turn), trained (whether the segment's words are the perspective's),
    start (of the segment, in characters of the rendered dialogue), mask_start and mask_end (what
    of the dialogue is trained on: the text and its end mark; both equal start in others' turns).

    Every role of a dialogue is a participant. Turns are in the order of turn, then role, then text;
    null turns come first, equal rows stay repeated. Null roles and texts count as empty, a null
    conv_id is one dialogue. Further columns are not kept. Places come from sums by blocks of
    `block` turn numbers, so no dialogue has to be in one task."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    speakers = said.select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = F.concat(F.lit(START), F.when(own, F.lit("assistant\n")).otherwise(F.concat(F.lit("user name="), "role", F.lit("\n"))))
    rows = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    rows = rows.withColumns({"_block": F.floor(F.col("turn") / block), "_head": F.length(head), "segment": F.concat(head, "text", F.lit(END + "\n"))})
    rows = rows.withColumns({"_size": F.length("segment").cast("long"), "_own": own}).repartition("conv_id", "perspective", "_block")
    inside = Window.partitionBy("conv_id", "perspective", "_block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))

    # lengths by block, from the turns alone
    sums = rows.groupBy("conv_id", "perspective", "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & F.col("_block").eqNullSafe(F.col("_b"))
    start = F.col("_before") + F.col("_inside")
    return rows.join(sums, same).select(
        *("conv_id", "perspective", "turn", "role"),
        F.when(F.col("_own"), "assistant").otherwise("user").alias("seat"),
        *("segment", F.col("_own").alias("trained"), start.alias("start")),
        F.when(F.col("_own"), start + F.col("_head")).otherwise(start).alias("mask_start"),
        F.when(F.col("_own"), start + F.col("_head") + F.length("text") + len(END)).otherwise(start).alias("mask_end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """Put the segments of each dialogue and perspective together: conv_id, perspective, text and
    masks (start, end). Each result is one string in one task, so this is for dialogues of bounded
    length; rotate() itself has no such bound."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment")))
    masks = F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end")))))
    return rotated.groupBy("conv_id", "perspective").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("text"), masks.alias("masks"))


#: rotate() in SQL, over a view `conversations`.
SQL = f"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
speakers as (select distinct conv_id, role as perspective from said),
seated as (select s.conv_id, perspective, turn, s.role, text, s.role = perspective as trained,
    '{START}' || case when s.role = perspective then 'assistant' else 'user name=' || s.role end || chr(10) as head
  from said s join speakers p on s.conv_id is not distinct from p.conv_id),
placed as (select *, head || text || '{END}' || chr(10) as segment,
    cast(coalesce(sum(length(head || text || '{END}' || chr(10))) over (partition by conv_id, perspective
      order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from seated)
select conv_id, perspective, turn, role, case when trained then 'assistant' else 'user' end as seat, segment, trained, start,
  case when trained then start + length(head) else start end as mask_start,
  case when trained then start + length(head) + length(text) + {len(END)} else start end as mask_end
from placed
"""
