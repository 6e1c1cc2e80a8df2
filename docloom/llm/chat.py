"""Multi-party perspective rotation: each participant's view of a dialogue, that speaker as assistant, others as named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import settled

SYSTEM = "system"
NAMELESS = "unknown"


def unmarked(c: Column) -> Column:
    """A backslash between the characters of each mark that a name or text holds, so that none opens or ends a turn."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, participant and turn: the segment as that participant's view renders it.

    Columns: conv_id, perspective, seq (from 0), turn, role (assistant, user or system), name (of a user), segment,
    start_char and end_char (of the segment in the view, gapless from 0), mask_start and mask_end (of the text to learn
    in the view: the assistant's, with the end mark; empty elsewhere). The segments of a view in order of seq are its
    dialogue; they stay rows, as a dialogue may be of any size.

    Participants are all speakers but ``system``, whose turns every view shows as such. Turns are in order of turn,
    speaker and text, null turns first; repeated rows stay. Marks inside names and texts are broken by a backslash. A null speaker is called unknown, a null text is
    empty; rows without a conversation belong to no dialogue and give no rows, nor do conversations that only the
    system speaks in. Other columns are not looked at.

    Positions are sums within (conversation, partition of the range-sorted turns) plus the totals of the partitions
    before, so that one long conversation is many tasks' work.
    """
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit(NAMELESS))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["turn", "speaker", "text"]
    rows = rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    rows = settled(rows)
    people = rows.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("view")).distinct()
    views = rows.select("conv", "part").distinct().join(people, "conv")
    shown = rows.join(views, ["conv", "part"])
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("view"), "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), unmarked(name)), F.lit("")), F.lit("|>\n"))
    shown = shown.select("conv", "view", "part", *order, role.alias("role"), name.alias("name"), head.alias("head"), F.concat(head, unmarked(F.col("text")), F.lit("<|end|>\n")).alias("segment"))
    shown = shown.withColumn("size", F.length("segment").cast("long"))
    here = Window.partitionBy("conv", "view", "part").orderBy(*order)
    local = shown.withColumn("row", F.row_number().over(here) - 1).withColumn("until", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    totals = shown.groupBy("conv", "view", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))
    before = Window.partitionBy("conv", "view").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "view", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"))
    out = local.join(totals, ["conv", "view", "part"])
    end = F.col("chars") + F.col("until")
    learn = F.when(F.col("role") == "assistant", end - F.col("size") + F.length("head")).otherwise(end)
    return out.select(F.col("conv").alias("conv_id"), F.col("view").alias("perspective"), (F.col("rows") + F.col("row")).alias("seq"), "turn", "role", "name", "segment", (end - F.col("size")).alias("start_char"), end.alias("end_char"), learn.alias("mask_start"), end.alias("mask_end"))


UNMARKED = "replace(replace({0}, '<|', '<\\|'), '|>', '|\\>')"

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{NAMELESS}') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
s AS (SELECT t.*, p.perspective, CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN p USING (conv_id)),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || {UNMARKED.format('speaker')} ELSE '' END || '|>' || chr(10) AS head FROM s),
g AS (SELECT *, head || {UNMARKED.format('text')} || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS seq, (sum(length(segment)) OVER w)::BIGINT AS end_char
      FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, role, name, segment, end_char - length(segment) AS start_char, end_char,
       CASE WHEN role = 'assistant' THEN end_char - length(segment) + length(head) ELSE end_char END AS mask_start, end_char AS mask_end
FROM o"""
