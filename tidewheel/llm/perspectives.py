"""Operator 1: chat formatting, the dialogue from every participant's side.

For each participant of a conversation all its turns are rendered with that
speaker as assistant and the others as named users; turns of role `system` stay
system, and nobody speaks from its side. A mask marks what the model should
learn: the content and end mark of the assistant's own turns.

Output is one row for each turn and side, with its rendered text, its place in
the side's whole rendering and its mask; assemble() puts texts together in parts
of a bounded number of turns. So a conversation of any length is spread over
tasks: turns are numbered in chunks of CHUNK by their turn value, chunk sums are
added up, and only one number a chunk meets in one place. Sides of a
conversation are its distinct speakers.

Defined cases: marks inside a text or role are escaped, as is a line break in a
role, so neither can forge a turn; null text is empty; a null role is the speaker
`unknown`; turns with a null conversation form one conversation of their own,
null turns come first; repeated rows are repeated turns; a conversation without
any participant but `system` has no side and no rows; other columns are not read.
Ties of turn follow speaker, then text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"
CHUNK = 64
#: The marks of the rendered format.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """text with a backslash put into every mark that it spells, so that none opens or ends a turn; taking one out gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def sides(turns: DataFrame) -> DataFrame:
    """(conv_id, side): every participant of every conversation."""
    return turns.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("side")).distinct()


def header(speaker: Column, side: Column) -> Column:
    role = F.when(speaker == SYSTEM, F.lit("system")).when(speaker == side, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.replace(escaped(speaker), F.lit("\n"), F.lit("\\n"))))
    return F.concat(F.lit(START), role, F.lit("\n"))


def perspectives(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, side, turn, turn_no, part, rendered, begin, mask_begin, mask_end) of every turn and side.

    begin is the text's first code point in the side's rendering; the mask runs
    from mask_begin to mask_end there (both null for turns of others). part counts
    chunks of turns.
    """
    turns = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), escaped(F.coalesce(text, F.lit(""))).alias("text")
    )
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    who = sides(turns)
    # a side's length of a turn is its text, the marks and the header; the header depends on side and speaker only
    both = turns.join(who.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    both = both.withColumn("head", header(F.col("speaker"), F.col("side"))).withColumn("size", F.length("head") + F.length("text") + F.lit(len(END)))
    chunks = both.groupBy("conv_id", "side", "chunk").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id", "side").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(F.col("conv_id").alias("c"), F.col("side").alias("w"), F.col("chunk").alias("k"), F.coalesce(F.sum("s").over(order), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("conv_id", "side", "chunk").orderBy("turn", "speaker", "text")
    sum_before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = both.withColumn("b", sum_before).withColumn("no", F.row_number().over(inside) - 1)
    placed = numbered.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("side") == F.col("w")) & (F.col("chunk") == F.col("k")))
    begin = (F.col("s0") + F.col("b")).cast("long")
    own = F.col("speaker") == F.col("side")
    return placed.select(
        "conv_id",
        "side",
        "turn",
        (F.col("n0") + F.col("no")).cast("long").alias("turn_no"),
        F.floor((F.col("n0") + F.col("no")) / CHUNK).cast("long").alias("part"),
        F.concat("head", "text", F.lit(END)).alias("rendered"),
        begin.alias("begin"),
        F.when(own, begin + F.length("head")).alias("mask_begin"),
        F.when(own, begin + F.col("size")).alias("mask_end"),
    )


def assemble(rows: DataFrame) -> DataFrame:
    """(conv_id, side, part, begin, text, masks): the rendering in parts of at most CHUNK turns."""
    one = F.struct("turn_no", "rendered", "mask_begin", "mask_end")
    parts = rows.groupBy("conv_id", "side", "part").agg(F.min("begin").alias("begin"), F.array_sort(F.collect_list(one)).alias("t"))
    masks = F.transform(F.filter("t", lambda x: x["mask_begin"].isNotNull()), lambda x: F.struct(x["mask_begin"].alias("begin"), x["mask_end"].alias("end")))
    return parts.select("conv_id", "side", "part", "begin", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"), masks.alias("masks"))


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)  # noqa: E731  turns of others have no mask
    return perspectives(table(spark, sf_dir, "conversations")).select("conv_id", "side", "turn", "turn_no", "begin", none("mask_begin"), none("mask_end"), F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g')"

QUERIES = {"op1_perspectives": op1_perspectives}
ORACLE = {
    "op1_perspectives": f"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, {_ESCAPED.format("coalesce(text, '')")} AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, speaker AS side FROM t WHERE speaker <> '{SYSTEM}'),
h AS (SELECT t.*, side, '{START}' || CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = side THEN 'assistant' ELSE 'user name=' || replace({_ESCAPED.format('speaker')}, chr(10), '\\n') END || chr(10) AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (SELECT *, head || text || '{END.strip()}' || chr(10) AS rendered FROM h),
p AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS turn_no,
             CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin"
      FROM r WINDOW w AS (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, side, turn, turn_no, "begin",
       CASE WHEN speaker = side THEN "begin" + length(head) ELSE -1 END AS mask_begin,
       CASE WHEN speaker = side THEN "begin" + length(rendered) ELSE -1 END AS mask_end,
       CAST(length(rendered) AS BIGINT) AS n_chars, sha256(rendered) AS rendered_sha256
FROM p
"""
}
