"""Preference pairs: the common prompt of a chosen and a rejected conversation, and their masked completions (operator 1).

Input rows are turns: pair_id, side ('chosen' or 'rejected'), turn, role, text.
The prompt is the longest run of turns from the start in which both sides have the
same turn numbers, roles and texts; it is rendered once. What follows on either
side is its completion. Output rows are rendered segments, one a turn, with their
place in the rendered string and a loss mask: 1 for the assistant's turns of a
completion, 0 for the rest. Rows, not strings, so that a conversation of any
length is never gathered in one task; ``strings`` joins them for callers who know
that theirs are short.

Places come from sums in two steps: over blocks of ``BLOCK`` turn numbers, then
within each, so a pair that holds a third of all rows is dealt out too.

Nulls and edges: a row with a null pair_id, side or turn is left out, as is one
of another side; a null role or text renders as empty. Of rows that repeat a
(pair, side, turn) the least (role, text) counts. A pair with one side only has an
empty prompt and one completion. If one side is the other's beginning, its
completion is empty. Texts are rendered whole, however long. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>\n"  # fixed values of the chat format


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, role, rendered, char_start, char_end, loss_mask.

    Places count from the start of the prompt; either completion follows it.
    """
    empty = F.lit("")
    rows = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    rows = rows.groupBy("pair_id", "turn", "side").agg(F.min(F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))).alias("m"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("m")))
    both = rows.groupBy("pair_id", "turn").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    parts = both.withColumn("same", F.col("c").isNotNull() & F.col("r").isNotNull() & (F.col("c") == F.col("r")))
    parts = parts.withColumn("block", F.floor(F.col("turn") / BLOCK))
    # what is known of a pair is a row for each of its blocks, so that a large pair's turns meet it block by block
    split = parts.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("split"), F.collect_set("block").alias("block"))
    split = split.select("pair_id", "split", F.explode("block").alias("block"))
    placed = parts.join(split, ["pair_id", "block"]).withColumn("prompt", F.col("split").isNull() | (F.col("turn") < F.col("split")))
    piece = F.explode(F.when(F.col("prompt"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("m")))).otherwise(F.array(F.struct(F.lit("chosen").alias("part"), F.col("c").alias("m")), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("m")))))
    pieces = placed.select("pair_id", "block", "turn", piece.alias("x")).where("x.m is not null").select("pair_id", "block", "turn", "x.part", "x.m.role", rendered(F.col("x.m.role"), F.col("x.m.text")).alias("rendered"))
    pieces = pieces.withColumn("n", F.length("rendered").cast("long"))

    blocks = pieces.groupBy("pair_id", "part", "block").agg(F.sum("n").alias("size"))
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prompt = F.coalesce(F.sum(F.when(F.col("part") == "prompt", F.col("size"))).over(Window.partitionBy("pair_id")), F.lit(0))
    blocks = blocks.select("pair_id", "part", "block", earlier.alias("before"), prompt.alias("prompt_size"))
    within = F.sum("n").over(Window.partitionBy("pair_id", "part", "block").orderBy("turn"))
    out = pieces.withColumn("within", within).join(blocks, ["pair_id", "part", "block"])
    end = F.col("before") + F.col("within") + F.when(F.col("part") == "prompt", 0).otherwise(F.col("prompt_size"))
    mask = ((F.col("part") != "prompt") & (F.col("role") == "assistant")).cast("int")
    return out.select("pair_id", "part", "turn", "role", "rendered", (end - F.col("n")).alias("char_start"), end.alias("char_end"), mask.alias("loss_mask"))


def strings(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected as strings, with the masked ranges of both completions. For pairs of bounded length."""
    joined = lambda p: F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("turn", "rendered")))), lambda s: s["rendered"]), ""), F.lit(""))
    spans = lambda p: F.array_sort(F.collect_list(F.when((F.col("part") == p) & (F.col("loss_mask") == 1), F.struct("char_start", "char_end"))))
    return segments.groupBy("pair_id").agg(joined("prompt").alias("prompt"), joined("chosen").alias("chosen"), joined("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def stale_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation; rejected has its last assistant turn answered with its first assistant turn's text again, or with nothing if that is the same turn.

    A conversation without an assistant turn gives no pair and is left out.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    said = turns.where("role = 'assistant' and turn is not null")
    ends = said.groupBy("pair_id").agg(F.min(F.struct("turn", "text")).alias("first"), F.max("turn").alias("last")).select("pair_id", "last", F.when(F.col("first.turn") < F.col("last"), F.col("first.text")).otherwise("").alias("stale"))
    rejected = turns.join(ends, "pair_id").select("pair_id", "turn", "role", F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("stale")).otherwise(F.col("text")).alias("text"))
    return turns.join(ends.select("pair_id"), "pair_id", "left_semi").withColumn("side", F.lit("chosen")).unionByName(rejected.withColumn("side", F.lit("rejected")))


SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
ends AS (SELECT pair_id, last, CASE WHEN first.turn < last THEN first.text ELSE '' END AS stale FROM (
  SELECT pair_id, min({'turn': turn, 'text': text}) AS first, max(turn) AS last FROM t WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY pair_id)),
sides AS (SELECT pair_id, turn, role, text, 'chosen' AS side FROM t WHERE pair_id IN (SELECT pair_id FROM ends)
  UNION ALL SELECT pair_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN stale ELSE text END, 'rejected' FROM t JOIN ends USING (pair_id)),
rows_ AS (SELECT pair_id, turn, side, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS m FROM sides WHERE pair_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
both_ AS (SELECT pair_id, turn, max(m) FILTER (side = 'chosen') AS c, max(m) FILTER (side = 'rejected') AS r FROM rows_ GROUP BY ALL),
split AS (SELECT pair_id, min(turn) FILTER (c IS NULL OR r IS NULL OR c <> r) AS split FROM both_ GROUP BY pair_id),
pieces AS (SELECT pair_id, turn, 'prompt' AS part, c AS m FROM both_ JOIN split USING (pair_id) WHERE split IS NULL OR turn < split
  UNION ALL SELECT pair_id, turn, 'chosen', c FROM both_ JOIN split USING (pair_id) WHERE turn >= split AND c IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', r FROM both_ JOIN split USING (pair_id) WHERE turn >= split AND r IS NOT NULL),
texts AS (SELECT pair_id, turn, part, m.role AS role, '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10) AS rendered FROM pieces),
placed AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn) + CASE WHEN part = 'prompt' THEN 0 ELSE
  coalesce(sum(CASE WHEN part = 'prompt' THEN length(rendered) END) OVER (PARTITION BY pair_id), 0) END AS char_end FROM texts)
SELECT pair_id, part, turn, role, rendered, CAST(char_end - length(rendered) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS loss_mask FROM placed"""
