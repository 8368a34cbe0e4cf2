"""Chat formatting, native: cumulative-snapshot collapse, then rendering.

Logged conversations often repeat a shorter snapshot of themselves. Every turn gets the
rolling hash of its prefix (position, role and text of all turns up to it, combined
by XOR of two 64-bit hashes, which a window can carry); a conversation whose last
prefix hash is a proper prefix hash of a longer one, or which equals one with a smaller
id, is removed by anti-joins. Prefix hashes are reduced to one row each before they are
joined, so a first turn that most conversations share is no hot key. Only the
conversations that stay are rendered.

Rows without a conv_id can't be told to belong together: each is a conversation of one turn,
and meets no window, so any number of them is spread over all tasks.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated rows are
turns like any other; a null role renders as ``user`` and a null text as empty, but a null
differs from an empty text when prefixes are compared; of equal conversations the one with
the smallest id stays, one without an id only if none of them has one; an empty table gives
no rows; texts of any length are rendered whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import table

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def _hashes(pos: Column) -> list[Column]:
    """Two hashes of a turn at its position."""
    null_mark = [F.col(c).isNull() for c in ("role", "text")]
    return [F.xxhash64(pos, "role", "text", *null_mark), F.xxhash64("text", *null_mark, "role", pos)]


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` with position, prefix hashes and length."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"))
    h1, h2 = [F.bit_xor(h).over(upto) for h in _hashes(F.col("pos"))]
    named = named.select("*", h1.alias("h1"), h2.alias("h2"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"))
    h1, h2 = _hashes(F.lit(1))
    lone = turns.where("conv_id IS NULL").select("conv_id", "turn", "role", "text", F.lit(1).alias("pos"), h1.alias("h1"), h2.alias("h2"), F.lit(1).cast("long").alias("n_turns"))
    return named.unionByName(lone)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_logged, h1, h2)``: conversations that prefix no other one.

    ``n_logged`` counts the equal conversations the kept one stands for, itself included.
    """
    p = turn_prefixes(turns)
    ends = p.where(F.col("pos") == F.col("n_turns")).groupBy("n_turns", "h1", "h2")
    ends = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    inner = p.where(F.col("pos") < F.col("n_turns")).select(F.col("pos").cast("long").alias("n_turns"), "h1", "h2").distinct()
    return ends.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_logged", "h1", "h2")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, n_logged, rendered``."""
    turns = turns.select("conv_id", "turn", "role", "text")
    keep = maximal_conversations(turns)
    line = F.concat(
        F.lit(TURN_OPEN), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_CLOSE)
    )
    named = keep.where("conv_id IS NOT NULL").select("conv_id", "n_turns", "n_logged")
    kept = turns.withColumn("_line", line).join(named, "conv_id")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "_line")))
    out = kept.groupBy("conv_id").agg(
        F.first("n_turns").cast("long").alias("n_turns"),
        F.first("n_logged").cast("long").alias("n_logged"),
        F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n").alias("rendered"),
    )
    h1, h2 = _hashes(F.lit(1))
    said = turns.where("conv_id IS NULL").select(h1.alias("h1"), h2.alias("h2"), line.alias("rendered")).dropDuplicates(["h1", "h2"])
    lone = keep.where("conv_id IS NULL").join(said, ["h1", "h2"]).select("conv_id", "n_turns", "n_logged", "rendered")
    return out.unionByName(lone)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH ided AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone FROM conversations
), t AS (
  SELECT conv_id, lone, turn, role, text,
    row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    count(*) OVER (PARTITION BY conv_id, lone) AS n
  FROM ided
), p AS (
  SELECT a.conv_id, a.lone, a.pos, a.n,
    list([coalesce('=' || b.role, '-'), coalesce('=' || b.text, '-')] ORDER BY b.pos) AS prefix
  FROM t a JOIN t b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.lone = b.lone AND b.pos <= a.pos
  GROUP BY a.conv_id, a.lone, a.pos, a.n
), ends AS (
  SELECT prefix, min(conv_id) AS conv_id, min(lone) AS lone, count(*) AS n_logged FROM p WHERE pos = n GROUP BY prefix
), kept AS (
  SELECT conv_id, lone, n_logged FROM ends
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.prefix = ends.prefix)
)
SELECT t.conv_id, count(*) AS n_turns, any_value(n_logged) AS n_logged,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) ORDER BY pos) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id AND t.lone = kept.lone GROUP BY t.conv_id, t.lone
"""
