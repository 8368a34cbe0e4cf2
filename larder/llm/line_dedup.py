"""Line dedup, native: explode normalised lines, hash, count documents per hash, drop
frequent lines except in the largest document, reassemble by position.

Plan: one pass emits (key hash, document, position) for the lines long enough to be
judged; the document count and the largest document per key are partially aggregated
before their shuffle, so a line that every document holds is no hot task; the join back
is an equi-join against one row per frequent key, whose many-rows side adaptive execution
splits. Only the positions to drop travel to the documents.

Defined results: a null or empty text is one empty line; a text of any length is split whole;
rows with an equal doc_id count as one document; rows with a null doc_id are never counted
and lose frequent lines; repeated rows each come back; an empty table gives no rows; input
columns named like the three that are added give way to them, others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import bound, durable, table

MIN_CHARS = 20
MIN_DOCS = 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; text that is ASCII throughout takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(min_chars: int):
    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(_SPACE))
        return F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(ascii_lower(k))))

    return key


def dropped_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS) -> DataFrame:
    """``(_id, _th, _drop)``: per document the positions of the lines that go."""
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_t"))
    lines = src.select("_id", "_th", F.posexplode(F.transform(_lines(F.col("_t")), _line_key(min_chars))).alias("_pos", "_key")).where(
        F.col("_key").isNotNull()
    )
    frequent = (
        lines.groupBy("_key")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_holder"))
        .where(F.col("_n") >= min_docs)
        .select("_key", "_holder")
    )
    # Written first, so that the join below reads two plain exchanges and its hot keys can be split.
    frequent = durable(frequent, "frequent")
    return (
        lines.join(frequent, "_key")
        .where(~F.col("_id").eqNullSafe(F.col("_holder")))
        .groupBy("_id", "_th")
        .agg(F.collect_set("_pos").alias("_drop"))
    )


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added; every row stays."""
    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    # The text is in the row only, so that the join's exchange holds it once.
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"))
    # The text side is hashed, not sorted.
    joined = left.join(drops.hint("shuffle_hash"), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    read = F.col("_row")[text_col]
    lines, whole = _lines(read), F.coalesce(read, F.lit(""))
    left_over = lambda all_lines: F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_drop"))
    text = bound(lines, lambda x: F.array_join(F.transform(left_over(x), lambda i: F.get(x, i)), "\n"))
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")],
        F.when(F.col("_drop").isNull(), whole).otherwise(text).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.doc_id, pos, line, (holder IS NOT NULL AND holder <> keyed.doc_id) AS gone
  FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
