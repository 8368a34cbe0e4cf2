"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

The filtering stages keep every document that they have no reason to reject; stages that
change texts keep ``n_chars`` right.

Defined results, beside those that the stages' operators tell: a null or empty text, or one
without a letter, has no language and goes in the first stage; a null lang or source is
carried along; rows with a null doc_id are no near duplicates of others and are else told
apart by their texts; of a near-duplicate group the smallest id stays, of equal ids one text
and of repeated rows one; very long texts are judged and encoded whole; an empty table, or one of which nothing is left, gives no rows;
columns beside those of documents are carried to the last stage but one, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.tables import delete, scratch
from larder.llm.common import shared_dir, table
from larder.llm.decontaminate import drop_contaminated
from larder.llm.language_id import UND, fit, held_out, identify
from larder.llm.line_dedup import dedup_lines
from larder.llm.sentencepiece_codec import encode_pieces
from larder.llm.simhash import drop_near_duplicates


#: Rows of whole texts that go to a Python worker at once, where the session does not say how many.
BATCH_ROWS = 1000


def _narrow_batches(spark: SparkSession) -> None:
    """Documents are wide rows: ten thousand at a time, copied on both sides, fill an executor."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, BATCH_ROWS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; without a letter or between languages they go."""
    _narrow_batches(spark)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    told = identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, id_col="row")
    return told.where((F.col("lang_pred") != UND) & ~F.col("ambiguous")).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents share."""
    out = dedup_lines(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, the byte ends of their spans, and whether they decode to the text."""
    _narrow_batches(spark)
    out = encode_pieces(docs.select(F.struct("doc_id", "lang", "source", "text").alias("row"), "text"), id_col="row")
    whole = F.coalesce(F.col("row.text"), F.lit(""))
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", (F.col("decoded") == whole).alias("round_trip"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Classifier, fingerprints and encoder are not SQL; the tests hold run()'s rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes when the next one has written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(before)
        before = path
    return docs
