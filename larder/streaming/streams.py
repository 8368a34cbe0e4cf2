"""Stream jobs that reuse the batch code.

Checkpoints and outputs lie where the caller says, in storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions.exprs import js_round, portion_or_one
from larder.functions.tables import durable, scratch
from larder.operators.classify import TOLD, coded, tell, vocabulary_of, with_told
from larder.operators.history import scan_key
from larder.operators.labels import parse_labels
from larder.operators.score import score_products

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_WORDS = "batch int, family string, norm string, code string, " + ", ".join(f"{c} string" for c in TOLD)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB and write what a batch changed."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stream_scores(products: DataFrame, lex: dict[str, DataFrame], out: str, checkpoint: str, words: str) -> StreamingQuery:
    """Scores products as they land; each micro-batch is one batch job and one output folder,
    and what it wrote on the way goes with it.

    What the lexicon tells of a word is kept in the folder ``words``, by batch: only words
    that no earlier batch had meet the lexicon, and a batch of known words joins no grams. A
    batch that is run again writes its own words again. Another lexicon needs another folder.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch():
            rows = durable(coded(parse_labels(batch, "product_id", "ingredients_text", "product_type")), "ingredients")
            asked = vocabulary_of(rows)
            told = None
            if batch_id:
                told = spark.read.schema(_WORDS).parquet(words).where(F.col("batch") < batch_id).drop("batch")
                asked = durable(asked.join(told, ["family", "norm", "code"], "left_anti"), "unseen")
            if not batch_id or not asked.isEmpty():
                path = f"{words}/batch={batch_id}"
                tell(asked, lex).write.mode("overwrite").parquet(path)
                fresh = spark.read.schema(_WORDS).parquet(path).drop("batch")
                told = fresh if told is None else told.unionByName(fresh)
            known = durable(told.join(vocabulary_of(rows), ["family", "norm", "code"], "left_semi"), "vocabulary")
            score_products(batch, with_told(rows, known)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return products.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_intake(scans: DataFrame, amounts: DataFrame, late: str = "1 day") -> DataFrame:
    """Calories, and macros if told, per user and day over all eaten events; rows later than
    ``late`` are dropped.

    A scan counts once: one that comes again within ``late`` is known by its ``scan_id``, and
    later it is too late. ``amounts (product_id, kcal[, protein, carbs, fat])`` is a static
    side; the state is the scans within ``late`` and one row per user and open day.
    """
    eaten = scans.where("logged = 'eaten'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["scan_id"]).join(amounts, "product_id")
    told = [c for c in ("kcal", "protein", "carbs", "fat") if c in amounts.columns]
    amount = lambda c: F.coalesce(js_round(F.col(c) * portion_or_one(F.col("portion"))), F.lit(0)).cast("long")
    days = eaten.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(*[F.sum(amount(c)).alias(c) for c in told], F.count("*").alias("n"))
    return days.select("user_id", F.to_date("w.start").alias("day"), *told, "n")


def stream_daily_intake(scans: DataFrame, amounts: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    with rocksdb(scans.sparkSession):
        days = daily_intake(scans, amounts, late)
        return days.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest_scan(scans: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest scan per user and product, as keyed state; each micro-batch writes the
    keys that it touched to a folder of its own, so that what is written follows the batch.

    A batch that is run again writes its folder again. ``latest_scans`` reads them.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rest = [c for c in scans.columns if c not in ("user_id", "ts", "scan_id")]
    newest = scans.withColumn("_key", scan_key(scans)).groupBy("user_id", "_key").agg(F.max(F.struct("ts", "scan_id", *rest)).alias("newest"))
    with rocksdb(scans.sparkSession):
        return newest.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scans(spark: SparkSession, out: str) -> DataFrame:
    """The newest scan per user and product of all batches written so far."""
    every = spark.read.parquet(out)
    newest = every.groupBy("user_id", "_key").agg(F.max("newest").alias("newest"))
    return newest.select("user_id", "newest.*")


def compact_scans(spark: SparkSession, out: str, to: str) -> None:
    """Write one folder instead of the batches', for readers; the state stays where it is."""
    every = spark.read.parquet(out)
    every.groupBy("user_id", "_key").agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{to}/batch=0")
