"""Shared helpers: reading tables, dropping what is no longer needed, components.

Intermediate results that several jobs read are written as Parquet below the folder
named in ``spark.checkpoint.dir``, which all executors share, so a lost executor costs
a re-read and nothing else.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.exprs import bound
from larder.functions.tables import delete, durable, is_small, scratch, shared_dir, small_side

__all__ = ["bound", "collect_garbage", "components", "discard", "durable", "is_small", "scratch", "shared_dir", "small_side", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, shuffle files of earlier jobs too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and what jobs on them left behind."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/larder-" in f}:
            delete(folder)
    collect_garbage(tables[0].sparkSession)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)`` as ``(node, root)``, root the least node.

    Alternating large-star and small-star steps: each is an aggregated minimum over the
    neighbours (map-side combined) and a join back; the minima are checkpointed in between,
    so that the join reads plain exchanges and a node with very many neighbours is split.
    Nodes without an edge are absent. The number of rounds is logarithmic in the longest
    path; each round's edges are cut from their lineage.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = e.checkpoint()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = small.distinct().checkpoint()
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
