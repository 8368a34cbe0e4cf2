"""Scan history: latest state per key, insights, intake against targets, trend.

History jobs take ``mode='latest'``, where a product counts once per user by its newest
scan, or ``mode='events'``, where every eaten event counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.exprs import js_round, missing, portion_or_one, title_case
from larder.functions.tables import durable, small_side

KEPT = 100


def scan_key(scans: DataFrame) -> Column:
    return F.coalesce(missing(F.col("barcode")), F.col("product_id").cast("string")) if "barcode" in scans.columns else F.col("product_id").cast("string")


def upsert_scans(scans: DataFrame) -> DataFrame:
    """The newest scan per user and product, as an aggregated maximum."""
    rows = scans.withColumn("_key", scan_key(scans))
    rest = [c for c in scans.columns if c not in ("user_id", "ts", "scan_id")]
    newest = rows.groupBy("user_id", "_key").agg(F.max(F.struct("ts", "scan_id", *rest)).alias("_x"))
    return newest.select(*[F.col(c) if c == "user_id" else F.col(f"_x.{c}").alias(c) for c in scans.columns])


def _read_of(scans: DataFrame, *more: str) -> DataFrame:
    """What is not read does not go through the sort of the newest scans."""
    return scans.select([c for c in ("user_id", "product_id", "barcode", "ts", "scan_id", *more) if c in scans.columns])


def newest_scans(scans: DataFrame, n: int = KEPT) -> DataFrame:
    """A user's newest ``n`` products, which is what a saved history holds."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("scan_id"))
    return upsert_scans(scans).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def save_history(scans: DataFrame, path: str, n: int = KEPT) -> None:
    """Write what a history keeps, a user's newest ``n`` products, over what was there."""
    newest_scans(scans, n).write.mode("overwrite").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def set_logged(changes: DataFrame) -> DataFrame:
    """Latest ``logged`` per user and product of ``(user_id, product_id, scan_id, ts, logged)``; eaten carries its time."""
    last = changes.groupBy("user_id", "product_id").agg(F.max(F.struct("ts", "scan_id", "logged")).alias("x"))
    return last.select("user_id", "product_id", F.col("x.logged").alias("logged"), F.when(F.col("x.logged") == "eaten", F.col("x.ts")).alias("ate_at"))


def toggle_favorites(toggles: DataFrame) -> DataFrame:
    """Products toggled an odd number of times, with the last toggle's time."""
    return toggles.groupBy("user_id", "product_id").agg(F.count("*").alias("n"), F.max("ts").alias("since")).where(F.col("n") % 2 == 1).drop("n")


def scan_insights(scans: DataFrame, analysis: DataFrame, eaten_only: bool = False, flagged: DataFrame | None = None) -> DataFrame:
    """Per user: scans, rounded average score, counts by badge, best and worst product, and of
    ``flagged_names`` the few found in most of these products, ``top_flagged`` as
    ``array<struct<title, n>>``, empty if there are none."""
    rows = upsert_scans(_read_of(scans, "logged"))
    rows = rows.where("logged = 'eaten'") if eaten_only else rows
    # Read twice: for the scores and for the names.
    rows = rows if flagged is None else durable(rows, "newest")
    scored = rows.join(analysis.select("product_id", "score", "badge_cls"), "product_id")
    order = lambda s: F.struct(s.alias("s"), (-F.unix_micros("ts")).alias("t"), F.col("scan_id"), F.col("product_id"))
    out = scored.groupBy("user_id").agg(
        F.count("*").alias("n"),
        js_round(F.avg("score")).cast("int").alias("avg_score"),
        *[F.count_if(F.col("badge_cls") == c).alias(f"n_{c}") for c in ("exc", "good", "mid", "bad")],
        F.min(order(-F.col("score")))["product_id"].alias("best_id"),
        F.min(order(F.col("score")))["product_id"].alias("worst_id"),
    )
    if flagged is None:
        return out
    top = F.sort_array(F.collect_list(F.struct("rank", "title", "n")))
    top = most_flagged(rows, flagged).groupBy("user_id").agg(F.transform(top, lambda x: F.struct(x["title"], x["n"])).alias("top_flagged"))
    none = F.array().cast(top.schema["top_flagged"].dataType)
    return out.join(top, "user_id", "left").withColumn("top_flagged", F.coalesce("top_flagged", none))


def flagged_names(classified: DataFrame, additives: DataFrame) -> DataFrame:
    """``(product_id, title, pos)``: flagged ingredient names, each once per product."""
    first = additives.select(F.col("id").alias("additive_id"), F.get("names", F.lit(0)).alias("_first"))
    flagged = classified.where(F.col("status").isin("avoid", "caution")).join(small_side(first), "additive_id", "left")
    return flagged.groupBy("product_id", title_case(F.coalesce("_first", "name", "raw")).alias("title")).agg(F.min("pos").alias("pos"))


def most_flagged(newest: DataFrame, flagged: DataFrame, n: int = 6) -> DataFrame:
    """Per user the ``flagged_names`` in most of the products scanned; of equal counts the one
    met first, going from the newest scan and down its label."""
    seen = newest.select("user_id", "product_id", (-F.unix_micros("ts")).alias("age"), (-F.col("scan_id")).alias("scan"))
    met = F.min(F.struct("age", "scan", "pos")).alias("met")
    counts = seen.join(flagged, "product_id").groupBy("user_id", "title").agg(F.count("*").alias("n"), met)
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "met", "title")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("met")


def top_flagged(scans: DataFrame, classified: DataFrame, additives: DataFrame, n: int = 6) -> DataFrame:
    """``most_flagged`` of all scans."""
    return most_flagged(upsert_scans(_read_of(scans)), flagged_names(classified, additives), n)


def daily_targets(health: DataFrame) -> DataFrame:
    """Calories and macros per day from body data; rows that lack a figure are left out."""
    activity = F.coalesce(F.regexp_extract(F.col("activity"), r"^\s*([+-]?\d+(\.\d+)?)", 1).try_cast("double"), F.lit(1.375))
    h = health.where((F.col("kg") > 0) & (F.col("cm") > 0) & (F.col("age") > 0))
    bmr = 10 * F.col("kg") + 6.25 * F.col("cm") - 5 * F.col("age") + F.when(F.col("sex") == "female", -161).otherwise(5)
    tdee = bmr * activity
    goal = F.when(F.col("goal") == "lose", -500).when(F.col("goal") == "gain", 400).otherwise(0)
    target = F.greatest(F.lit(1200), js_round(tdee + goal))
    share = lambda part, kcal: js_round(target * part / kcal).cast("int")
    return h.select(
        "user_id",
        js_round(bmr).cast("int").alias("bmr"),
        js_round(tdee).cast("int").alias("tdee"),
        target.cast("int").alias("target"),
        share(0.30, 4).alias("protein"),
        share(0.40, 4).alias("carbs"),
        share(0.30, 9).alias("fat"),
    )


def eaten_items(scans: DataFrame, analysis: DataFrame, mode: str = "latest") -> DataFrame:
    """``(user_id, day, kcal, protein, carbs, fat)`` of each eaten item, rounded one by one."""
    rows = upsert_scans(scans) if mode == "latest" else scans
    rows = rows.where("logged = 'eaten'").select("user_id", "product_id", "ate_at", "portion")
    rows = rows.join(analysis.select("product_id", "kcal", "macros"), "product_id")
    by = lambda c: F.coalesce(js_round(F.col(c) * portion_or_one(F.col("portion"))), F.lit(0)).cast("long")
    return rows.select("user_id", F.to_date("ate_at").alias("day"), by("kcal").alias("kcal"), *[by(f"macros.{m}").alias(m) for m in ("protein", "carbs", "fat")])


def today_intake(scans: DataFrame, analysis: DataFrame, targets: DataFrame, as_of: Column, mode: str = "latest") -> DataFrame:
    """What every user with a target ate on the day of ``as_of``, perhaps nothing, its share
    of the target, and what remains."""
    sums = eaten_items(scans, analysis, mode).where(F.col("day") == F.to_date(as_of)).groupBy("user_id")
    sums = sums.agg(F.count("*").alias("n_items"), *[F.sum(c).alias(c) for c in ("kcal", "protein", "carbs", "fat")])
    t = targets.select("user_id", "target", *[F.col(m).alias(f"target_{m}") for m in ("protein", "carbs", "fat")])
    out = t.join(sums, "user_id", "left").fillna(0, ["n_items", "kcal", "protein", "carbs", "fat"])
    pct = lambda a, b: F.coalesce(F.least(F.lit(100), js_round(F.col(a) * 100 / F.nullif(F.col(b), F.lit(0)))), F.lit(0)).cast("int")
    return out.select(
        "user_id", "n_items", "kcal", "protein", "carbs", "fat", "target", pct("kcal", "target").alias("pct"), (F.col("target") - F.col("kcal")).alias("remaining"),
        *[pct(m, f"target_{m}").alias(f"{m}_pct") for m in ("protein", "carbs", "fat")],
    )


def weekly_trend(scans: DataFrame, analysis: DataFrame, targets: DataFrame, as_of: Column, mode: str = "latest") -> DataFrame:
    """Seven days up to ``as_of`` per user who ever ate: calories, over target, bar heights.

    A user who ate before that week only has seven days of nothing.
    """
    last = F.to_date(as_of)
    of_week = (F.col("day") > F.date_sub(last, 7)) & (F.col("day") <= last)
    days = eaten_items(scans, analysis, mode).groupBy("user_id", F.when(of_week, F.col("day")).alias("day")).agg(F.sum("kcal").alias("kcal"))
    top = F.coalesce(F.max(F.when(F.col("day").isNotNull(), F.col("kcal"))), F.lit(0)).alias("top")
    users = days.groupBy("user_id").agg(top).join(targets.select("user_id", "target"), "user_id", "left")
    users = users.select("user_id", F.coalesce("target", F.lit(0)).alias("target"), F.greatest(F.coalesce("target", F.lit(0)), "top", F.lit(1)).alias("scale"))
    spine = users.withColumn("day", F.explode(F.sequence(F.date_sub(last, 6), last)))
    out = spine.join(days.where("day IS NOT NULL"), ["user_id", "day"], "left").withColumn("kcal", F.coalesce("kcal", F.lit(0)))
    bar = lambda c: js_round(F.col(c) * 100 / F.col("scale")).cast("int")
    return out.select("user_id", "day", "kcal", ((F.col("target") > 0) & (F.col("kcal") > F.col("target"))).alias("over"), bar("kcal").alias("bar"), bar("target").alias("goal_line"))
