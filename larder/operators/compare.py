"""Comparison of product pairs, and better products of the same category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import missing, round1
from larder.functions.tables import durable, small_side

LOWER_IS_BETTER = ["Calories", "Sugar", "Salt", "Saturated fat", "Additives"]
GOOD_ENOUGH, LEAST_GAIN, ALERT_COST, SUGGESTIONS = 75, 8, 12, 4


def _side(analysis: DataFrame, side: str) -> DataFrame:
    labels = lambda rows, sev: F.array_distinct(F.transform(F.filter(rows, lambda r: r["sev"] == sev), lambda r: r["label"]))
    return analysis.select(
        F.col("product_id").alias(f"{side}_id"),
        F.coalesce("score", F.lit(0)).alias(f"{side}_score"),
        F.coalesce("flagged_count", F.lit(0)).alias(f"{side}_additives"),
        labels(F.col("negatives"), "bad").alias(f"{side}_bad"),
        labels(F.col("positives"), "good").alias(f"{side}_good"),
    )


def flagged_counts(analysis: DataFrame, classified: DataFrame) -> DataFrame:
    """``analysis`` with ``flagged_count`` counted from the ingredients where it is missing."""
    told = analysis if "flagged_count" in analysis.columns else analysis.withColumn("flagged_count", F.lit(None).cast("int"))
    counts = classified.groupBy("product_id").agg(F.count_if(F.col("status").isin("avoid", "caution")).cast("int").alias("_counted"))
    return told.join(counts, "product_id", "left").withColumn("flagged_count", F.coalesce("flagged_count", "_counted", F.lit(0))).drop("_counted")


def compare_products(pairs: DataFrame, analysis: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Pairs with the better side, the score delta, label sets and additive counts.

    With ``classified`` the additives of products without a flagged count are counted there.
    """
    analysis = analysis if classified is None else flagged_counts(analysis, classified)
    p = pairs.join(_side(analysis, "a"), "a_id").join(_side(analysis, "b"), "b_id")
    a, b = F.col("a_score"), F.col("b_score")

    def sets(kind: str) -> list[Column]:
        x, y = f"a_{kind}", f"b_{kind}"
        return [F.array_except(x, y).alias(f"{kind}_a_only"), F.array_except(y, x).alias(f"{kind}_b_only"), F.array_intersect(x, y).alias(f"{kind}_shared")]

    better = F.when(a > b, "a").when(b > a, "b").otherwise("tie")
    by = F.abs(a - b).cast("string")
    told = F.when(a > b, F.concat(F.lit("The first scores "), by, F.lit(" more"))).when(b > a, F.concat(F.lit("The second scores "), by, F.lit(" more"))).otherwise("Equal scores")
    return p.select("a_id", "b_id", better.alias("better"), told.alias("verdict"), (a - b).alias("score_delta"), "a_additives", "b_additives", *sets("bad"), *sets("good"))


def compare_nutrition(pairs: DataFrame, analysis: DataFrame) -> DataFrame:
    """``(a_id, b_id, label, a, b, delta, better)`` for labels with numbers on both sides."""
    rows = analysis.select("product_id", F.explode(F.concat("negatives", "positives")).alias("r")).where("r.value_num IS NOT NULL")
    rows = rows.select("product_id", "r.label", "r.value_num")
    left = rows.select(F.col("product_id").alias("a_id"), "label", F.col("value_num").alias("a"))
    right = rows.select(F.col("product_id").alias("b_id"), "label", F.col("value_num").alias("b"))
    p = pairs.join(left, "a_id").join(right, ["b_id", "label"])
    lower = F.col("label").isin(LOWER_IS_BETTER)
    better = F.when(F.col("a") == F.col("b"), "tie").when(lower == (F.col("a") < F.col("b")), "a").otherwise("b")
    return p.select("a_id", "b_id", "label", "a", "b", round1(F.col("a") - F.col("b")).alias("delta"), better.alias("better"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``, as an aggregated minimum: combined before the shuffle."""
    rest = [c for c in df.columns if c not in order and c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_x"))
    return first.select(*[F.col(c) if c in key else F.col(f"_x.{c}").alias(c) for c in df.columns])


def compare_candidates(history: DataFrame, favorites: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Products one could compare with, per user and product, first source first.

    Inputs ``(user_id, product_id, barcode, other_id, other_barcode, badge_cls)``; a product
    is no candidate for itself, by id or barcode, one without a badge is none at all, and the
    first row per barcode, else per product, stays.
    """
    parts = [x.withColumn("source", F.lit(i)) for i, x in enumerate((history, favorites, alternatives))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("badge_cls IS NOT NULL AND product_id <> other_id")
    rows = rows.where((F.coalesce("barcode", F.lit("")) == "") | ~F.col("barcode").eqNullSafe(F.col("other_barcode")))
    rows = rows.withColumn("key", F.coalesce(missing(F.col("other_barcode")), F.col("other_id").cast("string")))
    return keep_first(rows, ["user_id", "product_id", "key"], ["source", "other_id"]).drop("key")


def _pool_and_need(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may be suggested, first per barcode, else name, and what needs better ones."""
    known = F.coalesce("category", F.lit("")) != ""
    pool = analysis.where(known & (F.col("n_ingredients") > 0) & (F.coalesce("name", F.lit("")) != ""))
    pool = pool.withColumn("_key", F.coalesce(missing(F.col("barcode")), F.col("name")))
    pool = keep_first(pool.select("category", "_key", "product_id", "score"), ["category", "_key"], ["product_id"])
    need = analysis.where(known & (F.col("score") < GOOD_ENOUGH)).select("product_id", "category", F.col("score").alias("own"), F.coalesce(missing(F.col("barcode")), F.col("name")).alias("own_key"))
    return pool, need


def find_alternatives(analysis: DataFrame) -> DataFrame:
    """``(product_id, rank, other_id, other_score, fit)``: the best four of the category.

    Only a category's best five products can be among anyone's best four (one may be the
    product itself). They are one short list a category, which each product cuts by itself:
    no large category is paired with itself, and no row is exchanged after the join.
    """
    pool, need = _pool_and_need(analysis)
    lists = _best(pool.withColumn("fit", F.col("score")), ["category"])
    rows = need.join(small_side(durable(lists, "lists")), "category")
    return _suggested(rows, ["product_id"])


def find_alternatives_for_users(analysis: DataFrame, hits: DataFrame, profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(product_id, user_id, rank, other_id, other_score, fit)`` for ``wanted (user_id, product_id)``.

    Every alert that ``hits (product_id, profile_key)`` raises for a user costs points. Of the
    products of a category with the same set of keys all cost a user the same, so the best
    five per category and set are all that can be among the best four. They are ranked once
    for each category, set of flags that users have, and score to be beaten, whose number
    does not grow with users or products; a wanted row meets one list of five.
    """
    pool, need = _pool_and_need(analysis)
    sets = hits.groupBy("product_id").agg(F.sort_array(F.collect_set("profile_key")).alias("keys"))
    none = F.array().cast("array<string>")
    pool = pool.join(sets, "product_id", "left").withColumn("keys", F.coalesce("keys", none))
    top = Window.partitionBy("category", "keys").orderBy(F.desc("score"), "product_id")
    best = durable(pool.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= SUGGESTIONS + 1).drop("_n"), "best")
    users = profiles.groupBy("user_id").agg(F.sort_array(F.collect_set("profile_key")).alias("mine"))
    rows = need.join(wanted.select("user_id", "product_id").distinct(), "product_id").join(users, "user_id", "left").withColumn("mine", F.coalesce("mine", none))
    rows = durable(rows, "wanted")
    asked = rows.select("category", "mine", "own").distinct()
    fit = F.col("score") - ALERT_COST * F.size(F.array_intersect("keys", "mine"))
    able = asked.join(best, "category").where(F.col("score") >= F.col("own") + LEAST_GAIN).withColumn("fit", fit)
    lists = _best(able, ["category", "mine", "own"])
    return _suggested(rows.join(small_side(durable(lists, "lists")), ["category", "mine", "own"]), ["product_id", "user_id"])


def _best(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, others)``: the best five in order, one of which may be the product itself."""
    order = Window.partitionBy(*by).orderBy(F.desc("fit"), F.desc("score"), "product_id")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SUGGESTIONS + 1)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", F.col("product_id").alias("other_id"), F.col("score").alias("other_score"), F.col("fit").cast("int").alias("fit"), "_key"))).alias("others"))


def _suggested(rows: DataFrame, keys: list[str]) -> DataFrame:
    """At most four of each row's ``others`` that are enough better and not the product itself."""
    able = F.filter("others", lambda x: (x["other_score"] >= F.col("own") + LEAST_GAIN) & (x["_key"] != F.col("own_key")))
    out = rows.select(*keys, F.posexplode(F.slice(able, 1, SUGGESTIONS)).alias("rank", "x"))
    return out.select(*keys, (F.col("rank") + 1).alias("rank"), "x.other_id", "x.other_score", "x.fit")


def category_scan(products: DataFrame, category_tag: str) -> DataFrame:
    """Products tagged with a category that have ingredient text and a known name."""
    told = (F.coalesce("ingredients_text", F.lit("")) != "") & ~F.coalesce("name", F.lit("")).isin("", "Unknown product")
    return products.where(F.array_contains("categories_tags", category_tag) & told)


def health_sort(products: DataFrame) -> DataFrame:
    """Products with their place by Nutri-Score, missing grades last, stable by id."""
    grade = F.coalesce(F.nullif(F.instr(F.lit("abcde"), F.lower("nutriscore_grade")), F.lit(0)), F.lit(9))
    rank = F.when(F.coalesce("nutriscore_grade", F.lit("")) == "", 9).otherwise(grade)
    return products.withColumn("grade_rank", rank.cast("int")).orderBy("grade_rank", "product_id")
