"""Backups, histories, results and written tables beyond what the queries show."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import exprs as E
from larder.functions import tables
from larder.operators import classify as C
from larder.operators import compare as P
from larder.operators import history as H
from larder.operators import score as S
from larder.operators.labels import parse_labels
from larder.plans import adapters as A
from larder.sources import products as R
from larder.sources.lexicon import load_lexicon, merge_lexicons
from larder.streaming import streams as T
from tests.conftest import DATA

T0 = dt.datetime(2024, 1, 1, 12)
SCAN = "scan_id long, user_id long, product_id long, ts timestamp, logged string, ate_at timestamp, portion double"


def scans(spark, rows):
    return spark.createDataFrame([(i, u, p, ts, "eaten" if ate else "checked", ts if ate else None, 1.0) for i, u, p, ts, ate in rows], SCAN)


def analysed(spark):
    p = A.products_from_part(spark, DATA)
    c = C.classify(parse_labels(p, "product_id", "ingredients_text", "product_type"), load_lexicon(spark))
    return p, c, S.build_analysis(p, c)


def test_scratch_deletes_written_tables(spark):
    def folders(df):
        return {os.path.dirname(f.removeprefix("file:")) for f in df.inputFiles()}

    with tables.scratch():
        outer = tables.durable(spark.range(5), "outer")
        with tables.scratch():
            inner, kept = tables.durable(spark.range(5), "inner"), tables.durable(spark.range(5), "kept", keep=True)
            gone = folders(inner)
        assert not any(map(os.path.exists, gone)) and kept.count() == outer.count() == 5
        gone |= folders(kept) | folders(outer)
    assert not any(map(os.path.exists, gone))
    free = tables.durable(spark.range(5), "free")
    assert all(map(os.path.exists, folders(free)))


def test_small_by_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"), F.lit(None).cast("string").alias("n"))
    assert tables.is_small(df) and not tables.is_small(df, rows=99) and not tables.is_small(df, size=50_000)
    assert tables.is_small(df.where("false"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Session)


def test_backup_replaces_present_sections(spark, tmp_path):
    rows = scans(spark, [(1, 1, 5, T0 + dt.timedelta(microseconds=7), True), (2, 1, 6, T0, False), (3, 2, 5, T0, True)])
    liked = spark.createDataFrame([(1, 5, T0)], "user_id long, product_id long, since timestamp")
    flags = spark.createDataFrame([(1, "vegan"), (1, "egg"), (3, "soy")], "user_id long, profile_key string")
    path = str(tmp_path / "backup")
    R.export_backup(path, F.lit(T0).cast("timestamp"), rows.where("user_id = 1"), liked, flags)
    saved = R.import_backup(spark, path)
    assert sorted(map(tuple, R.replace_section(rows.withColumn("portion", F.lit(9.0)), saved, "history").collect())) == sorted(map(tuple, rows.withColumn("portion", F.when(F.col("user_id") == 1, 1.0).otherwise(9.0)).collect()))
    old = spark.createDataFrame([(1, "keto"), (2, "keto"), (3, "keto")], "user_id long, profile_key string")
    assert sorted(map(tuple, R.replace_section(old, saved, "profile").collect())) == [(1, "egg"), (1, "vegan"), (2, "keto"), (3, "soy")]
    assert saved["health"].count() == saved["settings"].count() == 0
    health = spark.createDataFrame([(3, "female")], "user_id long, sex string")
    assert R.replace_section(health, saved, "health").count() == 1


def test_history_is_saved_with_its_cap(spark, tmp_path):
    rows = scans(spark, [(i, 1, i, T0 + dt.timedelta(hours=i), True) for i in range(9)])
    H.save_history(rows, str(tmp_path / "h"), 4)
    assert sorted(r.scan_id for r in H.load_history(spark, str(tmp_path / "h")).collect()) == [5, 6, 7, 8]


def test_users_who_ate_nothing_are_shown(spark):
    _, _, analysis = analysed(spark)
    targets = spark.createDataFrame([(1, 2000, 100, 200, 60), (2, 1500, 100, 200, 60)], "user_id long, target int, protein int, carbs int, fat int")
    rows = scans(spark, [(1, 1, 1, T0, True), (2, 3, 1, T0 - dt.timedelta(days=30), True), (3, 4, 1, T0, False)])
    as_of = F.lit(T0).cast("timestamp")
    today = {r.user_id: r for r in H.today_intake(rows, analysis, targets, as_of).collect()}
    assert set(today) == {1, 2} and (today[2].n_items, today[2].kcal, today[2].pct, today[2].remaining) == (0, 0, 0, 1500)
    trend = H.weekly_trend(rows, analysis, targets, as_of).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("kcal").alias("kcal"), F.max("bar").alias("bar")).collect()
    assert {r.user_id: (r.n, r.bar) for r in trend} == {1: (7, next(r.bar for r in trend if r.user_id == 1)), 3: (7, 0)}


def test_ties_of_flagged_names_go_by_first_met(spark):
    spec = "product_id long, pos int, raw string, status string, name string, additive_id string"
    c = spark.createDataFrame([(1, 0, "zeta", "avoid", None, None), (1, 1, "alpha", "caution", None, None), (2, 0, "beta", "avoid", None, None), (2, 1, "fine", "good", None, None)], spec)
    rows = scans(spark, [(1, 1, 2, T0, True), (2, 1, 1, T0 + dt.timedelta(hours=1), True)])
    got = H.top_flagged(rows, c, load_lexicon(spark)["additives"]).orderBy("rank").collect()
    assert [r.title for r in got] == ["Zeta", "Alpha", "Beta"]


def test_insights_tell_the_names_flagged_most(spark):
    spec = "product_id long, pos int, raw string, status string, name string, additive_id string"
    many = [(3, i, f"n{i}", "avoid", None, None) for i in range(9)]
    c = spark.createDataFrame([(1, 0, "zeta", "avoid", None, None), (1, 1, "raw", "caution", "alpha", None), (1, 2, "zeta", "avoid", None, None), (2, 0, "x", "avoid", "y", "a"), (2, 1, "raw", "caution", "alpha", None), (2, 2, "fine", "limit", None, None), (4, 0, "fine", "ok", None, None), *many], spec)
    names = H.flagged_names(c, spark.createDataFrame([("a", ["beta red", "other"])], "id string, names array<string>"))
    analysis = spark.createDataFrame([(1, 10, "bad"), (2, 30, "bad"), (3, 0, "bad"), (4, 90, "exc")], "product_id long, score int, badge_cls string")
    rows = scans(spark, [(1, 1, 2, T0, True), (2, 1, 1, T0 + dt.timedelta(hours=1), False), (3, 1, 1, T0 - dt.timedelta(hours=1), True), (4, 2, 4, T0, True), (5, 3, 3, T0, True)])
    told = lambda **kw: {r.user_id: (r.n, r.avg_score, r.best_id, r.worst_id, list(map(tuple, r.top_flagged))) for r in H.scan_insights(rows, analysis, flagged=names, **kw).collect()}
    rest = {2: (1, 90, 4, 4, []), 3: (1, 0, 3, 3, [(f"N{i}", 1) for i in range(6)])}
    assert told() == {1: (2, 20, 2, 1, [("Alpha", 2), ("Zeta", 1), ("Beta Red", 1)]), **rest}
    assert told(eaten_only=True) == {1: (1, 30, 2, 2, [("Beta Red", 1), ("Alpha", 1)]), **rest}


def test_flagged_counts_fall_back_to_ingredients(spark):
    _, c, analysis = analysed(spark)
    bare = analysis.withColumn("flagged_count", F.when(F.col("product_id") % 2 == 0, F.col("flagged_count")))
    told = P.flagged_counts(bare, c).join(analysis.select("product_id", F.col("flagged_count").alias("want")), "product_id")
    assert told.where("flagged_count <> want").count() == 0 and told.count() == analysis.count()


def test_breakdown_can_show_ok(spark):
    _, c, _ = analysed(spark)
    assert S.status_breakdown(c, with_ok=True).where("status = 'ok'").count() > 0 == S.status_breakdown(c).where("status = 'ok'").count()


def test_verdicts_and_types(spark):
    rows = spark.createDataFrame([(x,) for x in ("exc", "good", "mid", "bad", "none")], "c string").select(E.verdict(F.col("c")).alias("v")).collect()
    assert len({r.v for r in rows}) == 5 and rows[4].v is None
    kinds = spark.createDataFrame([(x,) for x in (None, "", "food", "petfood", "beauty", "household", "odd")], "t string").select(E.type_label(F.col("t")).alias("v")).collect()
    assert [r.v for r in kinds] == ["Food", "Food", "Food", "Pet food", "Cosmetics", "Household and others", "Household and others"]


def test_alternatives_weigh_the_users_alerts(spark):
    rows = [(1, 10, "c", "n1", 1), (2, 90, "c", "n2", 1), (3, 85, "c", "n3", 1), (4, 84, "c", "n4", 1), *[(10 + i, 83 - i, "c", f"m{i}", 1) for i in range(8)]]
    analysis = spark.createDataFrame([(p, s, c, n, k, "") for p, s, c, n, k in rows], "product_id long, score int, category string, name string, n_ingredients int, barcode string")
    hits = spark.createDataFrame([(2, "egg"), (2, "soy"), (3, "soy"), *[(10 + i, "egg") for i in range(8)]], "product_id long, profile_key string")
    flags = spark.createDataFrame([(7, "egg"), (7, "soy"), (8, "soy")], "user_id long, profile_key string")
    wanted = spark.createDataFrame([(7, 1), (8, 1), (9, 1), (9, 2)], "user_id long, product_id long")
    got = {}
    for r in P.find_alternatives_for_users(analysis, hits, flags, wanted).orderBy("rank").collect():
        got.setdefault((r.user_id, r.product_id), []).append((r.other_id, r.fit))
    assert got == {(7, 1): [(4, 84), (3, 73), (10, 71), (11, 70)], (8, 1): [(4, 84), (10, 83), (11, 82), (12, 81)], (9, 1): [(2, 90), (3, 85), (4, 84), (10, 83)]}


def test_keywords_of_any_number_are_found_within_words(spark):
    rng = random.Random(4)
    made = lambda n: "".join(rng.choices("abc é", k=n))
    words = sorted({made(rng.randrange(12)) for _ in range(300)})
    terms = sorted({made(rng.randrange(5)) for _ in range(400)} | {"zzzz", "a"})
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = C.words_with(frame(words, "norm"), frame(terms, "term"))
    assert sorted(map(tuple, got.collect())) == sorted((w, t) for w in words for t in terms if t and t in w)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert C.words_with(frame(words, "norm"), frame([""], "term")).count() == 0


def test_retelling_equals_telling_all(spark):
    seed, more = load_lexicon(spark), A.generated_lexicon(spark)
    merged = {k: tables.durable(v, k) for k, v in merge_lexicons(seed, more).items()}
    assert sum(merged[k].count() for k in ("additives", "enumbers", "terms", "concern_terms")) > 1900
    rows = C.coded(parse_labels(A.products_from_part(spark, DATA), "product_id", "ingredients_text", "product_type"))
    extra = spark.createDataFrame([("food", "babel gum", ""), ("food", "x", "1701"), ("nonfood", "babel sulfate soap", ""), ("food", "plain nothing", "")], "family string, norm string, code string")
    words = tables.durable(C.vocabulary_of(rows).unionByName(extra), "words")
    told = tables.durable(C.tell(words, seed), "told")
    columns = ["family", "norm", "code", *C.TOLD]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    again = key(C.retell(told, seed, merged))
    assert again == key(C.tell(words, merged)) != key(told)
    assert key(C.retell(told, seed, seed)) == key(told)


def test_streams_leave_nothing_behind(spark, tmp_path):
    before = set(tables._written)
    products = A.products_from_part(spark, DATA)
    products.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(products.schema).parquet(str(tmp_path / "in"))
    T.stream_scores(stream, load_lexicon(spark), str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "words")).awaitTermination()
    assert set(tables._written) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == products.count()
