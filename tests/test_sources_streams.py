"""Files in and out, merged domains, empty tables, late stream rows."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from larder.operators import classify as C
from larder.operators import history as H
from larder.operators import score as S
from larder.operators.labels import parse_labels
from larder.plans import adapters as A
from larder.sources import products as R
from larder.sources.lexicon import SCHEMAS, load_lexicon
from larder.streaming import streams as T
from tests.conftest import DATA

T0 = dt.datetime(2024, 1, 1, 12)


def test_load_products(spark, tmp_path):
    rows = [
        {"code": "1", "product_name": "", "categories_tags": ["en:snacks", "en:x", "fr:biscuits"], "labels_tags": ["en:KOSHER"], "ingredients_text": "a", "ingredients_text_en": "b", "nutriments": {"salt_100g": "1"}},
        {"code": "2", "product_name": "N", "categories_tags": ["fr:biscuits"], "image_front_url": "large", "serving_quantity": 30},
        {"code": "3", "categories_tags": []},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r.barcode: r for r in R.load_products(spark, str(tmp_path), "beauty").collect()}
    assert (got["1"].name, got["1"].category, got["1"].kosher, got["1"].ingredients_text, got["1"].nutriments) == ("Unknown product", "snacks", True, "b", {"salt_100g": "1"})
    assert (got["2"].category, got["2"].image, got["2"].serving_quantity, got["2"].product_type) == ("biscuits", "large", "30", "beauty")
    assert (got["3"].category, got["3"].nutriments, got["3"].kosher) == ("", {}, False)


def test_lexicon_from_files(spark, tmp_path):
    for name, df in load_lexicon(spark).items():
        df.write.json(f"{tmp_path}/{name}.json")
    again = load_lexicon(spark, str(tmp_path))
    assert set(again) == set(SCHEMAS)
    p = A.products_from_part(spark, DATA)
    rows = parse_labels(p, "product_id", "ingredients_text", "product_type")
    assert C.classify(rows, again).exceptAll(C.classify(rows, load_lexicon(spark))).count() == 0


def test_barcodes_and_gate(spark):
    codes = spark.createDataFrame([("12-34 5678",), ("1234567",), (None,), ("",), ("x",)], "code string")
    assert [r.barcode for r in R.normalize_barcodes(codes).collect()] == ["12345678"]
    assert sorted(r.barcode for r in R.normalize_barcodes(codes, least=0).collect()) == ["1234567", "12345678"]
    labels = spark.createDataFrame([("ab cd", 99.0), ("abcdef", 99.0), ("long enough text", 59.0), ("long enough text", None), ("long enough text", 60.0), (None, 90.0)], "text string, confidence double")
    assert [r.gate for r in R.label_intake_gate(labels).collect()] == ["reject", "review", "review", "review", "accept", "reject"]


def test_snapshots(spark):
    day = dt.timedelta(days=1)
    rows = [("a", T0, 1), ("a", T0 + day, 2), ("b", T0 - 30 * day, 3), ("c", T0 - 30 * day + dt.timedelta(seconds=1), 4), ("d", T0 + 9 * day, 5)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, v int")
    as_of = F.lit(T0 + day).cast("timestamp")
    assert {(r.key, r.v) for r in R.fresh_snapshots(df, "key", as_of).collect()} == {("a", 2)}
    assert {r.key for r in R.fresh_snapshots(df, "key", as_of, "ingredient").collect()} == {"a", "b", "c"}


def test_indexed_search_equals_search(spark, tmp_path):
    rows = [(1, "Ring Ding", "Ünal"), (2, "String", None), (3, "Plain", "ÜNAL ring"), (4, None, "ring"), (5, "ri", "x"), (6, "", "ring")]
    few = spark.createDataFrame([(i, f"b{i}", n, b, 0) for i, n, b in rows], "product_id long, barcode string, name string, brand string, source_rank int")
    path = f"{tmp_path}/index"
    R.index_names(few, path)
    for query in ("ring", " RI ", "r", "", "nal", "ünal", "ng di", "zzz", "ringx"):
        got = R.search_indexed(few, path, query)
        assert sorted(map(str, got.collect())) == sorted(map(str, R.search_products(few, query).collect())), query
    plan = spark.read.parquet(path).where("bucket IN (1, 2) AND gram IN ('a', 'b')")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


def test_scans_with_the_newest_snapshot_before_them(spark):
    rng, hour = random.Random(6), dt.timedelta(hours=1)
    at = lambda: T0 + rng.randrange(0, 24 * 200, 6) * hour
    scans = [(i, rng.choice([None, "a", "b", "c"]), at()) for i in range(300)]
    snaps = [(i, rng.choice([None, "a", "b", "d"]), at(), i * 10) for i in range(60)] + [(900, "a", None, 1)]
    got = R.as_of_snapshots(spark.createDataFrame(scans, "scan_id long, code string, ts timestamp"), spark.createDataFrame(snaps, "snapshot_id long, code string, ts timestamp, v long"), "code")
    assert got.columns == ["scan_id", "code", "ts", "snapshot"]
    want = {}
    for i, key, ts in scans:
        held = [(t, s, v) for s, k, t, v in snaps if key and k == key and t and t <= ts and t >= ts - dt.timedelta(days=90)]
        if held:
            want[i] = max(held)[1:]
    assert {r.scan_id: (r.snapshot.snapshot_id, r.snapshot.v) for r in got.collect()} == want and 50 < len(want) < 200
    assert got.where("false").count() == 0


def test_search_needs_two_letters(spark):
    src = R.union_sources(A.source_tables(A.products_from_part(spark, DATA).select("product_id", "barcode", "name", "brand")))
    assert R.search_products(src, "r").count() == 0
    assert R.search_products(src, " RING ").count() == R.search_products(src, "ring").count() > 0


def test_empty_tables(spark):
    p = A.products_from_part(spark, DATA).where("false")
    c = C.classify(parse_labels(p, "product_id", "ingredients_text", "product_type"), load_lexicon(spark))
    analysis = S.build_analysis(p, c)
    scans = A.scans_from_events(spark, DATA)
    assert analysis.count() == 0 and S.explain(analysis).count() == 0 and S.concern_rows(c).count() == 0
    assert H.scan_insights(scans, analysis).count() == 0
    assert H.weekly_trend(scans.where("false"), analysis, H.daily_targets(A.health_from_customer(spark, DATA)), F.lit(T0).cast("timestamp")).count() == 0


def test_scans_latest_and_toggles(spark):
    rows = [(1, 1, 5, T0, "eaten"), (2, 1, 5, T0 + dt.timedelta(hours=1), "checked"), (3, 1, 6, T0, "eaten"), (4, 1, 6, T0, "checked")]
    df = spark.createDataFrame(rows, "scan_id long, user_id long, product_id long, ts timestamp, logged string")
    assert {(r.product_id, r.scan_id) for r in H.upsert_scans(df).collect()} == {(5, 2), (6, 4)}
    assert {(r.product_id, r.logged, r.ate_at) for r in H.set_logged(df).collect()} == {(5, "checked", None), (6, "checked", None)}
    assert H.toggle_favorites(df).count() == 0 and H.toggle_favorites(df.where("scan_id <> 1")).count() == 1


def test_late_rows_are_dropped(spark, tmp_path):
    def scans(name, rows):
        full = [(i, 1, 5, ts, "eaten", 1.0) for i, ts in rows]
        spark.createDataFrame(full, "scan_id long, user_id long, product_id long, ts timestamp, logged string, portion double").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    kcal = spark.createDataFrame([(5, 100)], "product_id long, kcal int")
    day = dt.timedelta(days=1)
    schema = "scan_id long, user_id long, product_id long, ts timestamp, logged string, portion double"
    for name, rows in (("a", [(1, T0), (2, T0 + 3 * day)]), ("b", [(3, T0), (4, T0 + 9 * day)]), ("c", [(5, T0 + 20 * day)])):
        scans(name, rows)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        T.stream_daily_intake(stream, kcal, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(str(r.day), r.kcal, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("2024-01-01", 100, 1) in got and ("2024-01-04", 100, 1) in got


def test_latest_scan_over_batches(spark, tmp_path):
    """What a batch writes follows the batch, through restarts of the query."""
    schema = "scan_id long, user_id long, product_id long, ts timestamp, logged string"
    batches = [[(i, 1, i, T0, "eaten") for i in range(200)], [(900, 1, 5, T0 + dt.timedelta(hours=1), "checked"), (901, 2, 5, T0, "eaten")], [(1, 1, 5, T0 - dt.timedelta(hours=1), "eaten")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        T.stream_latest_scan(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [spark.read.parquet(f"{tmp_path}/out/batch={i}").count() for i in range(3)] == [200, 2, 1]
    got = T.latest_scans(spark, f"{tmp_path}/out")
    assert got.columns == ["user_id", "ts", "scan_id", "product_id", "logged"]
    every = spark.createDataFrame([r for rows in batches for r in rows], schema)
    want = H.upsert_scans(every).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    T.compact_scans(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    assert sorted(map(tuple, T.latest_scans(spark, f"{tmp_path}/small").collect())) == sorted(map(tuple, want.collect()))


def test_replayed_scans_change_no_sum(spark, tmp_path):
    schema = "scan_id long, user_id long, product_id long, ts timestamp, logged string, portion double"
    kcal = spark.createDataFrame([(5, 100)], "product_id long, kcal int")
    hour = dt.timedelta(hours=1)
    first = [(1, 1, 5, T0, "eaten", 1.0), (2, 1, 5, T0 + hour, "eaten", 2.0)]
    for name, rows in (("a", first), ("b", [*first, (3, 1, 5, T0 + 2 * hour, "eaten", 1.0)]), ("c", [(4, 1, 5, T0 + 99 * hour, "eaten", 1.0)]), ("d", first), ("e", [(5, 1, 5, T0 + 300 * hour, "eaten", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        T.stream_daily_intake(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), kcal, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(str(r.day), r.kcal, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("2024-01-01", 400, 3) in got and len({d for d, _, _ in got}) == len(got)


def test_known_words_meet_no_lexicon_again(spark, tmp_path, monkeypatch):
    products, told = A.products_from_part(spark, DATA), []
    tell = T.tell
    monkeypatch.setattr(T, "tell", lambda words, lex: told.append(words.count()) or tell(words, lex))
    for i, part in enumerate([products, products.where("product_id < 50"), products.where("product_id < 3").withColumn("ingredients_text", F.lit("Water, Neverseen, E1452"))]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(products.schema).parquet(f"{tmp_path}/in/*")
        T.stream_scores(stream, load_lexicon(spark), f"{tmp_path}/out", f"{tmp_path}/check", f"{tmp_path}/words").awaitTermination()
        want = S.score_products(part, C.classify(parse_labels(part, "product_id", "ingredients_text", "product_type"), load_lexicon(spark)))
        got = spark.read.parquet(f"{tmp_path}/out/batch={i}")
        columns = ["product_id", "score", "badge_cls", "flagged_count"]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert len(told) == 2 and told[1] < 5 < told[0]
