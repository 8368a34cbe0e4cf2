"""Label parsing on tables that are few bytes or few files."""

import random
import re

from pyspark.sql import functions as F

from larder.functions.exprs import norm
from larder.operators import labels as L
from larder.operators.labels import parse_labels
from larder.plans import adapters as A
from tests.conftest import DATA


def _tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_labels_of_one_file_are_parsed_by_many_tasks(spark):
    labels = spark.range(0, 400, 1, 1).select(F.col("id").alias("product_id"), F.lit("sugar, salt").alias("ingredients_text"))
    rows = parse_labels(labels)
    assert rows.count() == 800
    assert _tasks(rows) >= spark.sparkContext.defaultParallelism
    assert _tasks(A.products_from_part(spark, DATA)) >= spark.sparkContext.defaultParallelism


def test_texts_are_cleaned_before_array_functions(spark):
    labels = spark.createDataFrame([(1, "water (tap), www.x.com salt and 2% sugar. a@b.c")], "product_id long, ingredients_text string")
    plan = parse_labels(labels)._jdf.queryExecution().optimizedPlan().toString()
    generate = [line for line in plan.splitlines() if "Generate" in line]
    assert len(generate) == 1 and "ttps?" in plan and "ttps?" not in generate[0]


def test_label_classes_name_letters_one_by_one(spark):
    # A class of ranges costs a call a range and character; this one took most of the parsing.
    plan = parse_labels(spark.createDataFrame([(1, "x")], "product_id long, ingredients_text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z" not in plan and "[A-Za-z" not in plan and "(?<![a-z" not in plan


def test_links_and_words_begin_at_boundaries(spark):
    want = [
        ("http://a b, www.c.d e", []), ("HTTPS://A b2", ["b2"]), ("xhttp://a b", ["xhttp a b"]), ("_www.a bc", ["a bc"]), ("éwww.a bc", ["bc"]),
        ("salt AND oil", ["salt", "oil"]), ("sand and land", ["sand", "land"]), ("and", []), ("a.com oil", ["oil"]), ("a.comx oil", ["comx oil"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "product_id long, ingredients_text string")
    found = {}
    for r in parse_labels(df).orderBy("product_id", "pos").collect():
        found.setdefault(r["product_id"], []).append(r["norm"])
    assert [found.get(i, []) for i in range(len(want))] == [w for _, w in want]


def test_ingredients_are_normalised_as_one_text(spark):
    # Item by item each pattern ran anew for every ingredient.
    labels = spark.createDataFrame([(1, "Water (tap), salt 2%; Salt. 12 g, Milk")], "product_id long, ingredients_text string")
    rows = parse_labels(labels)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in next(line for line in plan.splitlines() if "Generate" in line)
    assert [(r.pos, r.raw, r.norm) for r in rows.orderBy("pos").collect()] == [(0, "Water", "water"), (1, "salt 2%", "salt"), (2, "Milk", "milk")]


def test_whole_text_passes_equal_item_passes(spark):
    rng = random.Random(7)
    odd = ["a", "Salt", "salt", " ", " ", "  ", "\t", "\n", "\xa0", "﻿", ",", ";", ".", "..", "(", ")", "[", "}", "2", "12", "%", " %", "g", "3 mg", "é", "Σ", "İ", "K", "&", "'", "-", "#", "and", "contains", "per serving", "www", "www.", "http://x", "ww.", "a@b.c", "x.com", "fl oz", "Calories", "ingredients:", "made in"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "product_id long, ingredients_text string")
    cleaned = df.select("product_id", L.clean_label(F.col("ingredients_text")).alias("c"))
    got, want = {}, {}
    for r in parse_labels(df).orderBy("product_id", "pos").collect():
        got.setdefault(r["product_id"], []).append((r["raw"], r["norm"]))
    parts = F.transform(F.split("c", "[,;.]+"), lambda x: F.trim(F.regexp_replace(x, r"\([^)]*+\)|(\([^)]*+)", "$1")))
    items = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(F.trim(F.regexp_replace(x, r"\s+", " ")).alias("raw"), norm(x).alias("norm")))
    noise = re.compile(rf"(?<![a-z0-9])(?:(?:{L.NOISE})|[0-9]+(?:\.[0-9]+)? ?(?:{L.PANEL_UNITS}))(?![a-z0-9])")
    for r in cleaned.select("product_id", items.alias("items")).collect():
        kept = [(x["raw"], x["norm"]) for x in r["items"] if len(x["norm"]) >= 2 and not noise.search(x["norm"])]
        fresh = [x for i, x in enumerate(kept) if not i or x[1] != kept[i - 1][1]][: L.MAX_INGREDIENTS]
        if fresh:
            want[r["product_id"]] = fresh
    assert len(want) > 2000 and got == want


def test_texts_without_links_are_cleaned_as_all_are(spark):
    texts = ["plain, text", "WWW.a b", "hTTps://c d", "e.com", "é http://", "a www b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(L.clean_label(F.col("t")).alias("now"), L._without_links(F.col("t")).alias("always"))
    assert all(r.now == r.always for r in both.collect())


def test_top_flagged_sorts_only_what_it_reads(spark, monkeypatch):
    from larder.operators import history as H

    scans = A.scans_from_events(spark, DATA)
    seen, plain = [], H.upsert_scans
    monkeypatch.setattr(H, "upsert_scans", lambda s: seen.append(s.columns) or plain(s))
    classified = spark.createDataFrame([(1, 0, "Salt", "avoid", None, None)], "product_id long, pos int, raw string, status string, name string, additive_id string")
    H.top_flagged(scans, classified, spark.createDataFrame([("a", ["b"])], "id string, names array<string>"))
    assert seen == [["user_id", "product_id", "ts", "scan_id"]]
