"""Worked values and rules of parsing, classification and scoring."""

import pytest
from pyspark.sql import functions as F

from larder.functions import exprs as E
from larder.operators import classify as C
from larder.operators import compare as P
from larder.operators import history as H
from larder.operators import score as S
from larder.operators.labels import parse_labels
from larder.sources.lexicon import build_lexicon, load_lexicon, merge_lexicons

PRODUCT = "product_id long, product_type string, ingredients_text string, nova_group int, nutriscore_grade string, serving_quantity string, nutriments map<string,string>, barcode string, name string, category string"


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def norms(spark, text):
    df = spark.createDataFrame([(1, text)], "product_id long, ingredients_text string")
    return [r.norm for r in parse_labels(df).orderBy("pos").collect()]


def product(spark, text, kind="food", nova=None, grade=None, nutriments=None, key=1, name="x", category="c"):
    return spark.createDataFrame([(key, kind, text, nova, grade, None, nutriments or {}, "", name, category)], PRODUCT)


def classified(spark, products):
    return C.classify(parse_labels(products, "product_id", "ingredients_text", "product_type"), load_lexicon(spark))


def statuses(spark, text, kind="food"):
    return [(r.status, r.grp, r.enumber) for r in classified(spark, product(spark, text, kind)).orderBy("pos").collect()]


def scored(spark, *args, **kw):
    p = product(spark, *args, **kw)
    return S.score_products(p, classified(spark, p)).first()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Ingredients: Water, Sugar, Red 40, and Salt.", ["water", "sugar", "red 40", "salt"]),
        ("Water, Calories, Water", ["water"]),
        ("Water, Water, , Sugar", ["water", "sugar"]),
        ("Flour (wheat, niacin), Salt", ["flour wheat", "niacin", "salt"]),
        ("FD&C Red No. 40", ["fd&c red no", "40"]),
        ("Salt. Contains: Milk, Soy. May contain nuts", ["salt", "milk", "soy"]),
        ("refrigerated cream, crème", ["refrigerated cream", "cr me"]),
        ("write to a@b.com or www.acme.com/x y, acme.org, Salt 2g, 2% milk", ["write to or y", "milk"]),
        ("", []),
        (None, []),
    ],
)
def test_parse(spark, text, expected):
    assert norms(spark, text) == expected


def test_parse_cap_and_repeats(spark):
    assert len(norms(spark, ", ".join(f"item a{chr(97 + i % 26)}{i}x" for i in range(200)))) == 81
    assert norms(spark, "aa, bb, aa") == ["aa", "bb", "aa"]


def test_expressions(spark):
    assert [value(spark, E.js_round(F.lit(x))) for x in (-2.5, 2.5, -0.5)] == [-2, 3, 0]
    assert value(spark, E.title_case(F.lit("sweet'n LOW"))) == "Sweet'N LOW"
    assert [value(spark, E.num(F.lit(x).cast("string"))) for x in ("12.5", "12f", "", "NaN", " 3 ", None)] == [12.5, None, None, None, 3.0, None]
    assert value(spark, E.tokens(E.norm(F.lit("Red 40 (x) Allura-Red 5%")))) == ["red", "40", "allura", "red"]
    assert [value(spark, E.is_food(F.lit(x).cast("string"))) for x in (None, "", "petfood", "beauty")] == [True, True, True, False]
    assert value(spark, E.step_portion(F.lit(0.25), F.lit(-1.0))) == 0.25
    assert value(spark, E.body_from_imperial(F.lit(5), F.lit(9), F.lit(154))[0]) == 175.0


def test_precedence(spark):
    assert statuses(spark, "Amaranth, Grapeseed Oil, Honey, Citric acid, Unsalted Butter, Moonberry") == [
        ("avoid", None, "E123"), ("limit", "seedOil", None), ("limit", "addedSugar", None), ("ok", None, "E330"), ("good", "clean", None), ("unknown", "unknown", None),
    ]
    assert statuses(spark, "Starch aluminium octenyl succinate, colour e133, e999 thing, BHA") == [("avoid", "eAvoid", "E173"), ("caution", "eCaution", "E133"), ("caution", "eCaution", "E999"), ("avoid", None, "E320")]
    assert statuses(spark, "PEG 40, Limonene, Parfum, Aqua, Sugar", "beauty") == [("limit", None, None), ("caution", "fragranceAllergen", None), ("limit", "vague", None), ("good", "clean", None), ("unknown", "unknown", None)]


def test_one_row_per_phrase(spark):
    lex = load_lexicon(spark)
    rows = build_lexicon(lex).groupBy("family", "phrase").count().where("count > 1").count()
    assert rows == 0
    more = {k: v.where("false") for k, v in lex.items()} | {"groups": spark.createDataFrame([("clean", "x", "good", "new")], lex["groups"].schema)}
    assert merge_lexicons(lex, more)["groups"].where("grp = 'clean'").first().summary == "new"


def test_scores(spark):
    r = scored(spark, "Sugar, Red 40, Aspartame, Soybean Oil")
    assert (r.score, r.badge_label, r.flagged_count) == (72, "Good", 2)
    r = scored(spark, "Sugar, Red 3")
    assert (r.score, r.badge_cls, r.score_reasons[-1].d) == (39, "bad", 0)
    r = scored(spark, "Water, Oats", nova=4, grade="E")
    assert (r.score, r.badge_label) == (80, "Excellent")
    r = scored(spark, "")
    assert (r.score, r.badge_label, r.negatives, r.positives, r.n_ingredients) == (100, "Excellent", [], [], 0)
    r = scored(spark, "Aqua", kind="beauty", nova=4, grade="e", nutriments={"sugars_100g": "99"})
    assert (r.score, r.score_reasons) == (100, [])
    r = scored(spark, "Water", nutriments={"sugars_100g": "30", "salt_100g": "", "sodium_100g": "1", "fiber_100g": "3"})
    assert r.score == 92 and [(x.label, x.value_num) for x in r.negatives] == [("Sugar", 30.0), ("Salt", 2.5)]


def test_targets(spark):
    h = spark.createDataFrame([(1, "male", 30, 175.0, 70.0, "1.375", "maintain"), (2, "male", 0, 175.0, 70.0, None, "lose"), (3, "female", 90, 150.0, 40.0, None, "lose")], "user_id long, sex string, age int, cm double, kg double, activity string, goal string")
    rows = {r.user_id: r for r in H.daily_targets(h).collect()}
    assert tuple(rows[1])[1:] == (1649, 2267, 2267, 170, 227, 76)
    assert 2 not in rows and rows[3].target == 1200


def test_kcal_per_serving(spark):
    p = product(spark, "Water", nutriments={"energy-kcal_100g": "100", "proteins_100g": "10", "carbohydrates_100g": "20", "fat_100g": "5"}).withColumn("serving_quantity", F.lit("50"))
    r = S.build_analysis(p, classified(spark, p)).first()
    assert (r.kcal, tuple(r.macros)) == (50, (5, 10, 3))


def test_alerts_and_compare(spark):
    p = product(spark, "Eggplant, Egg, Milk", key=1).unionByName(product(spark, "Sugar, Red 3", key=2, name="y"))
    c = classified(spark, p)
    users = spark.createDataFrame([(7, "egg"), (7, "nothing")], "user_id long, profile_key string")
    terms = load_lexicon(spark)["allergen_terms"]
    pairs = spark.createDataFrame([(7, 1), (7, 2)], "user_id long, product_id long")
    assert [r.hits for r in C.personal_alerts(c, users, terms, pairs=pairs).collect()] == [["Egg"]]
    assert [r.hits for r in C.personal_alerts(c, users, terms, "substring", pairs).collect()] == [["Eggplant", "Egg"]]
    with pytest.raises(ValueError, match="pairs"):
        C.personal_alerts(c, users, terms)
    a = S.build_analysis(p, c)
    pair = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    r = P.compare_products(pair, a).first()
    assert (r.better, r.score_delta, r.bad_b_only, r.good_a_only) == ("a", 61, ["Additives"], ["Additives"])
    assert [(r.product_id, r.other_id) for r in P.find_alternatives(a).collect()] == [(2, 1)]
