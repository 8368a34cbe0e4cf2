"""The driver's tables as products, labels, scans and users; formulas are integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.tables import spread
from larder.sources.lexicon import PROFILE_KEYS, SCHEMAS, UNCATALOGUED, local_table, seed_rows

AS_OF = "2024-01-30 12:00:00"


def pool() -> list[str]:
    """Seed phrases in list order, each once, then words that no list has."""
    seed = seed_rows()
    found = [n for row in seed["additives"] for n in row[3]] + [r[2] for r in seed["enumbers"]] + [r[1] for r in seed["enumbers"][:3]]
    found += [r[2] for r in seed["terms"]] + [r[3] for r in seed["concern_terms"]] + UNCATALOGUED
    return list(dict.fromkeys(found))


def generated_rows() -> dict[str, list[tuple]]:
    """A knowledge base of thousands of entries by rule: half of what the seed does not list,
    phrases that begin or end with words of the seed, and made-up names and codes."""
    words, risks = pool(), ["ok", "limit", "caution", "avoid"]
    says = ("Generated.", "A generated substance.", "By rule.", "None told.")
    made = [f"{a}{b}" for a in "ba ce di fo gu ka le mi no pu ra se ti vo zu".split() for b in "bel con dra fex gil hum jor kel".split()]
    additives = [(i, ("food", "nonfood")[i % 2], f"gen{i}", [f"{made[i]}ate", f"{made[i]} gum"], f"E{1600 + i}", "Generated", risks[i % 4], *says) for i in range(len(made))]
    additives += [(len(made) + i, f, f"odd{i}{f}", [w.lower()], None, "Generated", risks[i % 4], *says) for i, w in enumerate(UNCATALOGUED[::2]) for f in ("food", "nonfood")]
    clean = [f"{x} {words[i % len(words)]}" for i, x in enumerate(made)] + [f"{w} {x}" for w in made for x in ("flour", "seed", "milk", "powder", "juice", "bran", "root", "leaf")]
    vague = [w for w in words if " " in w] + [f"{x} blend" for x in made]
    return {
        "additives": additives,
        "enumbers": [(i, f"E{1700 + i}", f"{made[i % len(made)]} salt {i}", risks[i % 4]) for i in range(400)],
        "terms": [("clean", i, p) for i, p in enumerate(clean)] + [("vague", i, p) for i, p in enumerate(vague)],
        "concern_terms": [("generated", 20, i, f"{x} sulfate", "limit", "Generated") for i, x in enumerate(made)],
        "groups": [("generated", "Generated", "limit", "By rule.")],
        "banned": [("gen3", "Not allowed by rule.")],
        "allergen_terms": [("soy", i, f"{x} soy") for i, x in enumerate(made)],
        "group_details": [("generated", *says[:3])],
        "studies": [("group", "generated", 0, "On rules", "Generated", 2020)],
    }


def generated_lexicon(spark: SparkSession) -> dict[str, DataFrame]:
    rows = generated_rows()
    return {k: local_table(spark, rows[k], s) for k, s in SCHEMAS.items()}


def label_text(k: Column) -> Column:
    words = pool()
    bag = F.lit(words)
    n = (k % 13).cast("int")
    pick = lambda i: F.get(bag, ((k * 7 + i * 13 + i * i) % len(words)).cast("int"))
    item = lambda i: F.when((k % 7 == 0) & (i == n - 1), F.concat(F.lit("("), pick(i), F.lit(")"))).otherwise(pick(i))
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), item)).otherwise(F.array().cast("array<string>"))
    items = F.when(k % 13 == 3, F.concat(F.array(pick(F.lit(0))), items)).otherwise(items)
    tail5 = F.when(k % 5 == 0, ". Calories 120. Total Fat 2g. Distributed by ACME. www.acme.com").otherwise("")
    tail11 = F.when(k % 11 == 0, ". Contains: Milk, Soy").otherwise("")
    return F.concat(F.lit("Ingredients: "), F.array_join(items, ", "), tail5, tail11)


def _tenths(k: Column, c: int, m: int) -> Column:
    return (k * c % m).cast("double") / 10


def products_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    k = F.col("p_partkey")
    per_100 = {"energy-kcal": (37, 6000), "saturated-fat": (11, 100), "sugars": (23, 400), "fiber": (7, 90), "proteins": (13, 200), "carbohydrates": (29, 800), "fat": (17, 350)}
    pairs = {f"{n}_100g": _tenths(k, *cm) for n, cm in per_100.items()}
    pairs["salt_100g"] = F.when(k % 6 != 0, _tenths(k, 19, 30))
    pairs["sodium_100g"] = _tenths(k, 3, 12)
    pairs["energy-kcal_serving"] = F.when(k % 4 == 0, _tenths(k, 41, 5000))
    nutriments = F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v.cast("string"))])
    kind = k % 10
    return p.select(
        k.alias("product_id"),
        F.when(k % 19 == 0, "").otherwise(F.lpad(k.cast("string"), 13, "0")).alias("barcode"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.lower("p_type").alias("category"),
        F.when(kind <= 6, "food").when(kind == 7, "petfood").when(kind == 8, "beauty").otherwise("household").alias("product_type"),
        label_text(k).alias("ingredients_text"),
        ((k % 5) * 25).cast("string").alias("serving_quantity"),
        F.when(k % 17 != 0, 1 + F.col("p_size") % 4).cast("int").alias("nova_group"),
        F.when(k % 17 != 1, F.substring(F.lit("abcde"), (1 + F.col("p_size") % 5).cast("int"), F.lit(1))).alias("nutriscore_grade"),
        nutriments.alias("nutriments"),
    )


def labels_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per distinct order line, the scale case."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product_id")).distinct()
    return rows.select("product_id", F.lit("food").alias("product_type"), label_text(F.col("product_id")).alias("ingredients_text"))


def labels_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("label_id"), "text", (F.col("doc_id") % 100).cast("double").alias("confidence"))


def count_products(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/part.parquet").count()


def scans_of(events: DataFrame, n_products: int) -> DataFrame:
    """Events as scans of all products; works on a stream too."""
    eaten = F.col("event_type").isin("purchase", "view")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("scan_id"),
        "user_id",
        (F.col("event_id") * 31 % n_products).alias("product_id"),
        ts.alias("ts"),
        F.when(eaten, "eaten").otherwise("checked").alias("logged"),
        F.when(eaten, ts).alias("ate_at"),
        F.least(F.lit(10.0), F.greatest(F.lit(0.25), F.floor(F.col("value") / 10.0 * 4 + 0.5) / 4)).alias("portion"),
        "event_type",
    )


def scans_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans_of(spark.read.parquet(f"{sf_dir}/events.parquet"), count_products(spark, sf_dir))


def health_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    activity = F.get(F.lit(["1.2", "1.375", "1.55", "1.725", "1.9"]), (k % 5).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("user_id"),
        F.when(k % 2 == 0, "male").otherwise("female").alias("sex"),
        F.when(k % 23 == 0, 0).otherwise(18 + k % 60).cast("int").alias("age"),
        (150 + k % 50).cast("double").alias("cm"),
        (45 + _tenths(k, 3, 700)).alias("kg"),
        F.when(k % 29 != 0, activity).alias("activity"),
        F.get(F.lit(["lose", "maintain", "gain"]), (k % 3).cast("int")).alias("goal"),
    )


def profiles_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    flags = F.array(*[F.when((k + j * 5) % 7 == 0, key) for j, key in enumerate(PROFILE_KEYS)])
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(k.alias("user_id"), F.explode(flags).alias("profile_key")).where("profile_key IS NOT NULL")


def overrides_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read by other means: for every second product the text of the next one, for every fifth a type."""
    k = F.col("p_partkey")
    text, kind = F.when(k % 2 == 0, label_text(k + 1)), F.when(k % 5 == 0, "beauty")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("product_id"), text.alias("text"), kind.alias("product_type"))


def imperial_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("user_id"), (4 + k % 3).alias("feet"), (k % 12).alias("inches"), (90 + k % 200).alias("pounds"))


def pairs_of(products: DataFrame) -> DataFrame:
    """``(k, k+1)`` for every k whose partner exists."""
    a = products.select(F.col("product_id").alias("a_id"), (F.col("product_id") + 1).alias("b_id"))
    return a.join(products.select(F.col("product_id").alias("b_id")), "b_id").select("a_id", "b_id")


def source_tables(products: DataFrame) -> dict[str, DataFrame]:
    """Four domains by key, every ninth product in the next domain too, under another name."""
    names = ["food", "beauty", "household", "petfood"]
    out = {}
    for i, name in enumerate(names):
        own = products.where(F.col("product_id") % 4 == i)
        extra = products.where((F.col("product_id") % 9 == 0) & ((F.col("product_id") + 1) % 4 == i)).withColumn("name", F.concat("name", F.lit(" (2)")))
        out[name] = own.unionByName(extra)
    return out


def raw_records(products: DataFrame) -> DataFrame:
    """Products as raw JSON records ``(product_id, record)``."""
    k = F.col("product_id")
    tags = F.when(k % 3 == 0, F.array(F.lit("en:snacks"), F.concat(F.lit("en:"), "category"), F.lit("fr:divers"))).when(k % 3 == 1, F.array(F.concat(F.lit("fr:"), "category"))).otherwise(F.array().cast("array<string>"))
    fields = F.struct(
        F.col("barcode").alias("code"),
        F.when(k % 8 == 0, "").otherwise(F.col("name")).alias("product_name"),
        F.col("brand").alias("brands"),
        F.when(k % 2 == 0, F.concat(F.lit("small/"), k.cast("string"))).alias("image_front_small_url"),
        F.concat(F.lit("large/"), k.cast("string")).alias("image_front_url"),
        F.col("ingredients_text").alias("ingredients_text"),
        F.when(k % 4 == 0, F.upper("ingredients_text")).when(k % 4 == 1, "").alias("ingredients_text_en"),
        tags.alias("categories_tags"),
        F.when(k % 5 == 0, F.array(F.lit("en:Kosher-parve"))).otherwise(F.array(F.lit("en:organic"))).alias("labels_tags"),
        F.when(k % 2 == 0, F.array(F.lit("en:e330"), F.lit("en:e129"))).alias("additives_tags"),
        "serving_quantity",
        "nova_group",
        "nutriscore_grade",
        "nutriments",
    )
    return products.select("product_id", F.to_json(fields).alias("record"))
