"""The lexicon: a knowledge base given as tables, and the one table the matcher joins.

A small seed in our own words serves the tests and queries; any tables of the same shape
(see ``SCHEMAS``) take its place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from larder.functions.exprs import norm, tokens

SCHEMAS = {
    "additives": "seq int, family string, id string, names array<string>, enumber string, category string, risk string, summary string, what_is string, why_flagged string, health_risk string",
    "enumbers": "seq int, code string, name string, risk string",
    "terms": "list string, seq int, phrase string",
    "concern_terms": "bucket string, bucket_ord int, seq int, phrase string, status string, reason string",
    "groups": "grp string, category string, status string, summary string",
    "banned": "additive_id string, note string",
    "allergen_terms": "profile_key string, seq int, phrase string",
    "group_details": "grp string, what_is string, why_flagged string, effects string",
    "studies": "kind string, key string, seq int, title string, source string, year int",
}

_ADDITIVES = [
    ("food", "red40", ["red 40", "allura red", "fd&c red"], "E129", "Colour", "caution"),
    ("food", "red3", ["red 3", "erythrosine"], "E127", "Colour", "avoid"),
    ("food", "e171", ["titanium dioxide"], "E171", "Colour", "avoid"),
    ("food", "nitrite", ["sodium nitrite"], "E250", "Preservative", "avoid"),
    ("food", "bha", ["bha", "butylated hydroxyanisole"], "E320", "Antioxidant", "avoid"),
    ("food", "amaranth", ["amaranth"], "E123", "Colour", "avoid"),
    ("food", "benzoate", ["sodium benzoate"], "E211", "Preservative", "caution"),
    ("food", "aspartame", ["aspartame"], "E951", "Sweetener", "caution"),
    ("food", "cmc", ["cellulose gum", "carboxymethyl cellulose"], "E466", "Thickener", "caution"),
    ("food", "msg", ["monosodium glutamate", "msg"], "E621", "Flavour enhancer", "limit"),
    ("food", "citric", ["citric acid"], "E330", "Acid", "ok"),
    ("food", "vitc", ["ascorbic acid", "vitamin c"], "E300", "Antioxidant", "ok"),
    ("food", "lecithin", ["lecithin", "soy lecithin"], "E322", "Emulsifier", "ok"),
    ("nonfood", "paraben", ["propylparaben", "propyl paraben"], None, "Preservative", "avoid"),
    ("nonfood", "formaldehyde", ["formaldehyde"], None, "Preservative", "avoid"),
    ("nonfood", "peg", ["peg"], None, "Emulsifier", "limit"),
    ("nonfood", "fdc", ["fd&c"], None, "Colour", "caution"),
    ("nonfood", "glycerin", ["glycerin", "glycerol"], None, "Humectant", "ok"),
]
_ENUMBERS = [
    ("E133", "Brilliant Blue FCF", "caution"),
    ("E173", "Aluminium", "avoid"),
    ("E1452", "Starch aluminium octenyl succinate", "limit"),
    ("E320", "BHA", "avoid"),
    ("E415", "Xanthan gum", "ok"),
    ("E440", "Pectin", "ok"),
    ("E471", "Mono- and diglycerides (fatty acids)", "limit"),
]
_TERMS = {
    "sweetener": ["sucralose", "saccharin"],
    "seedOil": ["soybean oil", "canola oil", "grapeseed oil"],
    "vague": ["natural flavor", "spices", "fragrance", "parfum"],
    "addedSugar": ["sugar", "corn syrup", "high fructose corn syrup", "honey"],
    "clean": ["water", "aqua", "salt", "oats", "milk", "butter", "egg", "almonds", "rice", "honey", "amaranth", "grapeseed oil", "citric acid", "wheat flour", "whole grain rolled oats", "stone ground whole wheat flour"],
}
_BUCKETS = [
    ("endocrine", "caution", "May act like a hormone", ["triclosan", "oxybenzone"]),
    ("formaldehydeReleaser", "caution", "Gives off formaldehyde", ["dmdm hydantoin"]),
    ("sulfate", "limit", "Harsh sulfate cleanser", ["sodium lauryl sulfate"]),
    ("fragranceAllergen", "caution", "Listed fragrance allergen", ["limonene", "linalool"]),
    ("sensitizer", "caution", "May sensitise skin", ["methylisothiazolinone"]),
    ("alcoholDrying", "limit", "Drying alcohol", ["alcohol denat"]),
    ("siliconeOther", "limit", "Silicone", ["dimethicone", "cyclohexasiloxane"]),
    ("dye", "caution", "Synthetic dye", ["yellow 5"]),
    ("phthalate", "caution", "Phthalate plasticiser", ["diethyl phthalate"]),
    ("pegEthoxylate", "limit", "Ethoxylated", ["laureth 7", "peg 40"]),
    ("microplastic", "limit", "Plastic particles", ["polyethylene"]),
]
_GROUPS = [
    ("unknown", "Uncatalogued", "unknown", "Not in the lexicon."),
    ("clean", "Plain ingredient", "good", "A common ingredient."),
    ("vague", "Undisclosed", "limit", "The label does not say what it is."),
    ("addedSugar", "Added sugar", "limit", "Sugar added in making."),
    ("seedOil", "Seed oil", "limit", "Refined seed oil."),
    ("sweetener", "Sweetener", "caution", "Intense sweetener."),
    ("eAvoid", "Additive", "avoid", "Additive to avoid."),
    ("eCaution", "Additive", "caution", "Additive to watch."),
    ("eLimit", "Additive", "limit", "Additive to limit."),
    ("eOk", "Additive", "ok", "Additive of no concern."),
]
_GROUP_DETAILS = [(g, f"What is called {c.lower()}.", f"Its status is {s}.", f"No effect is told of {c.lower()} here.") for g, c, s, _ in _GROUPS]
#: Studies of additives and groups; titles are placeholders of the seed.
_STUDIES = [
    ("additive", "red40", 0, "On colours in sweets", "Seed journal", 2007),
    ("additive", "red40", 1, "On colours in drinks", "Seed journal", 2012),
    ("additive", "e171", 0, "On white pigments", "Seed journal", 2021),
    ("group", "sweetener", 0, "On intense sweeteners", "Seed journal", 2019),
    ("group", "addedSugar", 0, "On sugar in drinks", "Seed journal", 2015),
]
_BANNED = [("e171", "Not allowed in food in the EU."), ("red3", "Not allowed in cosmetics in the US."), ("formaldehyde", "Not allowed in cosmetics in the EU.")]
_ALLERGENS = {
    "gluten": ["wheat", "barley", "wheat flour"],
    "dairy": ["milk", "butter", "cream"],
    "egg": ["egg", "eggs"],
    "soy": ["soy", "soybean", "soy lecithin"],
    "peanut": ["peanut", "peanuts"],
    "treenut": ["almond", "almonds", "walnut"],
    "shellfish": ["shrimp", "crab"],
    "fish": ["fish", "tuna"],
    "sesame": ["sesame", "tahini"],
    "vegan": ["milk", "butter", "egg", "honey"],
    "vegetarian": ["gelatin", "fish"],
    "keto": ["sugar", "corn syrup", "rice"],
}
PROFILE_KEYS = list(_ALLERGENS)
#: Words that no lexicon lists, for the adapters.
UNCATALOGUED = "Moonberry;Zorblat root;Eggplant;Unsalted Xyl;Kappa bloom;Quillfruit;Ferro leaf;Tansy pulp;Drumstick pod;Sea lettuce;Pine tips;Nettle juice;Sodium;Vervain;Quince paste".split(";")

_REASONS = {"sweetener": ("caution", "Intense sweetener"), "seedOil": ("limit", "Refined seed oil"), "vague": ("limit", "The label names no substance"), "addedSugar": ("limit", "Sugar added in making")}
_FOOD_STAGE = {"sweetener": 2, "seedOil": 3, "vague": 4, "addedSugar": 7, "clean": 8}
_OTHER_STAGE = {"vague": 13, "clean": 14}
ENAME_STAGE, ECODE_STAGE, UNKNOWN_STAGE = 5, 6, 99


def seed_rows() -> dict[str, list[tuple]]:
    says = lambda risk: (f"Rated {risk}.", "A listed substance.", f"Listed as {risk}.", "See the literature.")
    return {
        "additives": [(i, f, k, n, e, c, r, *says(r)) for i, (f, k, n, e, c, r) in enumerate(_ADDITIVES)],
        "enumbers": [(i, *x) for i, x in enumerate(_ENUMBERS)],
        "terms": [(k, i, p) for k, ps in _TERMS.items() for i, p in enumerate(ps)],
        "concern_terms": [(b, o, i, p, s, r) for o, (b, s, r, ps) in enumerate(_BUCKETS) for i, p in enumerate(ps)],
        "groups": _GROUPS,
        "banned": _BANNED,
        "allergen_terms": [(k, i, p) for k, ps in _ALLERGENS.items() for i, p in enumerate(ps)],
        "group_details": _GROUP_DETAILS,
        "studies": _STUDIES,
    }


def load_lexicon(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """The tables of a knowledge base: JSON files ``<path>/<table>.json``, or the seed."""
    if path:
        return {k: spark.read.schema(s).json(f"{path}/{k}.json") for k, s in SCHEMAS.items()}
    rows = seed_rows()
    return {k: local_table(spark, rows[k], s) for k, s in SCHEMAS.items()}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation, which needs no task to be read."""
    fields = StructType.fromDDL(schema)
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=fields.names), fields)


def merge_lexicons(base: dict[str, DataFrame], other: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``other``'s groups, their details, studies and bans replace ``base``'s of equal key;
    what else is not there already is appended, so it comes after ``base`` in list order."""
    keys = {"group_details": ["grp"], "studies": ["kind", "key", "seq"], "groups": ["grp"], "banned": ["additive_id"], "terms": ["list", "phrase"], "additives": ["family", "id"], "enumbers": ["code"], "concern_terms": ["bucket", "phrase"], "allergen_terms": ["profile_key", "phrase"]}
    out = {}
    for name, key in keys.items():
        replaces = name in ("groups", "banned", "group_details", "studies")
        first, second = (other[name], base[name]) if replaces else (base[name], other[name])
        if not replaces and "seq" in second.columns:
            last = first.agg(F.max("seq")).first()[0]
            second = second.withColumn("seq", (F.col("seq") + (0 if last is None else last + 1)).cast("int"))
        both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
        order = [F.col("_from"), *[F.col(c) for c in ("seq",) if c in both.columns]]
        best = both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        out[name] = best.where("_n = 1").drop("_n", "_from")
    return out


def lexicon_entries(lex: dict[str, DataFrame]) -> DataFrame:
    """Every phrase of every list with its stage; not yet reduced to one row a phrase."""
    null = F.lit(None).cast("string")
    a = lex["additives"].select("*", F.posexplode("names").alias("i", "raw"))
    additive = a.select(
        "family", F.lit(1).alias("stage"), (F.col("seq") * 1000 + F.col("i")).alias("seq"), "raw", F.col("id").alias("additive_id"), F.col("risk").alias("status"),
        null.alias("grp"), F.col("category").alias("reason"), F.get("names", F.lit(0)).alias("name"), F.col("enumber").alias("code"),
    )
    e = lex["enumbers"].select(
        F.lit("food").alias("family"), F.lit(ENAME_STAGE).alias("stage"), "seq", F.col("name").alias("raw"), null.alias("additive_id"), F.col("risk").alias("status"),
        F.concat(F.lit("e"), F.initcap("risk")).alias("grp"), F.concat(F.lit("Additive by name, "), F.col("code")).alias("reason"), "name", "code",
    )
    e_tokens = tokens(norm(F.col("raw")))
    e = e.where((F.size(e_tokens) > 1) | (F.length(F.get(e_tokens, F.lit(0))) >= 4))
    stages = [("food", k, s) for k, s in _FOOD_STAGE.items()] + [("nonfood", k, s) for k, s in _OTHER_STAGE.items()]
    meta = [(f, k, s, *(_REASONS.get(k) or ("good", "Plain food" if f == "food" else "Plain substance"))) for f, k, s in stages]
    spark = lex["terms"].sparkSession
    lists = local_table(spark, meta, "family string, list string, stage int, status string, reason string")
    terms = lex["terms"].join(F.broadcast(lists), "list").select(
        "family", "stage", "seq", F.col("phrase").alias("raw"), null.alias("additive_id"), "status", F.col("list").alias("grp"), "reason", null.alias("name"), null.alias("code")
    )
    concern = lex["concern_terms"].select(
        F.lit("nonfood").alias("family"), (F.col("bucket_ord") + 2).alias("stage"), "seq", F.col("phrase").alias("raw"), null.alias("additive_id"), "status",
        F.col("bucket").alias("grp"), "reason", null.alias("name"), null.alias("code"),
    )
    out = additive.unionByName(e).unionByName(terms).unionByName(concern)
    return out.withColumn("words", tokens(norm(F.col("raw")))).where(F.size("words") > 0)


def build_lexicon(lex: dict[str, DataFrame]) -> DataFrame:
    """One row per (family, phrase): the entry that precedence would pick.

    Order of precedence: stage, longer phrase first among additives, list order.
    """
    e = lexicon_entries(lex).withColumn("phrase", F.array_join("words", " "))
    e = e.withColumn("longer", F.when(F.col("stage") == 1, -F.size("words")).otherwise(0))
    payload = F.struct("stage", "longer", "seq", "additive_id", "status", "grp", "reason", "name", "code")
    return e.groupBy("family", "phrase").agg(F.min(payload).alias("best"), F.max(F.size("words")).alias("n_tokens"))
