"""Dictionary matching as an n-gram equi-join, and what is told about single ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import cap, family, letter_runs, norm, status_rank, title_case, tokens
from larder.functions.tables import durable, small_side
from larder.sources.lexicon import ECODE_STAGE, build_lexicon

def n_grams(words: Column, longest: int) -> Column:
    """Distinct runs of 1 to ``longest`` consecutive tokens."""
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words)))
    return F.when(F.size(words) > 0, F.array_distinct(F.flatten(F.transform(lengths, runs)))).otherwise(F.array().cast("array<string>"))


def e_code(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(raw), r"(?<![a-z0-9_])e ?([0-9]{3,4}[a-z]?)(?![a-z0-9_])", 1), F.lit(""))


TOLD = ["status", "grp", "reason", "name", "enumber", "additive_id"]


def vocabulary_of(rows: DataFrame) -> DataFrame:
    """The distinct words of ``coded`` rows: family, norm and the code in the raw text."""
    return rows.select("family", "norm", "code").distinct()


def coded(ingredients: DataFrame, type_col: str = "product_type") -> DataFrame:
    """Ingredient rows with their ``family`` and ``code``, empty if none is told in food."""
    rows = ingredients.withColumn("family", family(F.col(type_col)))
    return rows.withColumn("code", F.coalesce(F.when(F.col("family") == "food", e_code(F.col("raw"))), F.lit("")))


def tell(vocabulary: DataFrame, lex: dict[str, DataFrame]) -> DataFrame:
    """``vocabulary`` with what the lexicon tells of each word: the columns TOLD.

    Matching is an equi-join of n-grams; stage and list order are the sort key of one
    aggregated minimum.
    """
    table = durable(build_lexicon(lex), "lexicon")
    longest = table.agg(F.max("n_tokens")).first()[0]
    phrases = small_side(table.select("family", "phrase", "best"))
    grams = vocabulary.select("*", F.explode_outer(n_grams(tokens(F.col("norm")), longest or 1)).alias("phrase"))
    hits = grams.join(phrases, ["family", "phrase"], "left")
    best = hits.groupBy("family", "norm", "code").agg(F.min("best").alias("best"))

    known = lex["enumbers"].withColumn("low", F.lower("code"))
    first = known.groupBy("low").agg(F.min(F.struct("seq", "code", "name", "risk")).alias("e"))
    best = best.join(small_side(first), F.concat(F.lit("e"), F.nullif("code", F.lit(""))) == F.col("low"), "left")
    shown = F.concat(F.lit("E"), F.upper("code"))
    by_code = (F.col("code") != "") & (F.col("best").isNull() | (F.col("best.stage") > ECODE_STAGE))
    risk, code = F.coalesce("e.risk", F.lit("caution")), F.coalesce("e.code", shown)

    def pick(told: Column, field: str, default: str | None) -> Column:
        return F.when(by_code, told).when(F.col("best").isNotNull(), F.col(f"best.{field}")).otherwise(F.lit(default).cast("string"))

    null = F.lit(None).cast("string")
    return best.select(
        "family",
        "norm",
        "code",
        pick(risk, "status", "unknown").alias("status"),
        pick(F.concat(F.lit("e"), cap(risk)), "grp", "unknown").alias("grp"),
        pick(F.concat(F.lit("Additive by number, "), code), "reason", "In no list").alias("reason"),
        pick(F.coalesce("e.name", F.concat(F.lit("Additive "), shown)), "name", None).alias("name"),
        pick(code, "code", None).alias("enumber"),
        pick(null, "additive_id", None).alias("additive_id"),
    )


def with_told(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``coded`` rows with the columns TOLD of a written vocabulary; no code remains.

    A small vocabulary is broadcast and the rows are not shuffled; a large one is joined by a
    shuffle that is split at words that very many labels share.
    """
    t = small_side(told).withColumnsRenamed({"family": "_f", "norm": "_n", "code": "_c"})
    on = (F.col("family") == F.col("_f")) & (F.col("norm") == F.col("_n")) & (F.col("code") == F.col("_c"))
    return rows.join(t, on).drop("_f", "_n", "_c", "code")


def classify(ingredients: DataFrame, lex: dict[str, DataFrame], type_col: str = "product_type") -> DataFrame:
    """Adds family, status, grp, reason, name, enumber, additive_id to ingredient rows.

    The lexicon meets the distinct vocabulary, since a few words make up most of all labels.
    Rows are written first, so that a label is parsed once for the vocabulary and the join.
    """
    rows = durable(coded(ingredients, type_col), "ingredients")
    return with_told(rows, durable(tell(vocabulary_of(rows), lex), "vocabulary"))


def changed_phrases(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(family, phrase)`` whose entry differs between two lexicons, and ``(code)`` likewise."""
    entries = [build_lexicon(x).select("family", "phrase", F.xxhash64("best").alias(f"_{i}")) for i, x in enumerate((before, after))]
    phrases = entries[0].join(entries[1], ["family", "phrase"], "full_outer").where(~F.col("_0").eqNullSafe(F.col("_1")))
    codes = []
    for i, x in enumerate((before, after)):
        low = x["enumbers"].groupBy(F.lower("code").alias("low")).agg(F.min(F.struct("seq", "code", "name", "risk")).alias("e"))
        codes.append(low.select(F.regexp_replace("low", "^e", "").alias("code"), F.xxhash64("e").alias(f"_{i}")))
    other = codes[0].join(codes[1], "code", "full_outer").where(~F.col("_0").eqNullSafe(F.col("_1")))
    return durable(phrases.select("family", "phrase"), "changed"), durable(other.select("code"), "codes")


def retell(told: DataFrame, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """A vocabulary told by the lexicon ``before``, told by ``after``.

    Only words that hold a changed phrase or code meet the new lexicon; the others keep what
    they were told. ``told`` is read twice, so it should be a written table.
    """
    phrases, codes = changed_phrases(before, after)
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    grams = told.select("family", "norm", "code", F.explode(n_grams(tokens(F.col("norm")), longest)).alias("phrase"))
    touched = grams.join(small_side(phrases), ["family", "phrase"], "left_semi").select("family", "norm", "code")
    touched = touched.unionByName(told.join(small_side(codes), "code", "left_semi").select("family", "norm", "code"))
    touched = durable(touched.distinct(), "touched")
    same = told.join(small_side(touched), ["family", "norm", "code"], "left_anti")
    return same.unionByName(tell(touched, after).select(*same.columns))


def ingredient_detail(classified: DataFrame, lex: dict[str, DataFrame]) -> DataFrame:
    """What is told about each ingredient: its additive record with bans, else its group, with
    what it is, why it is flagged, its effects and the studies of either."""
    studies = F.sort_array(F.collect_list(F.struct("seq", "title", "source", "year")))
    read = lex["studies"].groupBy("kind", "key").agg(studies.alias("studies"))
    of = lambda kind: read.where(F.col("kind") == kind).select(F.col("key").alias("_key"), "studies")

    a = lex["additives"].select(
        F.col("id").alias("_id"), F.get("names", F.lit(0)).alias("_first"), F.struct("category", "summary", "what_is", "why_flagged", F.col("health_risk").alias("effects")).alias("_told")
    )
    a = a.join(of("additive"), F.col("_id") == F.col("_key"), "left").join(lex["banned"].select(F.col("additive_id").alias("_bid"), "note"), F.col("_id") == F.col("_bid"), "left")
    a = a.select("_id", "_first", F.struct("_told.*", F.col("studies")).alias("_additive"), "note")
    g = lex["groups"].join(lex["group_details"], "grp", "left").join(of("group"), F.col("grp") == F.col("_key"), "left")
    g = g.select(F.col("grp").alias("_grp"), F.struct("category", "summary", "what_is", "why_flagged", "effects", "studies").alias("_group"))
    known = small_side(g)
    other = small_side(g.where("_grp = 'unknown'").select(F.col("_grp").alias("_other"), F.col("_group").alias("_rest")))
    c = classified.join(small_side(a), F.col("additive_id") == F.col("_id"), "left").join(known, F.col("grp") == F.col("_grp"), "left")
    c = c.withColumn("_fallback", F.when(F.col("_grp").isNull(), "unknown")).join(other, F.col("_fallback") == F.col("_other"), "left")
    told = F.coalesce("_additive", "_group", "_rest")
    return c.select(
        "product_id",
        "pos",
        title_case(F.coalesce("_first", "name", "raw")).alias("title"),
        told["category"].alias("category"),
        F.coalesce("enumber", F.lit("")).alias("enumber"),
        "status",
        *[told[k].alias(k) for k in ("summary", "what_is", "why_flagged", "effects")],
        F.coalesce("note", F.lit("")).alias("banned"),
        F.coalesce(told["studies"], F.array().cast("array<struct<seq:int,title:string,source:string,year:int>>")).alias("studies"),
    )


def lexicon_browse(lex: dict[str, DataFrame], query: str = "") -> DataFrame:
    """Additive records whose names or category hold ``query``, worst first, then by name."""
    q = norm(F.lit(query))
    names = F.transform("names", norm)
    found = F.exists(names, lambda n: F.contains(n, q)) | F.contains(norm(F.col("category")), q)
    name = F.get("names", F.lit(0))
    return lex["additives"].where(found).select("family", F.col("id").alias("additive_id"), name.alias("name"), "category", "risk", status_rank(F.col("risk")).alias("rank")).orderBy(F.desc("rank"), "name", "additive_id")


def unknown_terms(classified: DataFrame) -> DataFrame:
    """Uncatalogued ingredients worth looking up, by how often labels have them."""
    # Words that name no ingredient.
    skip = ["and", "or", "contains", "less than", "of", "the", "other", "color added", "natural", "artificial"]
    rows = classified.where((F.col("status") == "unknown") & (F.length("raw") >= 3) & ~F.lower("raw").isin(skip))
    return rows.groupBy("norm").agg(F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"))


#: Letters of the grams by which words and keywords meet.
GRAM = 3


def words_with(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(norm, term)``: each of ``words (norm)`` with the ``keywords (term)`` that it holds anywhere.

    A keyword is joined by the one of its grams of GRAM letters that the fewest words have,
    and only what meets there is compared; shorter keywords are grams themselves.
    """
    sizes = sorted(r[0] for r in keywords.select(F.least(F.length("term"), F.lit(GRAM))).distinct().collect() if r[0])
    if not sizes:
        return words.select("norm", F.lit("").alias("term")).limit(0)
    held = words.select("norm", F.explode(F.concat(*[letter_runs(F.col("norm"), F.lit(n)) for n in sizes])).alias("gram"))
    size = F.least(F.length("term"), F.lit(GRAM))
    asked = keywords.where("term <> ''").select("term", F.explode(letter_runs(F.col("term"), size)).alias("gram"))
    asked = durable(asked, "grams")
    counts = held.join(small_side(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no word has ends the keyword, so it is the rarest.
    rarest = asked.join(counts, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = durable(rarest.where("r.n > 0").select("term", F.col("r.gram").alias("gram")), "rarest")
    return held.join(small_side(rarest), "gram").where(F.contains(F.col("norm"), F.col("term"))).select("norm", "term")


def alert_hits(ingredients: DataFrame, allergen_terms: DataFrame, mode: str = "token") -> DataFrame:
    """``(product_id, profile_key, hits)``: the first four raw hits in label order.

    Keywords are matched with the distinct vocabulary only. ``mode="token"`` is an equi-join
    of whole words, ``mode="substring"`` finds keywords within words (``words_with``); an
    empty keyword is in no word.
    """
    ingredients = durable(ingredients.select("product_id", "pos", "raw", "norm"), "labels")
    words = ingredients.select("norm").distinct()
    if mode == "token":
        terms = allergen_terms.select("profile_key", F.array_join(tokens(norm(F.col("phrase"))), " ").alias("term")).where("term <> ''").distinct()
        longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
        matched = words.select("norm", F.explode(n_grams(tokens(F.col("norm")), longest)).alias("term"))
    else:
        terms = allergen_terms.select("profile_key", F.lower("phrase").alias("term")).distinct()
        matched = words_with(words, terms.select("term").distinct())
    matched = matched.join(small_side(terms), "term")
    matched = small_side(durable(matched.select("norm", "profile_key").distinct(), "alert_words"))
    hits = ingredients.join(matched, "norm").groupBy("product_id", "profile_key").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("h"))
    return hits.select("product_id", "profile_key", F.transform(F.slice("h", 1, 4), lambda x: x["raw"]).alias("hits"))


def personal_alerts(ingredients: DataFrame, profiles: DataFrame, allergen_terms: DataFrame, mode: str = "token", pairs: DataFrame | None = None) -> DataFrame:
    """``(user_id, product_id, profile_key, hits)`` for the ``pairs (user_id, product_id)`` asked for.

    The pairs meet the users' few profile keys first and then, by product and key, the hits:
    no profile key, which very many users and products share, is a join key by itself. All
    users with all products is no output that anyone can read, so pairs must be given.
    """
    if pairs is None:
        raise ValueError("pairs (user_id, product_id) must say whom to alert of what")
    hits = alert_hits(ingredients, allergen_terms, mode)
    asked = pairs.select("user_id", "product_id").distinct().join(profiles.select("user_id", "profile_key").distinct(), "user_id")
    return asked.join(hits, ["product_id", "profile_key"]).select("user_id", "product_id", "profile_key", "hits")
