"""One query per operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.exprs import body_from_imperial as imperial
from larder.functions.exprs import step_portion as step
from larder.functions.tables import durable, new_path
from larder.operators import classify as C
from larder.operators import compare as P
from larder.operators import history as H
from larder.operators import score as S
from larder.operators.labels import parse_labels
from larder.plans import adapters as A
from larder.sources import products as R
from larder.sources.lexicon import load_lexicon, merge_lexicons
from larder.streaming import streams as T


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    """Products, their classified ingredients, the lexicon."""
    lex = load_lexicon(spark)
    products = A.products_from_part(spark, d)
    ingredients = parse_labels(products, "product_id", "ingredients_text", "product_type")
    return products, C.classify(ingredients, lex), lex


#: What suggestions read of a product.
SUGGESTED_BY = ("product_id", "barcode", "name", "category", "n_ingredients", "score")


def _analysis(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The ``columns`` of analysed products as a written table: comparisons and histories read
    it more than once, and joins with it are broadcast or split where a product has very many
    scans. Other columns are neither computed nor written."""
    products, classified, _ = _parts(spark, d)
    return durable(S.build_analysis(products, classified).select(*columns), "analysis")


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    """Calories and macros of all products as a written table; they need no label."""
    return durable(S.with_amounts(A.products_from_part(spark, d)).select("product_id", "kcal", "macros"), "amounts")


def _as_of():
    return F.lit(A.AS_OF).cast("timestamp")


def _shared(spark: SparkSession) -> str:
    return new_path(spark, "files")


def score_products(spark, d):
    products, classified, _ = _parts(spark, d)
    return S.score_products(products, classified).select("product_id", "score", "badge_label", "badge_cls", "flagged_count", "n_ingredients")


def parse_part_labels(spark, d):
    return parse_labels(A.products_from_part(spark, d))


def parse_document_labels(spark, d):
    """All that whole documents list, without the limit of a product's label."""
    return parse_labels(A.labels_from_documents(spark, d), "label_id", "text", most=None)


def classify_ingredients(spark, d):
    return _parts(spark, d)[1].select("product_id", "pos", "norm", "family", "status", "grp", "name", "enumber", "additive_id")


def classify_order_lines(spark, d):
    """Sums over the labels of all order lines; a text that many lines share is parsed once."""
    texts = A.labels_from_lineitem(spark, d).groupBy("product_type", "ingredients_text")
    texts = texts.agg(F.sum("product_id").alias("id_sum"), F.count("*").alias("n_labels"))
    rows = C.classify(parse_labels(texts, "id_sum", "ingredients_text", "product_type", "n_labels"), load_lexicon(spark))
    n = F.coalesce(F.sum("n_labels"), F.lit(0)).alias("n")
    return rows.groupBy("status", "grp").agg(n, F.sum("id_sum").alias("id_sum"), F.sum(F.col("pos") * F.col("n_labels")).alias("pos_sum"))


def eval_nutrition(spark, d):
    return S.eval_nutrition(A.products_from_part(spark, d))


def explain_scores(spark, d):
    products, classified, _ = _parts(spark, d)
    return S.explain(S.build_analysis(products, classified))


def build_analysis(spark, d):
    macros = [F.col(f"macros.{m}").alias(m) for m in ("protein", "carbs", "fat")]
    products, classified, _ = _parts(spark, d)
    return S.build_analysis(products, classified).select("product_id", "id", "score", "kcal", *macros, "is_food", "type_label", "verdict")


def overridden_labels(spark, d):
    """Scores where labels read by other means replace the records'."""
    products = R.override_products(A.products_from_part(spark, d), A.overrides_from_part(spark, d))
    classified = C.classify(parse_labels(products, "product_id", "ingredients_text", "product_type"), load_lexicon(spark))
    return S.score_products(products, classified).select("product_id", "product_type", "score", "badge_cls", "n_ingredients")


def shown_negatives(spark, d):
    products, classified, _ = _parts(spark, d)
    return S.shown_negatives(S.score_products(products, classified), classified)


def status_breakdown(spark, d):
    return S.status_breakdown(_parts(spark, d)[1])


def concern_rows(spark, d):
    return S.concern_rows(_parts(spark, d)[1])


def nutrition_facts(spark, d):
    return S.nutrition_facts(A.products_from_part(spark, d))


def ingredient_detail(spark, d):
    _, classified, lex = _parts(spark, d)
    rows = C.ingredient_detail(classified, lex)
    return rows.withColumn("studies", F.array_join(F.transform("studies", lambda x: F.concat_ws("|", x["title"], x["source"], x["year"].cast("string"))), ";"))


def lexicon_browse(spark, d):
    _, classified, lex = _parts(spark, d)
    used = classified.where("additive_id IS NOT NULL").groupBy("additive_id").agg(F.count_distinct("product_id").alias("n_products"))
    return C.lexicon_browse(lex, "Colour").join(used, "additive_id", "left").select("family", "additive_id", "name", "category", "risk", "rank", F.coalesce("n_products", F.lit(0)).alias("n_products"))


def unknown_terms(spark, d):
    return C.unknown_terms(_parts(spark, d)[1])


def personal_alerts(spark, d):
    return _alerts(spark, d, "token")


def personal_alerts_substring(spark, d):
    return _alerts(spark, d, "substring")


def _alerts(spark, d, mode):
    """Alerts of every product that a user has scanned."""
    ingredients = parse_labels(A.products_from_part(spark, d))
    alerts = C.personal_alerts(ingredients, A.profiles_from_customer(spark, d), load_lexicon(spark)["allergen_terms"], mode, A.scans_from_events(spark, d))
    return alerts.select("user_id", "product_id", "profile_key", F.array_join("hits", "|").alias("hits"))


def compare_products(spark, d):
    analysis = _analysis(spark, d, "product_id", "score", "flagged_count", "negatives", "positives")
    rows = P.compare_products(A.pairs_of(analysis), analysis)
    lists = [F.array_join(c, "|").alias(c) for c in rows.columns if c.startswith(("bad_", "good_"))]
    return rows.select("a_id", "b_id", "better", "verdict", "score_delta", "a_additives", "b_additives", *lists)


def compare_nutrition(spark, d):
    analysis = _analysis(spark, d, "product_id", "negatives", "positives")
    return P.compare_nutrition(A.pairs_of(analysis), analysis)


def compare_candidates(spark, d):
    """What a user could compare the newest scan with: the rest of the history, favorites, better products."""
    analysis = _analysis(spark, d, *SUGGESTED_BY, "badge_cls")
    scans = A.scans_from_events(spark, d)
    # Read twice: for the newest scan and for the rest of the history.
    saved = H.newest_scans(scans.select("user_id", "product_id", "scan_id", "ts"))
    saved = durable(saved.select("user_id", "product_id", "rank"), "saved")
    known = analysis.select("product_id", "barcode", "badge_cls")
    screen = saved.where("rank = 1").select("user_id", "product_id").join(known.drop("badge_cls"), "product_id")
    other = known.select(F.col("product_id").alias("other_id"), F.col("barcode").alias("other_barcode"), "badge_cls")

    def others(rows, on):
        return screen.join(rows, on).join(other, "other_id").select("user_id", "product_id", "barcode", "other_id", "other_barcode", "badge_cls")

    history = others(saved.select("user_id", F.col("product_id").alias("other_id")), "user_id")
    liked = others(H.toggle_favorites(scans.where("event_type = 'click'")).select("user_id", F.col("product_id").alias("other_id")), "user_id")
    better = others(P.find_alternatives(analysis).select("product_id", "other_id"), "product_id")
    return P.compare_candidates(history, liked, better).select("user_id", "product_id", "other_id", "source")


def find_alternatives(spark, d):
    return P.find_alternatives(_analysis(spark, d, *SUGGESTED_BY))


def find_alternatives_for_users(spark, d):
    products, classified, lex = _parts(spark, d)
    analysis = durable(S.build_analysis(products, classified).select(*SUGGESTED_BY), "analysis")
    eaten = A.scans_from_events(spark, d).where("logged = 'eaten'")
    hits = C.alert_hits(classified, lex["allergen_terms"])
    return P.find_alternatives_for_users(analysis, hits, A.profiles_from_customer(spark, d), eaten)


def category_scan(spark, d):
    return P.category_scan(_loaded(spark, d), "en:economy").select("barcode", "name", "category")


def health_sort(spark, d):
    return P.health_sort(A.products_from_part(spark, d)).select("product_id", "nutriscore_grade", "grade_rank")


def _loaded(spark, d):
    """Products as JSON records, written as files and loaded."""
    path = _shared(spark)
    A.raw_records(A.products_from_part(spark, d)).select("record").write.text(path)
    return R.load_products(spark, path)


def load_products(spark, d):
    tags = [F.array_join(c, "|").alias(c) for c in ("categories_tags", "additives_tags")]
    return _loaded(spark, d).select("barcode", "name", "brand", "image", "category", F.length("ingredients_text").alias("n_text"), "kosher", "nova_group", *tags)


def _sources(spark, d):
    return R.union_sources(A.source_tables(A.products_from_part(spark, d).select("product_id", "barcode", "name", "brand")))


def union_sources(spark, d):
    return _sources(spark, d).groupBy("source", "source_rank").agg(F.count("*").alias("n"), F.sum("product_id").alias("id_sum"))


def resolve_barcodes(spark, d):
    wanted = A.products_from_part(spark, d).select("barcode")
    return R.resolve_barcodes(_sources(spark, d), wanted).select("barcode", "name", "source")


def search_products(spark, d):
    return R.search_products(_sources(spark, d), "Ring").select("barcode", "name", "brand", "source")


def search_indexed(spark, d):
    path, sources = _shared(spark), _sources(spark, d)
    R.index_names(sources, path)
    return R.search_indexed(sources, path, "Ring").select("barcode", "name", "brand", "source")


def fresh_snapshots(spark, d):
    snaps = A.scans_from_events(spark, d).select("product_id", "ts", "scan_id", "portion")
    return R.fresh_snapshots(snaps, "product_id", F.lit("2024-02-20 12:00:00").cast("timestamp")).select("product_id", "scan_id", "portion")


def ingredient_snapshots(spark, d):
    """Each scan with the newest purchase of its product that is at most 90 days old, as the
    time when its ingredients were read."""
    scans = A.scans_from_events(spark, d)
    read = scans.where("event_type = 'purchase'").select("product_id", "ts", F.col("scan_id").alias("snapshot_id"), F.col("portion").alias("told"))
    found = R.as_of_snapshots(scans, read, "product_id")
    return found.select("scan_id", "product_id", "snapshot.snapshot_id", F.unix_micros("snapshot.ts").alias("read_us"), "snapshot.told")


def additives_counted(spark, d):
    """Comparison of products whose records tell no number of additives."""
    products, classified, _ = _parts(spark, d)
    analysis = durable(S.build_analysis(products, classified).select("product_id", "score", "negatives", "positives"), "analysis")
    rows = P.compare_products(A.pairs_of(analysis), analysis, classified)
    return rows.select("a_id", "b_id", "better", "score_delta", "a_additives", "b_additives")


def normalize_barcodes(spark, d):
    codes = A.products_from_part(spark, d).select("product_id", F.when(F.col("product_id") % 4 == 0, F.substring("barcode", 9, 5)).otherwise(F.concat(F.lit(" "), F.col("barcode"), F.lit("-x"))).alias("code"))
    return R.normalize_barcodes(codes)


def label_intake_gate(spark, d):
    gate = R.label_intake_gate(A.labels_from_documents(spark, d))
    return gate.groupBy("gate").agg(F.count("*").alias("n"), F.sum("label_id").alias("id_sum"))


def daily_targets(spark, d):
    return H.daily_targets(A.health_from_customer(spark, d))


def upsert_scans(spark, d):
    return H.upsert_scans(A.scans_from_events(spark, d)).select("user_id", "product_id", "scan_id", "logged", "portion")


def newest_scans(spark, d):
    return H.newest_scans(A.scans_from_events(spark, d), 5).select("user_id", "product_id", "scan_id", "rank")


def saved_history(spark, d):
    path = _shared(spark)
    H.save_history(A.scans_from_events(spark, d), path)
    return H.load_history(spark, path).select("user_id", "product_id", "scan_id", "logged", "portion", "rank")


def step_portion(spark, d):
    """Portions a quarter up after a purchase, else down."""
    scans = A.scans_from_events(spark, d)
    return scans.select("scan_id", step(F.col("portion"), F.when(F.col("event_type") == "purchase", 0.25).otherwise(-0.25)).alias("portion"))


def body_from_imperial(spark, d):
    cm, kg = imperial(F.col("feet"), F.col("inches"), F.col("pounds"))
    return A.imperial_from_customer(spark, d).select("user_id", cm.alias("cm"), kg.alias("kg"))


def set_logged(spark, d):
    return H.set_logged(A.scans_from_events(spark, d)).select("user_id", "product_id", "logged", F.unix_micros("ate_at").alias("ate_at_us"))


def toggle_favorites(spark, d):
    clicks = A.scans_from_events(spark, d).where("event_type = 'click'")
    return H.toggle_favorites(clicks).select("user_id", "product_id", F.unix_micros("since").alias("since_us"))


def scan_insights(spark, d):
    """With the names flagged most, as ``title n`` joined by ``|``."""
    products, classified, lex = _parts(spark, d)
    analysis = durable(S.build_analysis(products, classified).select("product_id", "score", "badge_cls"), "analysis")
    rows = H.scan_insights(A.scans_from_events(spark, d), analysis, flagged=H.flagged_names(classified, lex["additives"]))
    return rows.withColumn("top_flagged", F.array_join(F.transform("top_flagged", lambda x: F.concat_ws(" ", x["title"], x["n"].cast("string"))), "|"))


def scan_insights_eaten(spark, d):
    return H.scan_insights(A.scans_from_events(spark, d), _analysis(spark, d, "product_id", "score", "badge_cls"), eaten_only=True)


def top_flagged(spark, d):
    _, classified, lex = _parts(spark, d)
    return H.top_flagged(A.scans_from_events(spark, d), classified, lex["additives"])


def today_intake(spark, d):
    return H.today_intake(A.scans_from_events(spark, d), _amounts(spark, d), H.daily_targets(A.health_from_customer(spark, d)), _as_of())


def today_intake_events(spark, d):
    return H.today_intake(A.scans_from_events(spark, d), _amounts(spark, d), H.daily_targets(A.health_from_customer(spark, d)), _as_of(), mode="events")


def weekly_trend(spark, d):
    return H.weekly_trend(A.scans_from_events(spark, d), _amounts(spark, d), H.daily_targets(A.health_from_customer(spark, d)), _as_of())


def _backup(spark, d):
    """History and the saved sections, after an export of every user's data."""
    scans = A.scans_from_events(spark, d)
    history = H.newest_scans(scans).select("user_id", "scan_id", "product_id", "ts", "logged", "ate_at", "portion")
    health = A.health_from_customer(spark, d)
    settings = health.select("user_id", F.create_map(F.lit("theme"), F.when(F.col("sex") == "male", "dark").otherwise("light")).alias("settings"))
    path = _shared(spark)
    R.export_backup(path, _as_of(), history, H.toggle_favorites(scans.where("event_type = 'click'")), A.profiles_from_customer(spark, d), health, settings)
    return history, R.import_backup(spark, path)


def backup_round_trip(spark, d):
    """History after an import over older rows of the same users and of others, whose rows stay."""
    history, saved = _backup(spark, d)
    old = history.withColumn("portion", F.lit(0.0))
    old = old.unionByName(old.withColumn("user_id", -1 - F.col("user_id")))
    now = R.replace_section(old, saved, "history")
    return now.select("user_id", "scan_id", "product_id", F.unix_micros("ts").alias("ts_us"), "logged", F.unix_micros("ate_at").alias("ate_at_us"), "portion")


def backup_sections(spark, d):
    """Profile, health, settings and favorites of every user as an import gives them."""
    _, saved = _backup(spark, d)
    flags = saved["profile"].groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("profile_key")), "|").alias("flags"))
    liked = saved["favorites"].groupBy("user_id").agg(F.count("*").alias("n_favorites"), F.sum("product_id").alias("favorites_sum"))
    rows = saved["health"].join(saved["settings"], "user_id").join(flags, "user_id", "left").join(liked, "user_id", "left")
    return rows.select("user_id", "sex", "age", "cm", "kg", "goal", F.col("settings")["theme"].alias("theme"), "flags", "n_favorites", "favorites_sum")


def _stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # A stream reads a folder; the table's files are picked out of theirs by name.
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def stream_scores(spark, d):
    out = _shared(spark)
    products = A.products_from_part
    schema = products(spark, d).schema
    staged = f"{out}/in"
    products(spark, d).write.parquet(staged)
    T.stream_scores(spark.readStream.schema(schema).parquet(staged), load_lexicon(spark), f"{out}/scores", f"{out}/check", f"{out}/words").awaitTermination()
    return spark.read.parquet(f"{out}/scores").select("product_id", "score", "badge_cls", "flagged_count")


def stream_daily_intake(spark, d):
    """Closed days only: a day is told once the watermark has passed it."""
    out = _shared(spark)
    amounts = _amounts(spark, d).select("product_id", "kcal", "macros.*")
    scans = A.scans_of(_stream(spark, d, "events"), A.count_products(spark, d))
    T.stream_daily_intake(scans, amounts, f"{out}/days", f"{out}/check").awaitTermination()
    return spark.read.schema("user_id long, day date, kcal long, protein long, carbs long, fat long, n long").parquet(f"{out}/days")


def stream_latest_scan(spark, d):
    out = _shared(spark)
    scans = A.scans_of(_stream(spark, d, "events"), A.count_products(spark, d))
    T.stream_latest_scan(scans, out + "/latest", f"{out}/check").awaitTermination()
    return T.latest_scans(spark, out + "/latest").select("user_id", "product_id", "scan_id", "logged")


def merged_lexicon(spark, d):
    """Ingredients told by the seed, told again by a lexicon of thousands of entries merged into it."""
    seed, more = load_lexicon(spark), A.generated_lexicon(spark)
    rows = durable(C.coded(parse_labels(A.products_from_part(spark, d), "product_id", "ingredients_text", "product_type")), "ingredients")
    told = durable(C.tell(C.vocabulary_of(rows), seed), "vocabulary")
    merged = {k: durable(v, k) for k, v in merge_lexicons(seed, more).items()}
    again = durable(C.retell(told, seed, merged), "retold")
    return C.with_told(rows, again).select("product_id", "pos", "norm", "family", "status", "grp", "name", "enumber", "additive_id")


_FUNCTIONS = [
    score_products, parse_part_labels, parse_document_labels, classify_ingredients, classify_order_lines, eval_nutrition, explain_scores, build_analysis,
    overridden_labels, shown_negatives, status_breakdown, concern_rows, nutrition_facts, ingredient_detail, lexicon_browse, unknown_terms, personal_alerts, personal_alerts_substring,
    compare_products, compare_nutrition, compare_candidates, find_alternatives, find_alternatives_for_users, category_scan, health_sort, load_products,
    union_sources, resolve_barcodes, search_products, search_indexed, fresh_snapshots, ingredient_snapshots, additives_counted, normalize_barcodes, label_intake_gate, daily_targets, upsert_scans, newest_scans,
    set_logged, toggle_favorites, scan_insights, scan_insights_eaten, top_flagged, today_intake, today_intake_events, weekly_trend, backup_round_trip,
    backup_sections, saved_history, step_portion, body_from_imperial,
    merged_lexicon, stream_scores, stream_daily_intake, stream_latest_scan,
]


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}
