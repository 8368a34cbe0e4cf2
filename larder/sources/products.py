"""Product records, label texts, histories and backups as tables."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.exprs import letter_runs, missing, plain_spaces
from larder.operators.compare import keep_first

RAW_SCHEMA = (
    "code string, product_name string, brands string, image_front_small_url string, image_front_url string, ingredients_text string, ingredients_text_en string, "
    "categories_tags array<string>, labels_tags array<string>, additives_tags array<string>, serving_quantity string, nova_group int, nutriscore_grade string, nutriments map<string,string>"
)
#: Product domains in order of priority.
DOMAINS = ["food", "beauty", "household", "petfood"]
NO_NAME = "Unknown product"
FRESH_DAYS = {"product": 30, "ingredient": 90}
#: Sections of a user's backup: lists of rows, a list of flags, one row, a map.
BACKUP_SECTIONS = {
    "history": "array<struct<scan_id: bigint, product_id: bigint, ts: timestamp, logged: string, ate_at: timestamp, portion: double>>",
    "favorites": "array<struct<product_id: bigint, since: timestamp>>",
    "profile": "array<string>",
    "health": "struct<sex: string, age: int, cm: double, kg: double, activity: string, goal: string>",
    "settings": "map<string,string>",
}
BACKUP_SCHEMA = "app string, version int, exported_at timestamp, user_id bigint, " + ", ".join(f"{k} {t}" for k, t in BACKUP_SECTIONS.items())
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def category_of(tags: Column) -> Column:
    """The last English tag without its prefix, else the last tag without its language."""
    english = F.filter(tags, lambda t: t.startswith("en:") & (F.length(t) > 5))
    last = F.regexp_replace(F.try_element_at(tags, F.lit(-1)), "^[a-z]{2}:", "")
    return F.coalesce(F.substring(F.try_element_at(english, F.lit(-1)), 4, 1 << 30), last, F.lit(""))


def is_kosher(labels: Column) -> Column:
    return F.coalesce(F.exists(labels, lambda t: F.contains(F.lower(t), F.lit("kosher"))), F.lit(False))


def map_products(raw: DataFrame, product_type: str = "food") -> DataFrame:
    """Raw records as product rows."""
    first = lambda *names: F.coalesce(*[missing(F.col(n)) for n in names])
    return raw.select(
        F.col("code").alias("barcode"),
        F.coalesce(first("product_name"), F.lit(NO_NAME)).alias("name"),
        F.coalesce(first("brands"), F.lit("")).alias("brand"),
        F.coalesce(first("image_front_small_url", "image_front_url"), F.lit("")).alias("image"),
        category_of(F.col("categories_tags")).alias("category"),
        F.coalesce(first("ingredients_text_en", "ingredients_text"), F.lit("")).alias("ingredients_text"),
        F.lit(product_type).alias("product_type"),
        is_kosher(F.col("labels_tags")).alias("kosher"),
        "serving_quantity",
        "nova_group",
        "nutriscore_grade",
        F.coalesce("categories_tags", F.array().cast("array<string>")).alias("categories_tags"),
        F.coalesce("additives_tags", F.array().cast("array<string>")).alias("additives_tags"),
        F.coalesce("nutriments", F.create_map().cast("map<string,string>")).alias("nutriments"),
    )


def load_products(spark: SparkSession, path: str, product_type: str = "food", fmt: str = "json") -> DataFrame:
    return map_products(spark.read.schema(RAW_SCHEMA).format(fmt).load(path), product_type)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All domains with their ``source`` and ``source_rank``."""
    out = None
    for rank, name in enumerate(d for d in DOMAINS if d in sources):
        part = sources[name].withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def resolve_barcodes(products: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per barcode the row of the first source that has it; only those in ``requests (barcode)``."""
    first = keep_first(products.where(F.coalesce("barcode", F.lit("")) != ""), ["barcode"], ["source_rank", "product_id"])
    return first if requests is None else first.join(requests.select("barcode").distinct(), "barcode")


def search_products(products: DataFrame, query: str) -> DataFrame:
    """Named products whose name or brand holds ``query``, first per barcode, else name and brand."""
    q = query.strip().lower()
    told = products.where(~F.coalesce("name", F.lit("")).isin("", NO_NAME))
    hit = F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower(F.coalesce("brand", F.lit(""))), F.lit(q))
    found = told.where(hit & F.lit(len(q) >= 2))
    found = found.withColumn("key", F.coalesce(missing(F.col("barcode")), F.concat_ws("|", "name", "brand")))
    return keep_first(found, ["key"], ["source_rank", "product_id"]).drop("key")


#: Letters of the grams that an index has, and folders it is spread over.
INDEX_GRAMS, INDEX_BUCKETS = (2, 3), 256


def index_names(products: DataFrame, path: str) -> None:
    """Write which products have a gram in their name or brand, by bucket and sorted by gram."""
    sides = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "brand")]
    grams = F.array_distinct(F.concat(*[letter_runs(c, F.lit(n)) for c in sides for n in INDEX_GRAMS]))
    rows = products.select("product_id", F.explode(grams).alias("gram")).distinct().withColumn("bucket", (F.crc32("gram") % INDEX_BUCKETS).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(path)


def search_indexed(products: DataFrame, path: str, query: str) -> DataFrame:
    """``search_products`` with an index of ``index_names``: it reads the buckets of the query's
    grams, and of the products only those are compared that have the rarest of them."""
    q = query.strip().lower()
    size = min(max(INDEX_GRAMS), len(q))
    if size < min(INDEX_GRAMS):
        return search_products(products, query)
    grams = sorted({q[i : i + size] for i in range(len(q) - size + 1)})
    index = products.sparkSession.read.schema("product_id long, gram string, bucket int").parquet(path)
    index = index.where(F.col("bucket").isin([crc32(g.encode()) % INDEX_BUCKETS for g in grams]) & F.col("gram").isin(grams))
    counts = {r["gram"]: r["count"] for r in index.groupBy("gram").count().collect()}
    rarest = min(grams, key=lambda g: (counts.get(g, 0), g))
    held = index.where(F.col("gram") == rarest).select("product_id")
    return search_products(products.join(held, "product_id", "left_semi"), query)


def fresh_snapshots(snapshots: DataFrame, key: str, as_of: Column, kind: str = "product") -> DataFrame:
    """The latest snapshot per key that is at most as old as its kind may be."""
    from_ = as_of - F.make_interval(days=F.lit(FRESH_DAYS[kind]))
    fresh = snapshots.where((F.col("ts") >= from_) & (F.col("ts") <= as_of))
    rest = [c for c in snapshots.columns if c not in (key, "ts")]
    last = fresh.groupBy(key).agg(F.max(F.struct("ts", *rest)).alias("_x"))
    return last.select(key, *[F.col(f"_x.{c}").alias(c) for c in ["ts", *rest]])


def as_of_snapshots(scans: DataFrame, snapshots: DataFrame, key: str, kind: str = "ingredient", scan_id: str = "scan_id", snapshot_id: str = "snapshot_id") -> DataFrame:
    """Each of ``scans`` that has one, with the newest snapshot of its key at or before it
    that is at most as old as its kind may be, as the struct ``snapshot``.

    Of snapshots at one time the largest ``snapshot_id`` counts. Within a day both meet in a
    window by key and day; before it only each day's newest snapshot counts, so what a key
    holds in one task is a day, or a row a day, however hot it is.
    """
    day = F.to_date("ts")
    snaps = snapshots.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).alias("_k"), "ts", day.alias("_d"), F.struct("ts", F.col(snapshot_id), *[c for c in snapshots.columns if c not in (key, "ts", snapshot_id)]).alias("_s"))
    told = scans.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    asked = told.select(F.col(key).alias("_k"), "ts", day.alias("_d"), F.struct(*scans.columns).alias("_row"))
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = snaps.withColumn("_row", null(asked, "_row")).unionByName(asked.withColumn("_s", null(snaps, "_s")))
    # A snapshot at the time of a scan comes first.
    until = Window.partitionBy("_k", "_d").orderBy("ts", F.col("_row").isNotNull(), f"_s.{snapshot_id}").rowsBetween(Window.unboundedPreceding, 0)
    same_day = both.withColumn("_same", F.last("_s", ignorenulls=True).over(until)).where("_row IS NOT NULL").select("_k", "_d", "_row", "_same")

    newest = snaps.groupBy("_k", "_d").agg(F.max("_s").alias("_s"))
    days = newest.unionByName(asked.select("_k", "_d").distinct().withColumn("_s", null(snaps, "_s"))).groupBy("_k", "_d").agg(F.max("_s").alias("_s"))
    before = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    earlier = days.select("_k", "_d", F.last("_s", ignorenulls=True).over(before).alias("_before")).where("_before IS NOT NULL")
    found = same_day.join(earlier, ["_k", "_d"], "left").select("_row.*", F.coalesce("_same", "_before").alias("snapshot"))
    return found.where(F.col("snapshot.ts") >= F.col("ts") - F.make_interval(days=F.lit(FRESH_DAYS[kind])))


def normalize_barcodes(codes: DataFrame, code_col: str = "code", least: int = 8) -> DataFrame:
    """Adds ``barcode``, the digits of the code; codes with fewer than ``least`` digits go."""
    digits = F.regexp_replace(F.coalesce(F.col(code_col), F.lit("")), "[^0-9]", "")
    return codes.withColumn("barcode", digits).where(F.length("barcode") >= max(least, 1))


def label_intake_gate(labels: DataFrame) -> DataFrame:
    """Adds ``gate``: reject, review or accept, by visible characters and confidence."""
    seen = F.length(F.regexp_replace(plain_spaces(F.col("text")), r"\s+", ""))
    poor = (F.coalesce("confidence", F.lit(0.0)) < 60) | (seen < 12)
    return labels.withColumn("gate", F.when(seen < 6, "reject").when(poor, "review").otherwise("accept"))


def override_products(products: DataFrame, overrides: DataFrame) -> DataFrame:
    """Products with the text and type of ``overrides (product_id, text, product_type)`` where
    these are told: a label that was read itself wins over the record's."""
    o = overrides.select("product_id", missing(F.col("text")).alias("_text"), missing(F.col("product_type")).alias("_type"))
    out = products.join(o, "product_id", "left")
    out = out.withColumn("ingredients_text", F.coalesce("_text", "ingredients_text")).withColumn("product_type", F.coalesce("_type", missing(F.col("product_type")), F.lit("food")))
    return out.select(*products.columns)


def export_backup(path: str, exported_at: Column, history: DataFrame, favorites: DataFrame | None = None, profiles: DataFrame | None = None, health: DataFrame | None = None, settings: DataFrame | None = None) -> None:
    """One JSON record per user with the sections given; a user's saved rows are bounded by
    what a history keeps. ``settings`` is ``(user_id, settings map)``, the others are tables
    with a ``user_id``, ``profiles`` one row a flag."""
    listed = lambda df, *cols: df.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_x"))
    parts = {"history": listed(history, "scan_id", "product_id", "ts", "logged", "ate_at", "portion")}
    if favorites is not None:
        parts["favorites"] = listed(favorites, "product_id", "since")
    if profiles is not None:
        parts["profile"] = profiles.groupBy("user_id").agg(F.sort_array(F.collect_set("profile_key")).alias("_x"))
    if health is not None:
        parts["health"] = health.select("user_id", F.struct("sex", "age", "cm", "kg", "activity", "goal").alias("_x"))
    if settings is not None:
        parts["settings"] = settings.select("user_id", F.col("settings").alias("_x"))
    out = None
    for name, part in parts.items():
        part = part.withColumnRenamed("_x", name)
        out = part if out is None else out.join(part, "user_id", "full_outer")
    out = out.select(F.lit("larder").alias("app"), F.lit(4).alias("version"), exported_at.alias("exported_at"), "user_id", *parts)
    out.write.mode("overwrite").options(**_TIME).json(path)


def import_backup(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections as tables with a ``user_id``, and ``users``: who has which section, since a
    section may be there and empty."""
    saved = spark.read.schema(BACKUP_SCHEMA).options(**_TIME).json(path)
    return {
        "users": saved.select("user_id", *[F.col(k).isNotNull().alias(k) for k in BACKUP_SECTIONS]),
        "history": saved.select("user_id", F.inline("history")),
        "favorites": saved.select("user_id", F.inline("favorites")),
        "profile": saved.select("user_id", F.explode("profile").alias("profile_key")),
        "health": saved.where("health IS NOT NULL").select("user_id", "health.*"),
        "settings": saved.where("settings IS NOT NULL").select("user_id", "settings"),
    }


def replace_section(old: DataFrame, saved: dict[str, DataFrame], section: str) -> DataFrame:
    """The rows of a section after an import: those of users whose backup has it are replaced."""
    told = saved["users"].where(section).select("user_id")
    return old.join(told, "user_id", "left_anti").select(*old.columns).unionByName(saved[section].select(*old.columns))
