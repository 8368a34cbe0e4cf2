"""Benchmark decontamination, native: template canonicalisation.

Words become tokens without punctuation; digits, names and units become typed placeholders,
everything else is lower-cased. Items with equal placeholders are one template. Windows of
WINDOW tokens are hashed and hash-joined between documents and templates, so a question with
other numbers or names still meets its template. Then the slots of each item are compared at
the alignments found: within one alignment every value of the item must always meet the same
value in the document, and no two values may meet the same one, changed or not. Tokens of a
consistent alignment count; of an inconsistent one only those count that are the item's own
words and values. A document is contaminated by an item when COVERAGE of the item's tokens
count.

Only windows that a match needs are joined: a document that covers enough of a template
holds at least m of its w windows, so one of any w - m + 1; the windows that most templates
share are left out, and a common phrase of questions does not pair documents with all of
them. What the others could add is granted before the alignments are compared token by token.

The window index is broadcast only after its rows and bytes are checked; beyond the bound the
join shuffles by hash.

Items with fewer than WINDOW tokens have no room for other values and are matched word for
word, in lower case, wherever a document has them. Windows and items made of placeholders
alone are not indexed, as they carry no words. A capital at the start of a sentence is no
name, since any word may stand there: a name that is replaced there costs its one token.

Defined results: null or empty texts have no tokens and match nothing, and so does an empty
table on either side; very long texts are searched whole; repeated rows of a document give
the row once per (doc_id, item_id), rows that share only the id are searched one by one and
the best match is told; null ids are kept as null; repeated items are one, and items that
share only the id are searched one by one; other columns may have any names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import bound, durable, is_small, small_side, table

WINDOW = 5
COVERAGE = 0.8
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Measuring units that follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet yd yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks year years "
    "k c f percent dollar dollars usd euro euros eur cent cents hz khz mhz w kw v a j kj cal kcal"
).split()
_MARK = "\x01"
#: A capital after a lower-case letter, a digit or a comma, so not at the start of a sentence.
_NAME_START = r"(?<=[\p{Ll}\p{N},]\s)(?=\p{Lu})"
_NO_WORD = r"[^\p{L}\p{N}\s\x01]+"


def marked(text: Column) -> Column:
    """The text without punctuation, names marked; tokens are what white space separates."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _NAME_START, _MARK), _NO_WORD, "")


def canonical(mark: Column) -> Column:
    """Typed placeholders instead of units, names and digits; the tokens stay as many."""
    units = r"(?<=\p{N}\s)(?i:" + "|".join(UNITS) + r")(?!\S)"
    t = F.regexp_replace(F.regexp_replace(mark, units, UNIT), r"\x01\S*", NAME)
    return F.lower(F.regexp_replace(t, r"\p{N}+", NUM))


def tokens(text: Column) -> Column:
    """Words between white space, without the empty ones at the ends."""
    return F.array_remove(F.split(text, r"\s+"), "")


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, in order."""
    at = lambda w: lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    every = lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), at(w)))
    return bound(words, every)


def _spoken(words: Column) -> Column:
    """Whether any of the tokens is more than placeholders."""
    return F.exists(words, lambda x: F.regexp_replace(x, "<num>|<unit>|<name>", "") != "")


def _index(templates: DataFrame, window: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """``(tpl, ipos, hash)`` of the windows to join, and ``(tpl, n, free)`` of the templates
    that can be covered, ``free`` being the tokens of the windows left out."""
    every = templates.select("tpl", "words", F.posexplode(_windows(F.col("words"), window)).alias("ipos", "hash"))
    every = every.where(_spoken(F.slice("words", F.col("ipos") + 1, F.lit(window)))).select("tpl", F.size("words").alias("n"), "ipos", "hash")
    shared = every.groupBy("hash").agg(F.count("*").alias("shared"))
    one, rarest = Window.partitionBy("tpl"), Window.partitionBy("tpl").orderBy("shared", "ipos")
    least = F.ceil(F.ceil(F.col("n") * coverage) / window)
    ranked = every.join(shared, "hash").select("*", (F.count("*").over(one) - least + 1).alias("probes"), F.row_number().over(rarest).alias("rank"))
    ranked = durable(ranked.where("probes >= 1"), "windows")
    offsets = F.sequence(F.col("ipos"), F.col("ipos") + (window - 1))
    left_out = F.when(F.col("rank") > F.col("probes"), offsets).otherwise(F.array().cast("array<int>"))
    free = ranked.groupBy("tpl").agg(F.first("n").alias("n"), F.array_distinct(F.flatten(F.collect_list(left_out))).alias("free"))
    return ranked.where("rank <= probes").select("tpl", "ipos", "hash"), free


def _starts(words: Column, window: int) -> Column:
    """Where the windows with a word in them begin."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - window), lambda p: _spoken(F.slice(words, p + 1, F.lit(window))))


def _at(words: Column, shift: Column, template: Column, starts: Column, window: int) -> Column:
    """Positions of the template whose windows the document has at ``shift``."""
    equal = lambda p: (p + shift >= 0) & reduce(and_, [F.get(words, p + shift + k) == F.get(template, p + k) for k in range(window)])
    return F.array_distinct(F.flatten(F.transform(F.filter(starts, equal), lambda p: F.sequence(p, p + (window - 1)))))


def _counted(pairs: Column) -> Column:
    """Positions of ``pairs array<(i, a, b)>`` that count: all if the values agree, else equal ones."""
    kinds = [F.array_distinct(F.transform(pairs, f)) for f in (lambda x: F.struct(x["a"], x["b"]), lambda x: x["a"], lambda x: x["b"])]
    agreed = (F.size(kinds[0]) == F.size(kinds[1])) & (F.size(kinds[0]) == F.size(kinds[2]))
    return F.transform(F.filter(pairs, lambda x: agreed | (x["a"] == x["b"])), lambda x: x["i"])


def _runs(size: int):
    """All runs of ``size`` words of an array, each once."""
    run = lambda w: lambda i: F.array_join(F.slice(w, i + 1, size), " ")
    return lambda w: F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), run(w))))


def matches(docs: DataFrame, bench: DataFrame, doc_id="doc_id", item_id="item_id", text_col="text", window=WINDOW, coverage=COVERAGE) -> DataFrame:
    """``(doc, th, item, n, good)``: documents by id and text hash, the items they hold, the
    item's tokens and how many of them count. May repeat a row."""
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    mark = marked(F.col("text"))
    items = bench.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")).dropDuplicates()
    items = items.select("item", tokens(mark).alias("core"), tokens(canonical(mark)).alias("words")).where(_spoken(F.col("words")))
    items = durable(items.withColumn("tpl", F.xxhash64("words")), "items")
    long_ = items.where(F.size("words") >= window).withColumn("starts", _starts(F.col("words"), window))
    templates = long_.groupBy("tpl").agg(F.first("words").alias("words"))

    index, free = _index(templates, window, coverage)
    every = _windows(tokens(canonical(mark)), window)
    hits = d.select("doc", "th", F.posexplode(every).alias("pos", "hash")).join(small_side(index), "hash")
    runs = hits.groupBy("doc", "th", "tpl", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"))
    runs = runs.join(small_side(free), "tpl")
    spans = F.flatten(F.transform("at", lambda p: F.sequence(p, p + (window - 1))))
    near = runs.groupBy("doc", "th", "tpl").agg(
        F.collect_list("shift").alias("shifts"), F.flatten(F.collect_list(F.array_distinct(spans))).alias("met"), F.first("n").alias("n"), F.first("free").alias("free")
    )
    enough = F.size(F.array_union(F.array_distinct("met"), "free")) >= F.ceil(F.col("n") * coverage)
    near = durable(near.where(enough).select("doc", "th", "tpl", "shifts"), "near")

    # Alignments are compared on the few candidates only; their texts come back by an equi-join.
    asked = near.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "tpl", "shifts")
    asked = F.broadcast(asked) if is_small(asked) else asked.hint("shuffle_hash")
    told = d.join(asked, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
    told = told.select("doc", "th", "tpl", "shifts", tokens(mark).alias("dcore"), tokens(canonical(mark)).alias("dwords")).join(small_side(long_), "tpl")

    def counts(doc: Column) -> Column:
        def run(shift: Column) -> Column:
            pair = lambda i: F.struct(i.alias("i"), F.lower(F.get(F.col("core"), i)).alias("a"), F.lower(F.get(doc["core"], i + shift)).alias("b"))
            return bound(F.transform(_at(doc["words"], shift, F.col("words"), F.col("starts"), window), pair), _counted)

        return F.size(F.array_distinct(F.flatten(F.transform("shifts", run))))

    good = bound(F.struct(F.col("dcore").alias("core"), F.col("dwords").alias("words")), counts)
    told = told.select("doc", "th", "item", F.size("words").alias("n"), good.alias("good"))
    # Written, so that the filter does not count again.
    found = durable(told, "counted").where(F.col("good") >= F.ceil(F.col("n") * coverage))

    short = items.where(F.size("words") < window).select("item", F.array_join(F.transform("core", F.lower), " ").alias("say"), F.size("core").alias("n"))
    for size in sorted(r[0] for r in short.select("n").distinct().collect()):
        own = small_side(short.where(F.col("n") == size))
        said = bound(F.transform(tokens(mark), F.lower), _runs(size))
        found = found.unionByName(d.select("doc", "th", F.explode(said).alias("say")).join(own, "say").select("doc", "th", "item", "n", F.col("n").alias("good")))
    return found


def contaminated(docs: DataFrame, bench: DataFrame, doc_id="doc_id", item_id="item_id", text_col="text", window=WINDOW, coverage=COVERAGE) -> DataFrame:
    """``(doc_id, item_id, n_tokens, n_covered, coverage)`` of contaminated documents."""
    found = matches(docs, bench, doc_id, item_id, text_col, window, coverage).withColumn("coverage", F.col("good") / F.col("n"))
    best = found.groupBy("doc", "item").agg(F.max(F.struct("coverage", "n", "good")).alias("x"))
    return best.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("x.n").cast("long").alias("n_tokens"),
        F.col("x.good").cast("long").alias("n_covered"),
        F.col("x.coverage").alias("coverage"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, doc_id="doc_id", item_id="item_id", text_col="text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; rows are told apart by id and text."""
    gone = durable(matches(docs, bench, doc_id, item_id, text_col).select(F.col("doc").alias("_doc"), F.col("th").alias("_th")).distinct(), "gone")
    gone = F.broadcast(gone) if is_small(gone) else gone.hint("shuffle_hash")
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_doc"]) & (F.xxhash64(docs[text_col]) == gone["_th"]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LITERAL = "len(list_filter({0}, lambda x: regexp_replace(x, '<num>|<unit>|<name>', '', 'g') <> '')) > 0"
OP10_SQL = f"""
WITH src AS (
  SELECT DISTINCT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark
), marked AS (
  SELECT k, id, regexp_replace(regexp_replace(coalesce(text, ''), '([\\p{{Ll}}\\p{{N}},]\\s)(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), '[^\\p{{L}}\\p{{N}}\\s\\x01]+', '', 'g') AS m FROM src
), cut AS (
  SELECT k, id, list_filter(regexp_split_to_array(m, '\\s+'), lambda x: x <> '') AS core,
    list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(m, '(\\p{{N}}\\s)(?:(?i){"|".join(UNITS)})(\\s|$)', '\\1{UNIT}\\2', 'g'),
      '\\x01\\S*', '{NAME}', 'g'), '\\p{{N}}+', '{NUM}', 'g')), '\\s+'), lambda x: x <> '') AS words
  FROM marked
), windows AS (
  SELECT k, id, pos, list_slice(words, pos + 1, pos + {WINDOW}) AS w FROM (SELECT k, id, words, unnest(range(0, greatest(len(words) - {WINDOW - 1}, 0))) AS pos FROM cut)
), hits AS (
  SELECT d.id AS doc, b.id AS item, d.pos - b.pos AS shift, b.pos AS ipos
  FROM (SELECT * FROM windows WHERE k = 'd') d JOIN (SELECT * FROM windows WHERE k = 'b' AND {_LITERAL.format('w')}) b ON d.w = b.w
), cov AS (
  SELECT DISTINCT doc, item, shift, ipos + j AS i FROM hits, range(0, {WINDOW}) r(j)
), pairs AS (
  SELECT doc, item, shift, i, lower(b.core[i + 1]) AS a, lower(d.core[i + shift + 1]) AS c
  FROM cov JOIN cut d ON d.k = 'd' AND d.id = doc JOIN cut b ON b.k = 'b' AND b.id = item
), judged AS (
  SELECT doc, item, shift, count(DISTINCT (a, c)) = count(DISTINCT a) AND count(DISTINCT (a, c)) = count(DISTINCT c) AS agreed FROM pairs GROUP BY doc, item, shift
), found AS (
  SELECT doc, item, count(DISTINCT i) AS n FROM pairs JOIN judged USING (doc, item, shift) WHERE agreed OR a = c GROUP BY doc, item
), spoken AS (
  SELECT k, id, list_transform(core, lambda x: lower(x)) AS said, len(core) AS n FROM cut
), short AS (
  SELECT DISTINCT d.id AS doc, b.id AS item, b.n
  FROM (SELECT id, said, n FROM spoken JOIN cut USING (k, id) WHERE k = 'b' AND n < {WINDOW} AND {_LITERAL.format('words')}) b,
    (SELECT id, said, n, unnest(range(0, n)) AS p FROM spoken WHERE k = 'd') d
  WHERE d.p + b.n <= d.n AND list_slice(d.said, d.p + 1, d.p + b.n) = b.said
)
SELECT doc AS doc_id, item AS item_id, len(words) AS n_tokens, n AS n_covered, n / len(words)::DOUBLE AS coverage
FROM found JOIN cut ON k = 'b' AND id = item WHERE n >= ceil(len(words) * {COVERAGE})
UNION ALL SELECT doc, item, n, n, 1.0::DOUBLE FROM short
"""
