"""License scans, native: an exact set-similarity join of text blocks with license templates.

Texts become words. For every size class of templates a text is cut into blocks of twice that
many words, each beginning in the middle of the one before, so a passage of the template's
length stands whole in one block. The words of the templates are ordered by how often the
corpus has them, the rarest first, counted over all documents. A block holds ``CONTAINMENT``
of a template's n distinct words only if it has one of the template's first
n - ceil(CONTAINMENT n) + 1 words in that order (prefix filter), if it has enough distinct
words (length filter), and if the prefix words that it has, together with all words after the
prefix, are enough (positional filter). What passes is counted exactly.

Blocks are looked at only around prefix words, which are looked up in sets within the row; a
pair of block and template is made at the first prefix word that they share, once. Nothing is
shuffled but the counts of template words and one row per labelled document. Templates are
met in slices of at most VOCABULARY words, each of which is a pass over the texts, so a table
of templates of any size is scanned whole.

Templates longer than LONGEST words count as passages of at most that many; a label is given
for any passage. Places where one of PHRASES stands word for word are counted by themselves.

Defined results: null and empty texts have no words and no labels; very long texts are read
whole; repeated rows each come back; empty tables give no rows, and without templates only
the phrases label; null ids are kept; templates without a word, a label or a text are left
out, repeated ones count once; of ties nothing depends; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import bound, durable, is_small, small_side, table
from larder.llm.line_dedup import ascii_lower
from larder.sources.lexicon import local_table

CONTAINMENT = 0.8
#: Words of a passage at most, and of a short one.
LONGEST, SHORT = 64, 8
#: Template words that one pass looks for.
VOCABULARY = 20_000
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by which public licenses are told.
TEMPLATES = [
    ("agpl", "affero general public license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by-nc", "CC BY NC"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-nd", "CC BY ND"),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("epl", "Eclipse Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "lesser general public license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mpl", "Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def spoken(text: Column) -> Column:
    """Words in lower case (A to Z), joined by one space."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_of(said: Column) -> Column:
    return F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, " "))


def passages(templates: DataFrame, longest: int = LONGEST, short: int = SHORT) -> DataFrame:
    """``(label, words, size)``: distinct words of each passage and its size class."""
    told = templates.where("label IS NOT NULL AND label <> ''").select("label", words_of(spoken(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(longest))
    parts = told.select("label", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(longest)))).alias("w"))
    return parts.select("label", F.array_sort(F.array_distinct("w")).alias("words"), F.when(F.size("w") <= short, short).otherwise(longest).alias("size")).distinct()


def ordered(parts: DataFrame, docs_words: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``parts`` with words by corpus frequency, the least they must share, and the prefix.

    ``docs_words (words)`` are all documents; their words are counted before the shuffle.
    """
    known = durable(parts.select(F.explode("words").alias("word")).distinct(), "known")
    counts = docs_words.select(F.explode("words").alias("word")).join(small_side(known), "word").groupBy("word").agg(F.count("*").alias("n"))
    each = parts.select("label", "size", "words", F.explode("words").alias("word")).join(small_side(durable(counts, "counts")), "word", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
    told = each.groupBy("label", "size", "words").agg(F.transform(order, lambda x: x["word"]).alias("order"))
    least = F.ceil(F.size("order") * F.lit(containment)).cast("int")
    told = told.select("label", "size", F.col("order").alias("tpl"), least.alias("least"), F.slice("order", F.lit(1), F.size("order") - least + 1).alias("prefix"))
    # Slices of so many words that one pass can look for them.
    running = Window.partitionBy("size").orderBy("label", "tpl").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("slice", F.floor((F.sum(F.size("prefix")).over(running) - 1) / VOCABULARY))


def met_templates(docs_words: DataFrame, parts: DataFrame) -> DataFrame:
    """``(doc, th, label, share)`` of blocks that hold the templates ``parts``; may repeat."""
    found = []
    for size, k in sorted((r["size"], r["slice"]) for r in parts.select("size", "slice").distinct().collect()):
        own = parts.where((F.col("size") == size) & (F.col("slice") == k))
        rare = [r[0] for r in own.select(F.explode("prefix")).distinct().collect()]
        probes = small_side(own.select("label", "tpl", "least", "prefix", F.explode("prefix").alias("probe")))
        # A block begins every ``size`` words, so each place lies in two of them.
        at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(rare), F.floor(i / size).cast("int"))))
        blocks = F.array_distinct(F.flatten(F.transform(at, lambda b: F.array(F.greatest(b - 1, F.lit(0)), b))))
        near = docs_words.where(F.exists("words", lambda w: w.isin(rare)))
        cut = near.select("doc", "th", F.explode(bound(F.col("words"), lambda w: F.transform(blocks, lambda b: F.array_distinct(F.slice(w, b * size + 1, F.lit(2 * size)))))).alias("block"))
        pairs = cut.select("doc", "th", "block", F.explode(F.filter("block", lambda w: w.isin(rare))).alias("probe")).join(probes, "probe")
        shared = F.array_intersect("prefix", "block")
        pairs = pairs.where((F.get(shared, F.lit(0)) == F.col("probe")) & (F.size("block") >= F.col("least")))
        pairs = pairs.where(F.size(shared) + F.size("tpl") - F.size("prefix") >= F.col("least"))
        both = F.size(F.array_intersect("tpl", "block"))
        found.append(pairs.where(both >= F.col("least")).select("doc", "th", "label", (both / F.size("tpl")).alias("share")))
    return reduce(DataFrame.unionByName, found) if found else docs_words.select("doc", "th", F.lit("").alias("label"), F.lit(0.0).alias("share")).limit(0)


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words begin."""
    first, *rest = phrase.split(" ")
    here = lambda x, i: reduce(and_, [F.get(words, i + k) == s for k, s in enumerate(rest, 1)], x == first)
    return F.array_compact(F.transform(words, lambda x, i: F.when(here(x, i), i)))


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col="doc_id", text_col="text", phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row.

    ``templates (label, text)``. ``score`` is 1 where a phrase stands, else the largest share
    of a template's words that a block holds, among those of the threshold or more, else 0.
    """
    said = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), spoken(F.col(text_col)).alias("said"))
    words = said.select("doc", "th", words_of(F.col("said")).alias("words"))
    parts = durable(ordered(passages(templates), words, containment), "templates")
    met = met_templates(words, parts).groupBy("doc", "th").agg(F.collect_set("label").alias("_found"), F.max("share").alias("_share"))
    met = durable(met, "licensed").withColumnsRenamed({"doc": "_doc", "th": "_th"})
    met = F.broadcast(met) if is_small(met) else met.hint("shuffle_hash")

    padded = F.concat(F.lit(" "), F.col("said"), F.lit(" "))
    has = {p: F.contains(padded, F.lit(f" {p} ")) for p in phrases}
    places = bound(words_of(F.col("said")), lambda w: F.concat(*[F.when(has[p], _places(w, p)).otherwise(F.array().cast("array<int>")) for p in phrases]))
    none = F.array().cast("array<string>")
    labels = F.array_compact(F.array(*[F.when(has[p], x) for p, x in phrases.items()]))
    base = said.select(
        "doc",
        "th",
        F.when(F.col("said") == "", 0).otherwise(F.length("said") - F.length(F.replace(F.col("said"), F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(reduce(or_, has.values()), places).otherwise(F.array().cast("array<int>")).alias("_at"),
        F.array_distinct(labels).alias("_base"),
    )
    both = base.join(met, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    return both.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_found", none))), ",").alias("labels"),
        F.when(F.size("_at") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def known_templates(spark: SparkSession) -> DataFrame:
    return local_table(spark, TEMPLATES, "label string, text string")


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_templates(spark))


_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH templates(label, said) AS (
  VALUES {", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)}
), passages AS (
  SELECT DISTINCT label, list_sort(list_distinct(w)) AS words, len(list_distinct(w)) AS n, CASE WHEN len(w) <= {SHORT} THEN {SHORT} ELSE {LONGEST} END AS size
  FROM (SELECT label, regexp_extract_all({_LOW.format("said")}, '{_SQL_WORD}') AS w FROM templates)
), docs AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_SQL_WORD}') AS w FROM documents
), blocks AS (
  SELECT DISTINCT doc_id, size, list_distinct(list_slice(w, b * size + 1, (b + 2) * size)) AS block
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) // size + 1)) AS b FROM docs, (SELECT DISTINCT size FROM passages))
), met AS (
  SELECT doc_id, label, len(list_intersect(words, block)) AS k, n FROM blocks JOIN passages USING (size) WHERE list_has_any(words, block)
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(k / n::DOUBLE) AS share FROM met WHERE k >= ceil(n * {CONTAINMENT}) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w) AS n_words, {", ".join(f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'''w[i + {k}] = '{x}' ''' for k, x in enumerate(p.split(' '), 1))}) AS p{j}" for j, p in enumerate(PHRASES))} FROM docs
), places AS (
  SELECT doc_id, n_words, {" || ".join(f"p{j}" for j in range(len(PHRASES)))} AS p,
    {" || ".join(f"CASE WHEN len(p{j}) > 0 THEN ['{x}'] ELSE [] END" for j, x in enumerate(PHRASES.values()))} AS labels FROM base
)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word,
  array_to_string(list_sort(places.labels), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(places.labels || coalesce(found.labels, []))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM places LEFT JOIN found USING (doc_id)
"""
