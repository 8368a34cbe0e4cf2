"""Phrase collocation mining by direct-address tiling.

Words are numbered by frequency within their language. Neighbouring numbers make pairs, and
the plane of pairs is cut into tiles: bands of numbers of about equal mass, as many a side
that a tile has about TILE_MASS occurrences. A tile of at most DENSE cells is counted by
direct address (numpy bincount); any other is kept as sorted coordinates and numbers. Pairs
of MIN_COUNT or more get numbers by frequency again, and neighbouring pairs, which overlap in
all but one word, are the pairs of the next round: so phrases of one word more are counted in
the same way, and only where both their parts are frequent.

Plan: one map writes the texts as blocks of local word numbers, each of one language and of
about BLOCK_BYTES at most, and each block's words. From then on a round is a cogroup, by
block, of the block's numbers with the global numbers of what it holds, which writes the new numbers
and the block's pairs by tile; a grouping by tile, which sums them up; and a numbering by
counting, in which no task sorts a language. What a block learns is what it holds, so no
vocabulary is broadcast, and what a task holds is one block or one tile.

Phrases carry the counts of all their beginnings and ends, so every cut is scored without
another join on texts. Products are decimals of 38 digits.

Defined results: null and empty texts have no words; a null language is ``und``; very long
texts count whole (a block holds at most one beyond its size); repeated rows each count; an
empty table gives no rows; equal scores are told apart by count, then phrase, so no tie is
left; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import durable, small_side, table

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if so many percent of its occurrences stand in a longer one.
INSIDE = 80
SCALE = 2_000_000
BLOCK_BYTES = 64 << 20
#: Occurrences that a tile has on average, and cells up to which it is counted by direct address.
TILE_MASS = 4_000_000
DENSE = 1 << 22
#: Numbers below are counted by direct address in a block.
HEAD = 1 << 10
#: Parts of words of one frequency that are numbered apart.
_PARTS = 64
_END = re.compile(rb"[.,;:!?\n-\r]+")


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers by bytes of equal weight, deflated."""
    return zlib.compress(np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").ravel()


_BLOCKS = "lang string, block long, units binary, local long, word string, n long"


def word_blocks(docs: DataFrame, text_col="text", lang_col="lang") -> DataFrame:
    """Blocks of local word numbers (``units``; 0 ends a piece), and each block's words."""
    src = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [f.split(" ")[0] for f in _BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def fresh() -> tuple[defaultdict, list[np.ndarray]]:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        number[b"\n"] = 0
        return number, []

    def batch(rows: int, **told) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(told[c], t) if c in told else pa.nulls(rows, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def out(first: int, langs: dict) -> Iterator[pa.RecordBatch]:
        for block, (lang, (number, parts)) in enumerate(langs.items(), first):
            units = np.concatenate(parts)
            yield batch(1, lang=[lang], block=[block], units=[_pack(units)])
            counts, words = np.bincount(units, minlength=len(number)), list(number)
            for k in range(1, len(words), 1 << 16):
                own = words[k : k + (1 << 16)]
                n = len(own)
                yield batch(n, lang=[lang] * n, block=[block] * n, local=np.arange(k, k + n), word=[w.decode() for w in own], n=counts[k : k + n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, langs, size = TaskContext.get().partitionId() << 32, {}, 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                rows = whole.slice(k, 256)
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if lang not in langs:
                        langs[lang] = fresh()
                    number, parts = langs[lang]
                    data = _END.sub(b" \n ", text.encode().lower()).replace(b"\t", b" ")
                    parts.append(np.fromiter(map(number.__getitem__, [w for w in [*data.split(b" "), b"\n"] if w]), np.int64))
                    size += len(data)
                    if size >= BLOCK_BYTES:
                        yield from out(block, langs)
                        block, langs, size = block + len(langs), {}, 0
        yield from out(block, langs)

    return src.mapInArrow(run, _BLOCKS)


def numbered(units: DataFrame, key: list[str]) -> DataFrame:
    """``units (lang, *key, f)`` with ``id`` from 1 by falling ``f`` within the language, and ``band``.

    Numbers come from counts by language, frequency and hash: as many rows as a language has
    frequencies, times _PARTS. Within such a part rows are numbered by key.
    """
    units = units.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(_PARTS)))
    sizes = durable(units.groupBy("lang", "f", "part").agg(F.count("*").alias("size")), "frequencies")
    before = Window.partitionBy("lang").orderBy(F.desc("f"), "part").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.coalesce(F.sum(F.col("f") * F.col("size")).over(before), F.lit(0))
    total = F.sum(F.col("f") * F.col("size")).over(Window.partitionBy("lang"))
    starts = sizes.select("lang", "f", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), mass.alias("mass"), total.alias("total"))
    bands = F.ceil(F.sqrt(F.col("total") / TILE_MASS))
    starts = durable(starts.select("lang", "f", "part", "start", F.floor(F.col("mass") / F.col("total") * bands).alias("band")), "starts")
    own = F.row_number().over(Window.partitionBy("lang", "f", "part").orderBy(*key))
    return units.join(small_side(starts), ["lang", "f", "part"]).withColumn("id", own + F.col("start")).drop("part", "start")


_ROUND = "lang string, block long, units binary, across long, down long, keys binary, counts binary"


def _recoded(level: int):
    """Cogroup of a block with the numbers of what it holds: its new units, its pairs by tile."""

    def run(key: tuple, block: pa.Table, known: pa.Table) -> pa.Table:
        number, rows = key[0].as_py(), []
        for lang, packed in zip(block["lang"].to_pylist(), block["units"].to_pylist(), strict=True):
            u = _unpack(packed)
            held = u if level == 1 else np.where((u[:-1] > 0) & (u[1:] > 0), u[:-1] << 32 | u[1:], 0)
            keys, ids, bands = _known(known)
            order = np.argsort(keys)
            keys = np.concatenate([keys[order], [np.iinfo(np.int64).max]])
            at = np.searchsorted(keys, held)
            at = np.where(keys[at] == held, at, len(keys) - 1)
            units = np.append(ids[order], 0)[at]
            rows.append({"lang": lang, "block": number, "units": _pack(units)})
            if level < LONGEST:
                rows += [{"lang": lang, "block": number, **tile} for tile in _tiles(units, ids, bands)]
        return pa.Table.from_pylist(rows, _round_schema())

    return run


def _known(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, numbers and bands: a row each, or packed by tile."""
    if "key" in rows.column_names:
        return tuple(rows[c].to_numpy() for c in ("key", "id", "band"))
    none = np.zeros(0, np.int64)
    keys = np.concatenate([none, *[np.cumsum(_unpack(x)) for x in rows["keys"].to_pylist()]])
    return keys, *(np.concatenate([none, *map(_unpack, rows[c].to_pylist())]) for c in ("ids", "bands"))


def _round_schema() -> pa.Schema:
    return pa.schema([("lang", pa.string()), ("block", pa.int64()), ("units", pa.binary()), ("across", pa.int64()), ("down", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _tiles(units: np.ndarray, ids: np.ndarray, bands: np.ndarray) -> Iterator[dict]:
    """The block's pairs of neighbours with their numbers, by tile."""
    a, b = units[:-1], units[1:]
    both = (a > 0) & (b > 0)
    if not both.any():
        return
    head = both & (a < HEAD) & (b < HEAD)
    dense = np.bincount(a[head] * HEAD + b[head], minlength=1)
    cells = np.flatnonzero(dense)
    keys, counts = np.unique((a << 32 | b)[both & ~head], return_counts=True)
    keys, counts = np.concatenate([cells // HEAD << 32 | cells % HEAD, keys]), np.concatenate([dense[cells], counts])
    order = np.argsort(ids)
    left, right = (bands[order][np.searchsorted(ids[order], side)] for side in (keys >> 32, keys & 0xFFFFFFFF))
    order = np.lexsort((keys, right, left))
    keys, counts, left, right = keys[order], counts[order], left[order], right[order]
    cuts = np.flatnonzero((np.diff(left, prepend=-1) != 0) | (np.diff(right, prepend=-1) != 0))
    for start, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield {"across": int(left[start]), "down": int(right[start]), "keys": _pack(np.diff(keys[start:end], prepend=0)), "counts": _pack(counts[start:end])}


_TILE = "lang string, across long, down long, block long, keys binary, key long, f long"


def _summed(least: int):
    """Frequent pairs of a tile with their counts over all blocks, and which each block has."""

    def run(tile_key: tuple, tile: pa.Table) -> pa.Table:
        where = dict(zip(("lang", "across", "down"), (k.as_py() for k in tile_key), strict=True))
        keys = [np.cumsum(_unpack(k)) for k in tile["keys"].to_pylist()]
        counts = [_unpack(c) for c in tile["counts"].to_pylist()]
        every, n = np.concatenate(keys), np.concatenate(counts)
        a, b = every >> 32, every & 0xFFFFFFFF
        width = int(b.max() - b.min() + 1)
        if int(a.max() - a.min() + 1) * width <= DENSE:
            at = (a - a.min()) * width + b - b.min()
        else:
            at = np.unique(every, return_inverse=True)[1]
        # Sums of whole numbers below 2^53 are exact in double precision.
        total = np.bincount(at, n).astype(np.int64)[at]
        kept = total >= least
        rows, start = [], 0
        for block, own in zip(tile["block"].to_pylist(), keys, strict=True):
            held = own[kept[start : start + len(own)]]
            start += len(own)
            if len(held):
                rows.append({**where, "block": block, "keys": _pack(np.diff(held, prepend=0))})
        found, first = np.unique(every[kept], return_index=True)
        schema = pa.schema([("lang", pa.string()), *[(c, pa.int64()) for c in ("across", "down", "block")], ("keys", pa.binary()), ("key", pa.int64()), ("f", pa.int64())])
        size = len(found)
        own = {c: pa.array([v] * size, schema.field(c).type) for c, v in where.items()} | {"block": pa.nulls(size, pa.int64()), "keys": pa.nulls(size, pa.binary()), "key": pa.array(found), "f": pa.array(total[kept][first])}
        return pa.concat_tables([pa.Table.from_pylist(rows, schema), pa.table(own, schema)])

    return run


def _placed(blocks: pa.Table, ids: pa.Table) -> pa.Table:
    """The numbers of a tile's frequent pairs for each block that has them."""
    keys = ids["key"].to_numpy()
    order = np.argsort(keys)
    keys, number, band = keys[order], ids["id"].to_numpy()[order], ids["band"].to_numpy()[order]
    rows = []
    for block, packed in zip(blocks["block"].to_pylist(), blocks["keys"].to_pylist(), strict=True):
        at = np.searchsorted(keys, np.cumsum(_unpack(packed)))
        rows.append({"block": block, "keys": packed, "ids": _pack(number[at]), "bands": _pack(band[at])})
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("keys", "ids", "bands")]]))


def phrases(docs: DataFrame, text_col="text", lang_col="lang", min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, f, first, last)`` of phrases of 2 words or more, with the counts of all
    their beginnings and ends, shortest first; and ``(lang, n)``."""
    blocks = durable(word_blocks(docs, text_col, lang_col), "blocks")
    own = blocks.where("word IS NOT NULL")
    counts = durable(own.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = durable(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    ids = durable(numbered(counts.where(F.col("f") >= min_count), ["word"]), "numbers")
    known = own.select("lang", "block", F.col("local").alias("key"), "word").join(ids, ["lang", "word"]).select("block", "key", "id", "band")
    told = ids.select("lang", "id", F.array("word").alias("words"), "f", F.array("f").alias("first"), F.array("f").alias("last"))
    units, found = blocks.where("units IS NOT NULL").select("lang", "block", "units"), []
    for level in range(1, longest):
        side = known.withColumnRenamed("block", "_block")
        round_ = units.groupBy("block").cogroup(side.groupBy("_block")).applyInArrow(_recoded(level), _ROUND)
        round_ = durable(round_, f"round{level}")
        tiles = round_.where("keys IS NOT NULL").select("lang", "across", "down", "block", "keys", "counts")
        by = ["lang", "across", "down"]
        met = durable(tiles.groupBy(*by).applyInArrow(_summed(min_count), _TILE), "met")
        ids = durable(numbered(met.where("key IS NOT NULL").select(*by, "key", "f"), ["key"]), "numbers")
        held = met.where("key IS NULL").select(*by, "block", "keys")
        placed = ids.select(*[F.col(c).alias(f"_{c}") for c in by], "key", "id", "band")
        known = held.groupBy(*by).cogroup(placed.groupBy(*[f"_{c}" for c in by])).applyInArrow(_placed, "block long, keys binary, ids binary, bands binary")
        units = round_.where("units IS NOT NULL").select("lang", "block", "units")
        left = told.select("lang", F.col("id").alias("a"), F.col("words").alias("_words"), F.col("first").alias("_first"))
        right = told.select("lang", F.col("id").alias("b"), F.element_at("words", -1).alias("_word"), F.col("last").alias("_last"))
        pairs = ids.select("lang", "id", "f", F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"))
        pairs = pairs.join(left, ["lang", "a"]).join(right, ["lang", "b"])
        told = durable(
            pairs.select("lang", "id", F.array_append("_words", F.col("_word")).alias("words"), "f", F.array_append("_first", F.col("f")).alias("first"), F.array_append("_last", F.col("f")).alias("last")), f"phrases{level + 1}"
        )
        found.append(told.drop("id"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, totals


def _cuts() -> Column:
    """``(score, k, l, r)`` of every cut; the least is the one that counts."""
    wide = lambda c: c.cast("decimal(20,0)")

    def cut(k: Column) -> Column:
        left, right = F.get(F.col("first"), k - 1), F.get(F.col("last"), F.size("words") - k - 1)
        score = F.call_function("div", wide(F.col("f")) * F.lit(SCALE).cast("decimal(7,0)"), wide(left + right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)


def collocations(docs: DataFrame, text_col="text", lang_col="lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` candidates."""
    every, totals = phrases(docs, text_col, lang_col, min_count, longest)
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("words", i, k))))
    longer = every.where(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("most"))
    kept = every.join(longer, ["lang", "words"], "left").where(F.col("most").isNull() | (100 * F.col("most") < INSIDE * F.col("f")))
    told = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(_cuts()).alias("c"))
    best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(small_side(totals), "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS part FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut), range(1, {LONGEST + 1}) r(k) WHERE i + k - 1 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, phrase, k, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY lang, phrase, k HAVING count(*) >= {MIN_COUNT}
), totals AS (
  SELECT coalesce(lang, 'und') AS lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY 1
), parts AS (
  SELECT lang, phrase, k, a, i, array_to_string(list_slice(w, 1, i), ' ') AS head, array_to_string(list_slice(w, i + 1, k), ' ') AS rest FROM f, range(1, {LONGEST}) s(i) WHERE i < k
), inner_ AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, a FROM f, range(1, {LONGEST}) p(i), range(2, {LONGEST}) q(m) WHERE k > 2 AND m < k AND i + m - 1 <= k
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.i, x.a AS l, y.a AS r, {SCALE} * c.a::HUGEINT // (x.a + y.a) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM least LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE most IS NULL OR 100 * most < {INSIDE} * a QUALIFY rank <= {TOP}
"""
