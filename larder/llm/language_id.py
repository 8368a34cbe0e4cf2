"""Language identification by error-correcting output codes over character n-grams.

Every learned language has a codeword. For each code bit a binary classifier, a linear model
over hashed n-grams of the lower-cased UTF-8 bytes, tells the languages whose bit is 1 from
the others; its weights are log-ratios of smoothed n-gram frequencies, counted over all
labelled rows in one distributed aggregation that ends in one row per language and bucket.
Decoding sums each bit's logistic loss, weighted by how far apart the bit's two sides are in
training, and takes the codeword of least loss. A document whose second codeword is almost
as near as the first (odds above AMBIGUOUS) is flagged ambiguous.

Every label is learned (``languages`` may bound them to those with the most rows). Codewords
of many labels have CODE_BITS bits for each doubling of their number, so the weights that
travel with the task are that many times BUCKETS, and a label adds its name and a codeword.
Fitting adds up one label's counts at a time; the driver never holds those of all.

Defined results: rows with a null id are in no held-out fold, so they train where the fold
asks for the others; null texts and texts without a letter are ``und`` with score 0; very long
texts count whole; rows without a label never train; with no labelled row at all everything
is ``und``; ties go to the language that sorts first; repeated rows each come back (and each
train); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import durable, small_side, table

BUCKETS = 1 << 13
#: Up to so many labels each has a row of a Hadamard matrix; beyond, CODE_BITS times log2.
HADAMARD, CODE_BITS = 256, 16
SHARPNESS = 8.0
AMBIGUOUS = 0.9
UND = "und"
_CHUNK = 1 << 20
#: Labels whose sums a task holds before it gives them out.
_LABELS_HELD = 500


def _grams(text: str) -> np.ndarray:
    """Counts of the text's hashed 1- to 4-grams; digits and punctuation become spaces."""
    total = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text.lower().encode(), np.uint8)
    for at in range(0, max(len(data), 1), _CHUNK):
        a = data[at : at + _CHUNK + 3].astype(np.uint32)
        a = np.where(((a >= 97) & (a <= 122)) | (a >= 128), a, 32).astype(np.uint32)
        h = np.zeros(len(a), np.uint32)
        for n in range(1, 5):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] * np.uint32(0x01000193) ^ a[n - 1 :]
            mixed = (h * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(32 - 13)
            total += np.bincount(mixed[:_CHUNK], minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """``n`` rows of -1 and 1. Up to 7 all two-way splits, then rows of a Hadamard matrix,
    and of very many labels drawn ones, whose distance is near half their bits."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(n)], np.int8)
    if n > HADAMARD:
        bits = CODE_BITS * (n - 1).bit_length()
        return (1 - 2 * np.random.default_rng(n).integers(0, 2, (n, bits))).astype(np.int8)
    order = 1 << max(4, n.bit_length())
    bits = np.array([[(i & j).bit_count() & 1 for j in range(1, order)] for i in range(1, n + 1)])
    return (1 - 2 * bits[:, (bits.min(0) != bits.max(0))]).astype(np.int8)


class CodeModel:
    """Languages, codewords, one weight row per bit, one reliability per bit."""

    def __init__(self, languages: list[str], counts: Callable[[], Iterable[tuple[str, np.ndarray]]]):
        """``counts`` gives each language's counts by bucket; it is asked twice, in any order."""
        self.languages = sorted(languages)
        self.code = codewords(len(self.languages))
        if len(self.languages) < 2:
            return
        place = {x: i for i, x in enumerate(self.languages)}
        rates = lambda: ((place[x], (n + 0.5) / (n.sum() + 0.5 * BUCKETS)) for x, n in counts())
        bit = (self.code > 0).astype(np.float64)
        ones = np.zeros((self.code.shape[1], BUCKETS))
        every = np.zeros(BUCKETS)
        for i, rate in rates():
            ones[bit[i] > 0] += rate
            every += rate
        n_ones = bit.sum(0)[:, None]
        ones, zeros = ones / n_ones, (every - ones) / (len(place) - n_ones)
        weights = np.log(ones / zeros)
        trust = ((ones - zeros) * weights).sum(1)
        self.trust = trust / max(trust.sum(), 1e-12)
        self.weights = weights.astype(np.float32)
        # The bit's mean margin over the languages of either side.
        high, low = np.zeros(len(trust)), np.zeros(len(trust))
        for i, rate in rates():
            expected = self.weights @ rate
            high += np.where(bit[i] > 0, expected, 0)
            low += np.where(bit[i] > 0, 0, expected)
        high, low = high / n_ones[:, 0], low / (len(place) - n_ones[:, 0])
        self.centre, self.width = (high + low) / 2, np.maximum((high - low) / 2, 1e-9)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, whether it is ambiguous."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UND, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        grams = _grams(text)
        margins = (self.weights @ grams.astype(np.float32) / grams.sum() - self.centre) / self.width
        right, wrong = (np.logaddexp(0, sign * SHARPNESS * margins) * self.trust for sign in (-1, 1))
        losses = (self.code > 0) @ (right - wrong) + wrong.sum()
        odds = np.exp(losses.min() - losses)
        best = int(losses.argmin())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, bool(np.partition(odds, -2)[-2] > AMBIGUOUS)


def gram_counts(labelled: DataFrame, text_col: str, lang_col: str, languages: int | None = None) -> DataFrame:
    """``(lang, bucket, n)`` over all rows, or those of the ``languages`` labels with the most
    rows, ties by name; partitions sum up before the shuffle."""
    src = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if languages is not None:
        known = src.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
        src = src.join(small_side(durable(known.select("lang"), "labels")), "lang", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + _grams(text)
                if len(sums) > _LABELS_HELD:
                    yield from out()
        yield from out()

    return src.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col="text", lang_col="lang", languages: int | None = None) -> CodeModel:
    """The model of all labels, or of ``languages`` of them; their counts, a row of at most
    BUCKETS numbers a label, pass the driver one after another."""
    listed = gram_counts(labelled, text_col, lang_col, languages).groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
    listed = durable(listed, "grams")

    def counts() -> Iterator[tuple[str, np.ndarray]]:
        for row in listed.toLocalIterator():
            total = np.zeros(BUCKETS)
            total[row["at"]] = row["n"]
            yield row["lang"], total

    return CodeModel([r["lang"] for r in listed.select("lang").toLocalIterator()], counts)


def identify(docs: DataFrame, model: CodeModel, id_col="doc_id", text_col="text") -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` for every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    kinds = [src.schema["id"].dataType, T.StringType(), T.DoubleType(), T.BooleanType()]
    return src.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])).withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """The fold that never trains."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    told = identify(docs.select(F.struct("doc_id").alias("key"), "text"), model, id_col="key")
    return told.select("key.doc_id", held_out(F.col("key.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
