"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character;
dynamic programming carries the best path score and its number of pieces, never the path.
Tie rule of the tokenizer: candidates come by start and a later one must be strictly better,
so among equal scores the longest piece wins. A character that is no piece itself costs the
lowest score minus 10 and counts one token per UTF-8 byte with byte fallback; without it, a
run of such characters counts one token.

Scores are summed in double precision, which is exact for the whole scores of the vocabulary
files used here: equal sums are ties, as they are to the tokenizer, whose single precision is
relative to the place it has reached and loses no digit of scores of this size. Pieces with a
reserved score (the runs of white space at -1e9 that a byte-pair vocabulary lists for its own
use) are no unigram pieces: with them the tokenizer's own sums are lost in rounding. Over the
pieces that remain, counts of whole texts equal those of the tokenizer.

No piece has a space after another character, so best paths split at words, and a bounded
memo per worker keeps the count and score of words.

Defined results: a null or empty text has 0 tokens and score 0; a text of any length is one
row; repeated rows each come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import table
from larder.llm.sentencepiece_codec import MODEL, model_file

UNKNOWN_COST = 10.0
#: Pieces that score no more are not of the unigram vocabulary.
RESERVED = -1e8
#: Room of a worker's memo of words, its keys, values and table included.
MEMO_BYTES = 64 << 20
_ENTRY_BYTES = 104
#: Longer words are not kept.
LONGEST_WORD = 64
_MARK = "▁"


class Memo(dict):
    """What ``make`` gives for words, kept while it fits MEMO_BYTES.

    Two generations share the room: when the younger is full it becomes the older, from which
    words that are met again return, so what is frequent stays whatever comes between.
    """

    def __init__(self, make, room: int = MEMO_BYTES):
        self.make, self.older = make, {}
        self.room = self.left = room // 2

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        self.put(word, found)
        return found

    def put(self, word: str, found) -> None:
        if len(word) > LONGEST_WORD:
            return
        self.left -= _ENTRY_BYTES + getsizeof(word) + getsizeof(found)
        if self.left < 0:
            self.older = self.copy()
            self.clear()
            self.left = self.room
        self[word] = found


class CountingViterbi:
    """Piece counts under ``pieces``, text of a piece to its score; those of ``chosen`` are
    user-defined symbols, which the tokenizer prefers."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, chosen: frozenset[str] = frozenset()):
        import ahocorasick

        best = max(pieces.values(), default=0.0)
        scores = {p: len(p.encode()) * best - 0.1 if p in chosen else s for p, s in pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_COST
        self.byte_fallback = byte_fallback
        # Count and score of a word as one complex number.
        self.words = Memo(lambda word: complex(*self.chunk(word)))
        self.splits = byte_fallback and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.split = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+").findall

    def chunk(self, text: str) -> tuple[int, float]:
        """Count and score of the best path over ``text``, which is normalised."""
        n = len(text)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for end in range(1, n + 1):
            best, took, unknown = None, 1, False
            # The automaton gives longer matches first, as the tokenizer meets them.
            for size, own in ends[end - 1]:
                cand = score[end - size] + own
                if best is None or cand > best:
                    best, took = cand, size
            if text[end - 1] not in self.singles:
                cand = score[end - 1] + self.unknown
                if best is None or cand > best:
                    best, took, unknown = cand, 1, True
            start = end - took
            if not unknown:
                more = 1
            elif self.byte_fallback:
                more = len(text[start].encode("utf-8", "surrogatepass"))
            else:
                more = 0 if odd[start] else 1
            score[end], count[end], odd[end] = best, count[start] + more, unknown
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = _MARK + text.replace(" ", _MARK)
        if not self.splits:
            return self.chunk(text)
        total = sum(map(self.words.__getitem__, self.split(text)), 0j)
        return int(total.real), total.imag


@lru_cache(1)
def _viterbi(model: str) -> CountingViterbi:
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(model_file(model), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    known = {p.piece: p.score for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED) and p.score > RESERVED}
    return CountingViterbi(known, proto.trainer_spec.byte_fallback, frozenset(p.piece for p in proto.pieces if p.type == kinds.USER_DEFINED))


def count_tokens(docs: DataFrame, id_col="doc_id", text_col="text", model=MODEL) -> DataFrame:
    """``(id, n_tokens, score)``: the pieces of ``model`` above RESERVED as a unigram vocabulary."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = _viterbi(model)
        for batch in batches:
            found = [viterbi.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["id", "n_tokens", "score"]
            )

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
