"""Alignment of two tokenizers' tokens over the same bytes, and what their ids have in common.

A is a byte-level tokenizer of the tokenizers library, B a model of the sentencepiece library;
both read the text with a space before it. Character offsets of A and proto spans of B are
coarse cuts: where a token's span meets the next one's without sharing a character, its end
is known. Inside a character, as where bytes of one stand in several tokens and in B's byte
pieces, the ends come from the lengths of the decoded bytes since the last known one.

A byte that ends a token of A and one of B ends a group. Between two ends of either one token
of A and one of B overlap: that is a link. Pairs of ids are counted over the corpus, and every
document learns the counts of its own pairs.

Neither tokenizer joins bytes across a word's last character and the space that follows, nor
across a line feed. Texts are cut there, chunks that a worker has met lately are not
tokenized again, and groups and links of a text are those of its chunks. What is told of chunks
lies in a few long arrays, from which texts gather theirs. Any other model, and a chunk whose
tokens do not give its bytes, falls back to whole texts.

Plan: tokenizing is one map. It writes documents in blocks of about BLOCK_BYTES of text, each
document with its distinct pairs as places in the block's list of pairs, and that list. Lists
are summed into counts by pair; the counts join each block's list and meet the block's
documents in a cogroup. So a pair travels once a block however often texts have it, and a
task holds one block. The highest count per id of B has at most a row per piece of the model
and is broadcast.

Defined results: null and empty texts, and texts whose joined bytes of either tokenizer differ
from the space and the text, have no tokens, zeros and no hash; very long texts are aligned
whole; repeated rows count each and each come back; null ids are carried along; an empty
table gives no rows; equal counts are all the best; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import durable, table
from larder.llm.sentencepiece_codec import MODEL, model_file
from larder.llm.token_counts import LONGEST_WORD

BYTE_MODEL = "byte_bpe_50k.json"
#: Text of a block: more ends it, so a block holds at most this and one text.
BLOCK_BYTES = 24 << 20
#: Room of a worker's memo of chunks, and of an entry without its texts.
MEMO_BYTES, _ENTRY_BYTES = 96 << 20, 200
_SPACE = "▁"
#: Where neither tokenizer joins: before the space after a word, and around a lone line feed.
_CUT = re.compile(r"(?<=\S)(?= )|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_RUN = re.compile(r"\s\s|\s$")
#: Texts that are told at once: their number and, unless it is one, their length.
_ROWS, _LENGTH = 256, 4 << 20
#: Chunks that are tokenized as one text, and segments that are gathered at once.
_TOGETHER, _GATHERED = 4096, 1 << 16
_PIECE = attrgetter("id", "begin", "end")


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refined(spans: np.ndarray, sizes: np.ndarray, byte_at: np.ndarray) -> np.ndarray:
    """The byte where each token ends, from spans of characters and lengths of decoded bytes.

    Where the next span begins behind this one the cut is known; within a character that
    tokens share, lengths are counted from the last known cut.
    """
    if not len(spans):
        return np.zeros(0, np.int64)
    start, end = spans.T
    clean = (start < end) & (np.append(start[1:], end[-1]) >= end)
    coarse, counted = byte_at[end], np.cumsum(sizes)
    # The drift of the counted ends at the last clean cut before, if any.
    known = np.maximum.accumulate(np.where(clean, np.arange(len(spans)), -1))
    drift = np.where(known >= 0, coarse[known] - counted[known], 0)
    return np.where(clean, coarse, counted + drift)


def _numbers(rows: Iterable[tuple[int, ...]]) -> np.ndarray:
    """The numbers of all ``rows`` in order; an array of tuples takes several times as long."""
    return np.fromiter(chain.from_iterable(rows), np.int64)


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The segments of ``values`` that begin at ``first`` and have ``size`` of them, one after another."""
    parts = [values[:0]]
    for k in range(0, len(first), _GATHERED):
        n = size[k : k + _GATHERED]
        to = np.cumsum(n)
        parts.append(values[np.arange(to[-1]) + np.repeat(first[k : k + _GATHERED] - to + n, n)])
    return np.concatenate(parts)


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles within: spans and memo are millions of tuples that make none."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


#: Of segments: their groups as text, each with a semicolon behind it; their pairs of ids
#: ``a << 32 | b``; and a row each: first byte and number of bytes of its groups, first pair and
#: number of pairs, tokens of A and of B, groups. No pairs: the tokens do not give its bytes.
Told = tuple[np.ndarray, np.ndarray, np.ndarray]
_NOTHING: Told = (np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros((1, 7), np.int64))


class Chunks:
    """Chunks by number and what is told of them, in a few long arrays instead of objects each."""

    def __init__(self):
        self.number, self.groups, self.pairs, self.rows, self.length = {}, bytearray(), bytearray(), bytearray(), 0

    def add(self, chunks: list[str], told: Told) -> None:
        groups, pairs, rows = told
        n = len(self.number)
        self.number.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.rows += (rows + np.array([len(self.groups), 0, len(self.pairs) // 8, 0, 0, 0, 0])).tobytes()
        self.groups += groups.tobytes()
        self.pairs += pairs.tobytes()
        self.length += sum(map(len, chunks))

    def told(self, at: np.ndarray) -> Told:
        """What is told of the chunks of numbers ``at``, in their order."""
        rows = np.frombuffer(self.rows, np.int64).reshape(-1, 7)[at]
        groups = gathered(np.frombuffer(self.groups, np.uint8), rows[:, 0], rows[:, 1])
        pairs = gathered(np.frombuffer(self.pairs, np.int64), rows[:, 2], rows[:, 3])
        rows[:, 0:4:2] = np.cumsum(rows[:, 1:4:2], axis=0) - rows[:, 1:4:2]
        return groups, pairs, rows

    def at(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def size(self) -> int:
        return len(self.groups) + len(self.pairs) + self.length + _ENTRY_BYTES * len(self.number)

    def marked(self) -> tuple[int, int, int, int]:
        return len(self.number), len(self.groups), len(self.pairs), self.length

    def back_to(self, mark: tuple[int, int, int, int]) -> None:
        """Forget the chunks that came after ``mark``."""
        n, groups, pairs, self.length = mark
        while len(self.number) > n:
            self.number.popitem()
        del self.rows[56 * n :], self.groups[groups:], self.pairs[pairs:]


class Aligner:
    """Tokens of both tokenizers over one text, as groups and pairs of overlapping ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        with open(b_path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        kinds, spec = pb.ModelProto.SentencePiece, proto.normalizer_spec
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.replace(_SPACE, " ").encode() for p in proto.pieces]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        # Ids as text with what may follow them: 3 * id for a comma, then a bar, then a semicolon.
        said = [f"{i}{sign}" for i in range(max(len(self.a_sizes), len(self.b_sizes))) for sign in ",|;"]
        self.said, self.said_size = np.frombuffer("".join(said).encode(), np.uint8), np.array([len(x) for x in said])
        self.said_at = np.cumsum(self.said_size) - self.said_size
        parts = json.loads(self.a.to_str())
        self.by_chunk = (
            parts["model"]["type"] == "BPE"
            and parts["pre_tokenizer"]["type"] == "ByteLevel"
            and not parts["normalizer"]
            and proto.trainer_spec.model_type == pb.TrainerSpec.BPE
            and proto.trainer_spec.byte_fallback
            and spec.add_dummy_prefix
            and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix)
            and not any(re.search(f"[^{_SPACE}]{_SPACE}|\n", p.piece) for p in proto.pieces)
            and not any(re.search(r"\S |\S\n|\n\S", t.decode(errors="replace")) for t in self.a_bytes.values())
        )
        # The space comes with the text, so that both libraries tell places in the same string.
        proto.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # Chunks met lately and what became of them, in two generations.
        self.young, self.older, self.left = Chunks(), Chunks(), MEMO_BYTES // 2

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and the bytes where they end, those of B; None if either's bytes are not the text's."""
        data, a, b = text.encode(), self.a.encode(text, add_special_tokens=False), self.b.encode(text, return_type="proto").pieces
        a_ids, b_told = a.ids, _numbers(map(_PIECE, b)).reshape(-1, 3)
        b_ids = b_told[:, 0]
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != data or b"".join(map(self.b_bytes.__getitem__, b_ids.tolist())) != data:
            return None
        a_ids = np.array(a_ids, np.int64)
        byte_at = np.arange(len(data) + 1)
        if len(data) != len(text):
            # Where characters begin: bytes that continue none.
            byte_at = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
        a_ends = refined(_numbers(a.offsets).reshape(-1, 2), self.a_sizes[a_ids], byte_at)
        # B's spans are of bytes already.
        return a_ids, a_ends, b_ids, refined(b_told[:, 1:], self.b_sizes[b_ids], np.arange(len(data) + 1))

    def aligned(self, text: str, ends: np.ndarray) -> Told | None:
        """What is told of the segments of ``text`` that end at the bytes ``ends``, the last at its end."""
        found = self.tokens(text)
        if found is None:
            return None
        a_ids, a_ends, b_ids, b_ends = found
        by = np.zeros(ends[-1] + 1, np.int8)
        by[a_ends] = 1
        by[b_ends] += 2
        either = np.flatnonzero(by)
        by = by[either]
        by_a, by_b, shared = (by & 1).astype(bool), by > 1, by == 3
        # Tokens of A and B and groups up to each end.
        a_to, b_to, g_to = np.cumsum(by_a), np.cumsum(by_b), np.cumsum(shared)
        pairs = a_ids[a_to - by_a] << 32 | b_ids[b_to - by_b]
        # Tokens by group, those of A first, each with what follows it.
        group, a_by, b_by = g_to - shared, a_to[shared], b_to[shared]
        a_place = np.arange(len(a_ids)) + np.append(0, b_by)[group[by_a]]
        b_place = np.arange(len(b_ids)) + a_by[group[by_b]]
        said = np.empty(len(a_ids) + len(b_ids), np.int64)
        said[a_place], said[b_place] = 3 * a_ids, 3 * b_ids
        said[a_place[a_by - 1]] += 1
        said[b_place[b_by - 1]] += 2
        size = self.said_size[said]
        groups = gathered(self.said, self.said_at[said], size)
        # All of these up to the end of each segment.
        links = np.searchsorted(either, ends, "right")
        n_a, n_b = a_to[links - 1], b_to[links - 1]
        to = np.stack([np.cumsum(size)[n_a + n_b - 1], links, n_a, n_b, g_to[links - 1]], axis=1)
        own = np.diff(to, prepend=0, axis=0)
        first = to - own
        return groups, pairs, np.column_stack([first[:, 0], own[:, 0], first[:, 1], own[:, 1:]])

    def one(self, text: str) -> tuple[str, bytes, int] | None:
        """Groups, pairs as bytes, and the numbers of tokens of A and B and of groups as one
        number of 40 bits each; nothing if the tokens do not give the text."""
        told = self.aligned(text, np.array([len(text.encode())]))
        if told is None:
            return None
        groups, pairs, rows = told
        return groups[:-1].tobytes().decode(), pairs.tobytes(), sum(n << 40 * k for k, n in enumerate(rows[0, 4:].tolist()))

    def tell(self, chunks: list[str]) -> None:
        """Add ``chunks`` to the young; those that stay apart side by side go as one text."""
        apart, rest = [], []
        for c in chunks:
            (apart if c[-1].strip() and (c[0] == " " or c[0].strip()) and _SPACE not in c else rest).append(c)
        for k in range(0, len(apart), _TOGETHER):
            self._together(apart[k : k + _TOGETHER])
        for c in rest:
            self.young.add([c], self.aligned(c, np.array([len(c.encode())])) or _NOTHING)

    def _together(self, chunks: list[str]) -> None:
        # After a line feed neither tokenizer joins either. The line feeds are segments of their own.
        fed = np.array([c[0] != " " for c in chunks])
        sizes = np.array([len(c) if c.isascii() else len(c.encode()) for c in chunks]) + fed
        place = np.arange(len(chunks)) + np.cumsum(fed)
        ends = np.empty(place[-1] + 1, np.int64)
        ends[place] = np.cumsum(sizes)
        ends[place[fed] - 1] = ends[place[fed]] - sizes[fed] + 1
        told = self.aligned("".join([c if c[0] == " " else "\n" + c for c in chunks]), ends)
        if told is not None:
            self.young.add(chunks, (*told[:2], told[2][place]))
        elif len(chunks) == 1:
            self.young.add(chunks, self.aligned(chunks[0], ends[-1:] - fed) or _NOTHING)
        else:
            # Some chunk's tokens do not give its bytes; it alone is to go without.
            half = len(chunks) // 2
            self._together(chunks[:half])
            self._together(chunks[half:])

    def meet(self, chunks: list[str]) -> tuple[int, int, int, int]:
        """Have all ``chunks`` among the young, long ones behind the mark that is returned."""
        new = set(chunks).difference(self.young.number)
        known = [c for c in new if c in self.older.number]
        if known:
            self.young.add(known, self.older.told(self.older.at(known)))
        fresh = list(new.difference(known))
        self.tell([c for c in fresh if len(c) <= LONGEST_WORD])
        mark = self.young.marked()
        self.tell([c for c in fresh if len(c) > LONGEST_WORD])
        return mark

    def keep(self, mark: tuple[int, int, int, int]) -> None:
        """Remember chunks up to ``mark`` while they fit half of MEMO_BYTES; then they become the older."""
        self.young.back_to(mark)
        self.left = MEMO_BYTES // 2 - self.young.size()
        if self.left < 0:
            # What one batch of texts brought may be more than a memo holds.
            self.older = self.young if -self.left <= MEMO_BYTES // 2 else Chunks()
            self.young, self.left = Chunks(), MEMO_BYTES // 2

    def chunks(self, text: str) -> list[str]:
        """The space and the text, cut where neither tokenizer joins."""
        text = " " + text
        if _RUN.search(text):
            return _CUT.split(text)
        lines = text.split("\n")
        out = []
        for k, line in enumerate(lines):
            first, *rest = line.split(" ")
            if k:
                out.append("\n")
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def texts(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, list[int]]]:
        """For each text its groups in runs, pairs of ids in order, and numbers of tokens of A
        and B and of groups; nothing of texts without tokens."""
        out, k = [], 0
        with uncollected():
            while k < len(texts):
                # As many as have room at once, one at least.
                n, room = k + 1, _LENGTH - len(texts[k])
                while n < len(texts) and len(texts[n]) <= room:
                    room -= len(texts[n])
                    n += 1
                out += self._texts(texts[k:n])
                k = n
        return out

    def _texts(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, list[int]]]:
        none = ([], np.zeros(0, np.int64), [0, 0, 0])
        chunks, to = [], [0]
        for t in texts:
            if t and self.by_chunk:
                chunks += self.chunks(t)
            to.append(len(chunks))
        mark = self.meet(chunks)
        at, to = self.young.at(chunks), np.array(to)
        # Bytes of groups, pairs, tokens of A and B, groups and chunks without tokens before each text's end.
        upto = np.zeros((len(to), 6), np.int64)
        groups, pairs = [_NOTHING[0]], [_NOTHING[1]]
        for k in range(0, len(at), _GATHERED):
            g, p, rows = self.young.told(at[k : k + _GATHERED])
            groups.append(g)
            pairs.append(p)
            sums = np.cumsum(np.column_stack([rows[:, [1, 3, 4, 5, 6]], rows[:, 3] == 0]), axis=0)
            upto += np.insert(sums, 0, 0, axis=0)[np.clip(to - k, 0, len(rows))]
        self.keep(mark)
        groups, pairs, out = np.concatenate(groups), np.concatenate(pairs), []
        for text, (g, p, *_), (g_to, p_to, *_), (_, n_links, *sizes, lost) in zip(texts, upto[:-1].tolist(), upto[1:].tolist(), np.diff(upto, axis=0).tolist(), strict=True):
            if text and n_links and not lost:
                out.append(([groups[g : g_to - 1].tobytes().decode()], pairs[p:p_to], sizes))
            elif text and (whole := self.one(" " + text)):
                out.append(([whole[0]], np.frombuffer(whole[1], np.int64), [whole[2] >> k & (1 << 40) - 1 for k in (0, 40, 80)]))
            else:
                out.append(none)
        return out


@lru_cache(1)
def _aligner(a_model: str, b_model: str) -> Aligner:
    return Aligner(model_file(a_model), model_file(b_model))


_BLOCKS = "block long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, pair long, n long"


class _Block:
    """Rows of documents, and the pairs that they have with their numbers."""

    def __init__(self, block: int):
        self.block, self.rows, self.parts, self.size = block, [], [], 0

    def add(self, text: str, pairs: np.ndarray, row: tuple) -> None:
        found, times = np.unique(pairs, return_counts=True)
        self.parts.append((found, times))
        self.rows.append(row)
        self.size += len(text.encode())

    def out(self, id_type) -> Iterator[pa.RecordBatch]:
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *[p for p, _ in self.parts]]))
        total = np.zeros(len(every), np.int64)
        kinds = [pa.int64(), id_type, *[pa.int64()] * 5, pa.string(), pa.binary(), pa.int64(), pa.int64()]
        names = ["block", "id", *[f.split(" ")[0] for f in _BLOCKS.split(", ")[1:]]]

        def batch(n: int, told: dict) -> pa.RecordBatch:
            told["block"] = np.full(n, self.block)
            return pa.RecordBatch.from_arrays([pa.array(told[c], t) if c in told else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

        for k in range(0, len(self.rows), 1024):
            own = []
            for found, times in self.parts[k : k + 1024]:
                at = np.searchsorted(every, found)
                total[at] += times
                own.append(packed(at, times))
            yield batch(len(own), dict(zip(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"], zip(*self.rows[k : k + 1024], strict=True), strict=True)) | {"own": own})
        for k in range(0, len(every), 1 << 16):
            pairs = every[k : k + (1 << 16)]
            yield batch(len(pairs), {"row": np.arange(k, k + len(pairs)), "pair": pairs, "n": total[k : k + len(pairs)]})


def packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places and their numbers: steps and numbers less 1, by bytes of equal weight, deflated."""
    both = np.stack([np.diff(at, prepend=0), times - 1]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes(), 1)


def unpacked(own: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(own), np.uint8).reshape(2, 4, -1)
    steps, times = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(steps), times + 1


def aligned_blocks(docs: DataFrame, id_col="doc_id", text_col="text", a_model=BYTE_MODEL, b_model=MODEL) -> DataFrame:
    """Documents and their blocks' pairs: rows with ``pair`` are pairs, ``row`` being their place."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType.fromDDL(_BLOCKS)
    schema = T.StructType([schema["block"], T.StructField("id", src.schema["id"].dataType), *schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_model, b_model)
        number = TaskContext.get().partitionId() << 32
        block, id_type = _Block(number), None
        for whole in batches:
            id_type = whole.column(0).type
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                texts = batch.column(1).to_pylist()
                for doc, text, (groups, pairs, (n_a, n_b, n_groups)) in zip(batch.column(0).to_pylist(), texts, aligner.texts(texts), strict=True):
                    digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
                    block.add(text, pairs, (doc, n_a, n_b, n_groups, len(pairs), digest))
                    if block.size >= BLOCK_BYTES:
                        yield from block.out(id_type)
                        block = _Block(block.block + 1)
        if block.rows:
            yield from block.out(id_type)

    return src.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: links of each pair of ids, and whether no other A id has more with its B id."""
    counts = durable(blocks.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))
    # A row for each piece of the model at most.
    return counts.join(F.broadcast(top), b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _told(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with their sums over the block's counted pairs."""
    order = np.argsort(pairs["row"].to_numpy())
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order]
    sums = np.zeros((2, docs.num_rows), np.int64)
    for i, own in enumerate(docs["own"].to_pylist()):
        at, times = unpacked(own)
        sums[:, i] = times[best[at]].sum(), times @ count[at]
    kept = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def align(docs: DataFrame, id_col="doc_id", text_col="text", a_model=BYTE_MODEL, b_model=MODEL) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row."""
    blocks = durable(aligned_blocks(docs, id_col, text_col, a_model, b_model), "aligned")
    counts = durable(pair_counts(blocks), "counts")
    listed = blocks.where("pair IS NOT NULL").select(F.col("block").alias("of"), "row", "pair").join(counts, "pair").select("of", "row", "count", "best")
    own = blocks.where("pair IS NULL").drop("pair", "n", "row")
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    schema = T.StructType([T.StructField("id", blocks.schema["id"].dataType), *T.StructType.fromDDL(numbers).fields])
    told = own.groupBy("block").cogroup(listed.groupBy("of")).applyInArrow(_told, schema)
    return told.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
