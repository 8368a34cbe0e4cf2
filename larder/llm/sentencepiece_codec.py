"""SentencePiece encoding and decoding with offsets into the original bytes.

The text is normalised by longest-prefix lookups in the model's compiled character map
(a double array of prefixes and a pool of replacements), and the source byte of every
normalised byte is recorded. Pieces cover the normalised bytes one after another, so the
running sum of their lengths, looked up in that record, projects every piece to a span of
the original bytes: piece i covers ``[ends[i-1], ends[i])``.

Piece ids of whole texts come from the library in one call a text; nothing is kept between
texts but the model, so a worker's memory is bounded by its longest text.

Defined results: null is encoded as the empty text, which has no pieces; repeated rows each
come back; a text of any length is one row; an empty table gives no rows; ids of any value,
null too, are carried along, and other columns, whatever their names, are not read; of equal
merges the library takes the leftmost, and so does this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import table

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_ROWS_OUT = 256


class CharacterMap:
    """The compiled character map: uint32 size, double array, zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units = self.pool = None
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest mapped prefix at ``at``, and its length; (b"", 0): none."""
        units, pos, found = self.units, 0, (0, 0)
        unit = units[0]
        pos ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            pos ^= text[i]
            if pos >= len(units):
                break
            unit = units[pos]
            if (unit & 0x800000FF) != text[i]:
                break
            pos ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (units[pos] & 0x7FFFFFFF, i + 1 - at)
        if not found[1]:
            return b"", 0
        return self.pool[found[0] : self.pool.index(b"\0", found[0])], found[1]


class Normalizer:
    """Normalised UTF-8 bytes of a text and, for each of them and the end, the source byte."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        src = text.encode()
        if not src:
            return b"", np.zeros(1, np.int64)
        if self.map.units is None and not self.squeeze and self.escape and not self.suffix:
            b = np.frombuffer(src, np.uint8)
            start = np.maximum.accumulate(np.where((b & 0xC0) == 0x80, 0, np.arange(len(b))))
            head = [0, 0, 0] if self.prefix else []
            align = np.concatenate([np.array(head, np.int64), np.repeat(start, np.where(b == 32, 3, 1)), [len(b)]])
            return (b" " * bool(self.prefix) + src).replace(b" ", _MARK.encode()), align
        return self._walk(src)

    def _step(self, src: bytes, at: int) -> tuple[bytes, int]:
        if self.map.units is not None:
            new, took = self.map.longest(src, at)
            if took:
                return new, took
        lead = src[at]
        took = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return src[at : at + took], took

    def _walk(self, src: bytes) -> tuple[bytes, np.ndarray]:
        space = _MARK.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0
        while self.squeeze and at < len(src):
            new, took = self._step(src, at)
            if new != b" ":
                break
            at += took
        if at == len(src):
            return b"", np.zeros(1, np.int64)

        def put(new: bytes, source: int) -> None:
            new = new.replace(b" ", space)
            out.extend(new)
            align.extend([source] * len(new))

        if self.prefix and not self.suffix:
            put(b" ", at)
        after_space = self.squeeze
        while at < len(src):
            new, took = self._step(src, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new, at)
                after_space = self.squeeze and new.endswith(b" ")
            at += took
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            at = align[-len(space)]
            del align[-len(space) :]
        if self.prefix and self.suffix:
            put(b" ", at)
        return bytes(out), np.array([*align, at], np.int64)


class PieceCodec:
    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_path, "rb") as f:
            blob = f.read()
        proto = pb.ModelProto.FromString(blob)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        kinds = pb.ModelProto.SentencePiece
        none = (kinds.CONTROL, kinds.UNKNOWN)
        self.lengths = np.array([0 if p.type in none else 1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.whole.unk_id()

    def encode(self, text: str) -> np.ndarray:
        """The library's piece ids of ``text``."""
        return np.array(self.whole.encode(text), np.int32)

    def ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """For each piece the end of its span in the bytes of ``text``."""
        _, align = self.normalize(text)
        lengths = self.lengths[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():
            surfaces = self.whole.encode(text, out_type=str)
            lengths = np.array([len(s.encode()) if i == self.unknown else n for i, n, s in zip(ids, lengths, surfaces, strict=True)], np.int64)
        return align[np.cumsum(lengths)]

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


def model_file(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@lru_cache(1)
def _codec(model: str) -> PieceCodec:
    return PieceCodec(model_file(model))


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, kind)]).astype(kind)))


def encode_pieces(docs: DataFrame, id_col="doc_id", text_col="text", model=MODEL, decoded=True) -> DataFrame:
    """``(id, ids array<int>, ends array<int>[, decoded string])`` for every row.

    ``model`` is the name of a public tokenizer file or a path that executors can read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_OUT):
                batch = whole.slice(at, _ROWS_OUT)
                texts = batch.column(1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                ends = [codec.ends(t, i) for t, i in zip(texts, ids, strict=True)]
                cols = [batch.column(0), _lists(ids, np.int32), _lists(ends, np.int32)]
                if decoded:
                    cols.append(pa.array([codec.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    out = src.mapInArrow(run, T.StructType(fields))
    return out.withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, id_col="doc_id", ids_col="ids", model=MODEL) -> DataFrame:
    """``(id, decoded)`` of rows that hold piece ids; null decodes to the empty text."""
    src = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [codec.whole.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("decoded", T.StringType())])).withColumnRenamed("id", id_col)


def with_digests(encoded: DataFrame, id_col="doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(encode_pieces(table(spark, sf_dir, "documents")))
