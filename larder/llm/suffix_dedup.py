"""Exact substring dedup: every byte covered by a LENGTH-byte string that starts earlier.

The construction is blockwise over a cover sample. A difference cover guarantees that two
equal strings hold sample positions at the same distance from their starts, so that ties
between long suffixes are settled by ranks of sample positions computed beforehand. Here the
sample is chosen by content instead of by residues: the position of the least K-byte hash
in each LENGTH-byte string. It has the same guarantee across documents of any alignment with
about 2/(LENGTH-K+2) of all positions in it, where residue covers need 10 % and more.

1. Every document emits its sample positions with the K-byte hash (the suffix bucket) and
   the hash of its context, the bytes of all LENGTH-byte strings that chose the position.
2. Buckets that occur once are dropped: nothing in them repeats.
3. A context's rank is its first occurrence, an aggregated minimum. Every later occurrence
   of the same context is removed whole.
4. In buckets with several contexts the first occurrence of each is cut into blocks of BLOCK
   starts. Equal blocks are ranked the same way; blocks that agree in the bytes common to
   all their strings but differ as a whole are compared string by string.
5. Spans meet their document by an equi-join and are merged there.

All grouping is by aggregated minima and counts, so a passage that a third of all documents
share is combined on the map side; joins back are against one row per key, and their other
side is split when it is skewed. Each step's spans are written as it ends, and the tables it
was made from are deleted, so the disk holds one step at a time. Nothing larger than a document's own spans meets in a task.
Strings are told apart by 128 bits of hash (bucket and string).

Defined results: null is the empty text; texts under LENGTH bytes keep everything; very long
texts are hashed in overlapping segments; rows that share id and text are the same document
and come back with the same result; rows that share only the id are documents of their own,
in the order of their texts' 64-bit hashes, by which they are told apart in every step; null
ids sort before all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import collect_garbage, discard, durable, table

LENGTH = 100
K = 24
BLOCK = 16
_SEGMENT = 1 << 22
_RANDOM = np.random.default_rng(20)
_TABLE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE2 = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_INVERSE2 = pow(_BASE2, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte windows, by doubling."""
    power, done, out, width = _TABLE[data], 0, None, 1
    while True:
        if size & width:
            n = len(data) - size + 1
            part = power[done : done + n]
            out = part if out is None else out * np.uint64(pow(_BASE, width, 1 << 64)) + part
            done += width
        width *= 2
        if width > size:
            return _mix(out)
        half = width // 2
        power = power[:-half] * np.uint64(pow(_BASE, half, 1 << 64)) + power[half:]


class _Prefix:
    """Hashes of any ranges of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        global _POWERS
        if len(_POWERS[0]) <= n:
            size = 1 << (n + 1).bit_length()
            _POWERS = (_powers(_BASE2, size), _powers(_INVERSE2, size))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE2[data] * _POWERS[0][:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _POWERS[1][start])


_POWERS = (_powers(_BASE2, 1 << 17), _powers(_INVERSE2, 1 << 17))


def _range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short ranges, a segment of ``data`` at a time; equal bytes, equal hashes."""
    if len(data) <= _SEGMENT or not len(start):
        return _Prefix(data)(start, end)
    out, longest = np.empty(len(start), np.uint64), int((end - start).max())
    for at in range(0, len(data), _SEGMENT):
        here = (start >= at) & (start < at + _SEGMENT)
        if here.any():
            out[here] = _Prefix(data[at : at + _SEGMENT + longest])(start[here] - at, end[here] - at)
    return out


def cover_sample(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """``(bucket, context, first start, last start, sample position)`` of the samples of
    ``data``; the strings that start between the two chose the sample."""
    n_starts = len(data) - length + 1
    if n_starts < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    width = length - k + 1
    keys = _window_hashes(data, k)
    order = (keys & ~np.uint64((1 << 23) - 1)) | np.arange(len(keys), dtype=np.uint64)
    least, span = order, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [n_starts]]) - 1
    at = place[first]
    context = _Prefix(data)(first, last + length)
    shape = ((last - first) * (1 << 8) + (at - first)).astype(np.uint64)
    return keys[at], _mix(context + shape * np.uint64(0x94D049BB133111EB)), first, last, at


def _segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces that hold each ``length``-byte string exactly once."""
    for at in range(0, max(1, len(data) - length + 1), _SEGMENT):
        yield at, data[at : at + _SEGMENT + length - 1]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _longs(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64, copy=False))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _place(start: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Start and a number under 2**16 in one value that sorts by start."""
    return (start.astype(np.int64) << 16) | more


def _emit(batches: Iterator[pa.RecordBatch], names: list[str], each) -> Iterator[pa.RecordBatch]:
    """``each(row)`` gives the columns of a document's rows; sent on in parts of a few MB."""
    parts: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*[c if isinstance(c, pa.ListArray) else c.to_pylist() for c in batch.columns], strict=True):
            for part in each(*row):
                parts.append(part)
                size += len(part[0])
            if size >= 100_000:
                yield pa.RecordBatch.from_arrays([_longs([p[k] for p in parts]) for k in range(len(names))], names=names)
                parts, size = [], 0
    yield pa.RecordBatch.from_arrays([_longs([p[k] for p in parts]) for k in range(len(names))], names=names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _fields(requests: pa.ListScalar) -> list[np.ndarray]:
    return [f.to_numpy() for f in requests.values.flatten()]


def _samples(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (bucket, context, doc, tag, at), one per sample; ``at`` holds the first start, how
    many starts follow it and how far the sample is from it."""
    names = ["bucket", "context", "doc", "tag", "at"]

    def each(doc: int, tag: int, text: str) -> Iterator[tuple]:
        data = _bytes(text)
        for skip, part in _segments(data, length):
            bucket, context, first, last, at = cover_sample(part, length, k)
            n = len(bucket)
            if n:
                yield _signed(bucket), _signed(context), np.full(n, doc), np.full(n, tag), _place(first + skip, ((last - first) << 8) | (at - first))

    return docs.mapInArrow(lambda b: _emit(b, names, each), _schema(names))


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """Rows (bucket, core, hull, doc, tag, at) for the contexts requested of each document;
    ``at`` holds the first start of a block and how many starts it has."""
    names = ["bucket", "core", "hull", "doc", "tag", "at"]

    def each(doc: int, tag: int, text: str, requests: pa.ListScalar) -> Iterator[tuple]:
        bucket, place = _fields(requests)
        first = place >> 16
        last, sample = first + ((place >> 8) & 255), first + (place & 255)
        near, far = (sample - last) // BLOCK, (sample - first) // BLOCK
        count = far - near + 1
        row = np.repeat(np.arange(len(first)), count)
        q = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[row]
        low = np.maximum(sample[row] - q * BLOCK - (BLOCK - 1), first[row])
        high = np.minimum(sample[row] - q * BLOCK, last[row])
        data = _bytes(text)
        end = sample[row] - q * BLOCK - (BLOCK - 1) + length
        core = _mix(_range_hashes(data, sample[row] - q * BLOCK, end) + q.astype(np.uint64))
        sides = ((sample[row] - low) * 256 + (sample[row] - high)).astype(np.uint64)
        hull = _mix(_range_hashes(data, low, high + length) + sides * np.uint64(0x94D049BB133111EB))
        yield bucket[row], _signed(core), _signed(hull), np.full(len(row), doc), np.full(len(row), tag), _place(low, high - low + 1)

    return rows.mapInArrow(lambda b: _emit(b, names, each), _schema(names))


def _strings(rows: DataFrame, length: int) -> DataFrame:
    """Rows (bucket, string, doc, tag, at) for the blocks requested of each document."""
    names = ["bucket", "string", "doc", "tag", "at"]

    def each(doc: int, tag: int, text: str, requests: pa.ListScalar) -> Iterator[tuple]:
        bucket, place = _fields(requests)
        count = place & 0xFFFF
        row = np.repeat(np.arange(len(bucket)), count)
        start = (place >> 16)[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        string = _range_hashes(_bytes(text), start, start + length)
        yield bucket[row], _signed(string), np.full(len(row), doc), np.full(len(row), tag), _place(start, 1)

    return rows.mapInArrow(lambda b: _emit(b, names, each), _schema(names))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: its first occurrence (doc, tag, at), and how many there are."""
    first = F.min(F.struct("doc", "tag", "at")).alias("first")
    out = rows.groupBy(*keys).agg(first, F.count("*").alias("seen"))
    return out.select(*keys, "first.doc", "first.tag", "first.at", "seen")


def _later(rows: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """``(doc, tag, at)`` of the occurrences that are not the first of their key."""
    first = ranked.where("seen > 1").select(*keys, F.col("doc").alias("doc0"), F.col("tag").alias("tag0"), F.col("at").alias("at0"))
    return rows.join(first, keys).where("doc <> doc0 OR tag <> tag0 OR at <> at0").select("doc", "tag", "at")


def _asked(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents with the list of what is asked of them; the text side is never sorted."""
    lists = requests.groupBy("doc", "tag").agg(F.collect_list(F.struct("bucket", "at")).alias("requests"))
    return docs.join(lists.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "requests")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``(doc, tag, spans)`` for ``docs (doc, tag, text)``: spans array<(start, end)> to remove."""
    samples = _samples(docs, length, k)
    often = samples.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    often = durable(often, "often")
    samples = durable(samples.join(often, "bucket", "left_semi"), "samples")
    discard(often)

    start = F.shiftright("at", 16)
    span = lambda n: [F.col("doc"), F.col("tag"), start.alias("start"), (start + n + (length - 1)).alias("end")]
    contexts = durable(_ranked(samples, ["bucket", "context"]), "contexts")
    collect_garbage(docs.sparkSession)
    starts = F.shiftright("at", 8).bitwiseAND(F.lit(255)) + 1
    spans = [durable(_later(samples, contexts, ["bucket", "context"]).select(*span(starts)), "spans")]
    discard(samples)

    several = contexts.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    several = durable(several, "several")
    several = contexts.join(several, "bucket", "left_semi")
    blocks = durable(_blocks(_asked(docs, several), length), "blocks")
    discard(contexts)
    hulls = durable(_ranked(blocks, ["bucket", "core", "hull"]), "hulls")
    collect_garbage(docs.sparkSession)
    spans.append(durable(_later(blocks, hulls, ["bucket", "core", "hull"]).select(*span(F.col("at").bitwiseAND(F.lit(0xFFFF)))), "spans"))
    discard(blocks)

    apart = hulls.groupBy("bucket", "core").agg(F.count("*").alias("m")).where("m > 1").select("bucket", "core")
    apart = durable(apart, "apart")
    apart = hulls.join(apart, ["bucket", "core"], "left_semi")
    strings = durable(_strings(_asked(docs, apart), length), "strings")
    discard(hulls)
    firsts = durable(_ranked(strings, ["bucket", "string"]).where("seen > 1"), "firsts")
    spans.append(durable(_later(strings, firsts, ["bucket", "string"]).select(*span(F.lit(1))), "spans"))
    discard(strings, firsts)

    every = spans[0].union(spans[1]).union(spans[2])
    return every.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, k: int = K) -> DataFrame:
    """``(id, n_bytes, kept binary, spans)``; ids are integers, spans merged byte ranges."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    found = repeated_spans(src, length, k)
    joined = src.join(found.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, kept, spans = [], [], []
                for text, asked in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    data = text.encode()
                    merged = _merge(*_fields(asked)) if asked.is_valid else []
                    sizes.append(len(data))
                    kept.append(_without(data, merged))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["id", "n_bytes", "kept", "spans"])

    out = joined.mapInArrow(run, "id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    return out.select(F.nullif("id", F.lit(-(1 << 63))).alias(id_col), "n_bytes", "kept", "spans")


def _merge(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), reach[last].tolist(), strict=True))


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[x for s in spans for x in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
