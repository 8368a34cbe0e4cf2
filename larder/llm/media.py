"""Media columns from ISO media containers.

Boxes are walked by their headers, nested containers included; the sample tables, and the
runs of movie fragments after them, are decoded to chunk and sample byte ranges; codec, time
scale, duration, edits and the byte ranges of the keyframes are stored as columns. Payload
bytes are never decoded. ``store_samples`` writes the containers that the query reads: 8-bit
samples in access units of UNIT bytes, one keyframe at the start of each chunk.

Defined results: bytes that are no container, or are cut off, give a row with ``error`` set
and no tracks; null media is handled as empty bytes; a payload is padded with zero bytes to
a positive multiple of UNIT, and one of any length is one row; equal payloads give equal
bytes; a track whose header tells no duration has that of its samples; repeated rows each
come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import table

UNIT = 64
UNITS_A_CHUNK = 128
RATE = 8000
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex"}
_ROWS_OUT = 256


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def store_samples(payload: bytes, unit: int = UNIT, per_chunk: int = UNITS_A_CHUNK, rate: int = RATE) -> bytes:
    """A container with one sound track whose access units are ``payload``'s units."""
    units = len(payload) // unit
    chunks = -(-units // per_chunk)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat = _box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    offsets = first + np.arange(chunks, dtype=np.int64) * (per_chunk * unit)
    rest = units - (chunks - 1) * per_chunk
    runs = [(1, per_chunk, 1)] if rest == per_chunk else [(1, rest, 1)] if chunks == 1 else [(1, per_chunk, 1), (chunks, rest, 1)]
    large = bool(offsets[-1] >= 1 << 32)
    places = _full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes())
    span = units * unit
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, units, unit)),
        _full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * per_chunk).astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        _full(b"stsz", struct.pack(">II", unit, units)),
        places,
    )
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    long = span >= 1 << 32
    times = lambda *a: struct.pack(">QQ" if long else ">II", 0, 0) + b"".join(a)
    size = lambda n: struct.pack(">Q" if long else ">I", n)
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(
        b"mdia",
        _full(b"mdhd", times(struct.pack(">I", rate), size(span)), struct.pack(">HH", 0x55C4, 0), version=int(long)),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
        minf,
    )
    tkhd = _full(b"tkhd", times(struct.pack(">II", 1, 0), size(span)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=int(long), flags=7)
    mvhd = _full(b"mvhd", times(struct.pack(">I", rate), size(span)), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=int(long))
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(kind, body start, body end)`` of the boxes between two places."""
    while start < end:
        if end - start < 8:
            raise ValueError("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, start + head, start + size
        start += size


def _walk(data: memoryview, start: int, end: int, found: list[dict], track: dict | None, defaults: dict[int, list[int]]) -> None:
    for kind, a, b in boxes(data, start, end):
        if kind == b"trak":
            found.append(own := {})
            _walk(data, a, b, found, own, defaults)
        elif kind in CONTAINERS:
            _walk(data, a, b, found, track, defaults)
        elif kind == b"trex":
            number, _, *rest = _u32(data, (a, b), 4, 5).tolist()
            defaults[number] = rest
        elif track is not None:
            track[kind] = (a, b)


def _u32(data: memoryview, at: tuple[int, int], skip: int, count: int) -> np.ndarray:
    if at[0] + skip + 4 * count > at[1]:
        raise ValueError("table is cut off")
    return np.frombuffer(data, ">u4", count, at[0] + skip).astype(np.int64)


def _track(data: memoryview, t: dict) -> dict:
    """Sample tables of one track as byte ranges."""
    a, _ = t[b"mdhd"]
    version = data[a]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, a + (20 if version else 12))
    codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1")
    sizes = _sizes(data, t)
    count = len(sizes)
    if b"co64" in t:
        n = int(_u32(data, t[b"co64"], 4, 1)[0])
        _u32(data, t[b"co64"], 8, 2 * n)
        offsets = np.frombuffer(data, ">u8", n, t[b"co64"][0] + 8).astype(np.int64)
    else:
        offsets = _u32(data, t[b"stco"], 8, int(_u32(data, t[b"stco"], 4, 1)[0]))
    runs = _u32(data, t[b"stsc"], 8, 3 * int(_u32(data, t[b"stsc"], 4, 1)[0])).reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(offsets) + 1)))
    if per_chunk.sum() != count or len(per_chunk) != len(offsets):
        raise ValueError("sample tables disagree")
    times = _u32(data, t[b"stts"], 8, 2 * int(_u32(data, t[b"stts"], 4, 1)[0])).reshape(-1, 2)
    last = np.cumsum(per_chunk)
    before = np.concatenate([[0], np.cumsum(sizes)])
    in_chunk = np.repeat(before[last - per_chunk], per_chunk)
    start = np.repeat(offsets, per_chunk) + before[:-1] - in_chunk
    sync = _u32(data, t[b"stss"], 8, int(_u32(data, t[b"stss"], 4, 1)[0])) - 1 if b"stss" in t else np.arange(count)
    spans = np.stack([offsets, before[last] - before[last - per_chunk]], 1)
    if count and ((start + sizes).max() > len(data) or sync.size and not 0 <= sync.min() <= sync.max() < count):
        raise ValueError("a sample lies outside the file")
    keys = np.stack([start[sync], sizes[sync]], 1)
    return {"codec": codec, "timescale": scale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "n_samples": count, "edits": _edits(data, t), "keyframes": keys, "spans": spans}


def _sizes(data: memoryview, t: dict) -> np.ndarray:
    """Sizes of the samples, from either kind of table."""
    if b"stz2" not in t:
        fixed, count = _u32(data, t[b"stsz"], 4, 2).tolist()
        return np.full(count, fixed, np.int64) if fixed else _u32(data, t[b"stsz"], 12, count)
    bits, count = _u32(data, t[b"stz2"], 4, 2).tolist()
    bits &= 255
    if bits not in (4, 8, 16) or t[b"stz2"][0] + 12 + (bits * count + 7) // 8 > t[b"stz2"][1]:
        raise ValueError("table is cut off")
    if bits == 16:
        return np.frombuffer(data, ">u2", count, t[b"stz2"][0] + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, (bits * count + 7) // 8, t[b"stz2"][0] + 12)
    return (raw if bits == 8 else np.stack([raw >> 4, raw & 15], 1).ravel()[:count]).astype(np.int64)


def _edits(data: memoryview, t: dict) -> list[tuple[int, int]]:
    """``(duration in the movie's time scale, start in the track's; -1: nothing shown)``."""
    if b"elst" not in t:
        return []
    a, b = t[b"elst"]
    version, count = data[a], int(_u32(data, (a, b), 4, 1)[0])
    form, size = (">Qq4x", 20) if version else (">Ii4x", 12)
    if a + 8 + size * count > b:
        raise ValueError("table is cut off")
    return [struct.unpack_from(form, data, a + 8 + size * i) for i in range(count)]


def _number(data: memoryview, t: dict) -> int:
    a, _ = t[b"tkhd"]
    return struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]


def _fragment(data: memoryview, start: int, a: int, b: int, tracks: dict[int, dict], defaults: dict[int, list[int]]) -> None:
    """Adds the runs of one movie fragment, which begins at ``start``, to their tracks."""
    place = start
    for kind, a1, b1 in boxes(data, a, b):
        if kind != b"traf":
            continue
        inner = list(boxes(data, a1, b1))
        head = next((x, y) for k, x, y in inner if k == b"tfhd")
        flags, number = (int(x) for x in _u32(data, head, 0, 2))
        at, known = head[0] + 8, list(defaults.get(number, [0, 0, 0]))
        base = struct.unpack_from(">Q", data, at)[0] if flags & 1 else start if flags & 0x20000 else place
        at += 8 * (flags & 1) + 4 * bool(flags & 2)
        for i, bit in enumerate((8, 16, 32)):
            if flags & bit:
                known[i], at = struct.unpack_from(">I", data, at)[0], at + 4
        place = base
        for k, x, y in inner:
            if k == b"trun":
                place = _run(data, (x, y), base, place, known, tracks[number])


def _run(data: memoryview, box: tuple[int, int], base: int, place: int, known: list[int], track: dict) -> int:
    """Adds the samples of one run; gives the place after them."""
    flags, count = (int(x) for x in _u32(data, box, 0, 2))
    flags &= 0xFFFFFF
    at = 8
    if flags & 1:
        place, at = base + struct.unpack_from(">i", data, box[0] + at)[0], at + 4
    first = int(_u32(data, box, at, 1)[0]) if flags & 4 else None
    at += 4 * bool(flags & 4)
    told = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    rows = _u32(data, box, at, count * len(told)).reshape(count, len(told))
    column = lambda i, bit: rows[:, told.index(bit)] if bit in told else np.full(count, known[i], np.int64)
    spans, sizes, marks = column(0, 0x100), column(1, 0x200), column(2, 0x400).copy()
    if first is not None and count:
        marks[0] = first
    starts = place + np.cumsum(sizes) - sizes
    end = place + int(sizes.sum())
    if place < 0 or end > len(data):
        raise ValueError("a sample lies outside the file")
    sync = (marks & 0x10000) == 0
    track["n_samples"] += count
    track["ticks"] += int(spans.sum())
    track["keyframes"] = np.concatenate([track["keyframes"], np.stack([starts[sync], sizes[sync]], 1)])
    track["spans"] = np.concatenate([track["spans"], np.array([[place, end - place]], np.int64)])
    return end


def read_tracks(media: bytes) -> list[dict]:
    data, found, defaults = memoryview(media), [], {}
    _walk(data, 0, len(data), found, None, defaults)
    if not found:
        raise ValueError("no track")
    tracks = [_track(data, t) for t in found]
    by_number = {_number(data, t): track for t, track in zip(found, tracks, strict=True) if b"tkhd" in t}
    start = 0
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moof":
            _fragment(data, start, a, b, by_number, defaults)
        start = b
    for track in tracks:
        track["duration"] = track["duration"] or track["ticks"]
    return tracks


_TRACK = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("timescale", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("ticks", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("edits", T.ArrayType(T.StructType([T.StructField("duration", T.LongType()), T.StructField("start", T.LongType())]))),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
    ]
)
_ARROW_TRACK = pa.list_(
    pa.struct(
        [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("ticks", pa.int64()), ("n_samples", pa.int64()), ("edits", pa.list_(pa.struct([("duration", pa.int64()), ("start", pa.int64())]))), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
    )
)


def _mapped(df: DataFrame, schema: T.StructType, each) -> DataFrame:
    """``each(value of the second column)`` gives the row's further values."""
    names = schema.fieldNames()
    kinds = {"media": pa.binary(), "payload": pa.binary(), "tracks": _ARROW_TRACK, "error": pa.string(), "n_bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_OUT):
                batch = whole.slice(at, _ROWS_OUT)
                rows = [each(x) for x in batch.column(1).to_pylist()]
                cols = [pa.array([r[k] for r in rows], kinds[name]) for k, name in enumerate(names[batch.num_columns - 1 :])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if i != 1], *cols], names=names)

    return df.mapInArrow(run, schema)


def store_media(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes, padded, in a container."""
    src = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return _mapped(src, schema, lambda b: (len(b), store_samples(pad(b)))).withColumnRenamed("id", id_col)


def media_columns(files: DataFrame, id_col="doc_id", media_col="media", payload=False) -> DataFrame:
    """``(id, tracks, error[, payload])`` of every container.

    ``payload`` adds the first track's stored bytes, copied chunk by chunk.
    """
    src = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(media_col), F.lit(b"")).alias("media"))
    fields = [T.StructField("id", src.schema["id"].dataType), T.StructField("tracks", T.ArrayType(_TRACK)), T.StructField("error", T.StringType())]
    fields += [T.StructField("payload", T.BinaryType())] * payload

    def each(media: bytes) -> tuple:
        try:
            tracks = read_tracks(media)
        except (ValueError, KeyError, IndexError, StopIteration, struct.error) as e:
            return (None, f"{type(e).__name__}: {e}", None)
        data = b"".join(media[a : a + n] for a, n in tracks[0]["spans"].tolist()) if payload else None
        ranges = lambda t: {"keyframes": [{"start": a, "length": n} for a, n in t["keyframes"].tolist()], "edits": [{"duration": a, "start": n} for a, n in t["edits"]]}
        told = [{k: v for k, v in t.items() if k not in ("spans", "keyframes", "edits")} | ranges(t) for t in tracks]
        return (told, None, data)

    return _mapped(src, T.StructType(fields), each).withColumnRenamed("id", id_col)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(table(spark, sf_dir, "documents"))
    stored = stored.select(F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("key"), "media")
    read = media_columns(stored, id_col="key", payload=True)
    t = F.get("tracks", F.lit(0))
    ranges = F.array_join(F.transform(t["keyframes"], lambda k: F.concat_ws("+", k["start"].cast("string"), k["length"].cast("string"))), ";")
    feature = F.concat_ws("|", t["codec"], t["timescale"].cast("string"), t["duration"].cast("string"), t["n_samples"].cast("string"), F.size(t["keyframes"]).cast("string"), F.substring(F.sha2(ranges, 256), 1, 16))
    return read.select(
        "key.doc_id",
        "key.n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT})")).cast("long").alias("tail_crc32"),
        "key.media_bytes",
        "key.media_sha256",
        feature.alias("feature"),
    )
