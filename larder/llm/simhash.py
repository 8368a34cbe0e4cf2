"""SimHash near-dedup with BK-trees.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles. Two
fingerprints within ``radius`` differing bits agree on at least ``m - radius`` of ``m`` bit
blocks, so each distinct fingerprint goes to one shard per choice of ``m - radius`` blocks,
and shards whose key only one fingerprint has are dropped before anything is built. ``m``
grows with the number of fingerprints, so that shards stay small whatever the corpus. A
shard builds a BK-tree (children keyed by their integer Hamming distance to the parent) and
a lookup follows only the edges within the radius of the distance to a node. A shard holds
at most SHARD fingerprints: those of a fuller key are dealt again by finer blocks, which any
two of them within the radius share as well, and where the finest are still too full, the
key is dealt over parts that meet pair by pair. No link is lost, and no task holds more than
two parts.

A shard gives back each linked fingerprint with the root of its component there, never all
pairs: a spanning set of its links. Connected components follow as joins.

Equal texts share a fingerprint and are collapsed before any search, so a group of
thousands of copies costs one tree node.

Shards are shuffled to tasks rather than broadcast: together they hold every fingerprint of
the corpus several times over, which no bound on size admits.

Defined results: null and empty texts have fingerprint zero and link like any other;
texts with fewer words than a shingle are one shingle, very long ones are hashed whole; rows
with a null id take part, and never name a component unless the whole component has null
ids; repeated rows each come back; an empty table gives no rows; other columns of the input
are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import collect_garbage, components, discard, durable, is_small, scratch, table

SHINGLE = 4
RADIUS = 4
SHARD = 2048
#: Fingerprints a key may hold on average, and how many blocks more than the radius are tried.
_PER_KEY = 16
_FINEST = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it; unsigned."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", size=SHINGLE) -> DataFrame:
    """``(id, fp)``, the fingerprint as a signed 64-bit value."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.LongType())]))


class BKTree:
    """Distinct 64-bit values; children of a node are keyed by their distance to it."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for new in range(1, len(values)):
            node = 0
            while True:
                d = (values[node] ^ values[new]).bit_count()
                child = self.children[node].setdefault(d, new)
                if child == new:
                    break
                node = child
        self._table = None

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            todo += [c for k, c in self.children[node].items() if d - radius <= k <= d + radius]
        return found

    def within_all(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` pairs for many lookups, followed level by level."""
        if len(self.values) <= 48 or len(values) <= 4:
            pairs = [(q, node) for q, v in enumerate(values.tolist()) for node in self.within(v, radius)]
            return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        if self._table is None:
            self._table = np.full((len(self.values), 65), -1, np.int32)
            for node, kids in enumerate(self.children):
                for k, c in kids.items():
                    self._table[node, k] = c
            self._array = np.array(self.values, np.uint64)
        query, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        reach = np.arange(-radius, radius + 1)
        while len(query):
            d = np.bitwise_count(self._array[node] ^ values[query]).astype(np.int64)
            near = d <= radius
            found.append((query[near], node[near]))
            keys = d[:, None] + reach
            kids = np.where((keys >= 0) & (keys <= 64), self._table[node[:, None], np.clip(keys, 0, 64)], -1)
            at, _ = np.nonzero(kids >= 0)
            query, node = query[at], kids[kids >= 0].astype(np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _shard_links(members: list[int], visitors: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Every linked member and visitor, with the root of its component in the shard.

    Visitors, if there are any, are held against the members only, else members against each other.
    """
    tree, array = BKTree(members), np.array(members, np.uint64)
    label = np.arange(len(members))
    met: list[tuple[np.ndarray, np.ndarray]] = []
    values = np.array(visitors or members, np.uint64)
    for at in range(0, len(values), 512):
        part = values[at : at + 512]
        q, m = tree.within_all(part, radius)
        while True:
            old = label.copy()
            least = np.full(len(part), len(members), np.int64)
            np.minimum.at(least, q, label[m])
            np.minimum.at(label, label[m], least[q])
            np.minimum.at(label, m, least[q])
            while (label[label] != label).any():
                label = label[label]
            if (label == old).all():
                break
        have, first = np.unique(q, return_index=True)
        met.append((part[have], m[first]))
    for part, first in met:
        for x, y in zip(part.tolist(), array[label[first]].tolist(), strict=True):
            if x != y:
                yield x, y
    for x, y in zip(members, array[label].tolist(), strict=True):
        if x != y:
            yield x, y


def _block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key per choice of ``blocks - radius`` of the blocks of bits that make up ``fp``."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    signed = F.lit([m - (1 << 64) if m >> 63 else m for m in masks]).cast("array<bigint>")
    return F.transform(signed, lambda m: F.xxhash64(m, fp.bitwiseAND(m)))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``(a, b)``: links that connect the distinct values of ``fps.fp`` within ``radius``."""
    return shard_links(fps, radius, shard).select("a", "b").distinct()


def shard_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, finest: int = _FINEST) -> DataFrame:
    """``(key, tree, a, b)``: in a tree, ``b`` is the root of the component of ``a``.

    Two distinct values within ``radius`` are in one component of some tree.
    """
    todo = durable(fps.select("fp").distinct(), "values")
    n, blocks, last = todo.count(), radius + 1, radius + finest
    while blocks < last and n > _PER_KEY * 2 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    dealt = []
    while True:
        keyed = todo.select("fp", F.explode(_block_keys(F.col("fp"), blocks, radius)).alias("key"))
        sizes = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        whole = sizes.where(F.col("n") <= shard).select("key")
        dealt.append(keyed.join(whole, "key").select("key", F.lit(0).cast("long").alias("tree"), F.lit(False).alias("visits"), "fp"))
        full = sizes.where(F.col("n") > shard)
        if full.limit(1).count() == 0:
            break
        if blocks >= last:
            dealt.append(_parts(keyed.join(full, "key"), shard))
            break
        blocks += 1
        todo = durable(keyed.join(full, "key", "left_semi").select("fp").distinct(), "values")
    rows = dealt[0]
    for more in dealt[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "visits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, ...]] = []
        now, members, visitors = None, [], []

        def flush() -> None:
            if len(members) + len(visitors) > 1:
                out.extend((*now, x, y) for x, y in _shard_links(members, visitors, radius))

        for batch in batches:
            key, tree = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            visits, values = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(tree) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if a == b:
                    continue
                if (shard_key := (int(key[a]), int(tree[a]))) != now:
                    flush()
                    now, members, visitors = shard_key, [], []
                members += values[a:b][~visits[a:b]].tolist()
                visitors += values[a:b][visits[a:b]].tolist()
            if len(out) >= 50_000:
                yield _edges(out)
                out = []
        flush()
        yield _edges(out)

    return rows.mapInArrow(run, "key long, tree long, a long, b long")


def _parts(keyed: DataFrame, shard: int) -> DataFrame:
    """The fingerprints of full keys ``(key, fp, n)`` in parts of about ``shard``, each with each."""
    parts = F.ceil(F.col("n") / shard).cast("int")
    rows = keyed.select("key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = F.least("own", "other"), F.greatest("own", "other")
    tree = F.shiftleft(left.cast("long"), 32) + right
    return rows.select("key", tree.alias("tree"), ((F.col("own") == right) & (left < right)).alias("visits"), "fp")


def _edges(links: list[tuple[int, ...]]) -> pa.RecordBatch:
    shards = [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)]
    sides = [pa.array(np.array([x[k] for x in links], np.uint64).view(np.int64)) for k in (2, 3)]
    return pa.RecordBatch.from_arrays([*shards, *sides], names=["key", "tree", "a", "b"])


def simhash_components(docs: DataFrame, id_col="doc_id", text_col="text", size=SHINGLE, radius=RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for every row; a component is named by its smallest id."""
    prints = durable(fingerprints(docs, id_col, text_col, size), "fingerprints")
    names = components(fingerprint_links(prints, radius))
    own = prints.groupBy("fp").agg(F.min("id").alias("least"))
    own = own.join(names, own["fp"] == names["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    own = durable(own, "classes")
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = own.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(classes, prints["fp"] == classes["_fp"]).select(F.col("id").alias(id_col), "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Near-duplicate groups of five-word shingles, similarity 0.8 or more ---------------------

NEAR_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Nodes a task holds against one root; members and shingles of a block of a group.
STAR, GROUP, BLOCK = 64, 256, 1 << 20
_ODD = np.random.default_rng(64).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of ROWS least values of the shingle set under fixed permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _ODD).min(0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ value) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


def _sketches(docs: DataFrame) -> DataFrame:
    """``(id, th, same1, same2, fp, size, bands)`` of ``docs (id, th, text)``; equal word
    sequences have equal ``same``, and ``size`` is the number of shingles."""
    names = ["id", "th", "same1", "same2", "fp", "size", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            same, fps, sizes, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, NEAR_SHINGLE)
                same.append(xxh3_128_intdigest(b" ".join((text or "").encode().translate(_LOWER).split())))
                fps.append(fingerprint(hashes))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = pa.array(np.arange(0, BANDS * (len(bands) + 1), BANDS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, longs(np.concatenate([*bands, np.zeros(0, np.uint64)])))
            cols = [longs([s >> 64 for s in same]), longs([s & (1 << 64) - 1 for s in same]), longs(fps), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    kinds = [docs.schema["id"].dataType, *[T.LongType()] * 5, T.ArrayType(T.LongType())]
    return docs.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the nodes ``wanted (node, id, th)``: the distinct shingle hashes in rising order."""
    rows = docs.join(F.broadcast(wanted) if is_small(wanted) else wanted.hint("shuffle_hash"), ["id", "th"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, NEAR_SHINGLE)) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes array<bigint>")


def _rows_of(batch: pa.RecordBatch, lists: int) -> Iterator[tuple]:
    """The rows of a batch; column ``lists`` as arrays of unsigned values."""
    cols = [batch.column(i).to_pylist() if i != lists else None for i in range(batch.num_columns)]
    column = batch.column(lists)
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    cols[lists] = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    yield from zip(*cols, strict=True)


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _star_links(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: the pairs ``stars (root, node)`` that are similar.

    A root with many nodes is dealt over blocks of STAR, and its set goes to each of them.
    """
    blocks = stars.groupBy("root").agg(F.ceil(F.count("*") / STAR).cast("int").alias("blocks"))
    leaves = stars.join(blocks, "root").select("root", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(1).alias("leaf"), "node")
    roots = blocks.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("leaf"), F.col("root").alias("node"))
    rows = durable(leaves.unionByName(roots), "stars").join(sets, "node").select("root", "block", "leaf", "node", "hashes")
    rows = rows.repartition("root", "block").sortWithinPartitions("root", "block", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for root, _, leaf, node, hashes in _rows_of(batch, 4):
                if not leaf:
                    centre = hashes.copy()
                elif _similar(centre, hashes, similarity):
                    found.append((root, node))
            yield _links(found)

    return rows.mapInArrow(run, "a long, b long")


def _block_links(members: list[tuple[int, bool, int, np.ndarray]], one: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Spanning links among (component, visits, node, hashes), of members of two components
    and, unless it is ``one`` block, of two sides.

    Sets as similar as that share one of the least hashes, by which they are found.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    index: dict[int, int] = {}
    sides = [0, 0]
    for i, (component, visits, node, hashes) in enumerate(members):
        least = hashes[: len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1].tolist()
        near = 0
        for h in least:
            near |= index.get(h, 0)
            index[h] = index.get(h, 0) | 1 << i
        near &= ~(1 << i)
        if not one:
            near &= sides[not visits]
        sides[visits] |= 1 << i
        while near:
            j = near.bit_length() - 1
            near ^= 1 << j
            if top(component) != top(members[j][0]) and _similar(hashes, members[j][3], similarity):
                parent[top(component)] = top(members[j][0])
                yield node, members[j][2]


def _group_links(open_: DataFrame, sets: DataFrame, similarity: float, shard: int) -> DataFrame:
    """``(a, b)``: similar pairs of different components within groups ``open_ (grp, node, component, size)``.

    The largest component of a group is held against the rest, and the rest against itself,
    in blocks of about ``shard`` members or BLOCK shingles: a group that is nearly one
    component costs one pass over it.
    """
    parts = open_.groupBy("grp", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / shard), F.ceil(size / BLOCK), F.lit(1)).cast("int")
    main = F.max(F.struct("n", "size", "component"))
    shapes = parts.groupBy("grp").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    shapes = shapes.select(
        "grp",
        F.col("main.component").alias("main"),
        blocks(F.col("main.n"), F.col("main.size")).alias("_main_blocks"),
        blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("_rest_blocks"),
    )
    rows = open_.join(durable(shapes, "shapes"), "grp")
    dealt = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    core = rows.where(F.col("component") == F.col("main")).withColumn("own", dealt("_main_blocks"))
    rest = rows.where(F.col("component") != F.col("main")).withColumn("own", dealt("_rest_blocks"))
    core = core.withColumn("other", upto("_rest_blocks")).select("grp", F.lit(0).alias("kind"), F.col("own").alias("left"), F.col("other").alias("right"), F.lit(False).alias("visits"), "component", "node")
    against = rest.withColumn("other", upto("_main_blocks")).select("grp", F.lit(0).alias("kind"), F.col("other").alias("left"), F.col("own").alias("right"), F.lit(True).alias("visits"), "component", "node")
    left, right = F.least("own", "other"), F.greatest("own", "other")
    among = rest.withColumn("other", upto("_rest_blocks")).select("grp", F.lit(1).alias("kind"), left.alias("left"), right.alias("right"), ((F.col("own") == right) & (left < right)).alias("visits"), "component", "node")
    rows = durable(core.unionByName(against).unionByName(among), "blocks").join(sets, "node").select("grp", "kind", "left", "right", "visits", "component", "node", "hashes")
    rows = rows.repartition("grp", "kind", "left", "right").sortWithinPartitions("grp", "kind", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            found = []
            for *block, visits, component, node, hashes in _rows_of(batch, 7):
                if block != now:
                    if members:
                        found += _block_links(members, now[1] == 1 and now[2] == now[3], similarity)
                    now, members = block, []
                members.append((component, visits, node, hashes.copy()))
            yield _links(found)
        if members:
            yield _links(list(_block_links(members, now[1] == 1 and now[2] == now[3], similarity)))

    return rows.mapInArrow(run, "a long, b long")


def _candidate_groups(nodes: DataFrame, radius: int, shard: int) -> DataFrame:
    """``(grp, node, low)``: nodes that a tree of fingerprints connects, that share a
    fingerprint, or that share a band of least shingle hashes; ``low`` is the group's least node."""
    links = durable(shard_links(nodes, radius, shard), "links")
    tree = F.xxhash64("key", "tree", "b")
    grouped = links.select(tree.alias("grp"), F.col("a").alias("fp")).union(links.select(tree, "b"))
    alike = nodes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("fp", F.lit("alike")).alias("grp"), "fp")
    close = durable(grouped.union(alike).distinct(), "close").join(nodes.select("fp", "node"), "fp").select("grp", "node")
    groups = nodes.select(F.explode("bands").alias("grp"), "node").union(close)
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("who"))
    # Groups with the same members are one.
    live = durable(sizes.where("n > 1").groupBy("n", "low", "who").agg(F.min("grp").alias("grp")).select("grp", "low"), "live")
    return durable(groups.join(live, "grp"), "members")


def _near_rows(docs: DataFrame, id_col: str, text_col: str, radius: int, similarity: float, shard: int, block: int) -> DataFrame:
    """``(id, th, first)`` of every row with an id: ``first (id, th)`` is the row that its group keeps."""
    spark = docs.sparkSession
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    sketch = durable(_sketches(src), "sketches")
    first = F.min(F.struct("id", "th")).alias("first")
    nodes = sketch.groupBy("same1", "same2").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # Written at once, so the numbers are fixed.
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = _candidate_groups(nodes, radius, shard)
    collect_garbage(spark)

    known = nodes.select("node", "size", "first.id", "first.th")
    wanted = known.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "th")
    sets = _shingle_sets(src, durable(wanted, "wanted"))
    repeated = sketch.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1")
    sets = durable(sets if repeated.limit(1).count() == 0 else sets.dropDuplicates(["node"]), "sets")
    collect_garbage(spark)

    # First the least node of a group against the others, then what that leaves apart.
    stars = members.where("node <> low").select(F.col("low").alias("root"), "node").distinct()
    links = durable(_star_links(stars, sets, similarity), "pairs")
    told = components(links)
    told = durable(members.where("node <> low").join(told, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("component")), "told")
    apart = told.groupBy("grp").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("grp")
    open_ = durable(told.join(apart, "grp").join(known.select("node", "size"), "node"), "open")
    more = durable(_group_links(open_, sets, similarity, block), "pairs")
    discard(members, sets)
    roots = components(links.union(more))

    nodes = durable(nodes.join(roots, "node", "left").select("same1", "same2", "first", F.coalesce("root", "node").alias("root")), "roots")
    firsts = nodes.groupBy("root").agg(F.min("first").alias("first"))
    named = nodes.select("same1", "same2", "root").join(durable(firsts, "firsts"), "root")
    return sketch.join(named, ["same1", "same2"]).select("id", "th", "first")


def near_duplicate_groups(docs: DataFrame, id_col="doc_id", text_col="text", radius=RADIUS, similarity=SIMILARITY, shard=SHARD, block=GROUP) -> DataFrame:
    """``(id, group_id)`` of every row with an id; a group is named by its smallest id.

    Texts of equal words are one node. Candidates are the groups that a tree of fingerprints
    connects, with all texts of each fingerprint, and, because at a similarity of 0.8
    fingerprints of 64 bits are up to 18 bits apart, groups that share a band of least
    shingle hashes; of two texts of that similarity 5 in 10**8 share none of the 32 bands.
    Within a group every text is held against the first, and those not yet connected are then
    held against each other, by the exact similarity of the shingle sets: no group is taken
    on its fingerprints or bands alone, and no link is lost because the first text of a group
    is not similar. Rows are told apart by id and text, so rows that share an id are judged
    by their own texts.
    """
    rows = _near_rows(docs, id_col, text_col, radius, similarity, shard, block)
    return rows.select(F.col("id").alias(id_col), F.col("first.id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, of equal ids the one
    whose text has the least hash, of repeated rows any; rows without an id all stay."""
    with scratch():
        rows = durable(_near_rows(docs, id_col, text_col, RADIUS, SIMILARITY, SHARD, GROUP), "near", keep=True)
    same = (F.col("id") == F.col("first.id")) & (F.col("th") == F.col("first.th"))
    gone = rows.where(~same).select("id", "th").distinct()
    gone = F.broadcast(gone) if is_small(gone) else gone.hint("shuffle_hash")
    th = F.xxhash64(docs[text_col])
    left = docs.join(gone, (docs[id_col] == gone["id"]) & (th == gone["th"]), "left_anti")
    again = durable(rows.where(same).groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select("id", "th"), "again")
    if again.limit(1).count() == 0:
        return left
    on = (docs[id_col] == again["id"]) & (th == again["th"])
    more = left.join(again, on, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    return left.join(again, on, "left_anti").unionByName(more.dropDuplicates(["id", "th"]).select("row.*"))
