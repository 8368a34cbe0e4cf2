"""Substring dedup, SimHash components, near-duplicate groups and the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from larder.llm import sentencepiece_codec, simhash, suffix_dedup
from larder.llm.common import components
from tests.conftest import DATA
from tests.llm import test_texts as texts


def brute_repeats(docs, length=100):
    seen, out = set(), []
    for i, t in sorted(docs):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(docs):
    rows = suffix_dedup.remove_repeats(docs).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)


def test_repeats(docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 200)
            parts += [p[a : a + rng.randint(90, 300)], word()]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, "a" * 1000), (102, "a" * 350 + "b" + "a" * 99), (103, "ab" * 300), (104, None), (105, ""), (106, "x" * 100), (107, "x" * 99), (108, "x" * 101), (109, passages[0] * 3)]
    assert repeats(docs_of(rows)) == brute_repeats(rows)
    assert repeats(docs_of([])) == []


def test_repeats_of_equal_rows(docs_of, edge_rows):
    rows = suffix_dedup.remove_repeats(docs_of(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    kept = {r.doc_id: len(r.kept) for r in rows}
    assert kept[6] == 0 and kept[5] > 0


def text_hash(spark, texts):
    """The hash by which rows that share an id are told apart."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return {r.i: r.h for r in frame.selectExpr("i", "xxhash64(coalesce(t, '')) AS h").collect()}


def test_repeats_of_shared_ids(spark, docs_of):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 30))) + rng.choice(["", passage, passage[40:], passage[:180]])
    rows = [(rng.choice([None, 7, 8]), text()) for _ in range(400)] + [(None, text()) for _ in range(2000)] + [(9, passage)] * 3
    hashes = text_hash(spark, [t for _, t in rows])
    order = [((-1 if i is None else i, hashes[k]), t) for k, (i, t) in enumerate(rows)]
    # Equal rows are one document: the second would repeat the first.
    want = {tuple(x[0]): x[1:] for x in brute_repeats(list(dict.fromkeys(order)))}
    got = suffix_dedup.remove_repeats(docs_of(rows)).collect()
    told = sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert told == sorted((str(rows[k][0]), *want[key]) for k, (key, _) in enumerate(order))


def test_segments(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    starts = [at + s for at, part in suffix_dedup._segments(data, 100) for f, e in zip(*suffix_dedup.cover_sample(part)[2:4], strict=True) for s in range(f, e + 1)]
    assert sorted(starts) == list(range(4901))
    at = np.arange(0, 4800, 7)
    parts = suffix_dedup._range_hashes(data, at, at + 150)
    assert (parts == suffix_dedup._Prefix(data)(at, at + 150)).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80, unique=True), st.integers(0, 6))
def test_bk_tree(values, radius):
    values += [v ^ 7 for v in values if v ^ 7 not in values][:20]
    tree = simhash.BKTree(values)
    q, node = tree.within_all(np.array(values, np.uint64), radius)
    got = sorted(zip(q.tolist(), node.tolist(), strict=True))
    assert got == sorted((i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= radius)


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 120), rng.randint(50, 120)) for _ in range(40)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(201, pairs)
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, docs_of, edge_rows):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(150)) for _ in range(12)]
    rows = list(edge_rows)
    for i in range(80):
        words = base[i % 12].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((1000 + i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    for shard in (2048, 3):
        prints = simhash.fingerprints(docs_of(rows))
        links = simhash.fingerprint_links(prints, 4, shard)
        fps = sorted({r.fp for r in prints.collect()})
        u = [f & (1 << 64) - 1 for f in fps]
        want = union(len(fps), [(i, j) for i in range(len(u)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 4])
        at = {f: i for i, f in enumerate(fps)}
        assert union(len(fps), [(at[r.a], at[r.b]) for r in links.collect()]) == want
    out = simhash.simhash_components(docs_of(rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and {by[k].component_id for k in (1, 2, 3)} == {1} and by[6].component_id == 5
    assert simhash.simhash_components(docs_of([])).count() == 0


def similar_groups(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (both := len(sets[i] & sets[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    root = union(len(rows), pairs)
    return {min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root)}


def test_near_duplicates(spark, docs_of, edge_rows):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    words = rows[0][1].split()
    rows += [(9000 + k, " ".join(w if (i * 7 + k) % 91 else "changed" for i, w in enumerate(words))) for k in range(4)]
    kept = simhash.drop_near_duplicates(docs_of(rows))
    assert {r.doc_id for r in kept.collect()} == similar_groups(rows)
    small = simhash.near_duplicate_groups(docs_of(rows), shard=2).where("doc_id = group_id").select("doc_id").distinct()
    assert {r.doc_id for r in small.collect()} == similar_groups(rows)
    edge = simhash.drop_near_duplicates(docs_of(edge_rows)).collect()
    assert sorted(str(r.doc_id) for r in edge) == ["1", "10", "4", "5", "9", "None", "None"]
    assert simhash.drop_near_duplicates(docs_of([])).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(out) < docs.count()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "encoding"]


def test_pipeline_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    train = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    told = texts.brute_languages([r[1] for r in rows], train)
    rows = [r for r, (lang, _, unclear) in zip(rows, told, strict=True) if lang != "und" and not unclear]
    kept = {i: t for i, _, _, t in texts.brute_lines([r[:2] for r in rows])}
    rows = [(i, None if t is None else kept[i], *more) for i, t, *more in rows]
    left = similar_groups([r[:2] for r in rows])
    rows = [r for r in rows if r[0] in left]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    dirty = {i for i, _ in texts.brute_matches([r[:2] for r in rows], bench)}
    library = sentencepiece_codec._codec(sentencepiece_codec.MODEL).whole
    want = {}
    for i, t, lang, source in rows:
        if i not in dirty:
            pieces = library.encode(t or "", return_type="proto").pieces
            want[i] = (lang, source, len(pieces), [p.id for p in pieces], [p.end for p in pieces], True)
    got = {r.doc_id: (r.lang, r.source, r.n_tokens, r.ids, r.ends, r.round_trip) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got.keys() == want.keys() and got == want and dirty


def test_stages_on_edges(spark, docs_of, edge_rows):
    docs = docs_of([*edge_rows, *[(50 + i, "the quick brown fox and the lazy dog " * 3 + str(i), "en") for i in range(4)], (60, "der schnelle braune fuchs " * 9, "de")])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0
        out = stage(spark, docs, DATA)
        assert out.count() <= docs.count()
        if stage is not corpus_pipeline.encoding_stage:
            assert out.columns == docs.columns
            docs = out


def test_near_values_meet_in_a_group(spark):
    rng = random.Random(8)
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(63), 3))
    values = [rng.getrandbits(63) for _ in range(6)]
    values += [flip(rng.choice(values)) for _ in range(40)]
    near = {(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 4}
    fps = spark.createDataFrame([(x,) for x in values], "fp long")
    for shard in (2048, 3):
        groups = {}
        for r in simhash.shard_links(fps, 4, shard).collect():
            groups.setdefault((r.key, r.tree, r.b), {r.b}).add(r.a)
        assert near <= {(x, y) for g in groups.values() for x in g for y in g}
    # The links alone do not have them: they lead to the root of a component.
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.fingerprint_links(fps).collect()}
    assert near - links


def test_few_similar_pairs_share_no_band():
    assert (1 - simhash.SIMILARITY**simhash.ROWS) ** simhash.BANDS < 1e-7


def test_near_duplicates_tell_rows_by_id_and_text(docs_of):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a), (7, a), (7, b), (8, c), (8, a.upper()), (8, c), (8, c), (9, None), (9, ""), (None, a), (None, a), (None, None)]
    kept = sorted((str(r.doc_id), str(r.text)) for r in simhash.drop_near_duplicates(docs_of(rows)).collect())
    nothing = [r for r in kept if r[0] == "9"]
    assert [r for r in kept if r[0] != "9"] == sorted([("3", a), ("7", b), ("8", c), ("None", a), ("None", a), ("None", "None")])
    assert len(nothing) == 1
    many = [(None, text()) for _ in range(300)] + [(5, text()) for _ in range(300)]
    assert simhash.drop_near_duplicates(docs_of(many * 2)).count() == 600 + 300


def chain(n, rng):
    """Texts of which each is similar to the next only, a few to none."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(100 + 9 * n)]
    return [" ".join(words[9 * i : 9 * i + 100]) for i in range(n)]


def test_near_duplicates_of_large_groups(docs_of):
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    star = [" ".join(w if rng.random() > 0.012 else f"x{i}" for w in base) for i in range(150)]
    far = [" ".join(w if rng.random() > 0.04 else f"y{i}" for w in base) for i in range(60)]
    rows = list(enumerate([*chain(12, rng), *star, *far]))
    want = similar_groups(rows)
    for shard, block in ((2048, 256), (3, 5)):
        groups = simhash.near_duplicate_groups(docs_of(rows), shard=shard, block=block).collect()
        assert {r.group_id for r in groups} == want and len(groups) == len(rows)


def test_full_keys_are_dealt_finer(spark):
    rng = random.Random(10)
    top = rng.getrandbits(43) << 20
    values = sorted({top | rng.getrandbits(20) for _ in range(400)})
    fps = spark.createDataFrame([(x,) for x in values], "fp long")
    at = {v: i for i, v in enumerate(values)}
    want = union(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    for shard, finest in ((50, 8), (20, 2)):
        links = [(at[r.a], at[r.b]) for r in simhash.shard_links(fps, 4, shard, finest).select("a", "b").distinct().collect()]
        assert union(len(values), links) == want


def test_language_stage_judges_every_row_by_its_text(spark, docs_of):
    train = [(100 + i, f"the words of the plain text number {i} are read by all of them", "en") for i in range(9)]
    train += [(200 + i, f"die worte der schlichten schrift nummer {i} werden von allen gelesen", "de") for i in range(9)]
    rows = [(1, "12 34"), (1, "the words are read by all"), (None, "die worte werden gelesen"), (None, None), (None, "..."), (2, "the text is plain"), (2, "the text is plain")]
    kept = corpus_pipeline.language_stage(spark, docs_of([*train, *rows]), DATA).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.doc_id is None or r.doc_id < 100) == sorted(map(str, [rows[1], rows[2], rows[5], rows[6]]))


def test_near_groups_equal_brute_force_on_more_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.group_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == similar_groups(rows)
