"""Line dedup, chats, decontamination, tokens, media, languages and pages."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from larder.llm import chat, decontaminate, html_extract, language_id, line_dedup, media, sentencepiece_codec, token_counts
from larder.llm.common import table
from tests.conftest import DATA


def brute_lines(rows, chars=20, least=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars and i is not None:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(docs_of, edge_rows):
    shared = "This line is shared by many DOCUMENTS"
    rows = [*edge_rows, *[(100 + i, f"a{i}\n  {shared.lower() if i % 2 else shared}\t\nÉlan {shared}\n\nb") for i in range(7)], (107, "a\nshort"), (107, shared)]
    got = line_dedup.dedup_lines(docs_of(rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x"), (None, 0, "user", "lone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(0))
    got = {r.conv_id: (r.n_turns, r.n_logged) for r in chat.format_chats(df).collect()}
    assert got == {1: (2, 2), 4: (1, 1), 5: (2, 1), None: (1, 1)}
    assert chat.format_chats(df.where("false")).count() == 0


def test_decontamination(spark, docs_of, edge_rows):
    item = "A train of Anna leaves at 9 for Rome and travels 300 km in 4 h while another one waits"
    other = item.replace("9", "8").replace("300", "720").replace("Anna", "Berta").replace("4 h", "6 h")
    mixed = item.replace("300", "9 then 9")
    rows = [*edge_rows, (20, f"Before. {item}. after"), (21, f"Say: {other}!"), (22, "A train leaves at noon for the sea and no one waits for it today"), (23, mixed), (24, "1 2 3 4 5 6 7 8 9 " * 500)]
    bench = spark.createDataFrame([(1, item), (2, "1 2 3 4 5 6 7"), (3, None), (4, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(rows), bench).collect()}
    assert got == {(20, 1), (21, 1)} | ({(23, 1)} & got)
    assert decontaminate.contaminated(docs_of(rows), bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs_of([]), bench).count() == 0


def test_slots_must_agree(spark, docs_of):
    bench = spark.createDataFrame([(1, "take 7 apples then 7 pears then 5 plums and give 7 to each of the boys")], "item_id long, text string")
    rows = [(1, "take 3 apples then 3 pears then 2 plums and give 3 to each of the boys"), (2, "take 3 apples then 4 pears then 2 plums and give 9 to each of the boys")]
    assert [r.doc_id for r in decontaminate.contaminated(docs_of(rows), bench).collect()] == [1]


def brute_chats(turns):
    """(conv_id, n_turns, n_logged, rendered) of conversations that prefix no other."""
    key = lambda t: tuple((x is not None, x) for x in t)
    chats = {}
    for k, (i, *turn) in enumerate(turns):
        chats.setdefault((i is None, i, k if i is None else 0), []).append(tuple(turn))
    said = {c: [t[1:] for t in sorted(ts, key=lambda t: [(x is not None, x if x is not None else 0) for x in t])] for c, ts in chats.items()}
    groups = {}
    for c, ts in said.items():
        groups.setdefault(tuple(map(key, ts)), []).append(c)
    show = lambda ts: "\n".join(f"<|im_start|>{'user' if r is None else r}\n{t or ''}<|im_end|>" for r, t in ts)
    alone = [g for g in groups if not any(len(h) > len(g) and h[: len(g)] == g for h in groups)]
    return sorted(((min(groups[g])[1], len(g), len(groups[g]), show(said[groups[g][0]])) for g in alone), key=str)


def test_chats_equal_brute_force(spark):
    rng = random.Random(17)
    text = lambda: rng.choice([None, "", "yes", "no", "long " * 20_000])
    turns = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant"]), text()) for _ in range(120)]
    turns += [(40, k, "user", "same") for k in range(4)] + [(41, k, "user", "same") for k in range(3)] + [(42, 0, "user", "tie"), (42, 0, "user", "tie"), (43, 0, "user", "tie")]
    turns += [(None, 0, "user", "lone")] * 500 + [(44, 0, "user", "lone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("h1", F.lit("clash"))
    got = chat.format_chats(df).select("conv_id", "n_turns", "n_logged", "rendered").collect()
    assert sorted(map(tuple, got), key=str) == brute_chats(turns)


def plain_tokens(text):
    """(word, placeholder) of each token, by another way than the job's."""
    mark = regex.sub(r"(?<=[\p{Ll}\p{N},]\s)(?=\p{Lu})", "\x01", text or "")
    words = [w for w in regex.split(r"[ \t\n\x0b\x0c\r]+", regex.sub(r"[^\p{L}\p{N}\s\x01]+", "", mark)) if w]
    out = []
    for k, w in enumerate(words):
        unit = k and regex.search(r"\p{N}$", words[k - 1]) and w.lower() in decontaminate.UNITS
        kind = "<unit>" if unit else w[: w.index("\x01")] + "<name>" if "\x01" in w else regex.sub(r"\p{N}+", "<num>", w)
        out.append((w.lower(), kind.lower()))
    return out


def brute_matches(docs, bench):
    """{(doc, item): tokens that count} by trying every alignment at which a window agrees."""
    literal = lambda ws: any(regex.sub("<num>|<unit>|<name>", "", w) for w in ws)
    cut = lambda rows: [(i, ws, {tuple(k for _, k in ws[p : p + 5]) for p in range(len(ws) - 4)}) for i, ws in ((i, plain_tokens(t)) for i, t in rows)]
    found = {}
    for (i, d, met), (item, b, own) in itertools.product(cut(docs), cut(bench)):
        kinds = [k for _, k in b]
        if len(b) >= 5 and met.isdisjoint(own):
            continue
        if not literal(kinds):
            continue
        if len(b) < 5:
            if any([w for w, _ in d[p : p + len(b)]] == [w for w, _ in b] for p in range(len(d) - len(b) + 1)):
                found[i, item] = len(b)
            continue
        good = set()
        for shift in range(-len(b), len(d)):
            at = {p + k for p in range(len(b) - 4) if 0 <= p + shift <= len(d) - 5 and literal(kinds[p : p + 5]) and [k for _, k in d[p + shift : p + shift + 5]] == kinds[p : p + 5] for k in range(5)}
            pairs = {(b[p][0], d[p + shift][0]) for p in at}
            agreed = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
            good |= {p for p in at if agreed or b[p][0] == d[p + shift][0]}
        if len(good) >= 0.8 * len(b):
            found[i, item] = max(len(good), found.get((i, item), 0))
    return found


def test_decontamination_equals_brute_force(spark, docs_of):
    item = "Anna pays 7 euros for 7 apples and 3 euros for 3 pears while Berta pays 5 euros for one plum at the shop"
    swap = lambda text, **by: regex.sub(r"\w+", lambda m: by.get(m[0], by.get("n" + m[0], m[0])), text)
    ask = "which of the following words is said by the {0} of the {1} in the old book of {2} songs"
    bench = [(1, item), (2, "7 apples, 3 pears, 7 each"), (3, "What is 7 + 5?"), (4, "7 + 5"), (None, "the old man and 12 of the young boys go home"), (1, "another text of item one that has ten tokens")]
    bench += [(10 + k, ask.format(a, b, 5)) for k, (a, b) in enumerate([("fool", "king"), ("wife", "miller"), ("child", "smith"), ("fool", "king")])]
    rows = [(1, item), (2, swap(item, n7="4", n3="9", Berta="Carla")), (3, swap(item, n7="3")), (4, item.replace("7 apples", "8 apples")), (5, "3 apples, 3 pears, 3 each"), (6, "4 apples, 3 pears, 4 each")]
    rows += [(7, "Say what is 7 5 then"), (8, "What is 9 + 5?"), (9, "7 + 5"), (10, f"x {ask.format('fool', 'king', 8)} y"), (11, "which of the following words is said by the crowd in the end"), (12, f"{item} {item}")]
    rows += [(None, "So the old man and 40 of the young boys go home today"), (None, "clean"), (13, "clean"), (13, item), (13, swap(item, n7="2")), (14, "the old man and 12 of the young boys go home " * 30), (15, ""), (16, None)]
    frame = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contaminated(docs_of(rows + rows[:3]), frame).collect()
    want = brute_matches(rows, bench)
    assert {(r.doc_id, r.item_id): r.n_covered for r in got} == want and len(got) == len(want)
    assert {(5, 2), (8, 3), (11, 10)}.isdisjoint(want) and want[3, 1] == 22 and {(1, 1), (2, 1), (4, 1), (6, 2), (7, 3), (10, 10), (10, 11), (None, None), (13, 1)} <= set(want)
    left = decontaminate.drop_contaminated(docs_of(rows), frame).collect()
    dirty = {(i, t) for i, t in rows if any(k[0] == i for k in brute_matches([(i, t)], bench))}
    assert sorted(map(str, [(r.doc_id, r.text) for r in left])) == sorted(str(r) for r in rows if r not in dirty)


def odd_texts():
    rng = random.Random(5)
    return ["", " ", "  a  b", "\n\n a\n", "a \n b", "▁a▁ b", "é 梦\x00\x01 😀", "x\ty  \n\nz", " lead", "trail ", "a" * 3000] + ["".join(rng.choice(" \n▁ab é梦,.") for _ in range(40)) for _ in range(300)]


def test_codec_equals_library():
    codec = sentencepiece_codec._codec(sentencepiece_codec.MODEL)
    for t in odd_texts():
        ids = codec.encode(t)
        assert ids.tolist() == codec.whole.encode(t)
        if t:
            assert codec.ends(t, ids).tolist() == [p.end for p in codec.whole.encode(t, return_type="proto").pieces]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec
    ours = sentencepiece_codec.Normalizer(spec)
    for t in [*odd_texts(), "ＡＢＣ ① ﬁ é ㍿ İ  x "]:
        new, align = ours(t)
        assert new.decode() == theirs.normalize(t)
        assert len(align) == len(new) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(t.encode())


def test_encode_table(docs_of, edge_rows):
    docs = docs_of(edge_rows)
    rows = sentencepiece_codec.encode_pieces(docs)
    out = sentencepiece_codec.with_digests(rows).collect()
    assert len(out) == len(edge_rows)
    codec = sentencepiece_codec._codec(sentencepiece_codec.MODEL)
    want = sorted((str(i), hashlib.sha256(",".join(map(str, codec.whole.encode(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in edge_rows)
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in out) == want
    again = sentencepiece_codec.decode_pieces(rows).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(i), t or "") for i, t in edge_rows)
    assert sentencepiece_codec.encode_pieces(docs_of([])).count() == 0


def unigram_library(least=token_counts.RESERVED):
    """The library over the pieces that score more than ``least``, and these."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(sentencepiece_codec.model_file(sentencepiece_codec.MODEL), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    few = [p for p in proto.pieces if p.score > least]
    del proto.pieces[:]
    proto.pieces.extend(few)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), {p.piece: p.score for p in few if p.type == 1}


def test_viterbi_equals_library(docs_of, edge_rows):
    library, pieces = unigram_library()
    ours = token_counts.CountingViterbi(pieces)
    for t in odd_texts():
        assert ours.text(t)[0] == len(library.encode(t))
    assert ours.chunk("▁" + "a b a".replace(" ", "▁")) == ours.text("a b a")
    assert token_counts.count_tokens(docs_of(edge_rows)).where("n_tokens = 0").count() == 3
    assert token_counts.count_tokens(docs_of([])).count() == 0


def test_token_counts_of_whole_texts(spark):
    library, _ = unigram_library()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.op4_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "")) for r in docs.collect()}


def test_token_counts_beyond_single_precision():
    library, pieces = unigram_library()
    ours = token_counts.CountingViterbi(pieces)
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeé\n梦&&&") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(30_000))
    count, score = ours.text(text)
    assert score < -(2**28) and count == len(library.encode(text)) == ours.chunk("▁" + text.replace(" ", "▁"))[0]
    assert all(ours.text(text[:n])[0] == len(library.encode(text[:n])) for n in range(10_000, 40_000, 3_001))


def test_media(spark, docs_of, edge_rows):
    for size in (64, 64 * 127, 64 * 128, 64 * 129, 64 * 1000):
        payload = random.Random(size).randbytes(size)
        blob = media.store_samples(payload)
        track = media.read_tracks(blob)[0]
        assert b"".join(blob[a : a + n] for a, n in track["spans"].tolist()) == payload
        assert (track["n_samples"], track["ticks"], track["codec"]) == (size // 64, size, "raw ")
        assert all(blob[a : a + n] == payload[i * 8192 : i * 8192 + 64] for i, (a, n) in enumerate(track["keyframes"].tolist()))
    stored = media.store_media(docs_of(edge_rows))
    back = media.media_columns(stored, payload=True).join(stored, "doc_id", "left_semi").collect()
    want = sorted(zlib.crc32(media.pad((t or "").encode())) for i, t in edge_rows if i is not None)
    assert sorted(zlib.crc32(r.payload) for r in back) == want
    good = media.store_samples(bytes(64))
    junk = spark.createDataFrame([(1, None), (2, b"junk"), (3, good[:-9]), (4, b"\0" * 100), (5, good[:40])], "doc_id long, media binary")
    assert media.media_columns(junk).where("error IS NULL OR tracks IS NOT NULL").count() == 0
    assert media.media_columns(stored.where("false")).count() == 0


def test_fragments_edits_and_small_tables():
    box, full = media._box, media._full
    u32 = lambda *x: b"".join(n.to_bytes(4, "big") for n in x)

    def movie(stbl, *more, edits=b""):
        entry = box(b"av01", bytes(78))
        tables = box(b"stbl", full(b"stsd", u32(1), entry), *stbl)
        trak = box(b"trak", full(b"tkhd", u32(0, 0, 7, 0, 0), bytes(60)), edits, box(b"mdia", full(b"mdhd", u32(0, 0, 600, 0), bytes(4)), box(b"minf", tables)))
        return box(b"moov", trak, *more)

    none = [full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0))]
    trex = box(b"mvex", full(b"trex", u32(7, 1, 20, 5, 0x10000)))
    edit = box(b"edts", full(b"elst", u32(2, 30, 2**32 - 1, 1 << 16, 40, 9, 1 << 16)))
    head = movie(none, trex, edits=edit)

    def fragment(payload):
        def made(offset):
            first = full(b"trun", u32(3, offset, 0, 4, 6, 2), flags=0x205)
            second = full(b"trun", u32(2), flags=0)
            return box(b"moof", box(b"traf", full(b"tfhd", u32(7, 11), flags=0x20008), first, second))

        return made(len(made(0)) + 8) + box(b"mdat", payload)

    data = head + fragment(b"a" * 12 + b"b" * 10) + fragment(b"c" * 22)
    (track,) = media.read_tracks(data)
    assert (track["codec"], track["n_samples"], track["ticks"], track["duration"], track["edits"]) == ("av01", 10, 110, 110, [(30, -1), (40, 9)])
    assert b"".join(data[a : a + n] for a, n in track["spans"].tolist()) == b"a" * 12 + b"b" * 10 + b"c" * 22
    assert [data[a : a + n] for a, n in track["keyframes"].tolist()] == [b"aaaa", b"cccc"]
    for cut in range(len(head), len(data)):
        try:
            media.read_tracks(data[:cut])
        except ValueError:
            pass
    for bits, packed in ((4, bytes([0x35, 0x20])), (8, bytes([3, 5, 2])), (16, bytes([0, 3, 0, 5, 0, 2]))):
        mdat = box(b"mdat", b"xxxyyyyyzz")
        tables = [full(b"stts", u32(1, 3, 4)), full(b"stsc", u32(1, 1, 3, 1)), full(b"stz2", u32(bits, 3), packed), full(b"stco", u32(1, 8))]
        (track,) = media.read_tracks(mdat + movie(tables))
        assert track["keyframes"].tolist() == [[8, 3], [11, 5], [16, 2]] and track["duration"] == 12


def test_language_id(spark, docs_of, edge_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    held = docs.where(language_id.held_out(F.col("doc_id")))
    told = language_id.identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    assert told.where("lang_pred = lang").count() >= 0.99 * held.count()
    edge = {str(r.doc_id): r.lang_pred for r in language_id.identify(docs_of(edge_rows), model).collect()}
    assert [edge[k] for k in ("1", "2", "3", "10")] == ["und"] * 4 and edge["9"] != "und"
    none = language_id.fit(docs.where("false"))
    assert language_id.identify(docs_of(edge_rows), none).where("lang_pred <> 'und'").count() == 0
    one = language_id.fit(docs.where("lang = 'en'"))
    assert one.predict("words") == ("en", 1.0, False)
    for n in range(2, 12):
        code = language_id.codewords(n)
        assert len({tuple(x) for x in code.tolist()}) == n


def brute_languages(rows, labelled):
    """(lang_pred, score, ambiguous) of each text, by dictionaries and sums over all code bits."""

    def grams(text):
        data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
        found = Counter()
        for i in range(len(data)):
            h = 0
            for n in range(1, 5):
                if i + n > len(data):
                    break
                h = (h * 0x01000193 ^ data[i + n - 1]) & 0xFFFFFFFF
                found[((h * 2654435761 + n) & 0xFFFFFFFF) >> 19] += 1
        return found

    counts = {}
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    names = sorted(counts)
    code = language_id.codewords(len(names)).tolist()
    rate = []
    for x in names:
        total = sum(counts[x].values()) + 0.5 * 8192
        rate.append([(counts[x][k] + 0.5) / total for k in range(8192)])
    bits = []
    for j in range(len(code[0])):
        sides = {s: [r for r, c in zip(rate, code, strict=True) if c[j] == s] for s in (1, -1)}
        mean = {s: [sum(col) / len(rs) for col in zip(*rs, strict=True)] for s, rs in sides.items()}
        weight = [math.log(a / b) for a, b in zip(mean[1], mean[-1], strict=True)]
        at = {s: sum(sum(w * r for w, r in zip(weight, row, strict=True)) for row in rs) / len(rs) for s, rs in sides.items()}
        bits.append((weight, (at[1] + at[-1]) / 2, (at[1] - at[-1]) / 2, sum((a - b) * w for a, b, w in zip(mean[1], mean[-1], weight, strict=True))))
    trust = sum(b[3] for b in bits)
    out = []
    for text in rows:
        if text is None or not any(map(str.isalpha, text)):
            out.append(("und", 0.0, False))
            continue
        g = grams(text)
        margin = [(sum(w[k] * n for k, n in g.items()) / sum(g.values()) - c) / r for w, c, r, _ in bits]
        loss = [sum(math.log1p(math.exp(-8 * s * m)) * b[3] / trust for s, m, b in zip(word, margin, bits, strict=True)) for word in code]
        odds = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        out.append((names[best], odds[best] / sum(odds), sorted(odds)[-2] > 0.9))
    return out


def test_language_id_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    told = {r.doc_id: r for r in language_id.op9_language_id(spark, DATA).collect()}
    want = brute_languages([r.text for r in rows], train)
    assert all(told[r.doc_id].lang_pred == lang and abs(told[r.doc_id].score - score) < 1e-3 and told[r.doc_id].ambiguous == unclear for r, (lang, score, unclear) in zip(rows, want, strict=True))
    assert all(told[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_stray_labels_make_no_large_model(spark, docs_of):
    docs = docs_of([*[(i, "some words of a text", f"x{i}") for i in range(60)], *[(100 + i, "the plain words of it", "en") for i in range(3)], *[(200 + i, "die worte von allem", "de") for i in range(2)]])
    assert language_id.fit(docs, languages=3).languages == ["de", "en", "x0"]
    assert len({tuple(x) for x in language_id.codewords(256).tolist()}) == 256


PAGE = (
    "<html><head><title>t</title><script>x='</p>'</script></head><body><nav><ul><li>menu</ul></nav><div class='cookie-notice'>ok?</div>"
    "<article><h1>Head &amp; {0}</h1><p><b>One {0}<br>two<p>three&nbsp;  four</p><div class=ad>buy</div><form>mail</form><section id=comments><p>first!</section></article>"
    "<aside>side</aside><footer>&copy;</footer></body></html>"
)


def test_html(spark):
    plain = "<body><div class=top>Site name</div><div class=body><p>Story {0} of the day is long enough to be the text of it</p></div><div class=end>All rights</div>"
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(5)] + [(10 + i, f"http://b.example/{i}", plain.format(i)) for i in range(6)]
    rows += [(20, None, None), (21, "nonsense", ""), (22, "http://c.example/", "<p>alone & un<b>closed"), (22, "http://c.example/", "<p>alone & un<b>closed"), (23, "http://c.example/x", "no tags < at all")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert [got[i] for i in range(5)] == [f"Head & {i} One {i} two three four" for i in range(5)]
    assert [got[10 + i] for i in range(6)] == [f"Story {i} of the day is long enough to be the text of it" for i in range(6)]
    assert (got[20], got[21], got[22], got[23]) == ("", "", "alone & unclosed", "no tags < at all")
    assert html_extract.extract(pages).count() == len(rows)
    assert html_extract.extract(pages.where("false")).count() == 0
    t = html_extract.templates(pages).where("host = 'a.example'").first()
    assert t.region == "html/body/article" and "html/body/nav" in t.classes


def test_html_equals_article(spark):
    import html
    import re

    pages = table(spark, DATA, "pages")
    got = {r.page_id: r.text for r in html_extract.op2_html_extract(spark, DATA).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_html_marks_around_the_article():
    story = "<article{}><h1>Head</h1><p>Story text<div class=share>share</div></article>"
    for page in (
        "<body class='has-sidebar'>" + story.format(""),
        "<html class=no-comments><body class='search-page'>" + story.format(""),
        "<main class='no-comments'><h1>Head</h1><p>Story text</main>",
        "<body>" + story.format(" class='post share-on'"),
        "<body><div class='page with-sidebar'><div id=search>" + story.format("") + "</div></div>",
        "<body><form><div class=widget><main><div class=related>" + story.format("") + "</div></main></div></form>",
        "<body>" + story.format("") + "<div class=related><article>Other story</article></div><section id=comments><article>first!</article></section>",
    ):
        assert html_extract.main_text(page, None, {}) == "Head Story text"
    assert html_extract.main_text("<body><nav><article>menu</article></nav><div class=ad>buy</div>", None, {}) == ""


def test_html_templates_take_no_row_per_page(spark, monkeypatch):
    page = "<body><article id=post-{0} class='post-{0} post'><h1>Head {0}</h1></article><div id=entry-{0}>low {0}</div><div id=a-slug-of-story-{1}>x{0}</div>"
    rows = [(i, f"http://{'a' if i % 2 else i}.example/", page.format(i, "abcdefghij"[i % 10] * (i + 1))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    deduce = html_extract._deduce

    def counted(host, found):
        out = deduce(host, found)
        return out.assign(classes=str(len(found)))

    monkeypatch.setattr(html_extract, "_deduce", counted)
    got = {r.host: (r.region, int(r.classes)) for r in html_extract.templates(pages).collect()}
    assert set(got) == {"a.example", "*"}
    assert all(region == "body/article.post.post-0" and n < 12 for region, n in got.values())
    assert {x for x in html_extract.page_tokens(rows[1][2])[1]} == {x for x in html_extract.page_tokens(rows[2][2])[1]}


def test_html_template_texts_in_articles(spark):
    rng = random.Random(3)
    story = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60))
    long = "This notice of the publisher stands below every story of the site and has well over a hundred and twenty characters in its one sentence."
    news = "<body><div class=news></div><article><h1>Daily brief</h1><p>Filed by the desk<p>{}<p>" + long + "</article>"
    wiki = "<body><table class=wiki><tr><td>x</table><article><h1>{}</h1><p>From the free library<p>{}</article>"
    stories = [story() for _ in range(24)]
    rows = [(i, f"http://a.example/{i}", news.format(s) if i % 4 else wiki.format(f"Title {i}", s)) for i, s in enumerate(stories)]
    copy = news.format(stories[0])
    rows += [(100 + i, f"http://copies.example/{i}", copy) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert [got[i] for i in range(24)] == [f"Daily brief {s}" if i % 4 else f"Title {i} {s}" for i, s in enumerate(stories)]
    assert all(got[100 + i] == f"Daily brief Filed by the desk {stories[0]} {long}" for i in range(6))


def test_html_marks_that_name_something_else(spark):
    page = "<article><h1>Head</h1><p>Story<table class='share-price'><tr><td>7 up</table><p class='notice-board'>board<div class='share-buttons'>share</div><section class='reactions'><p>first!</section><ul id='related-posts-3'><li>other</ul></article>"
    assert html_extract.main_text(page, None, {}) == "Head Story 7 up board"


def test_html_without_article_or_known_names(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    story = lambda: " ".join(word() for _ in range(80))
    long = "Every reader of these pages agrees to what the house has written down elsewhere, and that is said here again at such length that no limit on the size of a notice would let it pass as one. " * 2
    page = "<body><div class=x1><span>Front</span><span>Back</span></div><div class=q7><h1>{}</h1><p>{}<p>{}</div><div class=z9><p>" + long + "<div class=z8><b>Call us</b></div></div>"
    rows, want = [], {}
    for i in range(12):
        head, a, b = word(), story(), story()
        rows.append((i, f"http://a.example/{i}", page.format(head, a, b)))
        want[i] = f"{head} {a} {b}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == want
    # Without the classes the notice is text like any other.
    assert "Every reader" in html_extract.main_text(rows[0][2], None, {}) and html_extract.main_text(rows[0][2], "body/div.q7", {}) == want[0]


def test_html_long_page_and_ties(spark):
    body = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "http://a.example/", f"<body><p>{body}</p>"), (2, None, "<body><div class=a><p>same</div><div class=b><p>same</div>"), (2, None, "<body><div class=a><p>same</div><div class=b><p>same</div>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, len(r.text)) for r in got) == [(1, len(body)), (2, len(got[1].text)), (2, len(got[1].text))]


def test_longest_rise():
    assert html_extract._longest_rise([0, 1, 5, 2, 3]) == {0, 1, 2, 3} and html_extract._longest_rise([]) == set()


def test_spans_of_a_table_equal_the_library(docs_of, edge_rows):
    rows = [*edge_rows, *[(100 + i, t) for i, t in enumerate(odd_texts()[:80])]]
    library = sentencepiece_codec._codec(sentencepiece_codec.MODEL).whole
    want = {}
    for i, t in rows:
        pieces = library.encode(t, return_type="proto").pieces if t else []
        want.setdefault(str(i), []).append(([p.id for p in pieces], [p.end for p in pieces]))
    got = {}
    for r in sentencepiece_codec.encode_pieces(docs_of(rows)).collect():
        got.setdefault(str(r.doc_id), []).append((r.ids, r.ends))
    assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in want.items()}


def test_memo_keeps_what_is_frequent_within_its_room():
    made = []

    def make(word):
        made.append(word)
        return 0j

    memo = token_counts.Memo(make, 40_000)
    for i in range(5_000):
        assert memo[f"rare{i}"] == memo["often"] == 0j
    assert made.count("often") == 1 and len(made) == 5_001
    assert sum(len(m) for m in (memo, memo.older)) < 40_000 / token_counts._ENTRY_BYTES


def test_hundreds_of_languages_are_all_learned(spark, docs_of):
    said = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("mo", "ra", "ti", "lu")) * 6
    docs = docs_of([(k, said(k), f"x{k}") for k in range(300)])
    model = language_id.fit(docs)
    assert len(model.languages) == 300 and model.weights.shape == (9 * language_id.CODE_BITS, language_id.BUCKETS)
    assert sum(model.predict(said(k))[0] == f"x{k}" for k in range(300)) >= 295
    assert len({tuple(x) for x in model.code.tolist()}) == 300


def test_html_articles_keep_what_they_share(spark):
    rng = random.Random(8)
    story = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60))
    some, many = "A paragraph that three articles quote from the same speech.", "A sentence that most articles of the house say somewhere."
    page = "<body><div class=top><span>Front</span></div><article><h1>Title {}</h1><p>{}<h2>Background</h2><p>{}{}<h3>What happened next</h3><p>{}</article><div class=end>All rights</div></body>"
    rows, want = [], {}
    for i in range(20):
        a, b, c = story(), story(), story()
        extra = [x for x, k in ((some, 3), (many, 12)) if i < k]
        rows.append((i, f"http://a.example/{i}", page.format(i, a, b, "".join(f"<p>{x}" for x in extra), c)))
        want[i] = " ".join([f"Title {i}", a, "Background", b, *extra, "What happened next", c])
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_equals_article_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wrong = [r.page_id for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect() if html_extract.main_text(r.html, None, {}) != r.text]
    assert wrong == []
