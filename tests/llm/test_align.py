"""Alignment of two tokenizers against a plain version that compares bytes of whole texts."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pytest

from larder.llm import align_tokenizers as al
from larder.llm.common import table
from larder.llm.sentencepiece_codec import MODEL, model_file
from tests.conftest import DATA


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(model_file(al.BYTE_MODEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_file(MODEL))


def tokens(libraries, text):
    """Ids and bytes of whole-text tokens by either library; nothing where bytes differ."""
    a, b = libraries
    letters = al.byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    said_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if not text or b"".join(said_a) != whole or b"".join(said_b) != whole:
        return [], []
    return list(zip(ids_a, said_a, strict=True)), list(zip(ids_b, said_b, strict=True))


def brute(libraries, texts):
    """Rows of all texts, byte by byte."""
    docs = []
    for text in texts:
        a, b = tokens(libraries, text or "")
        owner = []
        for told in (a, b):
            owner.append([k for k, (_, said) in enumerate(told) for _ in said])
        links = sorted(set(zip(*owner, strict=True)))
        ends = []
        for told in (a, b):
            at, own = 0, []
            for _, said in told:
                at += len(said)
                own.append(at)
            ends.append(own)
        of_group = {}
        shared = sorted(set(ends[0]) & set(ends[1]))
        for side, (told, own) in enumerate(zip((a, b), ends, strict=True)):
            for (i, _), end in zip(told, own, strict=True):
                of_group.setdefault(bisect_left(shared, end), ([], []))[side].append(str(i))
        groups = ["|".join(map(",".join, of_group[k])) for k in range(len(shared))]
        docs.append((len(a), len(b), groups, [(a[i][0], b[j][0]) for i, j in links]))
    counts = Counter(p for *_, pairs in docs for p in pairs)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (n_a, n_b, len(groups), len(pairs), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, pairs in docs
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(libraries, docs, rows):
    got = al.align(docs)
    assert got.columns == COLUMNS
    want = [(i, *told) for (i, _), told in zip(rows, brute(libraries, [t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "the", "Él", "ung", " ", " ", " ", "  ", "\n", "\n\n", "\t", "梦", "\U0001f600", "́", "​", "\xa0", "'s", "'", "...", "12", "<|endoftext|>", "<s>", "<0x41>", "▁", "\r\n", "\x00", "\x1c", "\x85", " ", "ß"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(n)]


def test_alignment_equals_brute_force(libraries, spark, docs_of, edge_rows):
    rows = [*edge_rows[:4], (5, "word x " * 3000), *edge_rows[6:], *[(100 + i, t) for i, t in enumerate(odd_texts(400))]]
    want = same(libraries, docs_of(rows).repartition(3), rows)
    assert sum(r[-1] == "" for r in want) > 20 and sum(r[1] > 0 for r in want) > 150


def test_given_table(libraries, spark):
    docs = table(spark, DATA, "documents")
    same(libraries, docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_several_blocks(libraries, spark, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_BYTES", 20_000)
    docs = table(spark, DATA, "documents").where("doc_id < 60")
    blocks = al.aligned_blocks(docs)
    assert blocks.select("block").distinct().count() >= 1
    same(libraries, docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_chunks_align_as_whole_texts():
    aligner = al._aligner(al.BYTE_MODEL, MODEL)
    assert aligner.by_chunk
    for text in odd_texts(3000, 9):
        assert "".join(aligner.chunks(text)) == " " + text
        (groups, pairs, sizes), whole = aligner.texts([text])[0], aligner.one(" " + text)
        assert (";".join(groups), pairs.tobytes()) == (whole or ("", b""))[:2]
        assert sizes == ([whole[2] >> k & (1 << 40) - 1 for k in (0, 40, 80)] if whole else [0, 0, 0])


def test_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700):
        at, times = np.sort(rng.choice(1 << 20, n, replace=False)), rng.integers(1, 400, n)
        assert all((x == y).all() for x, y in zip(al.unpacked(al.packed(at, times)), (at, times), strict=True))


def test_empty_table(docs_of):
    assert al.align(docs_of([])).collect() == []


def test_no_cycles_are_searched_while_texts_are_told(monkeypatch):
    import gc

    aligner = al._aligner(al.BYTE_MODEL, MODEL)
    seen = []
    plain = aligner.tokens
    monkeypatch.setattr(aligner, "tokens", lambda text: seen.append(gc.isenabled()) or plain(text))
    assert gc.isenabled()
    aligner.texts(["uncollected words zqxa zqxb"])
    assert seen and not any(seen) and gc.isenabled()


def test_memo_counts_a_chunk_once():
    aligner = al._aligner(al.BYTE_MODEL, MODEL)
    aligner.texts(["counted once zqxc zqxd"])
    left = aligner.left
    aligner.texts(["counted once zqxc zqxd"])
    assert aligner.left == left


def letters(n):
    return "".join(chr(97 + n // 26**k % 26) for k in range(4))


def test_memo_has_room_for_three_hundred_chunks_in_ninety_kilobytes(monkeypatch):
    monkeypatch.setattr(al, "MEMO_BYTES", 180_000)
    aligner = al.Aligner(model_file(al.BYTE_MODEL), model_file(MODEL))
    batches = [" ".join(letters(7919 * (300 * b + i)) for i in range(300)) for b in range(3)]
    first = aligner.texts(batches[:1])
    for text in batches[1:]:
        aligner.texts([text])
    said = []
    plain = aligner.tokens
    monkeypatch.setattr(aligner, "tokens", lambda text: said.append(text) or plain(text))
    again = aligner.texts(batches[:1])
    assert said == [] and again[0][0] == first[0][0] and (again[0][1] == first[0][1]).all() and again[0][2] == first[0][2]


def test_one_chunk_without_tokens_leaves_the_others_together(monkeypatch):
    aligner = al.Aligner(model_file(al.BYTE_MODEL), model_file(MODEL))
    words = [letters(7919 * i) for i in range(1000)]
    good, bad = " ".join(words), " ".join(["bad#chunk", *words[:5]])
    want = aligner.one(" " + good)
    said = []
    plain = aligner.tokens
    monkeypatch.setattr(aligner, "tokens", lambda text: said.append(text) or (None if "bad#chunk" in text else plain(text)))
    (groups, pairs, sizes), none = aligner.texts([good, bad])
    assert (";".join(groups), pairs.tobytes()) == want[:2] and sizes == [want[2] >> k & (1 << 40) - 1 for k in (0, 40, 80)]
    assert none[0] == [] and none[2] == [0, 0, 0] and not len(none[1])
    assert len(said) < 40


def test_memo_forgets_long_chunks_and_takes_back_what_it_had():
    aligner = al.Aligner(model_file(al.BYTE_MODEL), model_file(MODEL))
    texts = ["short words here", "x" * 500 + " and short words", "é" * 200 + "\nhere"]
    whole = [aligner.one(" " + t) for t in texts]
    for _ in range(2):
        assert [(";".join(g), p.tobytes()) for g, p, _ in aligner.texts(texts)] == [w[:2] for w in whole]
        assert max(map(len, aligner.young.number)) <= al.LONGEST_WORD
    aligner.older, aligner.young = aligner.young, al.Chunks()
    assert [(";".join(g), p.tobytes()) for g, p, _ in aligner.texts(texts[::-1])] == [w[:2] for w in whole[::-1]]


def test_texts_told_in_parts_are_the_same(monkeypatch):
    aligner = al._aligner(al.BYTE_MODEL, MODEL)
    texts = [*odd_texts(60, 5), "", " ".join(letters(7919 * i) for i in range(400))]

    def told():
        return [(";".join(g), p.tobytes(), sizes) for g, p, sizes in aligner.texts(texts)]

    want = told()
    monkeypatch.setattr(al, "_GATHERED", 7)
    monkeypatch.setattr(al, "_LENGTH", 50)
    assert told() == want
