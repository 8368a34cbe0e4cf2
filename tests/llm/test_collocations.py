"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

from larder.llm import collocations as co
from larder.llm.common import table
from tests.conftest import DATA


def brute(rows, least=30, top=2000):
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``rows (text, lang)``."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in held.items():
        cuts = [(co.SCALE * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        out[lang, *w] = (*min(cuts), a)
    for (lang, *w), a in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = (lang, *w[i : i + k])
                if 100 * a >= 80 * held[inner]:
                    out.pop(inner, None)
    rows = []
    for lang in {p[0] for p in out}:
        own = sorted((-score, -a, " ".join(p[1:]).encode(), left, right) for p, (score, _, left, right, a) in out.items() if p[0] == lang)
        rows += [(lang, i, phrase.decode(), -a, left, right, n[lang], -score) for i, (score, a, phrase, left, right) in enumerate(own[:top], 1)]
    return sorted(rows)


def same(docs, rows, **how):
    got = co.collocations(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, how.get("min_count", 30), how.get("top", 2000))
    assert sorted(map(tuple, got.collect())) == want
    return want


def invented(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "Été", "été", "\xa0x", "a\x1cb", "梦", "to", "be", "or", "not"]
    weights = [9, 2, 6, 5, 5, 4, 3, 2, 2, 1, 1, 1, 4, 4, 3, 3]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", "\r\n", " - "]
    return [("".join(w + rng.choice(ends) for w in rng.choices(words, weights, k=rng.randrange(0, 80))), rng.choice(["en", "fr", None, ""])) for _ in range(n)]


def test_collocations_equal_brute_force(spark, docs_of, edge_rows):
    rows = [*[(t, "en") for _, t in edge_rows], *invented(300), *[("a rose is a rose is a rose. A rose", "de")] * 40]
    docs = docs_of([(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(3)
    want = same(docs, rows)
    assert {r[0] for r in want} == {"", "de", "en", "fr", "und"} and any(r[2].count(" ") == 3 for r in want)


def test_blocks_tiles_and_parts(spark, docs_of, monkeypatch):
    """Many blocks, bands and sparse tiles give the same."""
    rows = invented(60, 7)
    docs = docs_of([(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(2)
    for name, value in (("BLOCK_BYTES", 1500), ("TILE_MASS", 40), ("DENSE", 4), ("HEAD", 3)):
        monkeypatch.setattr(co, name, value)
    same(docs, rows, min_count=3, top=50)


def test_given_table(spark):
    docs = table(spark, DATA, "documents")
    assert same(docs, [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()])


def test_nothing_to_find(spark, docs_of):
    assert co.collocations(docs_of([])).collect() == []
    assert co.collocations(docs_of([(1, None), (2, "one two three")])).collect() == []
