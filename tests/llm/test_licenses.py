"""License scans against a brute-force version that holds every block against every template."""

import math
import random
import re

from larder.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, templates, phrases=licenses.PHRASES, containment=licenses.CONTAINMENT):
    w = words(text)
    at, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split(" ")
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    share, labels = 0.0, set(base)
    for label, t in templates:
        if not label or not t:
            continue
        t = words(t)
        for k in range(0, len(t), licenses.LONGEST):
            part = t[k : k + licenses.LONGEST]
            size = licenses.SHORT if len(part) <= licenses.SHORT else licenses.LONGEST
            for b in range(0, len(w), size):
                met = len(set(part) & set(w[b : b + 2 * size]))
                if met >= math.ceil(len(set(part)) * containment):
                    labels.add(label)
                    share = max(share, met / len(set(part)))
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else share)


def ran(docs, templates):
    got = licenses.scan_licenses(docs, templates)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_scans_equal_brute_force(spark, docs_of, edge_rows):
    rng = random.Random(5)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["the"] * 40 + [f"w{i}" for i in range(200)]
    texts = ["Released under the MIT License. mit-license; MIT\nLICENSE", "GENERAL public license general public license", "ÉMIT license", "İmit license"]
    for _, t in licenses.TEMPLATES:
        said = t.split()
        texts.append(t.upper())
        texts.append(" ".join(w for w in said if rng.random() < 0.85))
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(150)) + "\n// " + "\n// ".join(said) + "\n" + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(90))))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(400))) for _ in range(40)]
    rows = [*edge_rows, *[(100 + i, t) for i, t in enumerate(texts)]]
    got = ran(docs_of(rows), licenses.known_templates(spark))
    assert got == sorted(((i, *brute(t, licenses.TEMPLATES)) for i, t in rows), key=repr)
    assert sum(r[5] != r[4] for r in got) > 20


def test_many_long_and_odd_templates(spark, docs_of, monkeypatch):
    monkeypatch.setattr(licenses, "VOCABULARY", 5)
    long = " ".join(f"clause{i}" for i in range(150))
    templates = [("long", long), ("long", long), ("a", "one two two three"), ("b", "four five six seven eight nine"), ("", "left out"), (None, "left out"), ("none", None), ("blank", " -- ")]
    rows = [(1, long), (2, "five four eight seven six"), (3, "six one three two"), (4, " ".join(f"clause{i}" for i in range(64, 128))), (5, "left out")]
    frame = spark.createDataFrame(templates, "label string, text string")
    got = ran(docs_of(rows), frame)
    assert got == sorted(((i, *brute(t, templates)) for i, t in rows), key=repr)
    assert [r[6] for r in got] == ["long", "b", "a", "long", ""]


def test_empty_tables(spark, docs_of):
    assert ran(docs_of([]), licenses.known_templates(spark)) == []
    none = spark.createDataFrame([], "label string, text string")
    assert ran(docs_of([(1, "an MIT license"), (None, None)]), none) == [(1, 3, 1, 1, 1, "mit", "mit", 1.0), (None, 0, 0, None, None, "", "", 0.0)]
