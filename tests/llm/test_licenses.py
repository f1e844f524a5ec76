import random

import cases

from reminisce.llm import licenses as L
from reminisce.llm.common import words


def test_planted(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    docs, want = [], []
    for i, (name, text) in enumerate(L.TEMPLATES * 3):
        before = filler(rng.randint(0, 400))
        docs.append((i, f"{before} {text} {filler(100)}"))
        want.append((i, name, len(words(before))))
    found = {(r.doc_id, r.license): r for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, name, start in want:
        assert found[i, name].start_word == start and found[i, name].containment == 1.0


def brute(text, least=0.8):
    """Templates whose shingles a stretch of the template's length holds to that share."""
    w, out = words(text), set()
    for name, template in L.TEMPLATES:
        t = words(template)
        k = min(5, len(t))
        own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        for a in range(max(1, len(w) - len(t) + 1)):
            part = w[a : a + len(t)]
            if len(own & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) >= least * len(own):
                out.add(name)
                break
    return out


def test_edited_texts(spark):
    rng = random.Random(2)
    docs = []
    for i in range(60):
        name, text = L.TEMPLATES[rng.randrange(len(L.TEMPLATES))]
        w = text.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i, "some words before " + " ".join(w) + " and after"))
    got = {}
    for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    missed = [(i, brute(t) - got.get(i, set())) for i, t in docs if brute(t) - got.get(i, set())]
    assert not missed


def test_edges(spark):
    df = cases.clashing(spark, "license", "containment")
    assert L.scan(df).count() == 0 and L.scan(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "All rights reserved. x y z all rights reserved"), (1, "All rights reserved. x y z all rights reserved"), (None, "ALL RIGHTS, RESERVED")], "doc_id long, text string")
    assert cases.rows(L.scan(twice), "doc_id", "start_word") == [(1, 0), (1, 0), (1, 6), (1, 6), (None, 0)]
