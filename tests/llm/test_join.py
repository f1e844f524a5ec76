import itertools
import random
from collections import Counter, defaultdict

import cases
import pytest

from reminisce.llm import ngramjoin as J
from reminisce.llm.common import components, words


def brute(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s or ():
            by[x].append(i)
    shared = Counter(p for ids in by.values() for p in itertools.combinations(ids, 2))
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        return x if root[x] == x else find(root[x])

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (find(i), links[i]) for i in sets}


def near_copies(n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("docs", [near_copies(120, 6, 1), near_copies(700, 4, 2), [(i + 1000 * g, t) for g in range(12) for i, t in near_copies(12, 5, g)]], ids=["one group", "several blocks", "groups"])
def test_brute_force(spark, docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    out = J.join(df).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == want
    assert {r.doc_id for r in J.one_of_each(df).collect()} == {i for i, (c, _) in want.items() if c == i}


def test_posterior_never_drops_a_sure_pair():
    limits = J.fewest()
    assert [m for m, _ in limits] == list(range(32, 161, 32)) and all(k < 0.8 * m for m, k in limits) and limits[-1][1] > 0.5 * 160


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)] + [(500, i) for i in range(501, 560)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = dict(cases.rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_edges(spark):
    df = cases.clashing(spark, "class", "copies", "keep", "leader", "_n")
    out = J.join(df)
    assert out.count() == df.count()
    assert cases.rows(out.filter("n_links > 0"), "doc_id", "class_id", "n_links") == [(6, 6, 1), (6, 6, 1)]
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert J.join(df.limit(0)).count() == 0 and J.one_of_each(df.limit(0)).count() == 0


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (3, text), (None, "q " + text), (None, "other")], "doc_id long, text string")
    assert cases.rows(J.one_of_each(df), "doc_id", "text") == [(3, text), (None, "other")]


def test_symbols_only(spark):
    df = spark.createDataFrame([(1, "*** !!! ***"), (2, " *** !!! ***\n"), (3, "*** !!!"), (4, "*** !!! ***"), (5, " "), (6, ""), (7, None), (8, " ")], "doc_id long, text string")
    assert cases.rows(J.join(df), "doc_id", "class_id", "n_links", "n_texts") == [(1, 1, 2, 0), (2, 1, 2, 0), (3, 3, 0, 0), (4, 1, 2, 0), (5, 5, 0, 0), (6, 6, 0, 0), (7, 7, 0, 0), (8, 8, 0, 0)]
    assert {r.doc_id for r in J.one_of_each(df).collect()} == {1, 3, 5, 6, 7, 8}
