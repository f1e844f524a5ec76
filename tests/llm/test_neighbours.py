import cases
import numpy as np

from reminisce.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, q in good:
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), found(N.search(df))
    assert want.keys() == got.keys()
    hits = sum(len({a for a, _ in want[q]} & {b for _, b, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all([r for r, _, _ in got[q]] == list(range(1, 11)) for q in got)


def test_exact_with_all_lists(spark):
    """With every list probed the result is the brute force one at any depth, ties and copies included, however few queries a task holds."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32).round(1)
    x[100:400] = x[100]
    rows = [(i, x[i].tolist()) for i in range(600)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    want = brute(rows, 50)
    for given in ({"depth": 600}, {"depth": 1, "query_rows": 3}):
        got = found(N.search(df, every=50, block_rows=100, probes=10_000, **given))
        assert {q: [(b, s) for _, b, s in v] for q, v in got.items()} == want


def test_jittered_copies(spark):
    """Many groups of hundreds of near copies: few codes are left for each, so estimates alone can't rank them."""
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(80, 32)), 400, axis=0) + rng.normal(size=(32_000, 32)) * 1e-4).astype(np.float32)
    x = x[rng.permutation(len(x))]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = found(N.search(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))), brute(rows)
    hits = sum(len({a for a, _ in want[q]} & {b for _, b, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95


def test_small_lists_far_away(spark):
    """A query in a list of a few vectors reads on until it has ten, or all there are; so does one of a rare dimension."""
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.normal(size=(40, 8)), 150, axis=0) + rng.normal(size=(6000, 8)) * 0.01).tolist()
    rows = list(enumerate(x, 1)) + [(100_000 + i, [1000.0 + i] + [0.0] * 7) for i in range(4)] + [(200_000 + i, [float(i + 1)] * 3) for i in range(5)] + [(200_003, [9.0, 9.0])]
    got = found(N.search(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), probes=1))
    want = brute([r for r in rows if len(r[1]) == 8])
    assert [b for _, b, _ in got[100_000]][:3] == [a for a, _ in want[100_000]][:3] == [100_001, 100_002, 100_003]
    assert all([r for r, _, _ in got[q]] == list(range(1, 11)) for q in want)
    assert [(r, b) for r, b, _ in got[200_000]] == [(1, 200_001), (2, 200_002), (3, 200_003), (4, 200_004)]


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (400, [1.0, None]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in N.search(df).orderBy("rank").collect()] == [(0, 1, 7), (0, 2, 10)]


def test_few_and_none(spark):
    assert N.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.search(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 2.0], 5, 5), (1, [1.0, 3.0], 5, 5)], "vec_id long, embedding array<float>, list int, rank int")
    assert cases.rows(N.search(df), "query_id", "vec_id", "score") == [(0, 1, 1.0)]
