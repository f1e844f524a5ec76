import zlib

import cases
import numpy as np

from reminisce.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.score(docs.select("doc_id", "text"), Q.fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([p == y for y, p in held]) >= 0.97
    assert np.mean([p for y, p in held if y == 1]) >= 0.99


def test_isotonic():
    x, y, n = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.array([1, 1, 2, 1, 1, 3.0])
    corners, values = Q.isotonic(x, y, n)
    assert (np.diff(values) > 0).all() and (np.diff(corners) > 0).all()
    assert np.isclose((values * np.array([1, 4, 4])).sum(), (y * n).sum())


def test_ridge_equals_direct_solution(spark):
    """The partition-summed equations give the weights that all rows give at once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.fit(docs, labels, features=32)
    y = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in docs.collect() if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5 in (1, 2, 3)]
    z = model.lift(np.array([Q.statistics(r.text) for r in rows]))
    t = np.array([y[r.doc_id] for r in rows], float)
    direct = np.linalg.solve(z.T @ z + 1e-4 * len(z) * np.eye(33), z.T @ t)
    assert np.allclose(direct, model.weights, atol=1e-6)


def test_labels_are_no_inputs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    other = docs.selectExpr("doc_id + 7 as doc_id", "text", "'x' as lang", "'y' as source")
    assert cases.rows(Q.score(docs, model), "text", "score") == cases.rows(Q.score(other, model), "text", "score")


def test_edges(spark):
    df = cases.clashing(spark, "score", "predicted", "held_out", "y", "x")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 1), (6, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.score(df, Q.fit(df, labels))
    assert out.count() == df.count() and out.filter("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    none = Q.fit(df, labels.limit(0))
    assert cases.rows(Q.score(df, none), "score") == [(0.5,)] * df.count()
    assert Q.score(df.limit(0), none).count() == 0
