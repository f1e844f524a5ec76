import zlib

import cases
import numpy as np

from reminisce.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.grade(docs.select("doc_id", "text"), T.fit(docs, labels)).collect()
    held = [r for r in rows if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    caught = [r.toxic for r in held if known[r.doc_id]]
    wrong = [r.toxic for r in held if not known[r.doc_id]]
    assert np.mean(caught) >= 0.6 and np.mean(wrong) <= 0.03
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in rows)


def test_thresholds_are_ordered_and_severity_grows(spark):
    from collections import Counter

    docs = [Counter({"fine": 3, "word": 2}) for _ in range(60)] + [Counter({"vile": n, "word": 1}) for n in (1, 4, 9) for _ in range(10)]
    model = T.learn(np.array([0.0] * 60 + [1.0] * 30), docs)
    assert (np.diff(model.thresholds) > 0).all()
    score = lambda t: model.grades(t, {}).sum()
    assert score("fine word") < 0.2 < score("vile word") < score("vile " * 9)


def test_one_class_only(spark):
    model = T.learn(np.zeros(5), [])
    assert (model.grades("x", {}) < 0.05).all() and len(T.learn(np.zeros(0), []).thresholds) == 3


def test_edges(spark):
    df = cases.clashing(spark, "severity", "toxic", "grade", "p_toxic")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    out = T.grade(df, T.fit(df, labels))
    assert out.count() == df.count() and out.filter("severity is null").count() == 0
    empty = T.fit(df.limit(0), labels.limit(0))
    assert T.grade(df.limit(0), empty).count() == 0


def test_scores_against_plain_sums(spark):
    """Each document's probabilities from the model's weights, counted anew; the expected grade is their sum."""
    import math

    from reminisce.llm.common import words

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    got = {(r.doc_id, r.text): r for r in T.grade(docs.select("doc_id", "text"), model).collect()}
    for key in text:
        found = {}
        for w in words(key[1]):
            for f in [w, *(w[:k] + "*" for k in T.STEMS if len(w) > k)]:
                found[f] = found.get(f, 0) + 1
        z = sum(model.weights.get(f, 0.0) * math.log1p(n) for f, n in found.items())
        over = [1 / (1 + math.exp(-max(-500, min(500, z - t)))) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *over], [*over, 0.0], strict=True)]
        r = got[key]
        assert math.isclose(r.severity, sum(over), abs_tol=1e-9) and math.isclose(r.p_toxic, over[0], abs_tol=1e-9)
        assert each[r.grade] >= max(each) - 1e-9 and r.toxic == int(over[0] >= 0.5)
