import math
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F

from reminisce.llm import mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("options", [{"max_repetition": 1.25}, {"max_repetition": None, "entropy": 0.9}, {"max_repetition": 3.0, "budget_tokens": 5_000, "blocks": 8}, {"max_repetition": 2.0, "budget_tokens": 400_000, "blocks": 4}])
def test_quotas(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    mixed = mixing.mix(docs, **options).collect()
    assert len(mixed) == docs.count()
    mass, weight, used, largest = Counter(), {}, Counter(), Counter()
    for r in mixed:
        mass[r.source] += r.n_tokens
        weight[r.source] = r.weight
        used[r.source] += r.copies * r.n_tokens
        largest[r.source] = max(largest[r.source], r.n_tokens)
    total = sum(mass.values())
    budget = options.get("budget_tokens", total)
    assert abs(sum(weight.values()) - 1) < 1e-6
    for s in mass:
        assert weight[s] * budget - largest[s] - 1 <= used[s] <= weight[s] * budget + 1
    # the copies of a source differ by one at most
    for s in mass:
        c = {r.copies for r in mixed if r.source == s}
        assert max(c) - min(c) <= 1
    if options.get("max_repetition"):
        exponents = [math.log(weight[a] / weight[b]) / math.log(mass[a] / mass[b]) for a in mass for b in mass if mass[a] > 2 * mass[b]]
        assert all(-1e-3 <= x <= 1 + 1e-3 for x in exponents)
    if options.get("entropy") and max(weight.values()) < max(mass.values()) / total - 1e-6:
        h = -sum(w * math.log(w) for w in weight.values()) / math.log(len(weight))
        assert math.isclose(h, 0.9, abs_tol=1e-3)


def test_oracle(spark):
    from oracle import check

    from reminisce.llm import queries

    check(spark, queries.op4_mixing, mixing.SQL, SF)


def test_realise(spark):
    mixed = spark.createDataFrame([(1, "x", 1, 0.5, 0), (2, "y", 1, 0.5, 3)], "doc_id long, text string, n_tokens long, weight double, copies long")
    assert cases.rows(mixing.realise(mixed), "doc_id", "text") == [(2, "y")] * 3


def test_edges(spark):
    df = cases.clashing(spark, "n_tokens", "weight", "copies", "mass", "key", "block")
    out = mixing.mix(df)
    assert out.count() == df.count() and out.filter("copies is null or weight is null").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0
    assert out.filter("source is null").select("weight").distinct().count() == 1
    with pytest.raises(ValueError):
        mixing.mix(df, max_repetition=None)
