"""Every helper name in the operators' source as a column of the user's: nothing crashes, no value is lost."""

import glob
import os
import re

import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from reminisce.llm import licenses, linededup, media, mixing, neighbours, ngramjoin, pieces, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"
GIVEN = {"doc_id", "text", "lang", "source", "n_chars", "vec_id", "embedding"}
FOLDER = os.path.dirname(quality.__file__)
NAMES = sorted({x.lower(): x for p in glob.glob(f"{FOLDER}/*.py") for x in re.findall(r"[\"']([A-Za-z_][A-Za-z0-9_]{0,24})[\"']", open(p).read()) if x.lower() not in GIVEN}.values())


def crowded(df):
    """df with a column for each name, of a value that tells it."""
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def kept(out, new=()):
    """Whether the user's columns have the values they had, all but those that the operator replaces."""
    names = [n for n in NAMES if n.lower() not in new]
    assert {n.lower() for n in names} <= {c.lower() for c in out.columns}
    wrong = [out.filter(~F.col(n).eqNullSafe(F.lit(i))) for i, n in enumerate(NAMES) if n in names]
    assert wrong[0].count() == 0 and out.filter(F.greatest(*(F.when(F.col(n).eqNullSafe(F.lit(NAMES.index(n))), 0).otherwise(1) for n in names)) == 1).count() == 0


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_names_were_found():
    assert {"held", "own", "spans", "gone", "copies", "block", "text_hash", "class"} <= set(NAMES) and len(NAMES) > 100


OPERATORS = {
    "lines": (lambda d, _: linededup.dedup(d), {"removed_lines"}),
    "passages": (lambda d, _: linededup.passages(d), {"removed_lines"}),
    "pieces": (lambda d, _: pieces.encode(d, pieces.Pieces.load()), {"ids", "n_tokens", "round_trip"}),
    "mix": (lambda d, _: mixing.mix(d), {"n_tokens", "weight", "copies"}),
    "mixture": (lambda d, _: mixing.mixture(d, max_repetition=3.0), set()),
    "one of each": (lambda d, _: ngramjoin.one_of_each(d), set()),
    "quality": (lambda d, s: quality.score(d, quality.fit(d, labels(s))), {"held_out", "score", "predicted"}),
    "accept": (lambda d, s: quality.accept(d, quality.fit(d, labels(s)), 0.0), set()),
    "toxicity": (lambda d, s: toxicity.grade(d, toxicity.fit(d, labels(s))), {"severity", "p_toxic", "grade", "toxic"}),
    "media": (lambda d, _: media.store_texts(d), {"n_bytes", "payload_bytes", "media"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_columns(spark, name):
    run, new = OPERATORS[name]
    kept(run(crowded(cases.edges(spark)), spark), new)


@pytest.mark.parametrize("run", [licenses.scan, ngramjoin.join, lambda d: secrets.scan(d, secrets.train(d)), media.media], ids=["licenses", "join", "secrets", "media"])
def test_operators_with_columns_of_their_own(spark, run):
    plain = run(cases.edges(spark))
    assert cases.rows(run(crowded(cases.edges(spark))), *plain.columns) == cases.rows(plain, *plain.columns)


def test_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    columns = ("query_id", "rank", "vec_id", "score")
    assert cases.rows(neighbours.search(crowded(df), every=10), *columns) == cases.rows(neighbours.search(df, every=10), *columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and an empty table, in every stage."""
    df = cases.edges(spark)
    out = stage(spark, crowded(df), SF)
    kept(out, {"ids", "n_tokens", "round_trip"} if name == "tokens" else ())
    assert stage(spark, df.limit(0), SF).count() == 0
    same = stage(spark, df, SF)
    if name != "tokens":
        assert same.columns == df.columns and same.schema.simpleString() == df.schema.simpleString()
    assert cases.rows(out, "doc_id", "source") == cases.rows(same, "doc_id", "source")
    ids = {r.doc_id for r in same.collect()}
    assert ids <= {r.doc_id for r in df.collect()}
    if name in ("line dedup", "tokens"):
        assert same.count() == df.count()
    if name == "near duplicates":
        assert sorted(r.doc_id or 0 for r in same.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
