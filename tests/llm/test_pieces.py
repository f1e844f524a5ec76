import cases
import pytest
from pyspark.sql import functions as F

from reminisce.llm import pieces as P

SF = "/root/testdata/sf0.001"
ODD = ["Hello  world\n\nx ", " lead", "a\tb", "ﬁ é ½ ².", "", "   ", "a\x00b", "a\r\nb", "    def f(x):\n        return x", "日本語のテキスト", "aaaaaaaaaaaaaaa", "x" * 3000, "\n\n\n", " " * 40 + "a", "<s> </s> <0x0A> <unk>", "😀😀 é̀", "can't won't, (a.b) e.g. 3.14%"]


@pytest.fixture(scope="module")
def model():
    return P.Pieces.load()


def test_same_as_the_library(spark, model):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=P.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in P.encode(docs, model).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_round_trip(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert cases.rows(P.decode(P.encode(docs, model), model), "doc_id", "text") == cases.rows(docs, "doc_id", "text")


def test_relational_form(spark, model):
    words = ["▁Hello", "▁world", "▁unbelievable", "▁▁▁x", "▁數", "▁aaaa", "ing"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    encoder = P.Encoder(model)
    assert cases.rows(P.encode_words(df, model), "word", "pieces") == sorted((w, encoder.path(w)) for w in words)


def test_unigram_viterbi(spark):
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁ab": -3.0, "bab": -3.2, "c": -9.0}
    model = P.Pieces({k: i for i, k in enumerate(scores)}, scores, [k.encode() for k in scores], [], 99, False, 3)
    encoder, words = P.Encoder(model), ["▁abab", "▁ab", "abc", "▁babab", "xab"]

    def best(word):
        if not word:
            return 0.0, []
        options = [(s + best(word[len(p) :])[0], [p, *best(word[len(p) :])[1]]) for p, s in [*scores.items(), *([(word[0], -19.0)] if word[0] not in scores else [])] if word.startswith(p)]
        return max(options)

    for w in words:
        assert sum(scores.get(p, -19.0) for p in encoder.path(w)) == best(w)[0]
    got = dict(cases.rows(P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model), "word", "pieces"))
    assert all(sum(scores.get(p, -19.0) for p in got[w]) == best(w)[0] and "".join(got[w]) == w for w in words)


def test_edges(spark, model):
    df = cases.clashing(spark, "ids", "n_tokens", "round_trip", "word")
    out = P.encode(df, model)
    assert out.count() == df.count() and out.filter("not round_trip").count() == 0
    assert out.filter("doc_id in (1, 2)").select(F.sum("n_tokens")).first()[0] == 0
    assert P.encode(df.limit(0), model).count() == 0
    assert P.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), model).orderBy("doc_id").select("text").collect() == [(None,), ("",)]
