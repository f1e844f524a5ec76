import os
from collections import Counter

import corpus_pipeline
import duckdb
import sentencepiece

from reminisce.llm import mixing, pieces, quality
from reminisce.llm.common import words

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def without_repeats(docs, least=50):
    """The words of each text that no earlier window of so many words holds; the earlier text by id, or place without overlap."""
    first, out = {}, {}
    for i in sorted(docs):
        w, gone = docs[i].split(), set()
        low = [x.lower() for x in w]
        for a in range(len(w) - least + 1):
            d, f = first.setdefault(tuple(low[a : a + least]), (i, a))
            if d != i or a >= f + least:
                gone |= set(range(a, a + least))
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def one_of_each(docs):
    """The smallest id of each class of texts connected by a similarity of 0.8 or more of five-word shingles."""
    sets = {}
    for i, t in docs.items():
        w = words(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else {("", t.strip(), "")} if t.strip() else {i}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        made[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns, name
    before, after = made["quality"]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts(after)) == {i for i, t in texts(before).items() if model.score([quality.statistics(t)])[0] >= 0.3}
    before, after = made["line dedup"]
    assert {i: t.split() for i, t in texts(after).items()} == without_repeats(texts(before))
    assert after.filter("n_chars != length(text)").count() == 0
    before, after = made["near duplicates"]
    assert set(texts(after)) == one_of_each(texts(before))
    before, after = made["mixture"]
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{os.path.join(str(tmp_path), 'near-duplicates')}/*.parquet'")
    want = {i: n for i, n in db.execute(f"select doc_id, copies from ({mixing.SQL})").fetchall() if n}
    assert Counter(r.doc_id for r in after.collect()) == want
    before, after = made["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    given = texts(before)
    assert all(r.ids == library.encode(given[r.doc_id]) for r in after.collect() if "▁" not in given[r.doc_id]) and after.filter("not round_trip").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "round_trip"] and out.count() > 50
