import random

import cases
import pytest

from reminisce.llm import linededup as L


def brute(docs, least):
    """Every shortest run of `least` words, from each line on and up to each line, against its first occurrence."""
    seqs = [[(i, " ".join(x.split()).lower(), len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    runs = []
    for d, lines in enumerate(seqs):
        for a in range(len(lines)):
            for step in (1, -1):
                words, b = 0, a
                while 0 <= b < len(lines):
                    words += lines[b][2]
                    if words >= least:
                        lo, hi = min(a, b), max(a, b)
                        runs.append((tuple(x[1] for x in lines[lo : hi + 1]), d, lo, hi))
                        break
                    b += step
    first, gone = {}, {}
    for k, d, a, b in sorted(runs, key=lambda r: r[1:3]):
        first.setdefault(k, (d, a, b))
    for k, d, a, b in runs:
        f = first[k]
        if f[0] < d or f[0] == d and a > f[2]:
            gone.setdefault(d, set()).update(range(seqs[d][a][0], seqs[d][b][0] + 1))
    return {docs[d][0]: "\n".join(x for i, x in enumerate(docs[d][1].split("\n")) if i not in gone.get(d, ())) for d in range(len(docs))}


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a", "b", "c", "dd", "e f", "g h i", "", "A  a"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()}
    assert got == brute(docs, 8)


def test_passage_in_many_documents(spark):
    passage = "\n".join(f"w{i} w{i} w{i} w{i} w{i} w{i}" for i in range(10))
    docs = [(i, f"own words {i}\n{passage}\nend {i}") for i in range(300)]
    out = {r.doc_id: r for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].removed_lines == 0 and all(out[i].text == f"own words {i}\nend {i}" and out[i].removed_lines == 10 for i in range(1, 300))


def test_short_repeats_stay(spark):
    docs = [(i, f"own {i}\nLicensed under the same few words.\nmore {i}") for i in range(20)]
    assert all(r.removed_lines == 0 for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_within_a_text(spark):
    line = " ".join(["word"] * 50)
    assert cases.rows(L.dedup(spark.createDataFrame([(1, f"{line}\n\n{line}\nx\n{line}")], "doc_id long, text string")), "text", "removed_lines") == [(f"{line}\n\nx", 2)]


def test_edges(spark):
    df = cases.clashing(spark, "removed_lines", "spans", "print", "_spans2")
    out = L.dedup(df)
    assert out.columns == [c for c in df.columns if c != "removed_lines"] + ["removed_lines"]
    assert cases.rows(out, "doc_id", "text", "source") == cases.rows(df, "doc_id", "text", "source")
    assert L.dedup(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(80))
    out = L.dedup(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"))
    assert cases.rows(out, "doc_id", "text") == [(1, text), (1, text), (2, "")]


def brute_words(docs, least):
    """Every run of `least` words against its first occurrence: the words that stay, by document."""
    seqs = [t.lower().split() for _, t in docs]
    first, gone = {}, [set() for _ in docs]
    for d, w in enumerate(seqs):
        for a in range(len(w) - least + 1):
            f = first.setdefault(tuple(w[a : a + least]), (d, a))
            if f[0] < d or a >= f[1] + least:
                gone[d].update(range(a, a + least))
    return {docs[d][0]: [x for i, x in enumerate(w) if i not in gone[d]] for d, w in enumerate(seqs)}


@pytest.mark.parametrize("seed", [1, 2])
def test_words_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a", "b", "c", "dd", "e f", "g h i", "", "A  a"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    docs += [(100 + i, " ".join(rng.choice(["x y z", "u", "v w", "p q r s"]) for _ in range(40))) for i in range(40)] + [(200, "o " * 60), (201, "n o " * 40)]
    got = {r.doc_id: r.text.lower().split() for r in L.passages(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()}
    assert got == brute_words(docs, 8)


def test_passage_inside_lines(spark):
    """The query finds a passage that begins and ends inside lines, over one line or several."""
    from reminisce.llm import queries as Q

    words = [f"w{i}" for i in range(60)]
    docs = [(1, "one " + " ".join(words) + " first"), (2, "Two " + " ".join(words) + "  second"), (3, "  three " + " ".join(words[:30]) + "\n\n" + " ".join(words[30:]) + " third\nend")]
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("inside_lines")
    table, Q._table = Q._table, lambda spark, *_: spark.table("inside_lines")
    try:
        got = cases.rows(Q.op1_line_dedup(spark, ""), "doc_id", "text", "removed_lines")
    finally:
        Q._table = table
    assert got == [(1, docs[0][1], 0), (2, "Two  second", 0), (3, "  three\nthird\nend", 1)]


def test_words_edges(spark):
    df = cases.clashing(spark, "removed_lines", "spans", "print", "_spans2")
    out = L.passages(df)
    assert out.columns == [c for c in df.columns if c != "removed_lines"] + ["removed_lines"]
    assert cases.rows(out, "doc_id", "source") == cases.rows(df, "doc_id", "source") and L.passages(df.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    assert cases.rows(L.passages(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")), "doc_id", "text") == [(1, text), (1, text), (2, "")]
