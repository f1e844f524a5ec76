"""Text expressions and driver-side parsers against plain Python."""

import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reminisce.functions import text as X
from reminisce.operators import listing, maintain, search
from reminisce.plans import search as terms
from reminisce.sources import transcripts


def estimate(text):
    ranges = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF), (0x3000, 0x303F), (0x3040, 0x30FF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF)]
    cost = lambda c: 1.5 if any(a <= c <= b for a, b in ranges) else 2 if c > 0xFFFF else 0.25
    return math.ceil(sum(cost(ord(c)) for c in text))


TEXTS = ["", "a", "abcde", "数据分析", "カタカナ 混ぜ", "😀😀", "한글 text", "𠀀x", "　", "ｆｕｌｌ", "a\nb\tc", None]


def test_token_estimate(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("t", X.estimate_tokens(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [estimate(r.t or "") for r in rows]


def test_one_line_and_hash(spark):
    r = spark.createDataFrame([("a\n b  c" + "x" * 300,)], "t string").select(X.one_line(F.col("t"), 20).alias("p"), X.identity_hash(F.lit("user"), F.col("t")).alias("h")).first()
    assert r.p == "a b c" + "x" * 14 + "…" and len(r.h) == 64


def test_snippets(spark):
    long = "x" * 50 + " needle " + "y" * 80
    r = spark.createDataFrame([(long,), ("no hit " * 20,), ("short",)], "t string").select(X.fallback_snippet(F.col("t"), ["needle"]).alias("s")).collect()
    assert r[0].s == "..." + long[27:97].strip() + "..."
    assert r[1].s.endswith("...") and len(r[1].s) <= 80 and r[2].s == "short"


def test_escape_ids_times(spark):
    r = spark.range(1).select(X.xml_escape(F.lit("<a & 'b'>")).alias("e"), X.file_ids(F.lit("file_0123456789abcdef x file_0123456789abcdef FILE_fedcba9876543210")).alias("f"), X.parse_utc(F.lit("2024-01-02 03:04:05")).alias("a"), X.parse_utc(F.lit("2024-01-02T03:04:05.000Z")).alias("b"), X.parse_utc(F.lit("never")).alias("c"), X.occurrences(F.lit("aaaa"), F.lit("aa")).alias("o")).first()
    assert r.e == "&lt;a &amp; &apos;b&apos;&gt;" and r.f == ["file_0123456789abcdef", "file_fedcba9876543210"] and r.a == r.b and r.c is None and r.o == 2


def test_json_first(spark):
    rows = spark.createDataFrame([('{"raw":{"id":"x"}}',), ("{broken",), ('{"id":"y","raw":{"id":"x"}}',)], "t string").select(X.json_first(F.col("t"), "$.id", "$.raw.id").alias("v")).collect()
    assert [r.v for r in rows] == ["x", None, "y"]


def test_search_parsing():
    assert terms.phrases('sub-agent "two words" x') == ["sub-agent", "two words", "x"]
    assert terms.like_terms('"Two Words", (foo) foo') == ["two words", "foo"]
    assert terms.cjk_groups("数据分析 Foo", 2) == ([["数据", "据分", "分析"]], ["foo"])
    assert terms.safe_pattern("a+b") and not any(map(terms.safe_pattern, ["(a+)+", "(a|b)*", "((a|b)c)*", "(a{2})*", "(", ")", "[a", "x" * 501]))
    assert all(map(terms.safe_pattern, [r"(a\|b)*", "([+*]b)+", r"\(a+\)+", "(?:ab)+", r"\p{L}+", "(?P<x>a)", "a{2}|b"]))
    assert terms.cjk_groups("数据 v1.2/a-b", 2) == ([["数据"]], ["v1.2/a-b"])
    assert terms.has_cjk("ab 数") and not terms.has_cjk("é")


def test_routes():
    assert terms.route("x", 0, 1000).action == "answer_directly"
    assert terms.route("x", 1, 4000, 1, probe=True).action == "answer_directly"
    assert terms.route("x", 1, 4000, 1).action == "expand_shallow"
    assert terms.route("x", 20, 4000, 3).action == "delegate_traversal"
    assert terms.route("timeline of the root cause", 1, 10**6, 1).action == "delegate_traversal"
    assert terms.broad_range("2019 to 2022") and not terms.broad_range("2021 2022")


def test_time_filter_and_cursor():
    as_of = datetime(2024, 1, 10)
    assert listing.time_filter(recency="2d", as_of=as_of) == (datetime(2024, 1, 8), None)
    for bad in ({"recency": "2x", "as_of": as_of}, {"between_": "a"}, {"after": "2024-01-02", "before": "2024-01-01"}, {"recency": "1d", "after": "2024-01-01", "as_of": as_of}):
        with pytest.raises(ValueError):
            listing.time_filter(**bad)
    c = listing.encode_cursor("messages", "2024-01-01 00:00:00", 5)
    assert listing.decode_cursor(c, "messages") == ("2024-01-01 00:00:00", 5)
    with pytest.raises(ValueError):
        listing.decode_cursor(c, "summaries")
    with pytest.raises(ValueError):
        listing.decode_cursor("%%%", "messages")


def test_session_patterns(spark):
    keys = ["agent:main:cron:1", "agent:main:cron:1:run", "agent:main", "agent:main:channel:c1:thread:t", "agent:main:channel:c1", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(listing.matches_any(F.col("k"), ["agent:*:cron:*"]).alias("one"), listing.matches_any(F.col("k"), ["agent:**"]).alias("all"), listing.is_cron(F.col("k")).alias("cron"), listing.channel_scope(F.col("k")).alias("scope"))
    rows = df.collect()
    assert [r.one for r in rows] == [True, False, False, False, False, False] and [r["all"] for r in rows] == [True, True, True, True, True, False]
    assert [r.cron for r in rows] == [True, True, False, False, False, False] and [r.scope for r in rows] == [None, None, None, "agent:main:channel:c1", "agent:main:channel:c1", None]


def test_retention_and_retry(spark):
    assert [maintain.retention_days(x) for x in ("90d", " 3M ", "1y", "0d", "x", None)] == [90, 90, 365, None, None, None]
    assert [r.s for r in spark.range(9).select(maintain.retry_after(F.col("id"), 10).alias("s")).collect()] == [10, 10, 20, 40, 80, 160, 320, 640, 640]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("conflated", "conflat"), ("happy", "happi"), ("sky", "sky"), ("adjustable", "adjust"), ("controlling", "control"), ("falling", "fall"), ("sing", "sing")])
def test_porter(word, stem):
    assert search.porter(word) == stem


def test_stemmed_rank_matches_sqlite(spark):
    import sqlite3

    docs = ["the cat runs", "running cats and dogs", "a dog ran", "cats running run runs", "nothing here"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this build")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(docs, 1)))
    want = dict(db.execute("select rowid, rank from t where t match '\"running\" \"cat\"'").fetchall())
    df = spark.createDataFrame(list(enumerate(docs, 1)), "message_id long, content string")
    got = {r.message_id: r["rank"] for r in search.bm25(df, "running cat", stem=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stemmed_words_match_sqlite(spark):
    import sqlite3

    docs = ["a thing", "things", "thinged", "thinging", "thinges", "thinger", "thingly", "thingy", "thin"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this build")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(docs, 1)))
    want = dict(db.execute("select rowid, rank from t where t match 'things'").fetchall())
    got = {r.message_id: r["rank"] for r in search.bm25(spark.createDataFrame(list(enumerate(docs, 1)), "message_id long, content string"), "things", stem=True).collect()}
    assert got.keys() == want.keys() == {1, 2, 3, 4, 5} and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40), st.integers(1, 60))
def test_utf8_head(spark, text, limit):
    text = text.replace("\ud800", "")
    got = spark.createDataFrame([(text,)], "t string").select(transcripts.utf8_head(F.col("t"), limit).alias("h")).first().h
    assert got == text.encode("utf-8", "ignore")[:limit].decode("utf-8", "ignore")


def test_marker_kinds(spark):
    m = maintain.Markers()
    texts = [m.directive + " x", m.fallback + " x", "x " + m.directive + " y" * 100, "x" * 200 + m.truncated + "9 tokens]", m.truncated + "9]" + "y" * 60, "x" * 100 + m.fallback, m.bare, "fine"]
    df = spark.createDataFrame([(t, "unknown") for t in texts], "t string, model string").select(maintain.marker_kind(F.col("t"), F.col("model")).alias("k"))
    assert [r.k for r in df.collect()] == ["fallback", "old", "fallback", "new", None, "fallback", "emergency", None]


def test_long_words_and_accents(spark):
    assert search.porter("a" + "y" * 3000) == "a" + "y" * 3000 and search.porter("syzygy") == "syzygi"
    df = spark.createDataFrame([(1, "Paul Erdős wrote"), (2, "PAUL ERDO\u030bS"), (3, "Erdogan"), (4, "Ångström ÇA")], "message_id long, content string")
    assert sorted(r.message_id for r in search.bm25(df, "Erdős").collect()) == [1, 2]
    assert [r.message_id for r in search.bm25(df, "angstrom ca").collect()] == [4]


def test_patterns_are_those_of_the_engine(spark):
    df = spark.createDataFrame([(1, "é1", "2024-01-01")], "message_id long, content string, created_at string")
    assert search.regex(df, r"\p{L}+\d", None).count() == 1
    assert search.regex(df, "(?P<x>a)", None).count() == 0 and search.regex(df, "(?<x>é)", None).count() == 1
