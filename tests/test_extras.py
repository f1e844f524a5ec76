"""The smaller operators on hand-made rows."""

from pyspark.sql import functions as F

from reminisce.operators import compact, extras


def test_import_report(spark):
    e = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", False)], "file string, accepted boolean")
    known = spark.createDataFrame([("b",)], "file string")
    report, rows = extras.bulk_import(e, known, True)
    assert sorted(tuple(r) for r in report.collect()) == [("a", 2, "imported"), ("b", 1, "known"), ("c", 0, "empty")] and rows.count() == 2
    assert extras.bulk_import(e, known, False)[1].count() == 0


def test_confined(spark):
    paths = ["/data/f1", "file:///data/x/f2", "/data/../etc/p", "/database/f", "/data"]
    df = spark.createDataFrame([(p,) for p in paths], "storage_uri string")
    assert [r.storage_uri for r in extras.confined(df, "/data/").collect()] == paths[:2]


def test_texts(spark):
    assert extras.summary_ids("see [sum_0123456789abcdef] SUM_0123456789ABCDEF sum_short") == ["sum_0123456789abcdef"]
    df = spark.createDataFrame([('Conversation info (untrusted metadata):\n```json\n{"a":1}\n```\n[Tue 2024-01-02 03:04 UTC] hello',), ("[not a time] x",), ("please continue",)], "t string")
    r = df.select(extras.body(F.col("t")).alias("b"), extras.volatile(F.col("t")).alias("v")).collect()
    assert [x.b for x in r] == ["hello", "[not a time] x", "please continue"] and [x.v for x in r] == [False, False, True]
    t = spark.range(1).select(extras.prompt_time(F.lit("2024-07-01 12:00:00").cast("timestamp"), "UTC").alias("t")).first().t
    assert t == "2024-07-01 12:00 UTC"
    zoned = spark.range(1).select(*(extras.prompt_time(F.lit(x).cast("timestamp"), "America/New_York").alias(n) for n, x in (("s", "2024-07-01 12:00:00"), ("w", "2024-01-01 12:00:00")))).first()
    assert (zoned.s, zoned.w) in (("2024-07-01 08:00 EDT", "2024-01-01 07:00 EST"), ("2024-07-01 08:00 America/New_York", "2024-01-01 07:00 America/New_York"))


def test_depth_chunk(spark):
    items = spark.createDataFrame([(1, i, k, None, s) for i, (k, s) in enumerate([("message", None), ("summary", "a"), ("summary", "b"), ("summary", "c"), ("message", None), ("summary", "d")])], "conversation_id long, ordinal long, item_type string, message_id long, summary_id string")
    s = spark.createDataFrame([("a", 0, 90), ("b", 0, 20), ("c", 0, 5), ("d", 0, 1)], "summary_id string, depth long, token_count long")
    pick = lambda n: [r.summary_id for r in extras.depth_chunk(items, s, 0, n).orderBy("ordinal").collect()]
    assert pick(50) == ["a"] and pick(110) == ["a", "b"] and pick(1000) == ["a", "b", "c"]
    assert extras.depth_chunk(items, s, 3, 50).count() == 0


def test_threshold_without_rules(spark):
    s = spark.createDataFrame([("m", "k", 1)], "model string, session_key string, context_window long")
    assert compact.threshold_for(s, [], 0.75).first().threshold == 0.75


def test_file_search_reads_whole_texts(spark):
    from reminisce.operators import search

    files = spark.createDataFrame([("a", "text/plain", "é" * 300_000 + "\nLicensed"), ("b", "text/plain", "Licensed")], "file_id string, mime_type string, content string")
    got = sorted((r.file_id, r.line, r.byte_offset) for r in search.file_matches(files, "Licensed").collect())
    assert got == [("a", 2, 600_001), ("b", 1, 0)]
    assert [r.file_id for r in search.file_matches(files, "Licensed", prefix_bytes=512_000).collect()] == ["b"]


def test_every_conversation(spark):
    from reminisce import registry
    from reminisce.operators import recall

    rows = [("a", 10, "x"), ("b", 11, "x"), ("c", 12, "y"), ("d", 12, "y"), ("e", 3, "z"), ("f", 30, "z")]
    df = spark.createDataFrame(rows, "summary_id string, conversation_id long, content string")
    assert sorted(r.summary_id for r in recall.duplicated_anywhere(df).collect()) == ["a", "b", "e", "f"]
    every, some = (registry.queries()[k](spark, "/root/testdata/sf0.01").count() for k in ("transplant_all", "transplant"))
    assert every > some > 0


def test_window_of_the_reference(spark):
    from reminisce import registry

    q, sf = registry.queries(), "/root/testdata/sf0.01"
    assert q["regex_window_10000"](spark, sf).count() > 100 >= q["regex_window"](spark, sf).count()
