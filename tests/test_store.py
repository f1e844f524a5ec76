"""Operators on hand-made stores: cycles, shared nodes, tool calls, transcripts, replays, and properties of whole stores."""

import json

import pytest
from pyspark.sql import functions as F

from reminisce.operators import assemble, compact, dag, ingest, listing, maintain, status, tail
from reminisce.sources import tables, transcripts

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def message_rows(spark, *items):
    """(conversation, seq, role, content, tokens)"""
    df = spark.createDataFrame(items, "conversation_id long, seq long, role string, content string, token_count long")
    return df.withColumn("message_id", F.col("conversation_id") * 100 + F.col("seq")).withColumn("identity_hash", F.sha2(F.concat("role", "content"), 256)).withColumn("created_at", F.timestamp_add("SECOND", F.col("seq").cast("int"), F.lit("2024-01-01").cast("timestamp")))


@pytest.fixture(scope="module")
def swept(spark):
    return compact.kept(compact.sweep(tables.messages(spark, SF)))


def test_context_has_no_gaps(swept):
    g = swept.context_items.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
    assert all(r.a == 0 and r.b == r.n - 1 for r in g.collect())


def test_every_message_in_context_or_lineage(swept):
    covered = swept.summary_messages.select("message_id").unionByName(swept.context_items.filter("message_id is not null").select("message_id"))
    assert rows(covered, "message_id") == rows(swept.messages, "message_id")


def test_assembled_within_budget_or_tail(swept):
    a = assemble.assemble(swept, 300, 2).groupBy("conversation_id").agg(F.sum("token_count").alias("t"), F.sum(F.when(F.col("in_tail"), F.col("token_count")).otherwise(0)).alias("tail"))
    assert all(r.t <= max(300, r.tail) for r in a.collect())


def test_pages_make_the_list(spark):
    m = tables.messages(spark, SF)
    want = [(r.created_at, r.message_id) for r in m.orderBy(F.desc("created_at"), F.desc("message_id")).collect()]
    got, after = [], None
    while True:
        page = listing.page(m, "created_at", "message_id", 97, after).collect()
        got += [(r.created_at, r.message_id) for r in page[:97]]
        if len(page) <= 97:
            break
        after = got[-1]
    assert got == want


def test_tail_rules(spark):
    m = message_rows(spark, (1, 1, "user", "a", 10), (1, 2, "user", "b", 10), (1, 3, "assistant", "c", 500), (1, 4, "assistant", "d", 10))
    assert rows(tail.listing_tail(m, 3, 100), "seq") == [(4,)]
    assert rows(tail.runtime_tail(m, 1, 5).filter("in_tail"), "seq") == [(2,), (3,), (4,)]
    assert rows(tail.newest_suffix(m, 5), "seq") == [] and rows(tail.newest_suffix(m, 15), "seq") == [(4,)]


def test_chunks(spark):
    df = message_rows(spark, *((1, i, "assistant", "x", t) for i, t in enumerate([100, 100, 50, 300, 10, 1], 1)), (2, 1, "user", "y", 5))
    assert rows(compact.leaf_chunks(df, 200, 1), "seq", "chunk") == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_sweep_goes_on_until_one_is_left(spark):
    store = compact.sweep(message_rows(spark, *((1, i, "assistant", f"text {i}", 200) for i in range(1, 34))), tail=1)
    depths = {r.depth: r["count"] for r in store.summaries.groupBy("depth").count().collect()}
    assert depths == {0: 32, 1: 16, 2: 8, 3: 4, 4: 2, 5: 1}
    assert [r.item_type for r in compact.kept(store).context_items.orderBy("ordinal").collect()] == ["summary", "message"]


def graph(spark, edges, leaves=(), tokens=5):
    names = sorted({x for e in edges for x in e[:2]} | set(leaves))
    s = spark.createDataFrame([(n, 1, "leaf" if n in leaves else "condensed", tokens, f"text {n}") for n in names], "summary_id string, conversation_id long, kind string, token_count long, content string")
    return s, spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "derived_id string, source_id string, ordinal long")


def test_cycle_ends(spark):
    s, e = graph(spark, [("a", "b"), ("b", "a"), ("a", "l")], ["l"])
    assert rows(dag.walk(e, s, 6).filter("root = 'a'"), "node", "level") == [("a", 0), ("b", 1), ("l", 1)]
    assert rows(dag.backfill_depth(s, e), "summary_id", "depth") == [("a", 1), ("b", 1), ("l", 0)]


def test_prior_context(spark):
    df = spark.createDataFrame([(f"s{i}", 1, 0, i, c) for i, c in enumerate(["a", " ", "b", "c", "", "d"])], "summary_id string, conversation_id long, depth long, first_seq long, content string")
    assert rows(dag.prior_context(df), "prior") == [("",), ("a",), ("a",), ("a\n\nb",), ("b\n\nc",), ("b\n\nc",)]


def test_shared_node_counts_by_path(spark):
    s, e = graph(spark, [("r", "x"), ("r", "y"), ("x", "l"), ("y", "l")], ["l"])
    none = spark.createDataFrame([], "summary_id string, message_id long, ordinal long")
    m = message_rows(spark, (1, 1, "user", "a", 1))
    store = compact.Store(m, s, none, e, None)
    r = {x.summary_id: x for x in dag.rollup(store).collect()}
    assert r["r"].descendant_count == 4 and r["r"].descendant_token_count == 20
    assert {x.summary_id: x.n_sources for x in dag.reachable(store, 4).collect()}["r"] == 3
    assert rows(dag.expand(store, s.filter("summary_id = 'r'"), 12, False, 4), "place", "node") == [(1, "x"), (2, "l")]
    assert rows(dag.roots(store), "summary_id") == [("r",)]


def test_tool_pairs(spark):
    items = spark.createDataFrame(
        [(1, 0, "user", None, None, "q"), (1, 1, "tool", None, "c9", "orphan"), (1, 2, "assistant", ["c1", "c2"], None, "call"), (1, 3, "user", None, None, "wait"), (1, 4, "tool", None, "c1", "r1"), (1, 5, "tool", None, "c1", "again")],
        "conversation_id long, ordinal long, role string, call_ids array<string>, call_id string, content string",
    )
    got = [(r.role, r.call_id, r.content) for r in assemble.repair_pairs(items).orderBy("ordinal").collect()]
    assert got == [("user", None, "q"), ("assistant", None, "call"), ("tool", "c1", "r1"), ("tool", "c2", "[missing tool result]"), ("user", None, "wait")]
    calls, results = assemble.unpaired(spark.createDataFrame([(1, "a", 1), (1, "b", 5)], "conversation_id long, call_id string, ordinal long"), spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "z", 4)], "conversation_id long, call_id string, ordinal long"))
    assert rows(calls, "call_id") == [("b",)] and rows(results, "call_id") == [("b",), ("z",)]


def test_stub_and_externalize(spark):
    df = spark.createDataFrame([(1, "tool", "x" * 50), (1, "user", "x" * 50), (1, "tool", "s")], "conversation_id long, role string, content string")
    out, files = assemble.externalize(df, 40)
    assert files.count() == 1 and out.filter("large_content is not null").count() == 1
    assert assemble.stub(out.withColumn("in_tail", F.lit(False))).filter("content like '[Stored tool result: file_%'").count() == 1
    assert assemble.drop_blank(df.withColumn("role", F.lit("assistant")).withColumn("content", F.lit(" "))).count() == 0


def test_fallback_and_truncation(spark):
    df = spark.createDataFrame([("word " * 400,), ("数" * 40,), ("short",)], "t string").select(assemble.fallback_summary(F.col("t"), 70).alias("s"), assemble.truncate_tokens(F.col("t"), 9).alias("u"))
    r = df.collect()
    assert r[0].s.endswith("management]") and len(r[0].s.split("\n")[0]) <= 280 and r[2].s == "short"
    assert r[0].u == ("word " * 400)[:36] and r[1].u == "数" * 6 and r[2].u == "short"


def test_escalation(spark):
    df = spark.createDataFrame([("a", "long " * 100), ("b", "x")], "summary_id string, text string")
    out = {r.summary_id: (r.level, r.content) for r in assemble.escalate(df, lambda text, aggressive: "s" if len(text) > 10 else text + "!", 10).collect()}
    assert out["a"] == ("normal", "s") and out["b"] == ("fallback", "x")


def test_heartbeats(spark):
    m = message_rows(spark, (1, 1, "user", "read heartbeat.md", 1), (1, 2, "assistant", "HEARTBEAT_OK", 1), (1, 3, "user", "real", 1), (1, 4, "assistant", "heartbeat_ok and more", 1), (2, 1, "user", "no marker", 1), (2, 2, "assistant", "heartbeat_ok", 1), (2, 3, "user", "[heartbeat poll]", 1))
    assert rows(ingest.heartbeats(m), "conversation_id", "seq") == [(1, 3), (1, 4), (2, 1), (2, 2)]


def test_entry_tail_and_caps(spark):
    e = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcde")], "conversation_id long, index int, entry_id string")
    stored = spark.createDataFrame([(1, "b"), (1, "e")], "conversation_id long, entry_id string")
    assert rows(ingest.entry_tail(e, stored), "index") == []
    assert rows(ingest.entry_tail(e, stored, spark.createDataFrame([(1, "b")], "conversation_id long, last_entry_id string")), "index") == [(2,), (3,)]
    assert rows(ingest.entry_tail(e, stored.filter("entry_id = 'z'")), "index") == []
    r = spark.createDataFrame([(100, "a", "a"), (1000, "a", "b"), (0, None, "b")], "n int, x string, y string").select(ingest.import_cap(F.col("n")).alias("c"), ingest.epoch_route(F.col("x"), F.col("y")).alias("e")).collect()
    assert [tuple(x) for x in r] == [(50, "same-epoch"), (200, "declared-rollover"), (50, "undeclared")]


def test_ingest_is_idempotent(spark):
    m = tables.messages(spark, SF).withColumn("entry_id", F.col("message_id").cast("string"))
    first = ingest.once(m, m.limit(0), "entry_id")
    assert first.count() == m.count() and ingest.once(m, first, "entry_id").count() == 0


def test_upsert_and_first(spark):
    s = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    c = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert rows(ingest.upsert(s, c, "k", "v"), "k", "x") == [(1, "c"), (2, "b"), (3, "e")]
    assert rows(ingest.keep_first(s.unionByName(c), ["k"], "v"), "k") == [(1,), (2,), (3,)]
    k = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "conversation_id long, seq long, key string")
    assert rows(ingest.keep_first_key(k, "key").filter("key is not null"), "seq") == [(1,), (3,)]


def test_resolution(spark):
    c = spark.createDataFrame([(1, "s1", "k1", True), (2, "s2", "k1", False), (3, "s2", None, True)], "conversation_id long, session_id string, session_key string, active boolean").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert rows(listing.resolve(c, "k1", "s2"), "conversation_id") == [(1,)] and rows(listing.resolve(c, None, "s2"), "conversation_id") == [(3,)] and rows(listing.resolve(c, "none", "none"), "conversation_id") == []
    w = spark.createDataFrame([("s9", "k1"), ("s2", None), ("s8", "k8")], "session_id string, session_key string")
    assert sorted((r.session_id, r.conversation_id or 0) for r in ingest.get_or_create(c, w).collect()) == [("s2", 3), ("s8", 0), ("s9", 1)]


def test_threshold_rules(spark):
    s = spark.createDataFrame([("m1", "k", 1000), ("m2", "k", 1000), ("m3", "z", 9000)], "model string, session_key string, context_window long")
    rules = [{"session_key": "k", "threshold": 0.5}, {"model": "m1", "threshold": 0.6}, {"min_window": 5000, "threshold": 0.9}, {"min_window": 6000, "threshold": 0.8}]
    assert rows(compact.threshold_for(s, rules, 0.75), "model", "threshold") == [("m1", 0.6), ("m2", 0.5), ("m3", 0.9)]


def test_transcripts(spark, tmp_path):
    lines = [{"id": "a", "parentId": None, "message": {"role": "user", "content": "one"}}, {"id": "b", "parentId": "a", "message": {"role": "assistant", "content": "old"}}, "broken{", "", {"id": "c", "parentId": "a", "message": {"role": "assistant", "content": "new"}}, {"id": "d", "parentId": "c", "command": "ls", "output": "x"}]
    (tmp_path / "t1.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (tmp_path / "t2.jsonl").write_text("\n".join(json.dumps(x) for x in [{"role": "user", "content": "bare"}, {"id": "z", "parentId": "gone", "role": "user", "content": "dangling"}]))
    raw = transcripts.read_lines(spark, str(tmp_path))
    entries = transcripts.parse(raw)
    assert entries.filter("accepted").count() == 6 and transcripts.malformed(raw).count() == 1
    live = transcripts.live_path(entries)
    assert sorted(r.content for r in live.collect()) == ["$ ls\nx", "bare", "dangling", "new", "one"]
    assert transcripts.newest_entry(entries).count() == 2 and transcripts.session_files(spark, str(tmp_path), limit=1).count() == 1


def test_files(spark):
    df = spark.createDataFrame([("f1", 'see <file name="a.txt" x="1">body</file> and <file name="b">c\nd</file>')], "file_id string, content string")
    r = df.select(transcripts.file_blocks(F.col("content")).alias("b")).first().b
    assert [(x.name, x.body) for x in r] == [("a.txt", "body"), ("b", "c\nd")]


def test_prune_and_delete(spark, swept):
    gone = spark.createDataFrame([(0,)], "conversation_id long")
    left = maintain.prune({"messages": swept.messages, "items": swept.context_items, "edges": swept.summary_edges}, gone)
    assert left["messages"].filter("conversation_id = 0").count() == 0 and left["edges"].count() == swept.summary_edges.count()
    kept = maintain.delete_unsummarized(swept.messages, swept.messages.filter("conversation_id = 1"), swept.summary_messages)
    assert swept.messages.count() - kept.count() == swept.messages.filter("conversation_id = 1").join(swept.summary_messages, "message_id", "left_anti").count()


def test_empty_tables(spark):
    m = tables.messages(spark, SF).limit(0)
    store = compact.sweep(m)
    assert store.summaries.count() == store.context_items.count() == status.per_conversation(store).count() == 0
    assert tail.runtime_tail(m, 2).count() == ingest.heartbeats(m).count() == 0
