"""Overlaps against brute force, and blocks of parts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reminisce.operators import blocks, reconcile

ROWS = st.lists(st.sampled_from("ab"), max_size=9)


@given(ROWS, ROWS)
@settings(max_examples=500, deadline=None)
def test_overlap(first, then):
    assert reconcile.overlap(first, then) == max(k for k in range(min(len(first), len(then)) + 1) if first[len(first) - k :] == then[:k])


@given(ROWS, ROWS)
@settings(max_examples=500, deadline=None)
def test_matched_until(batch, stored):
    want = 0
    for k in range(1, len(batch) + 1):
        n = min(k, len(stored))
        if n and batch[k - n : k] == stored[len(stored) - n :] and (k < len(batch) or n > 1):
            want = k
    assert reconcile.matched_until(batch, stored) == want


def test_without_overlap(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "conversation_id long, seq long, identity_hash string")
    batch, stored = rows((1, 1, "a"), (1, 2, "b"), (2, 1, "x")), rows((1, 1, "q"))
    got = lambda how: sorted(tuple(r)[:2] for r in reconcile.new_rows(batch, stored, how).collect())
    assert got("ingest") == [(1, 1), (1, 2), (2, 1)] and got("skip") == [(2, 1)]


def test_blocks(spark):
    row = spark.range(1).select(
        blocks.call_block(F.lit("function_call"), F.lit("p"), F.lit("c1"), F.lit("f"), F.lit("not json")).alias("a"), blocks.call_block(F.lit(None).cast("string"), F.lit("p"), F.lit(""), F.lit("f"), F.lit('[1,"x"]')).alias("b"),
        blocks.result_block(F.lit("function_call_output"), F.lit("c1"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("c"),
    ).first()
    assert row.a == '{"type":"function_call","call_id":"c1","name":"f","arguments":"not json"}'
    assert row.b == '{"type":"toolCall","id":"toolu_p","name":"f","arguments":[1,"x"]}'
    assert row.c == '{"type":"function_call_output","output":"","call_id":"c1"}'
    ids = spark.createDataFrame([('["a","b"]',), ("{",), (None,)], "t string").select(blocks.file_ids(F.col("t")).alias("i")).collect()
    assert [r.i for r in ids] == [["a", "b"], [], []]


def test_calls_and_lost_results(spark):
    m = spark.createDataFrame([(1, "assistant", '[{"type":"tool_use","id":"c1","name":"f","input":{"x":1}},{"type":"text","text":"t"}]'), (2, "tool", "out"), (3, "user", "plain")], "message_id long, role string, content string")
    assert [tuple(r) for r in blocks.tool_calls(m).collect()] == [(1, "c1", "f", '{"x":1}')]
    parts = spark.createDataFrame([(2, 0, "tool", "p", "tool_result", None, None, "f", None, "out", None)], "message_id long, ordinal int, part_type string, part_id string, raw_type string, text_content string, tool_call_id string, tool_name string, tool_input string, tool_output string, is_error boolean")
    got = {r.message_id: r for r in blocks.resolve(m, parts).collect()}
    assert got[2].role == "assistant" and got[2].blocks == ['{"type":"text","text":"out"}'] and got[3].blocks == ['{"type":"text","text":"plain"}']


def test_appended_lines(spark, tmp_path):
    from reminisce.sources import transcripts

    head = '{"type":"session","id":" s1 ","parentSession":"p","timestamp":"t"}'
    old, new = '{"role":"user","content":"é old"}', '{"role":"user","content":"new"}'
    for name, text in {"a": f"\n{head}\n{old}\n{new}\n", "b": f"{old}\n[1]\n", "c": f"{old}\n{new[:-2]}", "d": f"{old}\n", "e": f"{old}\n \n"}.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    lines = transcripts.read_lines(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1))
    assert [r.line_no for r in lines.filter("file = 'a.jsonl'").orderBy("line_no").collect()] == [0, 1, 2, 3]
    size = len(old.encode()) + 1
    offsets = spark.createDataFrame([("a.jsonl", len(head) + 2 + size), *((f"{x}.jsonl", size) for x in "bcde")], "file string, offset long")
    entries, status = transcripts.appended(lines, offsets)
    assert [(r.file, r.content) for r in entries.collect()] == [("a.jsonl", "new")]
    assert {r.file[0]: (r.usable, r.blank) for r in status.collect()} == {"a": (True, False), "b": (False, False), "c": (False, False), "d": (True, True), "e": (True, True)}
    got = {r.file[0]: r for r in transcripts.headers(lines).collect()}
    assert (got["a"].session_id, got["a"].parent_session, got["a"].created_at) == ("s1", "p", "t") and got["b"].session_id is None


def test_refusals():
    from reminisce.plans.search import refusal

    assert refusal("plain words", "full_text") is None and refusal('"a|b" words', "full_text") is None and refusal("a+b", "regex") is None
    assert all(refusal(q, "full_text") for q in ("a|b", "a.*b", "[abc] x", r"\bword", "(ab)+", "^start", "")) and refusal("(a+)+", "regex") and refusal("x", "other") and refusal("x", "regex", "2024-02-01", "2024-01-01")


def test_reports(spark):
    import json

    from reminisce.sources import output, scratch

    df = scratch.keep(spark.createDataFrame([(1, "a\nb", None), (2, "c", [1])], "i int, t string, l array<int>"), "report")
    assert json.loads(output.report(df.orderBy("i"), limit=1)) == {"ok": True, "rows": [{"i": 1, "t": "a\nb", "l": None}], "more": True}
    assert output.report(df.orderBy("i"), "table") == "i  t    l\n1  a b\n2  c    [1]"
    failed = json.loads(output.report(df.selectExpr("raise_error('no')"), "pretty"))
    assert not failed["ok"] and failed["error"]["code"]
    assert scratch.discard(spark) >= 1
