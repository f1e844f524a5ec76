"""Queries of the smaller operators, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.functions.text import identity_hash
from reminisce.operators import extras, maintain
from reminisce.plans.base import MESSAGES, STORE, WALK, est
from reminisce.plans.store_queries import kept, store
from reminisce.sources import tables
from reminisce.sources.tables import messages

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


M = f"WITH {MESSAGES}"


@query("newest_reasoned", f"{M} SELECT conversation_id, max(seq) % 2 = 0 OR max(seq) % 3 = 0 AS reasoned FROM m GROUP BY 1")
def newest_reasoned(spark, sf_dir):
    m = messages(spark, sf_dir)
    p = m.select("message_id", F.when(F.col("seq") % 2 == 0, "reasoning").otherwise("text").alias("part_type"), F.when(F.col("seq") % 3 == 0, '{"type":"thinking"}').otherwise("{bad").alias("metadata"))
    return extras.newest_reasoned(m, p)


@query("storable_messages", f"{M} SELECT message_id FROM m WHERE NOT (role = 'assistant' AND seq % 3 = 0) AND role <> 'system'")
def storable_messages(spark, sf_dir):
    m = messages(spark, sf_dir).withColumns({"stop_reason": F.when(F.col("seq") % 3 == 0, "aborted"), "content": F.when(F.col("role") == "assistant", " ").otherwise(F.col("content"))})
    return extras.storable(m, ("user", "assistant")).select("message_id")


@query("context_summary_reach", f"{STORE} SELECT x.summary_id, max(seq) AS last_seq FROM x LEFT JOIN k ON k.summary_id = x.summary_id LEFT JOIN m ON m.message_id = k.message_id WHERE x.summary_id IS NOT NULL GROUP BY 1")
def context_summary_reach(spark, sf_dir):
    return extras.covered_messages(store(spark, sf_dir))


@query("markers_by_conversation", f"{STORE} SELECT conversation_id, count(*) FILTER (depth = 0) AS old, count(*) FILTER (depth = 1) AS new FROM s WHERE depth < 2 GROUP BY 1")
def markers_by_conversation(spark, sf_dir):
    marks = maintain.Markers()
    s = store(spark, sf_dir).summaries
    text = F.when(F.col("depth") == 0, F.concat(F.lit(marks.fallback), "content")).when(F.col("depth") == 1, F.concat("content", F.lit(marks.truncated), F.lit("9 tokens]"))).otherwise(F.col("content"))
    return extras.markers_by_conversation(s.withColumn("marker", maintain.marker_kind(text)), ["old", "new"])


@query("expand_sharing", f"""{WALK}, q AS (SELECT conversation_id AS request, first_seq AS position, summary_id AS root FROM s WHERE depth = 1),
j AS (SELECT request, position, path, w.root, node, s.token_count FROM q JOIN w ON w.root = q.root AND level > 0 JOIN s ON s.summary_id = node)
SELECT request, place, root, node, token_count FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY position, path) AS place, sum(token_count) OVER (PARTITION BY request ORDER BY position, path ROWS UNBOUNDED PRECEDING) AS cum FROM j) WHERE cum <= 100""")
def expand_sharing(spark, sf_dir):
    s = kept(spark, sf_dir)
    roots = s.summaries.filter("depth = 1").select(F.col("conversation_id").alias("request"), F.col("first_seq").alias("position"), "summary_id")
    return extras.expand_sharing(s, roots, 100)


@query("depth_chunk", f"""{STORE}, j AS (SELECT x.*, coalesce(s.depth = 0, false) AS i, s.token_count AS t FROM x LEFT JOIN s ON s.summary_id = x.summary_id),
r AS (SELECT *, count(*) FILTER (NOT i) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS broken FROM j), fb AS (SELECT conversation_id, min(broken) AS b FROM r WHERE i GROUP BY 1),
c AS (SELECT r.*, coalesce(sum(t) OVER (PARTITION BY r.conversation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN fb ON fb.conversation_id = r.conversation_id AND r.broken = fb.b WHERE i)
SELECT conversation_id, ordinal, summary_id FROM c WHERE before = 0 OR (before + t <= 60 AND before < 60)""")
def depth_chunk(spark, sf_dir):
    s = kept(spark, sf_dir)
    return extras.depth_chunk(s.context_items, s.summaries, 0, 60)


@query("rewritten_summaries", f"{STORE}, v AS (SELECT summary_id, CASE WHEN depth = 1 THEN 'rewritten ' || summary_id ELSE content END AS content FROM s) SELECT summary_id, content, {est('content')} AS token_count FROM v")
def rewritten_summaries(spark, sf_dir):
    s = store(spark, sf_dir).summaries
    new = s.filter("depth = 1").select("summary_id", F.concat(F.lit("rewritten "), "summary_id").alias("new_content"))
    return extras.rewritten(s, new).select("summary_id", "content", "token_count")


@query("serialized_tokens", f"{M} SELECT message_id, CASE WHEN message_id % 2 = 0 THEN {est('content')} + 1600 ELSE {est('content')} END AS tokens FROM m")
def serialized_tokens(spark, sf_dir):
    blob = F.when(F.col("message_id") % 2 == 0, F.lit("A" * 5000)).otherwise("")
    # a space would count, so the payload stands where a word can't join it
    return messages(spark, sf_dir).select("message_id", (extras.serialized_tokens(F.concat("content", F.lit("{"), blob)) - extras.serialized_tokens(F.concat("content", F.lit("{"))) + extras.serialized_tokens(F.col("content"))).alias("tokens"))


@query("granted_messages", f"{M} SELECT message_id FROM m WHERE conversation_id % 3 = 1")
def granted_messages(spark, sf_dir):
    m = messages(spark, sf_dir)
    grants = m.filter("conversation_id % 3 > 0").select("conversation_id", F.when(F.col("conversation_id") % 3 == 1, "2024-06-01").otherwise("2024-01-01").cast("timestamp").alias("expires_at"))
    return extras.granted(m, grants, "2024-02-01").select("message_id")


@query("decorated_matches", f"{M} SELECT message_id, seq AS index FROM m WHERE role = 'user' QUALIFY count(*) OVER (PARTITION BY conversation_id, trim(content, ' ')) = 1")
def decorated_matches(spark, sf_dir):
    m = messages(spark, sf_dir)
    live = m.withColumn("content", F.concat(F.lit("[Mon 2024-01-01 10:00 UTC] "), "content")).withColumn("index", F.col("seq"))
    return extras.decorated_matches(m, live)


@query("rollover_verdicts", f"{M} SELECT conversation_id, CASE WHEN conversation_id % 3 = 0 THEN 'continuation' WHEN conversation_id % 3 = 1 THEN 'fresh' ELSE 'ambiguous' END AS verdict FROM m GROUP BY 1")
def rollover_verdicts(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = F.col("conversation_id") % 3
    last = m.groupBy("conversation_id").agg(F.max("seq").alias("n"), F.max_by("identity_hash", "seq").alias("h"), F.max("created_at").alias("t"))
    new = last.select("conversation_id", F.when(c == 0, F.col("h")).otherwise("new").alias("identity_hash"), F.when(c == 2, F.col("t") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("t") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return extras.rollover(m, new)


@query("backfilled_hashes", f"{M} SELECT message_id, identity_hash FROM m")
def backfilled_hashes(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("identity_hash", F.when(F.col("seq") % 2 == 0, F.col("identity_hash")))
    return extras.backfilled_hashes(m, identity_hash(F.col("role"), F.col("content"))).select("message_id", "identity_hash")


@query("same_payload", "SELECT doc_id AS file_id, min(doc_id) OVER (PARTITION BY text) AS same_as FROM documents")
def same_payload(spark, sf_dir):
    return extras.same_payload(tables.large_files(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "content"))


@query("file_payloads", f"{M} SELECT 'file_' || message_id AS file_id, CASE WHEN seq % 2 = 0 THEN content ELSE 'own' END AS content FROM m")
def file_payloads(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("large_content", F.concat(F.lit("file_"), F.col("message_id").cast("string")))
    files = m.select(F.col("large_content").alias("file_id"), F.when(F.col("seq") % 2 == 1, "own").alias("content"))
    return extras.payload(files, m)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
