"""Queries of parts, files, focus briefs, recall, windows and repeated compaction, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.engine import Engine
from reminisce.operators import assemble, compact, dag, focus, listing, maintain, parts, recall, rounds, search, status
from reminisce.plans.base import CONTEXT, CONVERSATIONS, MESSAGES, STORE, est
from reminisce.plans.store_queries import kept, store
from reminisce.sources import explore, tables
from reminisce.sources.tables import conversations, messages

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


M, C = f"WITH {MESSAGES}", f"WITH {MESSAGES}, {CONVERSATIONS}"


def _blocks(m: DataFrame) -> DataFrame:
    """messages whose content is a JSON array of one block, of a kind by id."""
    kind = F.element_at(F.array(*map(F.lit, ["text", "thinking", "tool_use", "image", "step-start", "other"])), (F.col("message_id") % 6 + 1).cast("int"))
    return m.withColumn("content", F.to_json(F.array(F.struct(kind.alias("type"), F.lit("hello").alias("text"), F.concat(F.lit("c"), F.col("message_id").cast("string")).alias("id")))))


@query("part_types", f"{M} SELECT message_id, (['text', 'reasoning', 'tool', 'file', 'step_start', 'agent'])[(message_id % 6 + 1)::INT] AS part_type, 'hello' AS text, 'c' || message_id AS tool_call_id FROM m")
def part_types(spark, sf_dir):
    return parts.parts_table(_blocks(messages(spark, sf_dir))).select("message_id", "part_type", "text", "tool_call_id")


@query("plain_text", f"{M} SELECT message_id, CASE WHEN message_id % 6 IN (1, 2) THEN '' ELSE 'hello' END AS text FROM m")
def plain_text(spark, sf_dir):
    return _blocks(messages(spark, sf_dir)).select("message_id", parts.plain_text(F.col("content")).alias("text"))


@query("role_tokens", f"{M}, j AS (SELECT message_id, role, '[{{\"type\":\"' || (['text', 'thinking', 'tool_use', 'image', 'step-start', 'other'])[(message_id % 6 + 1)::INT] || '\",\"text\":\"hello\",\"id\":\"c' || message_id || '\"}}]' AS x FROM m) SELECT message_id, CASE WHEN role = 'user' AND message_id % 6 = 0 THEN 2 ELSE {est('x')} END::BIGINT AS tokens FROM j")
def role_tokens(spark, sf_dir):
    return _blocks(messages(spark, sf_dir)).select("message_id", parts.role_tokens(F.col("role"), F.col("content")).alias("tokens"))


@query("message_signatures", f"{M} SELECT message_id, trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) = content AS plain FROM m")
def message_signatures(spark, sf_dir):
    m = messages(spark, sf_dir)
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    return m.select("message_id", ((parts.signature(F.col("role"), F.col("content")) == parts.signature(F.col("role"), flat)) & (flat == F.col("content"))).alias("plain"))


@query("stripped_context", f"{M} SELECT message_id, trim(content, ' ') AS content FROM m")
def stripped_context(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("content", F.concat(F.lit("<memory-context>\nold\n</memory-context>"), "content"))
    return m.select("message_id", parts.strip_injected(F.col("content"), ["memory-context", "recall"]).alias("content"))


@query("display_content", f"{M} SELECT message_id, CASE WHEN seq % 2 = 1 THEN content ELSE 'in' || seq || chr(10) || 'out' || seq END AS display FROM m")
def display_content(spark, sf_dir):
    m = messages(spark, sf_dir)
    p = m.select("message_id", F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit(None).cast("string").alias("tool_input"), F.concat(F.lit("out"), F.col("seq").cast("string")).alias("tool_output")), F.struct(F.lit(0).alias("ordinal"), F.concat(F.lit("in"), F.col("seq").cast("string")).alias("tool_input"), F.lit(None).cast("string").alias("tool_output")))).alias("p")).select("message_id", "p.*", F.lit(None).cast("string").alias("text_content"))
    return parts.display_content(m.withColumn("content", F.when(F.col("seq") % 2 == 1, F.col("content")).otherwise(" ")), p)


@query("page_exploration", "SELECT page_id, regexp_extract(html, '<([\\pL_][^\\s<>/]*)', 1) AS root FROM pages")
def page_exploration(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit("x.xml").alias("file_name"), F.lit(None).cast("string").alias("mime_type"), F.col("html").alias("content"))
    return explore.explore(p).select(F.col("file_id").alias("page_id"), F.element_at("names", 1).alias("root"))


@query("text_exploration", "SELECT doc_id, length(text) AS characters, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS words, len(string_split(text, chr(10))) AS lines FROM documents")
def text_exploration(spark, sf_dir):
    s = explore.explore(tables.large_files(spark, sf_dir).withColumn("file_id", F.col("doc_id")))
    return s.select(F.col("file_id").alias("doc_id"), "characters", "words", "lines")


@query("file_stats", "SELECT count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, max(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS most_lines FROM documents")
def file_stats(spark, sf_dir):
    return tables.large_files(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"), F.sum("byte_size").alias("bytes"), F.max("line_count").alias("most_lines"))


@query("externalized", f"{M} SELECT message_id, 'file_' || substr(sha256(content), 1, 16) AS file_id, octet_length(encode(content))::BIGINT AS byte_size FROM m WHERE token_count >= 200")
def externalized(spark, sf_dir):
    return rounds.split_large(messages(spark, sf_dir), 200)[1].select("message_id", "file_id", "byte_size")


def _briefs(spark, sf_dir):
    m = messages(spark, sf_dir)
    s = m.groupBy("conversation_id").agg(F.min("created_at").alias("t"))
    return s.select(F.concat(F.lit("brief-"), F.col("conversation_id").cast("string")).alias("brief_id"), "conversation_id", F.element_at(F.array(*map(F.lit, ["draft", "active", "inactive"])), (F.col("conversation_id") % 3 + 1).cast("int")).alias("status"), F.col("t").alias("created_at"), F.lit(2).cast("long").alias("covered_message_seq"), F.col("t").alias("covered_latest_at"), F.lit("old").alias("source_context_hash"))


@query("focus_drift", f"""{STORE}, b AS (SELECT conversation_id, min(created_at) AS t FROM m GROUP BY 1),
mm AS (SELECT conversation_id, count(*) AS n, sum(token_count) AS k FROM m WHERE seq > 2 GROUP BY 1), ss AS (SELECT s.conversation_id, count(*) AS n, sum(token_count) AS k FROM s JOIN b ON b.conversation_id = s.conversation_id AND latest_at > t GROUP BY 1)
SELECT 'brief-' || b.conversation_id AS brief_id, coalesce(mm.n, 0) AS messages, coalesce(ss.n, 0) AS summaries, (coalesce(mm.k, 0) + coalesce(ss.k, 0))::BIGINT AS tokens, true AS changed, true AS stale FROM b LEFT JOIN mm USING (conversation_id) LEFT JOIN ss USING (conversation_id)""")
def focus_drift(spark, sf_dir):
    s = kept(spark, sf_dir)
    return focus.drift(_briefs(spark, sf_dir), s.messages, s.summaries, assemble.source_hash(s))


@query("focus_created", f"{M} SELECT 'brief-' || conversation_id AS brief_id, CASE WHEN conversation_id % 2 = 0 AND conversation_id % 3 IN (0, 1) THEN 'superseded' ELSE (['draft', 'active', 'inactive'])[(conversation_id % 3 + 1)::INT] END AS status FROM m GROUP BY conversation_id UNION ALL SELECT 'new-' || conversation_id, 'active' FROM m WHERE conversation_id % 2 = 0 GROUP BY conversation_id")
def focus_created(spark, sf_dir):
    b = _briefs(spark, sf_dir)
    new = b.filter("conversation_id % 2 = 0").withColumn("brief_id", F.concat(F.lit("new-"), F.col("conversation_id").cast("string"))).withColumn("status", F.lit("active"))
    return focus.create(b, new).select("brief_id", "status")


@query("focus_active", f"{M} SELECT conversation_id, 'brief-' || conversation_id AS brief_id FROM m WHERE conversation_id % 3 = 1 GROUP BY conversation_id")
def focus_active(spark, sf_dir):
    return focus.active(_briefs(spark, sf_dir)).select("conversation_id", "brief_id")


@query("coverage_tokens", f"""{STORE}, w AS (SELECT summary_id AS root, summary_id AS node FROM s WHERE summary_id IN (SELECT summary_id FROM x) UNION ALL SELECT w.root, e.source_id FROM w JOIN e ON e.derived_id = w.node)
SELECT conversation_id, sum(token_count)::BIGINT AS tokens FROM (SELECT DISTINCT m.conversation_id, message_id, token_count FROM w JOIN k ON k.summary_id = w.node JOIN m USING (message_id)) GROUP BY 1""")
def coverage_tokens(spark, sf_dir):
    s = kept(spark, sf_dir)
    nodes = dag.closure(s.summary_edges, s.context_items.filter("summary_id is not null").select("summary_id")).select(F.col("node").alias("summary_id")).distinct()
    covered = nodes.join(s.summary_messages, "summary_id").select("message_id").distinct()
    return s.messages.join(covered, "message_id").groupBy("conversation_id").agg(F.sum("token_count").alias("tokens"))


@query("repair_input_tokens", f"{STORE} SELECT summary_id, sum(token_count)::BIGINT AS tokens FROM (SELECT k.summary_id, m.token_count FROM k JOIN m USING (message_id) UNION ALL SELECT derived_id, s.token_count FROM e JOIN s ON s.summary_id = source_id) GROUP BY 1")
def repair_input_tokens(spark, sf_dir):
    s = store(spark, sf_dir)
    leaf = s.summary_messages.join(s.messages.select("message_id", "token_count"), "message_id").select("summary_id", "token_count")
    condensed = s.summary_edges.join(s.summaries.select(F.col("summary_id").alias("source_id"), "token_count"), "source_id").select(F.col("derived_id").alias("summary_id"), "token_count")
    return leaf.unionByName(condensed).groupBy("summary_id").agg(F.sum("token_count").alias("tokens"))


@query("latest_window", f"{M} SELECT message_id, true AS has_older, false AS has_newer FROM m WHERE conversation_id = (SELECT min(conversation_id) FROM m GROUP BY conversation_id HAVING max(seq) >= 6 ORDER BY 1 LIMIT 1) ORDER BY seq DESC LIMIT 3")
def latest_window(spark, sf_dir):
    m = messages(spark, sf_dir)
    first = m.groupBy("conversation_id").agg(F.max("seq").alias("n")).filter("n >= 6").agg(F.min("conversation_id")).first()[0]
    return recall.window(m, first, 3).select("message_id", "has_older", "has_newer")


@query("session_lookup", f"{C}, q AS (SELECT session_id, session_key || ':topic:9' AS key FROM c) SELECT q.session_id, coalesce(k.id, i.id) AS conversation_id FROM q LEFT JOIN (SELECT session_key, max(conversation_id) AS id FROM c WHERE session_key IS NOT NULL GROUP BY 1) k ON k.session_key || ':topic:9' = q.key LEFT JOIN (SELECT session_id, max(conversation_id) AS id FROM c GROUP BY 1) i ON i.session_id = q.session_id")
def session_lookup(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return recall.session_lookup(c, c.select("session_id", F.concat("session_key", F.lit(":topic:9")).alias("session_key"))).select("session_id", "conversation_id")


@query("candidate_buckets", f"""{STORE}, h AS (SELECT conversation_id, summary_id, false AS ex, false AS by_m, latest_at AS t FROM s WHERE contains(lower(content), 'the') UNION ALL SELECT m.conversation_id, k.summary_id, false, true, m.created_at FROM m JOIN k USING (message_id) WHERE contains(lower(m.content), 'with') UNION ALL SELECT conversation_id, summary_id, true, false, latest_at FROM s WHERE depth = 2),
g AS (SELECT conversation_id, summary_id, bool_or(ex) AS ex, bool_or(by_m) AS by_m, max(t) AS t FROM h GROUP BY ALL)
SELECT conversation_id, count(*) FILTER (ex) AS explicit_count, count(*) AS candidate_count, count(*) FILTER (by_m) AS message_count, row_number() OVER (ORDER BY count(*) FILTER (ex) DESC, count(*) DESC, max(t) DESC, count(*) FILTER (by_m) DESC, conversation_id) AS rank FROM g GROUP BY conversation_id""")
def candidate_buckets(spark, sf_dir):
    s = kept(spark, sf_dir)
    pick = lambda df: df.select("conversation_id", "summary_id", F.col("latest_at").alias("matched_at"))
    hits = s.messages.filter(F.lower("content").contains("with"))
    leaves = dag.leaves_of_messages(hits, s).join(hits.select("message_id", "conversation_id", F.col("created_at").alias("matched_at")), "message_id").select("conversation_id", "summary_id", "matched_at")
    found = recall.candidates(pick(s.summaries.filter("depth = 2")), pick(s.summaries.filter(F.lower("content").contains("the"))), leaves)
    return recall.buckets(found).select("conversation_id", "explicit_count", "candidate_count", "message_count", "rank")


@query("duplicated_elsewhere", f"{STORE} SELECT summary_id FROM s WHERE conversation_id >= 10 AND sha256(content) IN (SELECT sha256(content) FROM s WHERE conversation_id < 10)")
def duplicated_elsewhere(spark, sf_dir):
    s = store(spark, sf_dir)
    return recall.duplicated_elsewhere(s.summaries, s.messages.filter("conversation_id < 10").select("conversation_id").distinct())


@query("duplicated_anywhere", f"{STORE} SELECT summary_id FROM s WHERE sha256(content) IN (SELECT sha256(content) FROM s GROUP BY 1 HAVING min(conversation_id) <> max(conversation_id))")
def duplicated_anywhere(spark, sf_dir):
    return recall.duplicated_anywhere(store(spark, sf_dir).summaries)


@query("duplicated_copies", f"{STORE}, z AS (SELECT summary_id, conversation_id, kind || token_count AS content FROM s) SELECT summary_id FROM z WHERE conversation_id % 2 = 1 AND content IN (SELECT content FROM z WHERE conversation_id % 2 = 0)")
def duplicated_copies(spark, sf_dir):
    s = store(spark, sf_dir).summaries.withColumn("content", F.concat("kind", F.col("token_count").cast("string")))
    return recall.duplicated_elsewhere(s, s.filter("conversation_id % 2 = 0").select("conversation_id").distinct())


@query("prompt_recall", f"{M} SELECT conversation_id, 'RETRY_LIMIT' AS identifier, message_id, 'Note RETRY_LIMIT is ' || seq || '.' AS snippet FROM m WHERE role IN ('user', 'assistant') AND conversation_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 4")
def prompt_recall(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("content", F.concat(F.lit("First line with RETRY_LIMITS and MY_RETRY_LIMIT.\nIntro. Note RETRY_LIMIT is "), F.col("seq").cast("string"), F.lit(". And API_KEY here.\nLast.")))
    shown = m.filter("conversation_id % 2 = 0")
    return recall.recall(m, shown, "what are RETRY_LIMIT and MY_API_KEY")  # RETRY_LIMITS and MY_RETRY_LIMIT are others


@query("maintenance_due", f"{C} SELECT conversation_id FROM c WHERE active AND conversation_id % 3 <> 2")
def maintenance_due(spark, sf_dir):
    return rounds.due(_debts(spark, sf_dir), "2024-02-01").select("conversation_id")


def _debts(spark, sf_dir):
    c = F.col("conversation_id")
    return conversations(spark, sf_dir).select("conversation_id", F.col("active").alias("pending"), F.lit(False).alias("running"), F.when(c % 2 == 0, " ").otherwise("threshold").alias("reason"), (c % 9).alias("retry_attempts"), F.when(c % 3 == 2, F.lit("2024-03-01").cast("timestamp")).when(c % 3 == 1, F.lit("2024-01-15").cast("timestamp")).alias("next_attempt_after"), F.lit(None).cast("string").alias("resolution_reason"), (c % 5).alias("maintenance_revision"))


@query("maintenance_reasons", f"{C} SELECT CASE WHEN conversation_id % 2 = 0 THEN 'reason unknown' ELSE 'threshold' END AS reason, count(*) AS n, count(*) AS active_n FROM c WHERE active GROUP BY 1")
def maintenance_reasons(spark, sf_dir):
    return maintain.debt_reasons(_debts(spark, sf_dir), conversations(spark, sf_dir))


@query("maintenance_failed", f"{C} SELECT conversation_id, conversation_id % 9 + 1 AS retry_attempts, strftime(TIMESTAMP '2024-02-01' + to_seconds((60 * least(64, pow(2, conversation_id % 9)))::BIGINT), '%Y-%m-%d %H:%M:%S') AS next_attempt_after, conversation_id % 5 + 1 AS maintenance_revision FROM c WHERE conversation_id % 4 = 0")
def maintenance_failed(spark, sf_dir):
    d = _debts(spark, sf_dir)
    out = rounds.failed(d, d.filter("conversation_id % 4 = 0"), "2024-02-01").filter("conversation_id % 4 = 0")
    return out.select("conversation_id", "retry_attempts", F.date_format("next_attempt_after", "yyyy-MM-dd HH:mm:ss").alias("next_attempt_after"), "maintenance_revision")


@query("maintenance_closed", f"{C} SELECT conversation_id, active AND conversation_id % 5 <> 2 AS pending, CASE WHEN active AND conversation_id % 5 = 2 THEN 'closed' END AS resolution_reason FROM c")
def maintenance_closed(spark, sf_dir):
    d = _debts(spark, sf_dir)
    return rounds.close_inactive(d, d.select("conversation_id", F.lit(2).cast("long").alias("revision"))).select("conversation_id", "pending", "resolution_reason")


@query("spending_windows", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 35999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def spending_windows(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return rounds.spending(e, 24, 600).select("event_id", "recent")


@query("compact_until_under")
def compact_until_under(spark, sf_dir):
    s, _ = rounds.until_under(messages(spark, sf_dir), 300)
    return status.context_tokens(s)


@query("threshold_rules", f"{C} SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN 0.6 WHEN session_key = 'agent:main:channel:5' THEN 0.5 WHEN conversation_id % 4 = 3 THEN 0.9 ELSE 0.75 END::DOUBLE AS threshold FROM c")
def threshold_rules(spark, sf_dir):
    c = F.col("conversation_id")
    s = conversations(spark, sf_dir).withColumn("model", F.when(c % 2 == 0, "m1").otherwise("m2")).withColumn("context_window", F.when(c % 4 == 3, 9000).otherwise(1000))
    return compact.threshold_for(s, [{"session_key": "agent:main:channel:5", "threshold": 0.5}, {"model": "m1", "threshold": 0.6}, {"min_window": 5000, "threshold": 0.9}], 0.75).select("conversation_id", "threshold")


@query("stubbed_context", f"{CONTEXT} SELECT conversation_id, ordinal, CASE WHEN role = 'assistant' AND ordinal < 2 THEN '[Stored tool result: file_x]' ELSE content END AS content FROM r")
def stubbed_context(spark, sf_dir):
    r = status.resolved_context(store(spark, sf_dir))
    tool = F.col("role") == "assistant"
    rows = r.withColumns({"role": F.when(tool, "tool").otherwise(F.col("role")), "large_content": F.when(tool, "file_x"), "in_tail": F.col("ordinal") >= 2})
    return assemble.stub(rows).select("conversation_id", "ordinal", "content")


@query("indexed_text", f"{M} SELECT message_id, CASE WHEN message_id % 2 = 0 THEN '[File: a.txt]' || chr(10) || 'line one' ELSE content END AS text FROM m")
def indexed_text(spark, sf_dir):
    even = F.lit("[File: a.txt]\n\nmeta\nUse describe to read\nExploration Summary:\nline one\nCall describe(x)")
    m = messages(spark, sf_dir).withColumn("content", F.when(F.col("message_id") % 2 == 0, even).otherwise(F.col("content")))
    return m.select("message_id", search.index_text(F.col("content")).alias("text"))


@query("tool_closure", f"{M}, p AS (SELECT conversation_id, seq, (seq + 1) // 2 AS call FROM m), a AS (SELECT DISTINCT conversation_id, call FROM p WHERE seq = 1) SELECT conversation_id, seq AS ordinal FROM p JOIN a USING (conversation_id, call)")
def tool_closure(spark, sf_dir):
    m = messages(spark, sf_dir)
    links = m.select("conversation_id", F.col("seq").alias("ordinal"), F.floor((F.col("seq") + 1) / 2).cast("string").alias("call_id"))
    return parts.tool_closure(links, links.filter("ordinal = 1"))


@query("engine_grep", f"{M} SELECT 'message' AS kind, message_id::VARCHAR AS id FROM m WHERE regexp_matches(content, 'th[a-z]+ing') ORDER BY created_at DESC, message_id DESC LIMIT 10")
def engine_grep(spark, sf_dir):
    return Engine(spark, sf_dir).grep("th[a-z]+ing", "messages", "regex", limit=10).select("kind", "id")


@query("engine_expand_query")
def engine_expand_query(spark, sf_dir):
    return Engine(spark, sf_dir).expand_query("with the", 500)


@query("unsummarized_deleted", f"{STORE} SELECT message_id FROM m WHERE NOT (seq % 2 = 0 AND message_id NOT IN (SELECT message_id FROM k))")
def unsummarized_deleted(spark, sf_dir):
    s = store(spark, sf_dir)
    return maintain.delete_unsummarized(s.messages, s.messages.filter("seq % 2 = 0"), s.summary_messages).select("message_id")


@query("tail_identity_matches", f"{M} SELECT message_id FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 3) WHERE identity_hash IN (SELECT identity_hash FROM m WHERE role = 'user')")
def tail_identity_matches(spark, sf_dir):
    m = messages(spark, sf_dir)
    return listing.tail_matches(m, 3, m.filter("role = 'user'")).select("message_id")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
