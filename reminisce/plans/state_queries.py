"""Queries of provider blocks, of how batches continue what is stored, and of changes of state, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.functions.text import format_seconds
from reminisce.operators import blocks, reconcile, state
from reminisce.plans.base import CONTEXT, CONVERSATIONS, MESSAGES, STORE, WALK
from reminisce.plans.store_queries import kept
from reminisce.sources.tables import conversations, messages

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}
M, C = f"WITH {MESSAGES}", f"WITH {MESSAGES}, {CONVERSATIONS}"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items()}


@query("batch_new_rows", f"""{M},
b AS (SELECT conversation_id, list(identity_hash ORDER BY seq) AS b FROM m WHERE seq >= 3 GROUP BY 1), s AS (SELECT conversation_id, list(identity_hash ORDER BY seq) AS s FROM m WHERE seq <= 5 AND conversation_id % 5 <> 0 GROUP BY 1),
k AS (SELECT b.conversation_id, b, s, unnest(range(1, len(b) + 1)) AS k FROM b LEFT JOIN s USING (conversation_id)),
u AS (SELECT conversation_id, max(CASE WHEN list_slice(b, k - least(k, len(s)) + 1, k) = list_slice(s, len(s) - least(k, len(s)) + 1, len(s)) AND (k < len(b) OR least(k, len(s)) > 1 OR (len(b) = 1 AND len(s) > 0)) THEN k END) AS until FROM k GROUP BY 1)
SELECT conversation_id, seq FROM m JOIN u USING (conversation_id) WHERE seq - 2 > coalesce(until, 0)""")
def batch_new_rows(spark, sf_dir):
    m = messages(spark, sf_dir)
    return reconcile.new_rows(m.filter("seq >= 3"), m.filter("seq <= 5 and conversation_id % 5 != 0")).select("conversation_id", "seq")


@query("batch_unknown_ids", f"{M} SELECT conversation_id, seq FROM m WHERE seq > 4 OR (conversation_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM m q WHERE q.conversation_id = m.conversation_id AND q.seq = m.seq + 1 AND q.seq <= 4)) OR conversation_id % 3 = 0")
def batch_unknown_ids(spark, sf_dir):
    name = lambda c: F.concat(F.lit("raw-"), c.cast("string"))
    own = F.when(F.col("conversation_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name(F.col("seq")), name(F.when(F.col("conversation_id") % 2 == 0, F.col("seq") + 1).otherwise(F.col("seq")))))
    m = messages(spark, sf_dir).withColumn("raw_ids", own)
    stored = messages(spark, sf_dir).filter("seq <= 4").withColumn("raw_ids", F.array(name(F.col("seq"))))
    return reconcile.without_known_ids(m, stored).select("conversation_id", "seq")


@query("batch_after_prefix", f"{M}, k AS (SELECT DISTINCT conversation_id, identity_hash FROM m WHERE seq <= 2), f AS (SELECT conversation_id, min(seq) AS f FROM m ANTI JOIN k USING (conversation_id, identity_hash) GROUP BY 1) SELECT conversation_id, seq FROM m JOIN f USING (conversation_id) WHERE seq >= f")
def batch_after_prefix(spark, sf_dir):
    m = messages(spark, sf_dir)
    return reconcile.replayed_prefix(m, m.filter("seq <= 2")).select("conversation_id", "seq")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text part of each message; a call with every second; a result alone with every third."""
    m = messages(spark, sf_dir)
    text = lambda c: F.lit(c).cast("string")
    part = lambda kind, ordinal, raw, content, given, output, failed: F.struct(F.lit(kind).alias("part_type"), F.lit(ordinal).alias("ordinal"), text(raw).alias("raw_type"), content.alias("text_content"), given.alias("tool_input"), output.alias("tool_output"), failed.alias("is_error"))
    none, no = text(None), F.lit(None).cast("boolean")
    said = part("text", 0, None, F.col("content"), none, none, no)
    call = part("tool", 1, "tool_use", none, F.concat(F.lit('{"n":'), F.col("seq").cast("string"), F.lit("}")), none, no)
    result = part("tool", 0, "tool_result", none, none, F.concat(F.lit("out "), F.col("seq").cast("string")), F.col("seq") % 2 == 1)
    p = m.select("message_id", "seq", F.explode(F.when(F.col("seq") % 3 == 0, F.array(result)).when(F.col("seq") % 2 == 0, F.array(said, call)).otherwise(F.array(said))).alias("p")).select("message_id", "seq", "p.*")
    tool = F.col("part_type") == "tool"
    return p.withColumns({"part_id": F.concat(F.lit("p"), F.col("message_id").cast("string")), "tool_call_id": F.when(tool & (F.col("seq") % 4 != 0), F.concat(F.lit("call-"), F.col("message_id").cast("string"))), "tool_name": F.when(tool, F.lit("grep"))})


@query("provider_blocks", f"""{M} SELECT message_id, CASE WHEN seq % 3 = 0 AND role = 'assistant' THEN 'tool' ELSE role END AS role, CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 THEN 2 ELSE 1 END AS n,
  CASE WHEN seq % 3 = 0 THEN '{{"type":"tool_result","name":"grep","output":"out ' || seq || '","is_error":' || (seq % 2 = 1) || CASE WHEN seq % 4 <> 0 THEN ',"tool_use_id":"call-' || message_id || '"' ELSE '' END || '}}'
    WHEN seq % 2 = 0 THEN '{{"type":"tool_use","id":"' || CASE WHEN seq % 4 <> 0 THEN 'call-' ELSE 'toolu_p' END || message_id || '","name":"grep","input":{{"n":' || seq || '}}}}' END AS last_block,
  CASE WHEN (seq % 3 = 0 OR seq % 2 = 0) AND seq % 4 <> 0 THEN 'call-' || message_id END AS tool_call_id, CASE WHEN seq % 3 = 0 THEN seq % 2 = 1 END AS is_error FROM m""")
def provider_blocks(spark, sf_dir):
    r = blocks.resolve(messages(spark, sf_dir), _parts(spark, sf_dir))
    last = F.element_at("blocks", -1)
    return r.select("message_id", "role", F.size("blocks").alias("n"), F.when(~last.startswith('{"type":"text"'), last).alias("last_block"), "tool_call_id", "is_error")


@query("prompt_token_usage", f"{M} SELECT message_id, CASE seq % 5 WHEN 0 THEN seq WHEN 1 THEN seq + 7 WHEN 2 THEN seq * 2 WHEN 3 THEN NULL ELSE 9 END AS tokens FROM m")
def prompt_token_usage(spark, sf_dir):
    s = F.col("seq").cast("string")
    usage = (
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit('{"currentTokenCount":'), s, F.lit(',"usage":{"input":1}}'))).when(F.col("seq") % 5 == 1, F.concat(F.lit('{"usage":{"input":'), s, F.lit(',"cacheRead":7}}')))
        .when(F.col("seq") % 5 == 2, F.concat(F.lit('{"usage":{"input":0},"promptCache":{"lastCallUsage":{"prompt_tokens":'), (F.col("seq") * 2).cast("string"), F.lit("}}}"))).when(F.col("seq") % 5 == 3, F.lit('{"usage":{"input":-4}')).otherwise(F.lit('{"lastCallUsage":{"inputTokens":9.5}}'))
    )
    return messages(spark, sf_dir).select("message_id", blocks.prompt_tokens(usage).alias("tokens"))


@query("media_annotated", f"{M} SELECT message_id, CASE WHEN seq % 3 = 0 THEN '[media attachment]' WHEN seq % 3 = 1 THEN role || ' [with media attachment]' ELSE role END AS text FROM m")
def media_annotated(spark, sf_dir):
    m = messages(spark, sf_dir)
    kinds = F.when(F.col("seq") % 3 == 2, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("image")))
    return m.select("message_id", blocks.annotate_media(F.when(F.col("seq") % 3 == 0, " ").otherwise(F.col("role")), kinds).alias("text"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    return conversations(spark, sf_dir).withColumns({"archived_at": none.cast("timestamp"), "archive_cause": none.cast("string"), "bootstrapped_at": F.when(F.col("conversation_id") % 2 == 0, F.lit("2024-01-05").cast("timestamp"))})


@query("conversations_created", f"""{C}, w AS (SELECT conversation_id + 100000 AS conversation_id, CASE WHEN conversation_id % 3 = 0 THEN 'new-' || (conversation_id // 6) ELSE session_key END AS session_key FROM c),
f AS (SELECT * FROM w WHERE session_key IS NULL OR session_key NOT IN (SELECT session_key FROM c WHERE active AND session_key IS NOT NULL))
SELECT conversation_id FROM c UNION ALL SELECT conversation_id FROM f WHERE session_key IS NULL UNION ALL SELECT min(conversation_id) FROM f WHERE session_key IS NOT NULL GROUP BY session_key""")
def conversations_created(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    key = F.when(F.col("conversation_id") % 3 == 0, F.concat(F.lit("new-"), F.floor(F.col("conversation_id") / 6).cast("string"))).otherwise(F.col("session_key"))
    return state.created(c, c.withColumns({"session_key": key, "conversation_id": F.col("conversation_id") + 100000, "active": F.lit(True)})).select("conversation_id")


@query("conversations_archived", f"{C} SELECT conversation_id, active AND conversation_id % 3 <> 0 AS active, CASE WHEN active AND conversation_id % 3 = 0 THEN 'reset' END AS archive_cause FROM c")
def conversations_archived(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    return state.archived(c, c.filter("conversation_id % 3 = 0").select("conversation_id", F.lit("reset").alias("cause")), "2024-02-01").select("conversation_id", "active", "archive_cause")


@query("conversations_rebound", f"{C} SELECT conversation_id, CASE WHEN conversation_id % 5 = 0 THEN 'again-' || conversation_id ELSE session_id END AS session_id, CASE WHEN conversation_id % 10 = 0 THEN 'key' ELSE session_key END AS session_key, active OR conversation_id % 5 = 0 AS active FROM c")
def conversations_rebound(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    s = c.filter("conversation_id % 5 = 0").select("conversation_id", F.concat(F.lit("again-"), F.col("conversation_id").cast("string")).alias("new_session_id"), F.when(F.col("conversation_id") % 10 == 0, "key").alias("new_key"))
    return state.rebound(c, s).select("conversation_id", "session_id", "session_key", "active")


@query("conversations_bootstrapped", f"{C} SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN '2024-01-05 00:00:00' WHEN conversation_id % 3 = 0 THEN '2024-02-01 00:00:00' END AS bootstrapped_at FROM c")
def conversations_bootstrapped(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    return state.marked_bootstrapped(c, c.filter("conversation_id % 3 = 0"), "2024-02-01").select("conversation_id", format_seconds(F.col("bootstrapped_at")).alias("bootstrapped_at"))


@query("parts_added", f"{M} SELECT message_id, 0 AS ordinal, 'old' AS text FROM m UNION ALL SELECT message_id, 1, 'new-a' FROM m WHERE seq % 2 = 0")
def parts_added(spark, sf_dir):
    m = messages(spark, sf_dir).select("message_id", "seq")
    part = lambda df, i, name, text: df.select("message_id", F.lit(i).alias("ordinal"), F.lit(name).alias("part_id"), F.lit(text).alias("text"))
    even = m.filter("seq % 2 = 0")
    new = part(m, 0, "x", "new").unionByName(part(even, 1, "b", "new-b")).unionByName(part(even, 1, "a", "new-a"))
    return state.parts_added(part(m, 0, "z", "old"), new).select("message_id", "ordinal", "text")


@query("context_appended", f"""{STORE}, ends AS (SELECT conversation_id, max(ordinal) AS last FROM x GROUP BY 1) SELECT conversation_id, ordinal FROM x
UNION ALL SELECT conversation_id, coalesce(last, -1) + row_number() OVER (PARTITION BY conversation_id ORDER BY seq) FROM m LEFT JOIN ends USING (conversation_id) WHERE seq <= 2""")
def context_appended(spark, sf_dir):
    s = kept(spark, sf_dir)
    new = s.messages.filter("seq <= 2").select("conversation_id", F.col("seq").alias("place"), F.lit("message").alias("item_type"), (F.col("message_id") + 500_000).alias("message_id"), F.lit(None).cast("string").alias("summary_id"))
    return state.appended(s.context_items, new).select("conversation_id", "ordinal")


@query("live_appended", f"""{M}, s AS (SELECT conversation_id, sum(token_count) AS t FROM m WHERE seq <= 3 GROUP BY 1)
SELECT conversation_id, seq AS place, token_count FROM (SELECT *, sum(token_count) OVER (PARTITION BY conversation_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS cum FROM m WHERE seq > 3) LEFT JOIN s USING (conversation_id) WHERE cum <= 700 - coalesce(t, 0)""")
def live_appended(spark, sf_dir):
    m = messages(spark, sf_dir)
    return state.appended_live(m.filter("seq <= 3"), m.filter("seq > 3").select("conversation_id", F.col("seq").alias("place"), "token_count"), 700)


@query("conversation_diagnostics", f"""{CONTEXT}, ids AS (SELECT DISTINCT conversation_id FROM m), a AS (SELECT conversation_id, role, count(*) AS n, sum(token_count)::BIGINT AS t FROM m GROUP BY ALL), b AS (SELECT conversation_id, kind, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT conversation_id, item_type, sum(token_count)::BIGINT AS t FROM r GROUP BY ALL)
SELECT conversation_id, (SELECT string_agg(role || ':' || n || ':' || t, ',' ORDER BY role) FROM a WHERE a.conversation_id = ids.conversation_id) AS messages, coalesce((SELECT string_agg(kind || ':' || n, ',' ORDER BY kind) FROM b WHERE b.conversation_id = ids.conversation_id), '') AS summaries,
  (SELECT string_agg(item_type || ':' || t, ',' ORDER BY item_type) FROM z WHERE z.conversation_id = ids.conversation_id) AS context, 0 AS without_sources, 0 AS dangling FROM ids""")
def conversation_diagnostics(spark, sf_dir):
    d = state.diagnostics(kept(spark, sf_dir), conversations(spark, sf_dir))
    said = lambda c, *keys: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[k].cast("string") for k in keys))), ","), F.lit(""))
    return d.select("conversation_id", said("messages", "role", "n", "tokens").alias("messages"), said("summaries", "kind", "n").alias("summaries"), said("context", "item_type", "tokens").alias("context"), "without_sources", "dangling")


@query("optional_rows", f"{C} SELECT conversation_id, conversation_id % 2 = 0 AS has_state, CASE WHEN conversation_id % 3 = 0 THEN 'hot' END AS cache FROM c")
def optional_rows(spark, sf_dir):
    c = conversations(spark, sf_dir)
    out = state.with_optional(c, bootstrap=c.filter("conversation_id % 2 = 0").select("conversation_id", F.lit("p").alias("path")), telemetry=c.filter("conversation_id % 3 = 0").select("conversation_id", F.lit("hot").alias("cache_state")))
    return out.select("conversation_id", F.col("bootstrap").isNotNull().alias("has_state"), F.col("telemetry.cache_state").alias("cache"))


@query("close_refusals", f"{C} SELECT conversation_id, CASE WHEN conversation_id % 2 = 1 THEN 'nothing pending' WHEN conversation_id % 8 = 0 THEN 'running' WHEN active THEN 'conversation is active' END AS refusal FROM c")
def close_refusals(spark, sf_dir):
    c = conversations(spark, sf_dir)
    debts = c.select("conversation_id", (F.col("conversation_id") % 2 == 0).alias("pending"), (F.col("conversation_id") % 8 == 0).alias("running"))
    return state.close_preflight(debts, c)


@query("repair_order", f"""{STORE}, n AS (SELECT derived_id AS summary_id FROM e UNION ALL SELECT summary_id FROM k), q AS (SELECT summary_id, count(*) AS n_sources FROM n GROUP BY 1)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY depth, first_seq, summary_id) AS place, summary_id, kind, depth, n_sources FROM s JOIN q USING (summary_id) WHERE first_seq % 2 = 1""")
def repair_order(spark, sf_dir):
    s = kept(spark, sf_dir)
    return state.repair_plan(s, s.summaries.filter("first_seq % 2 = 1"))


@query("summary_time_ranges", f"{WALK} SELECT root AS summary_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM w JOIN k ON k.summary_id = w.node JOIN m USING (message_id) GROUP BY 1")
def summary_time_ranges(spark, sf_dir):
    s = kept(spark, sf_dir)
    return state.time_ranges(s, s.summaries).select("summary_id", *(format_seconds(F.col(c)).alias(c) for c in ("first_at", "last_at")))


@query("single_root", f"{STORE} SELECT conversation_id, 1::BIGINT AS roots, sum(source_message_token_count)::BIGINT AS tokens FROM s WHERE kind = 'leaf' GROUP BY 1")
def single_root(spark, sf_dir):
    s = state.single_root(kept(spark, sf_dir))
    top = s.summaries.join(s.summary_edges.select(F.col("source_id").alias("summary_id")), "summary_id", "left_anti")
    return top.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("roots"), F.sum("source_message_token_count").alias("tokens"))
