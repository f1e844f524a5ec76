"""Queries of search, files, ingestion, retention, health and streams, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.functions import text as X
from reminisce.operators import assemble, ingest, listing, maintain, reconcile, search, status, tail
from reminisce.plans import search as terms
from reminisce.plans.base import CONVERSATIONS, MESSAGES, STORE, est
from reminisce.sources import explore, tables, transcripts
from reminisce.sources.tables import conversations, messages
from reminisce.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


M, C = f"WITH {MESSAGES}", f"WITH {MESSAGES}, {CONVERSATIONS}"
AS_OF = "2024-02-01 00:00:00"


def snippet_sql(text: str, words: list[str]) -> str:
    """fallback_snippet as SQL, for words that occur."""
    at = "least(" + ", ".join(f"CASE WHEN instr(lower({text}), '{w}') > 0 THEN {{'at': instr(lower({text}), '{w}'), 'i': {i}, 'n': {len(w)}}} END" for i, w in enumerate(words)) + ")"
    return f"(SELECT CASE WHEN b > 0 THEN '...' ELSE '' END || trim(substr({text}, b + 1, e - b), ' ') || CASE WHEN e < length({text}) THEN '...' ELSE '' END FROM (SELECT greatest(0, h.at - 25) AS b, least(length({text}), h.at - 1 + h.n + 40) AS e FROM (SELECT {at} AS h)))"


@query("like_search", f"{M} SELECT message_id, {snippet_sql('content', ['with', 'the'])} AS snippet FROM m WHERE contains(lower(content), 'with') AND contains(lower(content), 'the') ORDER BY created_at DESC, message_id DESC LIMIT 50")
def like_search(spark, sf_dir):
    return search.like(messages(spark, sf_dir), "With, the").select("message_id", "snippet")


@query("regex_search", f"{M} SELECT message_id, regexp_extract(content, '(t[a-z]+ing)', 1) AS snippet FROM m WHERE regexp_matches(content, 't[a-z]+ing') ORDER BY created_at DESC, message_id DESC LIMIT 40")
def regex_search(spark, sf_dir):
    return search.regex(messages(spark, sf_dir), "t[a-z]+ing", 40).select("message_id", "snippet")


@query("regex_window", f"{M} SELECT message_id FROM (SELECT * FROM m ORDER BY created_at DESC, message_id DESC LIMIT 100) WHERE regexp_matches(content, 'and [a-z]+')")
def regex_window(spark, sf_dir):
    return search.regex(messages(spark, sf_dir), "and [a-z]+", None, scanned=100).select("message_id")


@query("regex_window_10000", f"{M} SELECT message_id FROM (SELECT * FROM m ORDER BY created_at DESC, message_id DESC LIMIT 10000) WHERE regexp_matches(content, 'and [a-z]+')")
def regex_window_10000(spark, sf_dir):
    return search.regex(messages(spark, sf_dir), "and [a-z]+", None, scanned=10_000).select("message_id")


_TERMS = "regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}\\p{Co}]+')"


def bm25_sql(words: list[str]) -> str:
    f = ", ".join(f"len(list_filter(w, lambda z: z = '{x}')) AS f{i}" for i, x in enumerate(words))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(words)))
    rank = " ".join(f"- greatest(ln((docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(words)))
    return f"tf AS (SELECT *, len(w) AS n, {f} FROM (SELECT *, {_TERMS} AS w FROM m)), df AS (SELECT count(*) AS docs, avg(n) AS mean, {d} FROM tf), hits AS (SELECT message_id, created_at, {rank} AS rank FROM tf, df WHERE {' AND '.join(f'f{i} > 0' for i in range(len(words)))})"


@query("full_text_rank", f"{M}, {bm25_sql(['with', 'the'])} SELECT message_id, round(rank, 9) AS rank FROM hits")
def full_text_rank(spark, sf_dir):
    return search.bm25(messages(spark, sf_dir), "with the").select("message_id", F.round("rank", 9).alias("rank"))


@query("full_text_relevance", f"{M}, {bm25_sql(['que'])} SELECT message_id FROM hits ORDER BY round(rank, 9), created_at DESC, message_id DESC LIMIT 20")
def full_text_relevance(spark, sf_dir):
    hits = search.bm25(messages(spark, sf_dir), "que").withColumn("rank", F.round("rank", 9))
    return search.ordered(hits, "relevance", AS_OF, 20).select("message_id")


@query("full_text_hybrid", f"{M}, {bm25_sql(['the'])}, h AS (SELECT message_id, created_at, round(rank / (1 + (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3.6e9 * 0.001), 9) AS hybrid FROM hits) SELECT message_id, hybrid FROM h ORDER BY hybrid, created_at DESC, message_id DESC LIMIT 20")
def full_text_hybrid(spark, sf_dir):
    out = search.ordered(search.bm25(messages(spark, sf_dir), "the"), "hybrid", AS_OF, 10**6).withColumn("hybrid", F.round("hybrid", 9))
    return out.orderBy("hybrid", F.desc("created_at"), F.desc("message_id")).limit(20).select("message_id", "hybrid")


@query("full_text_accents", f"""{M}, z AS (SELECT message_id, content || CASE message_id % 3 WHEN 0 THEN ' Erdős’s naïve Łódź proof' WHEN 1 THEN ' ERDO' || chr(779) || 'S' ELSE '' END AS content FROM m),
t AS (SELECT message_id, {_TERMS} AS w FROM z) SELECT message_id FROM t WHERE list_contains(w, 'erdos')""")
def full_text_accents(spark, sf_dir):
    m = messages(spark, sf_dir)
    m = m.withColumn("content", F.concat("content", F.when(F.col("message_id") % 3 == 0, " Erdős’s naïve Łódź proof").when(F.col("message_id") % 3 == 1, " ERDO\u030bS").otherwise("")))
    return search.bm25(m, "Erdős").select("message_id")


@query("full_text_phrase", f"{M}, w AS (SELECT message_id, {_TERMS} AS w FROM m) SELECT message_id FROM w WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
def full_text_phrase(spark, sf_dir):
    return search.bm25(messages(spark, sf_dir), '"of the"').select("message_id")


#: Words of the stem that the query asks for.
_THINGS = "('thing', 'things', 'thinged', 'thinging')"


@query("full_text_stemmed", f"""{M}, tf AS (SELECT message_id, len(w) AS n, len(list_filter(w, lambda z: z IN {_THINGS})) AS f FROM (SELECT *, {_TERMS} AS w FROM m)),
df AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f > 0) AS d FROM tf)
SELECT message_id, round(- greatest(ln((docs - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)), 9) AS rank FROM tf, df WHERE f > 0""")
def full_text_stemmed(spark, sf_dir):
    return search.bm25(messages(spark, sf_dir), "things", stem=True).select("message_id", F.round("rank", 9).alias("rank"))


@query("cjk_search", f"{M}, z AS (SELECT message_id, created_at, content || CASE WHEN message_id % 3 = 0 THEN ' 数据分析引擎' WHEN message_id % 3 = 1 THEN ' 分析报告' ELSE '' END AS content FROM m) SELECT message_id FROM z WHERE contains(content, '数据') OR contains(content, '据分') OR contains(content, '分析') ORDER BY created_at DESC, message_id DESC LIMIT 50")
def cjk_search(spark, sf_dir):
    m = messages(spark, sf_dir)
    m = m.withColumn("content", F.concat("content", F.when(F.col("message_id") % 3 == 0, " 数据分析引擎").when(F.col("message_id") % 3 == 1, " 分析报告").otherwise("")))
    return search.cjk(m, "数据分析", key="message_id").select("message_id")


@query("prompt_relevance", f"{M}, w AS (SELECT message_id, regexp_extract_all(lower(content), '[a-z0-9]{{2,}}') AS w FROM m) SELECT message_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda z: z IN ('of', 'the', 'und'))) / len(w)::DOUBLE END, 9) AS score FROM w")
def prompt_relevance(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", F.round(tail.relevance(F.col("content"), "of the und"), 9).alias("score"))


@query("document_tokens", f"SELECT doc_id, {est('text')} AS tokens FROM documents")
def document_tokens(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("describe_files", "SELECT 'file_' || substr(md5(doc_id::VARCHAR), 1, 16) AS file_id, octet_length(encode(text))::BIGINT AS byte_size, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_count, octet_length(encode(text)) > 2048 AS truncated FROM documents")
def describe_files(spark, sf_dir):
    return transcripts.describe_files(tables.large_files(spark, sf_dir), 2048).select("file_id", "byte_size", "line_count", "truncated")


@query("file_head")
def file_head(spark, sf_dir):
    return transcripts.describe_files(tables.large_files(spark, sf_dir), 2048).select("file_id", "head", "truncated")


@query("file_lines", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents")
def file_lines(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", transcripts.line_range(F.col("text"), 2, 4).alias("lines"))


@query("text_files", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 9")
def text_files(spark, sf_dir):
    return tables.large_files(spark, sf_dir).filter(search.text_like(F.col("mime_type"))).select("doc_id")


@query("file_search", "SELECT 'file_' || substr(md5(doc_id::VARCHAR), 1, 16) AS file_id, (length(split_part(text, 'Licensed', 1)) - length(replace(split_part(text, 'Licensed', 1), chr(10), '')) + 1)::BIGINT AS line, octet_length(encode(split_part(text, 'Licensed', 1)))::BIGINT AS byte_offset FROM documents WHERE doc_id % 10 <> 9 AND contains(text, 'Licensed')")
def file_search(spark, sf_dir):
    return search.file_matches(tables.large_files(spark, sf_dir), "Licensed").filter("place = 0").select("file_id", "line", "byte_offset")


@query("file_exploration", """WITH d AS (SELECT 'file_' || substr(md5(doc_id::VARCHAR), 1, 16) AS file_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l, string_split(text, chr(10)) AS a FROM documents)
SELECT file_id, 'text' AS kind, length(text) AS characters, len(a) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '^(?:#+ +|={2,} *)\\S'))) AS items, length(trim(regexp_replace(coalesce(l[1], ''), '[ \\t]+', ' ', 'g'), ' ')) > 160 AS clipped FROM d""")
def file_exploration(spark, sf_dir):
    return explore.explore(tables.large_files(spark, sf_dir)).select("file_id", "kind", "characters", "lines", "items", F.endswith("sample", F.lit("…")).alias("clipped"))


@query("conversations", f"{C} SELECT conversation_id, session_id, session_key, active, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM c")
def conversations_view(spark, sf_dir):
    return conversations(spark, sf_dir).select("conversation_id", "session_id", "session_key", "active", X.format_seconds(F.col("created_at")).alias("created_at"))


@query("resolve_conversation", f"{C} SELECT conversation_id FROM c WHERE session_key = 'agent:main:channel:4' AND active ORDER BY created_at DESC, conversation_id DESC LIMIT 1")
def resolve_conversation(spark, sf_dir):
    return listing.resolve(conversations(spark, sf_dir), "agent:main:channel:4", "session-3").select("conversation_id")


@query("current_conversations", f"{C} SELECT conversation_id, active FROM c QUALIFY row_number() OVER (PARTITION BY coalesce(session_key, session_id) ORDER BY active DESC, created_at DESC, conversation_id DESC) = 1")
def current_conversations(spark, sf_dir):
    return listing.current(conversations(spark, sf_dir)).select("conversation_id", "active")


@query("conversation_families", f"{C}, g AS (SELECT coalesce(session_key, session_id) AS key, string_agg(conversation_id::VARCHAR, ',' ORDER BY active DESC, created_at DESC, conversation_id DESC) AS family, count(*) AS family_size FROM c GROUP BY 1) SELECT conversation_id, family, family_size FROM c JOIN g ON g.key = coalesce(c.session_key, c.session_id)")
def conversation_families(spark, sf_dir):
    return listing.families(conversations(spark, sf_dir)).withColumn("family", F.array_join(F.col("family").cast("array<string>"), ","))


@query("shared_session_keys", f"{C} SELECT session_key, count(*) AS n, count(*) FILTER (active) AS active_n, min(conversation_id) AS first_id FROM c WHERE session_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def shared_session_keys(spark, sf_dir):
    return status.shared_keys(conversations(spark, sf_dir))


@query("session_scopes", f"{C} SELECT conversation_id, coalesce(regexp_matches(session_key, '^agent:[^:]*:cron:.*$'), false) AS ignored, coalesce(session_key LIKE 'agent:%:cron:%', false) AS cron, CASE WHEN session_key LIKE '%:channel:%' THEN session_key END AS scope FROM c")
def session_scopes(spark, sf_dir):
    key = F.col("session_key")
    return conversations(spark, sf_dir).select("conversation_id", listing.matches_any(key, ["agent:*:cron:**"]).alias("ignored"), listing.is_cron(key).alias("cron"), listing.channel_scope(key).alias("scope"))


_REPLAY = "(SELECT *, message_id AS id FROM m UNION ALL SELECT message_id + 500000, conversation_id, seq + 100, role, content, token_count, identity_hash, created_at + INTERVAL 2 HOUR, message_id + 500000 FROM m WHERE seq <= 3)"


def _with_replay(spark, sf_dir):
    m = messages(spark, sf_dir)
    again = m.filter("seq <= 3").withColumns({"message_id": F.col("message_id") + 500000, "seq": F.col("seq") + 100, "created_at": F.col("created_at") + F.expr("INTERVAL 2 HOURS")})
    return m.unionByName(again)


@query("replayed_messages", f"{M} SELECT message_id, created_at > min(created_at) OVER (PARTITION BY conversation_id, identity_hash) AS replayed FROM {_REPLAY}")
def replayed_messages(spark, sf_dir):
    return ingest.replays(_with_replay(spark, sf_dir)).select("message_id", "replayed")


@query("replay_floods", f"{M}, z AS (SELECT message_id, conversation_id, seq, role, identity_hash, created_at FROM m UNION ALL SELECT message_id + 500000, conversation_id, seq + 100, role, identity_hash, TIMESTAMP '2024-03-01' FROM m), y AS (SELECT * FROM z QUALIFY created_at > min(created_at) OVER (PARTITION BY conversation_id, identity_hash)) SELECT conversation_id, count(*) AS users FROM y WHERE role = 'user' GROUP BY conversation_id, date_trunc('second', created_at) HAVING count(*) >= 3")
def replay_floods(spark, sf_dir):
    m = messages(spark, sf_dir)
    z = m.unionByName(m.withColumns({"message_id": F.col("message_id") + 500000, "seq": F.col("seq") + 100, "created_at": F.lit("2024-03-01").cast("timestamp")}))
    return ingest.floods(z).select("conversation_id", "users")


@query("idempotent_batch", f"{M} SELECT message_id FROM m WHERE seq > 2 AND conversation_id % 2 = 0")
def idempotent_batch(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("entry_id", F.col("identity_hash"))
    half = m.filter("conversation_id % 2 = 0")
    batch = half.unionByName(half.withColumn("seq", F.col("seq") + 100))
    keyed = batch.withColumn("entry_id", F.concat(F.col("message_id").cast("string"), F.lit("-e")))
    stored = m.filter("seq <= 2").withColumn("entry_id", F.concat(F.col("message_id").cast("string"), F.lit("-e")))
    return ingest.once(keyed, stored, "entry_id").select("message_id")


@query("next_seq", f"{M} SELECT conversation_id, seq + max(seq) OVER (PARTITION BY conversation_id) AS seq FROM m")
def next_seq(spark, sf_dir):
    m = messages(spark, sf_dir)
    return ingest.next_seq(m, m).select("conversation_id", "seq")


@query("covered_frontier", f"{M} SELECT conversation_id, greatest(0, max(seq) - 2)::BIGINT AS covered FROM m GROUP BY 1")
def covered_frontier(spark, sf_dir):
    m = messages(spark, sf_dir)
    # the batch begins at the third stored message, all distinct, and goes on with new ones
    batch = m.filter("seq > 2").select("conversation_id", "seq", "identity_hash").unionByName(m.filter("seq <= 2").select("conversation_id", (F.col("seq") + 100).alias("seq"), F.concat("identity_hash", F.lit("-new")).alias("identity_hash")))
    return reconcile.align(batch, m)


@query("full_replay", f"{M} SELECT conversation_id, conversation_id % 2 = 0 AS replay FROM m GROUP BY 1")
def full_replay(spark, sf_dir):
    m = messages(spark, sf_dir)
    batch = m.withColumn("identity_hash", F.when((F.col("conversation_id") % 2 == 1) & (F.col("seq") == 1), "other").otherwise(F.col("identity_hash")))
    return ingest.full_replay(batch, m)


@query("entry_tail", f"{M} SELECT conversation_id, seq AS index, 3::BIGINT AS anchor FROM m WHERE seq > 3")
def entry_tail(spark, sf_dir):
    entries = messages(spark, sf_dir).select("conversation_id", F.col("seq").alias("index"), F.col("message_id").cast("string").alias("entry_id"))
    return ingest.entry_tail(entries, entries.filter("index <= 3")).select("conversation_id", "index", "anchor")


@query("adopted_ids", f"{M} SELECT message_id, 'late-' || message_id AS entry_id FROM m WHERE seq > 2 QUALIFY count(*) OVER (PARTITION BY conversation_id, identity_hash) = 1")
def adopted_ids(spark, sf_dir):
    m = messages(spark, sf_dir)
    stored = m.withColumn("entry_id", F.when(F.col("seq") <= 2, F.concat(F.lit("late-"), F.col("message_id").cast("string"))))
    incoming = m.withColumn("entry_id", F.concat(F.lit("late-"), F.col("message_id").cast("string")))
    return ingest.adopt_ids(stored, incoming)


@query("covered_multiset", f"{M} SELECT conversation_id, max(seq) <= 3 AS covered FROM m GROUP BY 1")
def covered_multiset(spark, sf_dir):
    m = messages(spark, sf_dir)
    return status.covered_multiset(m, m.filter("seq <= 3"))


@query("first_new_message", f"{M} SELECT conversation_id, min(CASE WHEN seq > 3 THEN seq END) AS first_new FROM m GROUP BY 1")
def first_new_message(spark, sf_dir):
    m = messages(spark, sf_dir)
    return status.first_new(m, m.filter("seq <= 3"))


@query("heartbeat_filter", f"{M} SELECT message_id FROM m WHERE conversation_id % 3 <> 0 UNION ALL SELECT message_id FROM (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conversation_id ORDER BY seq) AS turn, max(CASE WHEN role = 'assistant' THEN seq END) OVER (PARTITION BY conversation_id) AS last FROM m WHERE conversation_id % 3 = 0) QUALIFY NOT (turn > 0 AND seq <= coalesce(max(CASE WHEN role = 'assistant' THEN seq END) OVER (PARTITION BY conversation_id, turn), 0))")
def heartbeat_filter(spark, sf_dir):
    beats = F.col("conversation_id") % 3 == 0
    m = messages(spark, sf_dir).withColumn("content", F.when(beats & (F.col("role") == "user"), "please read HEARTBEAT.md").when(beats & (F.col("role") == "assistant"), " HEARTBEAT_OK ").otherwise(F.col("content")))
    return ingest.heartbeats(m).select("message_id")


@query("prune_candidates", f"{C}, g AS (SELECT conversation_id, max(created_at) AS last_at, count(*) AS messages, sum(token_count)::BIGINT AS tokens FROM m GROUP BY 1) SELECT conversation_id, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, messages, tokens FROM c JOIN g USING (conversation_id) WHERE last_at < TIMESTAMP '2024-01-03'")
def prune_candidates(spark, sf_dir):
    return maintain.prune_candidates(conversations(spark, sf_dir), messages(spark, sf_dir), "2024-01-03").withColumn("last_at", X.format_seconds(F.col("last_at")))


@query("prune_messages", f"{M} SELECT message_id FROM m WHERE conversation_id NOT IN (SELECT conversation_id FROM m GROUP BY 1 HAVING max(created_at) < TIMESTAMP '2024-01-03')")
def prune_messages(spark, sf_dir):
    m = messages(spark, sf_dir)
    gone = maintain.prune_candidates(conversations(spark, sf_dir), m, "2024-01-03")
    return maintain.prune({"messages": m}, gone)["messages"].select("message_id")


_CLEANERS = f"""{C}, q AS (SELECT conversation_id, count(*) AS message_count, arg_min(content, seq) AS p FROM m GROUP BY 1),
z AS (SELECT 'archived_subagents' AS filter_id, conversation_id, message_count FROM c JOIN q USING (conversation_id) WHERE starts_with(session_key, 'agent:main:subagent:') AND NOT active
  UNION ALL SELECT 'cron_sessions', conversation_id, message_count FROM c JOIN q USING (conversation_id) WHERE starts_with(session_key, 'agent:main:cron:')
  UNION ALL SELECT 'null_subagent_context', conversation_id, message_count FROM c JOIN q USING (conversation_id) WHERE session_key IS NULL AND NOT active AND starts_with(p, '[Subagent Context]'))"""


def _cleaners(spark, sf_dir):
    return maintain.cleaner_matches(conversations(spark, sf_dir), messages(spark, sf_dir))


@query("cleaner_matches", f"{_CLEANERS} SELECT * FROM z")
def cleaner_matches(spark, sf_dir):
    return _cleaners(spark, sf_dir).drop("first_preview")


@query("cleaner_counts", f"{_CLEANERS} SELECT filter_id, count(*) AS conversations, sum(message_count)::BIGINT AS messages FROM z GROUP BY 1 UNION ALL SELECT 'total', count(*), coalesce(sum(message_count), 0)::BIGINT FROM (SELECT DISTINCT conversation_id, message_count FROM z)")
def cleaner_counts(spark, sf_dir):
    return maintain.cleaner_counts(_cleaners(spark, sf_dir))


@query("cleaner_examples", f"{_CLEANERS} SELECT filter_id, conversation_id, row_number() OVER (PARTITION BY filter_id ORDER BY message_count DESC, conversation_id) AS rank FROM z QUALIFY rank <= 3")
def cleaner_examples(spark, sf_dir):
    return maintain.cleaner_examples(_cleaners(spark, sf_dir)).select("filter_id", "conversation_id", "rank")


@query("doctor_markers", f"""{STORE}, v AS (SELECT summary_id, CASE WHEN depth = 1 THEN '[Fallback summary; truncated for context management] ' || content WHEN first_seq = 1 THEN content || ' [Truncated from 900 tokens]' ELSE content END AS content FROM s)
SELECT summary_id, CASE WHEN starts_with(content, '[Fallback summary; truncated') THEN 'old' WHEN contains(content, '[Truncated from ') THEN 'new' END AS marker FROM v""")
def doctor_markers(spark, sf_dir):
    from reminisce.plans.store_queries import store

    s = store(spark, sf_dir).summaries
    broken = F.when(F.col("depth") == 1, F.concat(F.lit("[Fallback summary; truncated for context management] "), "content")).when(F.col("first_seq") == 1, F.concat("content", F.lit(" [Truncated from 900 tokens]"))).otherwise(F.col("content"))
    return s.select("summary_id", maintain.marker_kind(broken).alias("marker"))


@query("rollover_splits", f"""{C}, sp AS (SELECT conversation_id, min(created_at) AS a, max(created_at) AS b, count(*) AS n FROM m GROUP BY 1),
j AS (SELECT c.*, sp.a, sp.n, sp.a < lag(sp.b) OVER (PARTITION BY session_key ORDER BY created_at, conversation_id) AS o FROM c JOIN sp USING (conversation_id) WHERE session_key IS NOT NULL),
g AS (SELECT session_key, count(*) AS conversations, count(*) FILTER (active) AS an, coalesce(sum(n) FILTER (NOT active), 0)::BIGINT AS stranded, coalesce(bool_or(o), false) AS ov FROM j GROUP BY 1 HAVING count(*) > 1)
SELECT session_key, conversations, stranded, concat_ws('; ', CASE WHEN an <> 1 THEN 'not one active target' END, CASE WHEN stranded = 0 THEN 'nothing stranded' END, CASE WHEN ov THEN 'times overlap' END) AS reasons, an = 1 AND stranded > 0 AND NOT ov AS repairable FROM g""")
def rollover_splits(spark, sf_dir):
    return maintain.rollover_splits(conversations(spark, sf_dir), messages(spark, sf_dir))


@query("merge_order", f"""{C}, t AS (SELECT *, max(CASE WHEN active THEN conversation_id END) OVER (PARTITION BY session_key) AS target_id FROM c WHERE session_key IS NOT NULL)
SELECT message_id, target_id, row_number() OVER (PARTITION BY session_key ORDER BY t.created_at, t.conversation_id, seq, message_id) AS new_seq FROM t JOIN m ON m.conversation_id = t.conversation_id WHERE target_id IS NOT NULL""")
def merge_order(spark, sf_dir):
    return maintain.merge_order(conversations(spark, sf_dir), messages(spark, sf_dir))


@query("cache_states", f"""{M}, z AS (SELECT conversation_id, seq AS turn, CASE WHEN (conversation_id + seq) % 4 = 0 THEN 10 ELSE 0 END AS cached FROM m), y AS (SELECT *, count(*) FILTER (cached > 0) OVER (PARTITION BY conversation_id ORDER BY turn) AS g FROM z),
x AS (SELECT *, CASE WHEN cached > 0 THEN 0 ELSE count(*) FILTER (cached = 0) OVER (PARTITION BY conversation_id, g ORDER BY turn) END AS cold_streak FROM y)
SELECT conversation_id, turn, cold_streak, CASE WHEN cached > 0 THEN 'hot' WHEN cold_streak >= 2 THEN 'cold' WHEN g > 0 THEN 'hot' ELSE 'unknown' END AS state FROM x""")
def cache_states(spark, sf_dir):
    turns = messages(spark, sf_dir).select("conversation_id", F.col("seq").alias("turn"), F.when((F.col("conversation_id") + F.col("seq")) % 4 == 0, 10).otherwise(0).alias("cached"))
    return ingest.cache_states(turns).select("conversation_id", "turn", "cold_streak", "state")


@query("fair_split", f"{M} SELECT conversation_id AS query_id, seq AS bucket, (1000 // count(*) OVER (PARTITION BY conversation_id) + CASE WHEN row_number() OVER (PARTITION BY conversation_id ORDER BY seq) <= 1000 % count(*) OVER (PARTITION BY conversation_id) THEN 1 ELSE 0 END)::BIGINT AS share FROM m")
def fair_split(spark, sf_dir):
    return assemble.fair_split(messages(spark, sf_dir).select(F.col("conversation_id").alias("query_id"), F.col("seq").alias("bucket")), 1000)


@query("uncovered_live", f"{M} SELECT conversation_id, seq FROM m WHERE role = 'user' AND seq % 2 = 0 QUALIFY count(*) OVER (PARTITION BY conversation_id, content) = 1")
def uncovered_live(spark, sf_dir):
    m = messages(spark, sf_dir).filter("role = 'user'")
    return assemble.live_coverage(m.select("conversation_id", "seq", "content"), m.filter("seq % 2 = 1").select("conversation_id", "content")).select("conversation_id", "seq")


@query("event_properties", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.id')) AS found FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def event_properties(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.filter(listing.between(F.col("ts").cast("timestamp"), *listing.time_filter(between_="2024-01-10..2024-01-12"))).select("event_id", X.json_first(F.col("props"), "$.k", "$.id").alias("found"))


_CLOSED = "ts < (SELECT time_bucket(INTERVAL 1 HOUR, max(ts) - INTERVAL 1 HOUR) FROM events)"


@query("stream_windows", f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE {_CLOSED} GROUP BY ALL")
def stream_windows(spark, sf_dir):
    out = streams.run(streams.windowed(streams.events(spark, sf_dir), "1 hour"))
    return out.select(X.format_seconds(F.col("start")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_numbered", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def stream_numbered(spark, sf_dir):
    return streams.run(streams.numbered(streams.events(spark, sf_dir), "user_id", "event_id"))


@query("stream_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_deduplicated(spark, sf_dir):
    return streams.run(streams.deduplicated(streams.events(spark, sf_dir).select("event_id", "ts"), "event_id", "ts")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_floods", f"SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events WHERE {_CLOSED} GROUP BY ALL HAVING count(*) > 1")
def stream_floods(spark, sf_dir):
    out = streams.run(streams.over_limit(streams.events(spark, sf_dir), "1 hour", 1, "user_id"))
    return out.withColumn("start", X.format_seconds(F.col("start")))


@query("stream_telemetry")
def stream_telemetry(spark, sf_dir):
    e = streams.events(spark, sf_dir).select("user_id", F.when(F.col("event_type") == "view", 1).otherwise(0).alias("cached"))
    return streams.run(streams.telemetry(e, "user_id"), "update")


@query("expansion_routes")
def expansion_routes(spark, sf_dir):
    cases = [("what broke", 1, 4000.0, 1, False, True), ("timeline of the root cause", 6, 4000.0, 3, False, False), ("what broke", 0, 4000.0, None, True, False), ("how did it lead to this since 2019 and 2022", 3, 9000.0, 4, True, False)]
    rows = [(q, n, r.action, r.tokens, r.risk) for q, n, cap, depth, inc, probe in cases for r in [terms.route(q, n, cap, depth, inc, probe)]]
    return spark.createDataFrame(rows, "query string, candidates long, action string, tokens long, risk string")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
