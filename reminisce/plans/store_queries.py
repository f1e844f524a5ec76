"""Queries over messages, tails, compaction, contexts and the summary graph, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.functions.text import format_seconds
from reminisce.operators import assemble, compact, dag, listing, maintain, status, tail
from reminisce.plans.base import CONTEXT, CONVERSATIONS, MESSAGES, STORE, WALK, one_line as sql_one_line, tail as sql_tail
from reminisce.sources.tables import conversations, messages

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


def store(spark: SparkSession, sf_dir: str) -> compact.Store:
    return compact.sweep(messages(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> compact.Store:
    return compact.kept(store(spark, sf_dir))


M, C = f"WITH {MESSAGES}", f"WITH {MESSAGES}, {CONVERSATIONS}"


@query("fresh_tail", f"WITH {MESSAGES}, {sql_tail(3, 300)} SELECT conversation_id, count(*) AS n, sum(token_count)::BIGINT AS tokens, min(seq) AS first_seq, max(seq) AS last_seq FROM t WHERE in_tail GROUP BY conversation_id")
def fresh_tail(spark, sf_dir):
    t = tail.runtime_tail(messages(spark, sf_dir), 3, 300).filter("in_tail")
    return t.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("messages", f"{M} SELECT message_id, conversation_id, seq, role, token_count, identity_hash, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM m")
def messages_view(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", "conversation_id", "seq", "role", "token_count", "identity_hash", format_seconds(F.col("created_at")).alias("created_at"))


@query("messages_after", f"{M} SELECT conversation_id, seq, role FROM m WHERE conversation_id = 5 AND seq > 2 ORDER BY seq LIMIT 3")
def messages_after(spark, sf_dir):
    return listing.by_conversation(messages(spark, sf_dir), 5, 2, 3).select("conversation_id", "seq", "role")


@query("last_messages", f"{M} SELECT conversation_id, message_id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 3")
def last_messages(spark, sf_dir):
    return listing.last(messages(spark, sf_dir), 3).select("conversation_id", "message_id")


@query("newest_message", f"{M} SELECT conversation_id, max(message_id) AS message_id, arg_max(role, seq) AS role, arg_max(identity_hash, seq) AS identity_hash FROM m GROUP BY 1")
def newest_message(spark, sf_dir):
    return listing.newest(messages(spark, sf_dir))


@query("message_list", f"{M} SELECT message_id, {sql_one_line('substr(content, 1, 1024)', 240)} AS preview FROM m WHERE role IN ('user', 'system') AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-04'")
def message_list(spark, sf_dir):
    since, before = listing.time_filter(between_="2024-01-02..2024-01-04")
    return listing.message_list(messages(spark, sf_dir), ["user", "system"], since, before).select("message_id", "preview")


@query("message_page", f"{M} SELECT message_id FROM m WHERE created_at < TIMESTAMP '2024-01-03' OR (created_at = TIMESTAMP '2024-01-03' AND message_id < 48000002) ORDER BY created_at DESC, message_id DESC LIMIT 21")
def message_page(spark, sf_dir):
    after = listing.decode_cursor(listing.encode_cursor("messages", "2024-01-03 00:00:00", 48000002), "messages")
    return listing.page(messages(spark, sf_dir), "created_at", "message_id", 20, after).select("message_id")


@query("listing_tail", f"{M} SELECT conversation_id, message_id, cum FROM (SELECT *, row_number() OVER w AS rank, sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY seq DESC)) WHERE rank <= 4 AND (rank = 1 OR cum <= 400)")
def listing_tail(spark, sf_dir):
    return tail.listing_tail(messages(spark, sf_dir), 4, 400).select("conversation_id", "message_id", "cum")


@query("counted_tail", f"{M} SELECT message_id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 2")
def counted_tail(spark, sf_dir):
    return tail.counted_tail(messages(spark, sf_dir), 2).select("message_id")


@query("newest_suffix", f"{M} SELECT message_id FROM (SELECT message_id, sum(token_count) OVER (PARTITION BY conversation_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS cum FROM m) WHERE cum <= 500")
def newest_suffix(spark, sf_dir):
    return tail.newest_suffix(messages(spark, sf_dir), 500).select("message_id")


@query("budget_selection", f"""WITH {MESSAGES}, {sql_tail(2)},
b AS (SELECT *, greatest(0, 600 - sum(CASE WHEN in_tail THEN token_count ELSE 0 END) OVER (PARTITION BY conversation_id)) AS rest, sum(CASE WHEN in_tail THEN 0 ELSE token_count END) OVER (PARTITION BY conversation_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS older FROM t)
SELECT conversation_id, message_id, in_tail FROM b WHERE in_tail OR older <= rest""")
def budget_selection(spark, sf_dir):
    return tail.split_budget(messages(spark, sf_dir), 600, 2).filter("selected").select("conversation_id", "message_id", "in_tail")


_PROMPT = "the other of with nothing"


@query("prompt_aware_selection", f"""WITH RECURSIVE {MESSAGES}, {sql_tail(2)},
q AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda z: z IN ('the', 'other', 'of', 'with', 'nothing'))) / len(w)::DOUBLE END AS score FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]{{2,}}') AS w FROM t)),
b AS (SELECT conversation_id, greatest(0, 600 - sum(CASE WHEN in_tail THEN token_count ELSE 0 END)) AS budget FROM q GROUP BY 1),
o AS (SELECT q.*, budget, row_number() OVER (PARTITION BY q.conversation_id ORDER BY score DESC, seq DESC) AS place FROM q JOIN b USING (conversation_id) WHERE NOT in_tail),
p AS (
  SELECT conversation_id, place, message_id, token_count <= budget AS kept, CASE WHEN token_count <= budget THEN token_count ELSE 0 END AS used FROM o WHERE place = 1
  UNION ALL
  SELECT o.conversation_id, o.place, o.message_id, used + token_count <= budget, CASE WHEN used + token_count <= budget THEN used + token_count ELSE used END FROM p JOIN o ON o.conversation_id = p.conversation_id AND o.place = p.place + 1)
SELECT message_id FROM t WHERE in_tail UNION ALL SELECT message_id FROM p WHERE kept""")
def prompt_aware_selection(spark, sf_dir):
    return tail.prompt_aware(messages(spark, sf_dir), _PROMPT, 600, 2).select("message_id")


@query("compaction_evaluate", f"{M} SELECT conversation_id, sum(token_count)::BIGINT AS current_tokens, 750::BIGINT AS limit_tokens, sum(token_count) > 750 AS should_compact FROM m GROUP BY 1")
def compaction_evaluate(spark, sf_dir):
    return compact.evaluate(messages(spark, sf_dir), 1000, 0.75)


@query("leaf_trigger", f"WITH {MESSAGES}, {sql_tail(2)} SELECT conversation_id, sum(CASE WHEN in_tail THEN 0 ELSE token_count END)::BIGINT AS raw_tokens, sum(CASE WHEN in_tail THEN 0 ELSE token_count END) >= 300 AS triggered FROM t GROUP BY 1")
def leaf_trigger(spark, sf_dir):
    return compact.leaf_trigger(messages(spark, sf_dir), 300, 2)


@query("leaf_chunks", f"{STORE} SELECT conversation_id, seq, message_id, chunk::BIGINT AS chunk FROM f")
def leaf_chunks(spark, sf_dir):
    return compact.leaf_chunks(messages(spark, sf_dir), 150, 2)


_SUMMARY = "summary_id, conversation_id, kind, depth, content, token_count, descendant_count, descendant_token_count, source_message_token_count"


@query("summaries", f"{STORE} SELECT {_SUMMARY} FROM s")
def summaries(spark, sf_dir):
    return store(spark, sf_dir).summaries.select(*_SUMMARY.split(", "))


@query("summary_messages", f"{STORE} SELECT summary_id, message_id, ordinal FROM k")
def summary_messages(spark, sf_dir):
    return store(spark, sf_dir).summary_messages


@query("summary_edges", f"{STORE} SELECT derived_id, source_id, ordinal FROM e")
def summary_edges(spark, sf_dir):
    return store(spark, sf_dir).summary_edges


@query("context_items", f"{STORE} SELECT conversation_id, ordinal, item_type, message_id, summary_id FROM x")
def context_items(spark, sf_dir):
    return store(spark, sf_dir).context_items


@query("leaf_source_text", f"""{STORE} SELECT summary_id, md5(string_agg('[' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' | ' || role || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY k.ordinal)) AS digest FROM k JOIN m USING (message_id) GROUP BY 1""")
def leaf_source_text(spark, sf_dir):
    s = store(spark, sf_dir)
    return compact.source_text(s.messages, s.summary_messages).select("summary_id", F.md5("text").alias("digest"))


@query("summary_list", f"""{STORE} SELECT summary_id, depth, (SELECT count(*) FROM e WHERE derived_id = s.summary_id) AS source_count, (SELECT count(*) FROM e WHERE source_id = s.summary_id) AS derived_count, (SELECT count(*) FROM k WHERE k.summary_id = s.summary_id) AS message_count FROM s""")
def summary_list(spark, sf_dir):
    s = store(spark, sf_dir)
    return listing.summary_list(s.summaries, s.summary_edges, s.summary_messages).select("summary_id", "depth", "source_count", "derived_count", "message_count")


@query("store_totals", f"""{CONTEXT}, {CONVERSATIONS}
SELECT (SELECT count(*) FROM c) AS conversations, (SELECT count(*) FROM c WHERE active) AS active_conversations, (SELECT count(*) FROM m) AS messages, (SELECT sum(token_count)::BIGINT FROM m) AS message_tokens,
  (SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S') FROM m) AS first_message_at, (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM m) AS last_message_at,
  (SELECT count(*) FROM s) AS summaries, (SELECT sum(token_count)::BIGINT FROM s) AS summary_tokens, (SELECT count(*) FROM s WHERE kind = 'leaf') AS leaves, (SELECT max(depth) FROM s) AS max_depth,
  (SELECT sum(token_count)::BIGINT FROM r) AS context_tokens, (SELECT count(*) FROM r) AS context_items""")
def store_totals(spark, sf_dir):
    t = status.totals(kept(spark, sf_dir), conversations(spark, sf_dir))
    return t.withColumns({c: format_seconds(F.col(c)) for c in ("first_message_at", "last_message_at")})


@query("summaries_by_kind", f"{STORE} SELECT kind, depth, count(*) AS n, sum(token_count)::BIGINT AS tokens, sum(source_message_token_count)::BIGINT AS source_tokens FROM s GROUP BY ALL")
def summaries_by_kind(spark, sf_dir):
    return status.by_kind_depth(store(spark, sf_dir).summaries)


@query("resolved_context", f"{CONTEXT} SELECT conversation_id, ordinal, item_type, token_count, role, md5(content) AS digest FROM r")
def resolved_context(spark, sf_dir):
    return status.resolved_context(store(spark, sf_dir)).select("conversation_id", "ordinal", "item_type", "token_count", "role", F.md5("content").alias("digest"))


@query("context_tokens", f"{CONTEXT} SELECT conversation_id, count(*) AS items, sum(token_count)::BIGINT AS context_tokens, count(*) FILTER (item_type = 'summary') AS summary_items FROM r GROUP BY 1")
def context_tokens(spark, sf_dir):
    return status.context_tokens(store(spark, sf_dir))


@query("context_by_type", f"{CONTEXT} SELECT conversation_id, item_type, count(*) AS n, sum(token_count)::BIGINT AS tokens, min(ordinal) AS first_ordinal FROM r GROUP BY ALL")
def context_by_type(spark, sf_dir):
    return status.by_item_type(store(spark, sf_dir))


@query("conversation_stats", f"""{CONTEXT},
ms AS (SELECT conversation_id, count(*) AS messages, sum(token_count)::BIGINT AS message_tokens, max(seq) AS max_seq FROM m GROUP BY 1),
ss AS (SELECT conversation_id, count(*) AS summaries, count(*) FILTER (kind = 'leaf') AS leaves, count(*) FILTER (kind = 'condensed') AS condensed, sum(token_count)::BIGINT AS summary_tokens, max(depth) AS max_depth FROM s GROUP BY 1),
xs AS (SELECT r.conversation_id, count(*) AS items, sum(r.token_count)::BIGINT AS context_tokens, count(*) FILTER (item_type = 'summary') AS summary_items, sum(source_message_token_count + descendant_token_count)::BIGINT AS compressed_tokens FROM r LEFT JOIN s ON s.summary_id = r.summary_id GROUP BY 1)
SELECT conversation_id, messages, message_tokens, max_seq, coalesce(summaries, 0) AS summaries, coalesce(leaves, 0) AS leaves, coalesce(condensed, 0) AS condensed, coalesce(summary_tokens, 0) AS summary_tokens, max_depth, coalesce(items, 0) AS items, coalesce(context_tokens, 0) AS context_tokens, coalesce(summary_items, 0) AS summary_items, coalesce(compressed_tokens, 0) AS compressed_tokens
FROM ms LEFT JOIN ss USING (conversation_id) LEFT JOIN xs USING (conversation_id)""")
def conversation_stats(spark, sf_dir):
    return status.per_conversation(kept(spark, sf_dir))


@query("depths_in_context", f"{CONTEXT} SELECT conversation_id, max(ordinal) AS last_summary_ordinal, string_agg(DISTINCT depth::VARCHAR, ',' ORDER BY depth::VARCHAR) AS depths FROM r WHERE depth IS NOT NULL GROUP BY 1")
def depths_in_context(spark, sf_dir):
    return status.depths_in_context(store(spark, sf_dir)).withColumn("depths", F.array_join("depths", ","))


@query("context_overflow", f"{CONTEXT} SELECT conversation_id, rank, ordinal, token_count, total FROM (SELECT *, sum(token_count) OVER (PARTITION BY conversation_id)::BIGINT AS total, row_number() OVER (PARTITION BY conversation_id ORDER BY token_count DESC, ordinal) AS rank FROM r) WHERE total > 400 AND rank <= 5")
def context_overflow(spark, sf_dir):
    return status.overflow(store(spark, sf_dir), 400)


@query("duplicate_clusters", f"""{M}, d AS (SELECT * FROM m UNION ALL SELECT message_id + 500000, conversation_id, seq + 100, role, content, token_count, identity_hash, created_at FROM m WHERE seq % 2 = 0),
g AS (SELECT conversation_id, identity_hash, count(*) AS n, sum(token_count)::BIGINT AS tokens, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs FROM d GROUP BY ALL HAVING count(*) > 1)
SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC, identity_hash) AS rank FROM g QUALIFY rank <= 5""")
def duplicate_clusters(spark, sf_dir):
    m = messages(spark, sf_dir)
    d = m.unionByName(m.filter("seq % 2 = 0").withColumn("message_id", F.col("message_id") + 500000).withColumn("seq", F.col("seq") + 100))
    return status.duplicate_clusters(d).withColumn("seqs", F.array_join(F.col("seqs").cast("array<string>"), ","))


@query("reachable_sources", f"""{WALK},
n AS (SELECT DISTINCT root, node FROM w), v AS (SELECT DISTINCT n.root, k.message_id FROM n JOIN k ON k.summary_id = n.node)
SELECT n.root AS summary_id, count(*) - 1 AS n_sources, any_value(first_seq) AS first_seq, any_value(last_seq) AS last_seq, any_value(message_count) AS message_count, any_value(covered_tokens) AS covered_tokens
FROM n LEFT JOIN (SELECT root, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS message_count, sum(token_count)::BIGINT AS covered_tokens FROM v JOIN m USING (message_id) GROUP BY 1) q ON q.root = n.root GROUP BY 1""")
def reachable_sources(spark, sf_dir):
    return dag.reachable(kept(spark, sf_dir))


@query("derived_subtree", f"""{STORE},
u AS (SELECT summary_id AS root, summary_id AS node, 0::BIGINT AS level, '' AS path FROM s WHERE kind = 'leaf'
  UNION ALL SELECT u.root, e.derived_id, u.level + 1, u.path || '.' || format('{{:04d}}', e.ordinal) FROM u JOIN e ON e.source_id = u.node)
SELECT root, node, level, path FROM u QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY level, path) = 1""")
def derived_subtree(spark, sf_dir):
    return dag.derived_subtree(kept(spark, sf_dir))


@query("expand_summaries", f"""{WALK},
i AS (SELECT w.root, w.path, w.node, NULL::BIGINT AS message_id, s.token_count FROM w JOIN s ON s.summary_id = w.node WHERE level > 0
  UNION ALL SELECT w.root, w.path || '.m' || lpad(k.ordinal::VARCHAR, 6, '0'), w.node, k.message_id, m.token_count FROM w JOIN k ON k.summary_id = w.node JOIN m USING (message_id))
SELECT root, place, node, message_id, token_count, cum FROM (SELECT *, sum(token_count) OVER (PARTITION BY root ORDER BY path ROWS UNBOUNDED PRECEDING)::BIGINT AS cum, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM i) WHERE cum <= 300""")
def expand_summaries(spark, sf_dir):
    s = kept(spark, sf_dir)
    return dag.expand(s, s.summaries, 300)


@query("summary_sources", f"{STORE} SELECT derived_id, source_id, ordinal, s.kind, s.depth, s.token_count, s.conversation_id FROM e JOIN s ON s.summary_id = source_id JOIN s d ON d.summary_id = derived_id AND d.conversation_id = s.conversation_id")
def summary_sources(spark, sf_dir):
    return dag.sources(store(spark, sf_dir)).select("derived_id", "source_id", "ordinal", "kind", "depth", "token_count", "conversation_id")


@query("summary_roots", f"{STORE} SELECT summary_id, depth FROM s WHERE summary_id NOT IN (SELECT source_id FROM e)")
def summary_roots(spark, sf_dir):
    return dag.roots(store(spark, sf_dir)).select("summary_id", "depth")


@query("leaf_of_message", f"{STORE} SELECT message_id, min(summary_id) AS summary_id FROM k JOIN m USING (message_id) WHERE role = 'user' GROUP BY 1")
def leaf_of_message(spark, sf_dir):
    s = store(spark, sf_dir)
    return dag.leaves_of_messages(s.messages.filter("role = 'user'"), s)


@query("describe_summaries", f"""{STORE} SELECT summary_id, (SELECT string_agg(source_id, ',' ORDER BY ordinal) FROM e WHERE derived_id = s.summary_id) AS sources, (SELECT string_agg(message_id::VARCHAR, ',' ORDER BY ordinal) FROM k WHERE k.summary_id = s.summary_id) AS messages FROM s""")
def describe_summaries(spark, sf_dir):
    d = dag.describe(kept(spark, sf_dir))
    return d.select("summary_id", F.array_join("source_ids", ",").alias("sources"), F.array_join(F.col("message_ids").cast("array<string>"), ",").alias("messages"))


@query("depth_backfill", f"{WALK} SELECT root AS summary_id, CASE WHEN any_value(s.kind) = 'leaf' THEN 0 ELSE max(level) END::BIGINT AS depth FROM w JOIN s ON s.summary_id = root GROUP BY 1")
def depth_backfill(spark, sf_dir):
    s = kept(spark, sf_dir)
    return dag.backfill_depth(s.summaries, s.summary_edges)


@query("lineage_rollup", f"{STORE} SELECT summary_id, descendant_count, descendant_token_count, source_message_token_count, strftime(earliest_at, '%Y-%m-%d %H:%M:%S') AS earliest_at, strftime(latest_at, '%Y-%m-%d %H:%M:%S') AS latest_at FROM s")
def lineage_rollup(spark, sf_dir):
    return dag.rollup(kept(spark, sf_dir)).withColumns({c: format_seconds(F.col(c)) for c in ("earliest_at", "latest_at")})


@query("previous_summary", f"{STORE} SELECT summary_id, lag(summary_id) OVER (PARTITION BY conversation_id, depth ORDER BY first_seq, summary_id) AS previous_id FROM s")
def previous_summary(spark, sf_dir):
    return dag.previous_summary(store(spark, sf_dir).summaries)


@query("prior_context", f"""{STORE} SELECT summary_id, coalesce(CASE WHEN b IS NULL THEN a ELSE b || chr(10) || chr(10) || a END, '') AS prior FROM (SELECT summary_id, lag(content) OVER v AS a, lag(content, 2) OVER v AS b FROM s WINDOW v AS (PARTITION BY conversation_id, depth ORDER BY first_seq, summary_id))""")
def prior_context(spark, sf_dir):
    return dag.prior_context(store(spark, sf_dir).summaries)


@query("assemble_context", f"""{CONTEXT},
q AS (SELECT *, row_number() OVER v AS rank, max(CASE WHEN role = 'user' THEN ordinal END) OVER (PARTITION BY conversation_id) AS lu FROM r WINDOW v AS (PARTITION BY conversation_id ORDER BY ordinal DESC)),
z AS (SELECT *, rank <= 2 OR coalesce(ordinal >= lu, false) AS in_tail FROM q),
b AS (SELECT *, greatest(0, 400 - sum(CASE WHEN in_tail THEN token_count ELSE 0 END) OVER (PARTITION BY conversation_id)) AS rest, sum(CASE WHEN in_tail THEN 0 ELSE token_count END) OVER (PARTITION BY conversation_id ORDER BY ordinal DESC ROWS UNBOUNDED PRECEDING) AS older FROM z)
SELECT conversation_id, ordinal, item_type, message_id, summary_id, token_count, in_tail FROM b WHERE in_tail OR older <= rest""")
def assemble_context(spark, sf_dir):
    return assemble.assemble(store(spark, sf_dir), 400, 2)


@query("render_summaries", f"""{STORE}, v AS (SELECT *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM s)
SELECT summary_id, '<summary id="' || summary_id || '" kind="' || kind || '" depth="' || depth || '" descendant_count="' || descendant_count || '" trust="untrusted" earliest_at="' || strftime(earliest_at, '%Y-%m-%dT%H:%M:%S') || '" latest_at="' || strftime(latest_at, '%Y-%m-%dT%H:%M:%S') || '">'
  || coalesce((SELECT chr(10) || '  <parents>' || chr(10) || string_agg('    <summary_ref id="' || source_id || '" />', chr(10) ORDER BY ordinal) || chr(10) || '  </parents>' FROM e WHERE derived_id = v.summary_id), '') || chr(10) || '  <content>' || chr(10) || body || chr(10) || '  </content>' || chr(10) || '</summary>' AS xml FROM v""")
def render_summaries(spark, sf_dir):
    return assemble.render(store(spark, sf_dir))


@query("focus_overlay", f"""{WALK},
z AS (SELECT root AS summary_id, max(m.seq) AS max_seq FROM w JOIN k ON k.summary_id = w.node JOIN m USING (message_id) GROUP BY 1),
y AS (SELECT x.*, coalesce(max_seq <= 3 AND conversation_id % 2 = 0, false) AS covered FROM x LEFT JOIN z USING (summary_id))
SELECT conversation_id, ordinal, item_type, message_id, summary_id FROM y WHERE NOT covered
UNION ALL SELECT conversation_id, min(ordinal), 'focus_brief', NULL, 'brief_' || conversation_id FROM y WHERE covered GROUP BY conversation_id""")
def focus_overlay(spark, sf_dir):
    s = kept(spark, sf_dir)
    marks = s.messages.select("conversation_id").distinct().filter("conversation_id % 2 = 0").select("conversation_id", F.lit(3).cast("long").alias("covered_seq"), F.concat(F.lit("brief_"), F.col("conversation_id").cast("string")).alias("brief_id"))
    return assemble.overlay(s, marks)


@query("focus_watermark", f"""{WALK} SELECT root AS summary_id, strftime(max(s.latest_at), '%Y-%m-%d %H:%M:%S') AS covered_latest_at, max(m.seq) AS covered_message_seq FROM w JOIN s ON s.summary_id = w.node LEFT JOIN k ON k.summary_id = w.node LEFT JOIN m USING (message_id) GROUP BY 1""")
def focus_watermark(spark, sf_dir):
    s = kept(spark, sf_dir)
    return assemble.watermarks(s, s.summaries).withColumn("covered_latest_at", format_seconds(F.col("covered_latest_at")))


@query("context_source_hash", f"{STORE} SELECT conversation_id, sha256(string_agg(coalesce(message_id::VARCHAR, summary_id), '|' ORDER BY ordinal)) AS source_hash FROM x GROUP BY 1")
def context_source_hash(spark, sf_dir):
    return assemble.source_hash(store(spark, sf_dir))


@query("replace_range", f"""{STORE}, y AS (SELECT conversation_id, ordinal AS pos, item_type, message_id, summary_id FROM x WHERE ordinal > 1 UNION ALL SELECT DISTINCT conversation_id, 0, 'summary', NULL::BIGINT, 'sum_new' FROM x)
SELECT conversation_id, (row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1)::BIGINT AS ordinal, item_type, message_id, summary_id FROM y""")
def replace_range(spark, sf_dir):
    items = store(spark, sf_dir).context_items
    ranges = items.select("conversation_id").distinct().select("conversation_id", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("last"), F.lit("sum_new").alias("summary_id"))
    return compact.replace_range(items, ranges)


@query("dissolve_condensed", f"""{STORE}, y AS (SELECT x.conversation_id, x.ordinal AS pos, 0 AS then_, x.item_type, x.message_id, x.summary_id FROM x LEFT JOIN s USING (summary_id) WHERE coalesce(s.depth, 0) = 0
  UNION ALL SELECT x.conversation_id, x.ordinal, e.ordinal, 'summary', NULL, e.source_id FROM x JOIN e ON e.derived_id = x.summary_id)
SELECT conversation_id, (row_number() OVER (PARTITION BY conversation_id ORDER BY pos, then_) - 1)::BIGINT AS ordinal, item_type, message_id, summary_id FROM y""")
def dissolve_condensed(spark, sf_dir):
    s = store(spark, sf_dir)
    return compact.dissolve(s.context_items, s.summary_edges, s.summaries.filter("depth > 0"))


@query("eligible_depth", f"{CONTEXT} SELECT conversation_id, min(depth) AS depth FROM (SELECT conversation_id, depth, count(*) AS n, sum(token_count) AS t FROM r WHERE depth IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND sum(token_count) >= 20) GROUP BY 1")
def eligible_depth(spark, sf_dir):
    s = store(spark, sf_dir)
    return compact.eligible_depth(s.context_items, s.summaries, 2, 20)


@query("eligible_leaves", f"{STORE} SELECT conversation_id, 0::BIGINT AS depth FROM d0 GROUP BY 1 HAVING count(*) >= 2 AND sum(token_count) >= 40")
def eligible_leaves(spark, sf_dir):
    s = compact.sweep(messages(spark, sf_dir), depths=0)
    return compact.eligible_depth(s.context_items, s.summaries, 2, 40)


@query("new_session_context", f"{CONTEXT} SELECT conversation_id, ordinal, summary_id FROM r WHERE depth >= 1")
def new_session_context(spark, sf_dir):
    s = store(spark, sf_dir)
    return compact.prune_for_new_session(s.context_items, s.summaries, 1).select("conversation_id", "ordinal", "summary_id")


@query("transplant", f"""{STORE}, y AS (SELECT summary_id, 'sum_' || substr(md5(summary_id || '|' || (conversation_id + 1000)), 1, 16) AS new_id, conversation_id FROM s WHERE conversation_id < 10)
SELECT a.new_id AS derived_id, b.new_id AS source_id, ordinal FROM e JOIN y a ON a.summary_id = derived_id JOIN y b ON b.summary_id = source_id""")
def transplant(spark, sf_dir):
    s = store(spark, sf_dir)
    mapping = s.messages.filter("conversation_id < 10").select("conversation_id", (F.col("conversation_id") + 1000).alias("target_id")).distinct()
    return compact.transplant(s, mapping, 1_000_000)[1]


@query("transplant_all", f"""{STORE}, y AS (SELECT summary_id, 'sum_' || substr(md5(summary_id || '|' || (conversation_id + 1000000000)), 1, 16) AS new_id FROM s)
SELECT a.new_id AS derived_id, b.new_id AS source_id, ordinal FROM e JOIN y a ON a.summary_id = derived_id JOIN y b ON b.summary_id = source_id""")
def transplant_all(spark, sf_dir):
    s = store(spark, sf_dir)
    mapping = s.messages.select("conversation_id", (F.col("conversation_id") + 1_000_000_000).alias("target_id")).distinct()
    return compact.transplant(s, mapping, 1_000_000)[1]


@query("collectable_messages", f"{STORE} SELECT conversation_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS place, token_count FROM m WHERE role = 'assistant' AND message_id IN (SELECT message_id FROM k) AND message_id NOT IN (SELECT message_id FROM x WHERE message_id IS NOT NULL) QUALIFY place <= 25")
def collectable_messages(spark, sf_dir):
    s = store(spark, sf_dir)
    return maintain.collectable(s.messages, s.summary_messages, s.context_items)


@query("clamp_to_budget", f"""{M}, z AS (SELECT *, sum(token_count) OVER (PARTITION BY conversation_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 360 AS fits, max(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY conversation_id) AS lu FROM m),
y AS (SELECT *, min(CASE WHEN fits AND role <> 'tool' THEN seq END) OVER (PARTITION BY conversation_id) AS st FROM z)
SELECT message_id FROM y WHERE (fits AND seq >= st) OR seq = lu""")
def clamp_to_budget(spark, sf_dir):
    return assemble.clamp(messages(spark, sf_dir), 400).select("message_id")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
