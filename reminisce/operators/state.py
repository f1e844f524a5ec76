"""Changes of state as new tables: conversations, contexts, parts; what a report says of one conversation; repairs in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.functions.text import xml_escape
from reminisce.operators import compact, dag
from reminisce.operators.ingest import keep_first
from reminisce.sources.scratch import keep


def parts_added(parts: DataFrame, new: DataFrame) -> DataFrame:
    """parts and the new ones; of a message's repeated ordinal the stored part stays, else the one of the smallest part_id."""
    both = parts.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return keep_first(both.withColumn("_k", F.struct("_o", "part_id")), ["message_id", "ordinal"], "_k").drop("_o", "_k")


def created(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """conversations and those asked for (conversation_id, session_id, session_key, active, ...) whose key no active one has; of several with a key the smallest id is made."""
    held = conversations.filter("active and session_key is not null").select("session_key")
    fresh = asked.join(held, "session_key", "left_anti").select(*asked.columns)
    one = keep_first(fresh.filter("session_key is not null"), ["session_key"], "conversation_id")
    return conversations.unionByName(one.unionByName(fresh.filter("session_key is null")).select(*conversations.columns))


def archived(conversations: DataFrame, gone: DataFrame, at: str) -> DataFrame:
    """conversations where those of gone (conversation_id, cause) are inactive since a time, if they were active; others stay as they are."""
    j = conversations.join(gone.select("conversation_id", F.col("cause").alias("_cause")), "conversation_id", "left")
    hit = F.col("_cause").isNotNull() & F.col("active")
    return j.withColumns({"archived_at": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("archived_at")), "archive_cause": F.when(hit, F.col("_cause")).otherwise(F.col("archive_cause")), "active": F.col("active") & ~hit}).select(*conversations.columns)


def rebound(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """conversations where those of sessions (conversation_id, new_session_id, new_key) are active again under the new session; a null key leaves the old."""
    j = conversations.join(sessions, "conversation_id", "left")
    hit = F.col("new_session_id").isNotNull()
    changes = {
        "session_id": F.coalesce("new_session_id", "session_id"), "session_key": F.when(hit, F.coalesce("new_key", "session_key")).otherwise(F.col("session_key")), "active": F.col("active") | hit,
        "archived_at": F.when(~hit, F.col("archived_at")), "archive_cause": F.when(~hit, F.col("archive_cause")),
    }
    return j.withColumns(changes).select(*conversations.columns)


def marked_bootstrapped(conversations: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """conversations where the first time stays that each of ids was bootstrapped."""
    j = conversations.join(ids.select("conversation_id", F.lit(at).cast("timestamp").alias("_at")), "conversation_id", "left")
    return j.withColumn("bootstrapped_at", F.coalesce("bootstrapped_at", "_at")).select(*conversations.columns)


def soft_reset(state: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Bootstrap states where those of ids bear the time up to which they were pruned."""
    j = state.join(ids.select("conversation_id", F.lit(at).cast("timestamp").alias("_at")), "conversation_id", "left")
    return j.withColumn("soft_reset_pruned_at", F.coalesce("_at", "soft_reset_pruned_at")).select(*state.columns)


def appended(items: DataFrame, new: DataFrame) -> DataFrame:
    """Context items and the new ones (conversation_id, place, item_type, message_id, summary_id) after the last ordinal, in order of place."""
    last = items.groupBy("conversation_id").agg(F.max("ordinal").alias("_last"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("place"))
    more = new.join(last, "conversation_id", "left").withColumn("ordinal", (F.coalesce("_last", F.lit(-1)) + place).cast("long"))
    return items.unionByName(more.select(*items.columns))


def appended_live(items: DataFrame, live: DataFrame, budget: int) -> DataFrame:
    """conversation_id, place, token_count of the newest live inputs (place, token_count) that fit beside the items' tokens, up to the first that doesn't."""
    spent = items.groupBy("conversation_id").agg(F.sum("token_count").alias("_spent"))
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    j = live.withColumn("_cum", F.sum("token_count").over(newest)).join(spent, "conversation_id", "left")
    return j.filter(F.col("_cum") <= budget - F.coalesce("_spent", F.lit(0))).select("conversation_id", "place", "token_count")


def with_optional(conversations: DataFrame, **tables: DataFrame) -> DataFrame:
    """conversations with a struct of each table's row, null where it has none; each table has a row a conversation."""
    out = conversations
    for name, t in tables.items():
        out = out.join(t.select("conversation_id", F.struct(*(c for c in t.columns if c != "conversation_id")).alias(name)), "conversation_id", "left")
    return out


def diagnostics(store: compact.Store, conversations: DataFrame) -> DataFrame:
    """A row a conversation with structs: messages by role, summaries by kind, context by type, and the lineage's faults."""
    counted = lambda df, by, name: df.groupBy("conversation_id", by).agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens")).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct(by, "n", "tokens"))).alias(name))
    items = store.context_items.join(store.messages.select("message_id", F.col("token_count").alias("m")), "message_id", "left").join(store.summaries.select("summary_id", F.col("token_count").alias("s")), "summary_id", "left").withColumn("token_count", F.coalesce("m", "s", F.lit(0)))
    linked = store.summary_edges.select(F.col("derived_id").alias("summary_id")).unionByName(store.summary_messages.select("summary_id")).distinct()
    bare = store.summaries.join(linked, "summary_id", "left_anti").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("without_sources"))
    lost = store.context_items.filter("message_id is not null").join(store.messages.select("message_id"), "message_id", "left_anti").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("dangling"))
    out = conversations.select("conversation_id")
    for t in (counted(store.messages, "role", "messages"), counted(store.summaries, "kind", "summaries"), counted(items, "item_type", "context"), bare, lost):
        out = out.join(t, "conversation_id", "left")
    return out.fillna(0, ["without_sources", "dangling"])


def close_preflight(maintenance: DataFrame, conversations: DataFrame) -> DataFrame:
    """conversation_id, refusal: why a debt can't be closed by hand (null if it can): nothing pending, running, or its conversation active."""
    j = maintenance.join(conversations.select("conversation_id", F.col("active").alias("_active")), "conversation_id", "left")
    refusal = F.when(F.col("_active").isNull(), "no conversation").when(~F.col("pending"), "nothing pending").when(F.col("running"), "running").when(F.col("_active"), "conversation is active")
    return j.select("conversation_id", refusal.alias("refusal"))


def brief_xml(brief_id: Column, covered_at: Column, content: Column) -> Column:
    """A focus brief as it stands in a context."""
    return F.concat(F.lit('<focus_brief id="'), xml_escape(brief_id), F.lit('" covered_until="'), F.coalesce(covered_at, F.lit("")), F.lit('">\n'), content, F.lit("\n</focus_brief>"))


def repair_plan(store: compact.Store, broken: DataFrame) -> DataFrame:
    """conversation_id, place, summary_id, kind, depth, n_sources of broken summaries in the order of repair: sources before what is made from them."""
    sources = store.summary_edges.select(F.col("derived_id").alias("summary_id")).unionByName(store.summary_messages.select("summary_id")).groupBy("summary_id").agg(F.count(F.lit(1)).alias("n_sources"))
    s = store.summaries.join(broken.select("summary_id"), "summary_id", "left_semi").join(sources, "summary_id", "left").fillna(0, ["n_sources"])
    order = Window.partitionBy("conversation_id").orderBy("depth", "first_seq", "summary_id")
    return s.select("conversation_id", F.row_number().over(order).cast("long").alias("place"), "summary_id", "kind", "depth", "n_sources")


def time_ranges(store: compact.Store, summary_ids: DataFrame) -> DataFrame:
    """summary_id, first_at, last_at: the times of the messages that each reaches."""
    nodes = dag.closure(store.summary_edges, summary_ids).select(F.col("root").alias("summary_id"), F.col("node"))
    j = nodes.join(store.summary_messages.withColumnRenamed("summary_id", "node"), "node").join(store.messages.select("message_id", "created_at"), "message_id")
    return j.groupBy("summary_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def single_root(store: compact.Store, fanout: int = 2) -> compact.Store:
    """The store condensed further, whatever the depths, until each conversation has one summary that no other is made from."""
    summaries, edges = store.summaries, store.summary_edges
    while True:
        top = summaries.join(edges.select(F.col("source_id").alias("summary_id")), "summary_id", "left_anti")
        top = keep(top.withColumn("_depth", F.col("depth")).withColumn("depth", F.max("depth").over(Window.partitionBy("conversation_id"))), "tops")
        if top.groupBy("conversation_id").count().filter("count > 1").isEmpty():
            return compact.kept(compact.Store(store.messages, summaries, store.summary_messages, edges, compact.context(store.messages, summaries, edges, store.summary_messages)))
        more, links = [], []
        for depth in sorted(r["depth"] for r in top.select("depth").distinct().collect()):  # a row a depth
            m, e = compact.condensed_pass(top.drop("_depth"), depth, fanout)
            more.append(keep(m, "summaries"))
            links.append(keep(e, "summary_edges"))
        for m, e in zip(more, links, strict=True):
            summaries, edges = summaries.unionByName(m), edges.unionByName(e)
