"""Retention, health scans and maintenance of the store. Deletions are anti joins that give new tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Markers:
    """Texts that broken summaries hold; a store written by another tool has its own."""

    directive: str = "[Fallback summary; directive-shaped untrusted content omitted]"
    fallback: str = "[Fallback summary; truncated for context management]"
    truncated: str = "[Truncated from "
    bare: str = "[Truncated for context management]"
    emergency_model: str = "emergency-fallback"
    #: Within so many characters of the end.
    truncated_window: int = 40
    fallback_window: int = 80


def retention_days(text: str) -> int | None:
    """Days of `90d`, `3m` (30 days each) or `1y` (365); None for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*([dmy])\s*", text.lower()) if isinstance(text, str) else None
    return int(m[1]) * {"d": 1, "m": 30, "y": 365}[m[2]] if m and int(m[1]) > 0 else None


def prune_candidates(conversations: DataFrame, messages: DataFrame, cutoff: str) -> DataFrame:
    """Conversations whose newest message, or creation without any, is before the cutoff, with what goes with them."""
    m = messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_message_at"), F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("tokens"))
    j = conversations.join(m, "conversation_id", "left").withColumn("last_at", F.coalesce("last_message_at", "created_at"))
    return j.filter(F.col("last_at") < F.lit(cutoff).cast("timestamp")).select("conversation_id", "last_at", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def prune(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the conversations that go."""
    keys = gone.select("conversation_id")
    return {k: df.join(keys, "conversation_id", "left_anti") if "conversation_id" in df.columns else df for k, df in tables.items()}


def delete_unsummarized(messages: DataFrame, wanted: DataFrame, links: DataFrame) -> DataFrame:
    """messages without the wanted ones that no summary covers."""
    gone = wanted.select("message_id").join(links.select("message_id"), "message_id", "left_anti")
    return messages.join(gone, "message_id", "left_anti")


def cleaner_matches(conversations: DataFrame, messages: DataFrame, agents: tuple[str, ...] = ("main",)) -> DataFrame:
    """filter_id, conversation_id, message_count, first_preview: archived subagents and cron runs of these agents, and archived conversations without a key that begin like a subagent's."""
    w = Window.partitionBy("conversation_id").orderBy("seq", "created_at", "message_id")
    first = messages.withColumn("_r", F.row_number().over(w)).withColumn("message_count", F.count(F.lit(1)).over(Window.partitionBy("conversation_id"))).filter("_r = 1").select("conversation_id", "message_count", F.substring("content", 1, 256).alias("first_preview"))
    j = conversations.join(first, "conversation_id")
    lane = lambda name: F.coalesce(reduce(lambda a, b: a | b, [F.col("session_key").startswith(f"agent:{x}:{name}:") & (F.length("session_key") > len(f"agent:{x}:{name}:")) for x in agents]), F.lit(False))
    arms = [("archived_subagents", lane("subagent") & ~F.col("active")), ("cron_sessions", lane("cron")), ("null_subagent_context", F.col("session_key").isNull() & ~F.col("active") & F.col("first_preview").startswith("[Subagent Context]"))]
    out = None
    for name, test in arms:
        arm = j.filter(test).select(F.lit(name).alias("filter_id"), "conversation_id", "message_count", "first_preview")
        out = arm if out is None else out.unionByName(arm)
    return out


def cleaner_counts(matches: DataFrame) -> DataFrame:
    """Conversations and messages by filter, and in all, each conversation once."""
    each = matches.groupBy("filter_id").agg(F.count(F.lit(1)).alias("conversations"), F.sum("message_count").alias("messages"))
    total = matches.dropDuplicates(["conversation_id"]).agg(F.lit("total").alias("filter_id"), F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    return each.unionByName(total)


def cleaner_examples(matches: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("filter_id").orderBy(F.desc("message_count"), "conversation_id")
    return matches.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def marker_kind(content: Column, model: Column | None = None, markers: Markers = Markers()) -> Column:
    """What is wrong with a summary: old or fallback markers at the start, the directive marker anywhere, others near the end, an emergency model; else null."""
    left = lambda m: F.when(F.instr(content, m) > 0, F.length(content) - F.instr(content, m) + 1)
    out = F.when(content.startswith(markers.directive), "fallback").when(content.startswith(markers.fallback), "old").when(F.instr(content, markers.directive) > 0, "fallback")
    out = out.when(left(markers.truncated) < markers.truncated_window, "new").when(left(markers.fallback) < markers.fallback_window, "fallback")
    if model is not None:
        out = out.when(F.trim(model) == markers.emergency_model, "emergency").when((F.trim(model) == "unknown") & (F.instr(content, markers.bare) > 0), "emergency")
    return out


def doctor_targets(summaries: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """Broken summaries in the order of repair: leaves of the context by ordinal, other leaves, then condensed ones by depth."""
    n = edges.groupBy(F.col("derived_id").alias("summary_id")).agg(F.count(F.lit(1)).alias("source_count"))
    t = summaries.withColumn("marker", marker_kind(F.col("content"))).filter("marker is not null").join(n, "summary_id", "left").join(items.select("summary_id", "ordinal"), "summary_id", "left")
    rank = F.when((F.col("kind") == "leaf") & F.col("ordinal").isNotNull(), 0).when(F.col("kind") == "leaf", 1).otherwise(2)
    w = Window.partitionBy("conversation_id").orderBy(rank, F.when(F.col("kind") == "leaf", F.col("ordinal")).otherwise(F.col("depth")), "earliest_at", "summary_id")
    return t.withColumn("place", F.row_number().over(w).cast("long")).select("conversation_id", "place", "summary_id", "marker", F.coalesce("source_count", F.lit(0)).alias("source_count"))


def debt_reasons(maintenance: DataFrame, conversations: DataFrame) -> DataFrame:
    """Open debts by reason, blank reasons as unknown."""
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("reason unknown"))
    return maintenance.filter("pending").join(conversations.select("conversation_id", "active"), "conversation_id").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active_n"))


def rollover_splits(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Session keys whose conversations were split: whether they can be joined, and the reasons against it."""
    span = messages.groupBy("conversation_id").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count(F.lit(1)).alias("n"))
    c = conversations.filter("session_key is not null").join(span, "conversation_id", "left")
    w = Window.partitionBy("session_key").orderBy("created_at", "conversation_id")
    c = c.withColumn("overlaps", F.col("a") < F.lag("b").over(w))
    g = c.groupBy("session_key").agg(F.count(F.lit(1)).alias("conversations"), F.count_if("active").alias("active_n"), F.sum(F.when(~F.col("active"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("stranded"), F.coalesce(F.bool_or("overlaps"), F.lit(False)).alias("overlaps")).filter("conversations > 1")
    reasons = F.array_compact(F.array(F.when(F.col("active_n") != 1, "not one active target"), F.when(F.col("stranded") == 0, "nothing stranded"), F.when(F.col("overlaps"), "times overlap")))
    return g.select("session_key", "conversations", "stranded", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("repairable"))


def merge_order(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """message_id, target_id, new_seq: messages of all conversations of a session key as one, by conversation, then seq."""
    c = conversations.filter("session_key is not null")
    w = Window.partitionBy("session_key")
    c = c.withColumn("target_id", F.max(F.when(F.col("active"), F.col("conversation_id"))).over(w)).filter("target_id is not null")
    o = w.orderBy("created_at", "conversation_id", "seq", "message_id")
    return c.select("session_key", "conversation_id", "target_id", "created_at").join(messages.select("conversation_id", "message_id", "seq"), "conversation_id").withColumn("new_seq", F.row_number().over(o).cast("long")).select("message_id", "target_id", "new_seq")


def collectable(messages: DataFrame, links: DataFrame, items: DataFrame, role: str = "assistant", limit: int | None = 25) -> DataFrame:
    """Messages of a role that a summary covers and the context no longer holds, the first `limit` of each conversation; all with None."""
    w = Window.partitionBy("conversation_id").orderBy("seq")
    j = messages.filter(F.col("role") == role).join(links.select("message_id"), "message_id", "left_semi").join(items.filter("message_id is not null").select("message_id"), "message_id", "left_anti")
    return j.withColumn("place", F.row_number().over(w).cast("long")).filter(F.lit(True) if limit is None else F.col("place") <= limit).select("conversation_id", "message_id", "place", "token_count")


def retry_after(attempts: Column, base_seconds: int) -> Column:
    """Seconds until a failed debt is tried again: the base doubled each time, 64 times the base at most."""
    return F.lit(base_seconds) * F.least(F.lit(64.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1))).cast("long")
