"""Counts and sums over the store: totals, per-conversation statistics, health of contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reminisce.operators.compact import Store


def totals(store: Store, conversations: DataFrame) -> DataFrame:
    """One row of counts and sums over the whole store."""
    c = conversations.agg(F.count(F.lit(1)).alias("conversations"), F.count_if("active").alias("active_conversations"))
    m = store.messages.agg(F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("message_tokens"), F.min("created_at").alias("first_message_at"), F.max("created_at").alias("last_message_at"))
    s = store.summaries.agg(F.count(F.lit(1)).alias("summaries"), F.sum("token_count").alias("summary_tokens"), F.count_if(F.col("kind") == "leaf").alias("leaves"), F.max("depth").alias("max_depth"))
    x = context_tokens(store).agg(F.sum("context_tokens").alias("context_tokens"), F.sum("items").alias("context_items"))
    return c.crossJoin(m).crossJoin(s).crossJoin(x)  # one row each


def by_kind_depth(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.sum("source_message_token_count").alias("source_tokens"))


def resolved_context(store: Store) -> DataFrame:
    """Context items with the tokens, content and role of what they point to."""
    m = store.messages.select("message_id", F.col("token_count").alias("mt"), F.col("content").alias("mc"), "role", "seq")
    s = store.summaries.select("summary_id", F.col("token_count").alias("st"), F.col("content").alias("sc"), "depth")
    j = store.context_items.join(m, "message_id", "left").join(s, "summary_id", "left")
    return j.select("conversation_id", "ordinal", "item_type", "message_id", "summary_id", F.coalesce("mt", "st", F.lit(0)).alias("token_count"), F.coalesce("mc", "sc").alias("content"), F.coalesce("role", F.lit("summary")).alias("role"), "seq", "depth")


def context_tokens(store: Store) -> DataFrame:
    """Items and tokens of each conversation's context, by a union of its two kinds."""
    items = store.context_items
    m = items.join(store.messages.select("message_id", "token_count"), "message_id").select("conversation_id", "token_count", F.lit("message").alias("kind"))
    s = items.join(store.summaries.select("summary_id", "token_count"), "summary_id").select("conversation_id", "token_count", F.lit("summary").alias("kind"))
    return m.unionByName(s).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("items"), F.sum("token_count").alias("context_tokens"), F.count_if(F.col("kind") == "summary").alias("summary_items"))


def by_item_type(store: Store) -> DataFrame:
    """Of each conversation and kind of item: count, tokens and first ordinal."""
    r = resolved_context(store)
    return r.groupBy("conversation_id", "item_type").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.min("ordinal").alias("first_ordinal"))


def per_conversation(store: Store) -> DataFrame:
    """Messages, summaries and context of each conversation, zero where it has none."""
    m = store.messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("message_tokens"), F.max("seq").alias("max_seq"))
    s = store.summaries.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("summaries"), F.count_if(F.col("kind") == "leaf").alias("leaves"), F.count_if(F.col("kind") == "condensed").alias("condensed"), F.sum("token_count").alias("summary_tokens"), F.max("depth").alias("max_depth"))
    x = context_tokens(store)
    compressed = store.context_items.join(store.summaries.select("summary_id", "source_message_token_count", "descendant_token_count"), "summary_id").groupBy("conversation_id").agg(F.sum(F.col("source_message_token_count") + F.col("descendant_token_count")).alias("compressed_tokens"))
    out = m.join(s, "conversation_id", "left").join(x, "conversation_id", "left").join(compressed, "conversation_id", "left")
    return out.fillna(0, [c for c in out.columns if c not in ("conversation_id", "max_depth")])


def depths_in_context(store: Store) -> DataFrame:
    return store.context_items.join(store.summaries.select("summary_id", "depth"), "summary_id").groupBy("conversation_id").agg(F.array_sort(F.collect_set("depth")).alias("depths"), F.max("ordinal").alias("last_summary_ordinal"))


def shared_keys(conversations: DataFrame) -> DataFrame:
    """Session keys of several conversations, with the archived, active and all."""
    return conversations.filter("session_key is not null").groupBy("session_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active_n"), F.min("conversation_id").alias("first_id")).filter("n > 1")


def overflow(store: Store, budget: int, top: int = 5) -> DataFrame:
    """Of the contexts above the budget, the rows that contribute most tokens."""
    r = resolved_context(store)
    w = Window.partitionBy("conversation_id")
    r = r.withColumn("total", F.sum("token_count").over(w)).filter(F.col("total") > budget)
    o = w.orderBy(F.desc("token_count"), "ordinal")
    return r.withColumn("rank", F.row_number().over(o).cast("long")).filter(F.col("rank") <= top).select("conversation_id", "rank", "ordinal", "token_count", "total")


def duplicate_clusters(messages: DataFrame, top: int = 5, shown: int = 8) -> DataFrame:
    """Per conversation, the largest clusters of equal messages, and the first places of each."""
    g = messages.groupBy("conversation_id", "identity_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.slice(F.array_sort(F.collect_list("seq")), 1, shown).alias("seqs")).filter("n > 1")
    w = Window.partitionBy("conversation_id").orderBy(F.desc("n"), "identity_hash")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def covered_multiset(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """conversation_id, covered: whether every identity of the batch is stored at least as often."""
    need = batch.groupBy("conversation_id", "identity_hash").agg(F.count(F.lit(1)).alias("need"))
    have = stored.groupBy("conversation_id", "identity_hash").agg(F.count(F.lit(1)).alias("have"))
    return need.join(have, ["conversation_id", "identity_hash"], "left").groupBy("conversation_id").agg(F.bool_and(F.col("need") <= F.coalesce("have", F.lit(0))).alias("covered"))


def first_new(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """conversation_id, first_new: the first seq of the batch whose identity occurs more often so far than it is stored; null for none."""
    w = Window.partitionBy("conversation_id", "identity_hash").orderBy("seq")
    have = stored.groupBy("conversation_id", "identity_hash").agg(F.count(F.lit(1)).alias("have"))
    j = batch.withColumn("k", F.row_number().over(w)).join(have, ["conversation_id", "identity_hash"], "left")
    return j.groupBy("conversation_id").agg(F.min(F.when(F.col("k") > F.coalesce("have", F.lit(0)), F.col("seq"))).alias("first_new"))
