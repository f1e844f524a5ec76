"""Repeated compaction of all conversations: sweeps until contexts fit, and deferred debts that come due.

A round is a whole-table pass, and the loop on the driver looks at one number: how many conversations moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reminisce.operators import compact, status
from reminisce.operators.maintain import retry_after
from reminisce.sources.scratch import keep


def prefix_target(budget: int, threshold: float, chunk: int, condensed_target: int, configured: int | None = None) -> int:
    """Tokens that summaries may take at the front of a context."""
    if configured and configured > 0:
        return int(configured)
    return max(condensed_target, min(chunk, int(max(1, int(threshold * budget)) * 0.5)))


def _kept(messages: DataFrame, summaries: DataFrame, links: DataFrame, edges: DataFrame) -> compact.Store:
    summaries, links, edges = keep(summaries, "summaries"), keep(links, "summary_messages"), keep(edges, "summary_edges")
    return compact.kept(compact.Store(messages, summaries, links, edges, compact.context(messages, summaries, edges, links)))


def until_under(messages: DataFrame, budget: int, threshold: int = 150, tail: int = 2, fanout: int = 2, max_rounds: int = 10) -> tuple[compact.Store, int]:
    """(store, rounds): leaves for conversations above the budget, then a condensed depth a round, until all fit or none moves."""
    over = compact.evaluate(messages, budget, 1.0).filter("should_compact").select("conversation_id")
    big = messages.join(over, "conversation_id", "left_semi")
    summaries, links = compact.leaf_pass(big, threshold, tail)
    edges = summaries.select(F.lit("").alias("derived_id"), F.lit("").alias("source_id"), F.lit(0).cast("long").alias("ordinal")).limit(0)
    store = _kept(messages, summaries, links, edges)
    for depth in range(max_rounds):
        still = status.context_tokens(store).filter(F.col("context_tokens") > budget).select("conversation_id")
        more, e = compact.condensed_pass(store.summaries.join(still, "conversation_id", "left_semi"), depth, fanout)
        if not more.limit(1).count():
            return store, depth + 1
        summaries, edges = store.summaries.unionByName(more), store.summary_edges.unionByName(e)
        store = _kept(messages, summaries, store.summary_messages, edges)
    return store, max_rounds


def due(maintenance: DataFrame, as_of: str) -> DataFrame:
    """Debts that are pending, not running, and past their retry time."""
    now = F.lit(as_of).cast("timestamp")
    return maintenance.filter(F.col("pending") & ~F.col("running") & (F.col("next_attempt_after").isNull() | (F.col("next_attempt_after") <= now)))


def failed(maintenance: DataFrame, keys: DataFrame, as_of: str, base_seconds: int = 60) -> DataFrame:
    """maintenance where these debts count one more attempt and wait twice as long as before, 64 times the base at most."""
    j = maintenance.join(keys.select("conversation_id").distinct().withColumn("_f", F.lit(True)), "conversation_id", "left")
    n = F.col("retry_attempts") + 1
    wait = F.timestamp_seconds(F.unix_timestamp(F.lit(as_of).cast("timestamp")) + retry_after(n, base_seconds))
    return j.withColumns({"next_attempt_after": F.when(F.col("_f"), wait).otherwise(F.col("next_attempt_after")), "retry_attempts": F.when(F.col("_f"), n).otherwise(F.col("retry_attempts")), "running": F.col("running") & F.col("_f").isNull(), "maintenance_revision": F.col("maintenance_revision") + F.when(F.col("_f"), 1).otherwise(0)}).select(*maintenance.columns)


def close_inactive(maintenance: DataFrame, closing: DataFrame) -> DataFrame:
    """maintenance where debts are closed whose revision is still the one that was seen (closing: conversation_id, revision)."""
    j = maintenance.join(closing, "conversation_id", "left")
    hit = F.coalesce(F.col("pending") & ~F.col("running") & (F.col("maintenance_revision") == F.col("revision")), F.lit(False))
    return j.withColumns({"resolution_reason": F.when(hit, "closed").otherwise(F.col("resolution_reason")), "maintenance_revision": F.col("maintenance_revision") + F.when(hit, 1).otherwise(0), "pending": F.col("pending") & ~hit}).select(*maintenance.columns)


def spending(calls: DataFrame, limit: int = 24, minutes: int = 10) -> DataFrame:
    """calls (key, at) with how many the last minutes hold, the call included, and whether it is refused."""
    w = Window.partitionBy("key").orderBy(F.unix_timestamp("at")).rangeBetween(-minutes * 60 + 1, 0)
    return calls.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("refused", F.col("recent") > limit)


def split_large(messages: DataFrame, threshold: int = 25_000) -> tuple[DataFrame, DataFrame]:
    """(messages with large contents replaced by a reference, the files those went to)."""
    large = F.col("token_count") >= threshold
    key = F.concat(F.lit("file_"), F.substring(F.sha2("content", 256), 1, 16))
    files = messages.filter(large).select(key.alias("file_id"), "conversation_id", "message_id", F.octet_length("content").cast("long").alias("byte_size"), "content")
    return messages.withColumn("large_content", F.when(large, key)).withColumn("content", F.when(large, F.concat(F.lit("[file "), key, F.lit("]"))).otherwise(F.col("content"))), files
