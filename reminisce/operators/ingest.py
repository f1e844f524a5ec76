"""Taking in messages once: idempotency, replays, alignment of transcripts with what is stored, heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_IDENTITY = ["conversation_id", "identity_hash"]


def once(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose (conversation, key) isn't stored, the first of equals by seq; rows without a key all stay."""
    w = Window.partitionBy("conversation_id", key).orderBy("seq")
    fresh = batch.filter(F.col(key).isNotNull()).join(stored.filter(F.col(key).isNotNull()).select("conversation_id", key), ["conversation_id", key], "left_anti")
    fresh = fresh.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*batch.columns)
    return fresh.unionByName(batch.filter(F.col(key).isNull()))


def next_seq(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch numbered on from each conversation's largest stored seq."""
    top = stored.groupBy("conversation_id").agg(F.max("seq").alias("_top"))
    w = Window.partitionBy("conversation_id").orderBy("seq")
    return batch.withColumn("_r", F.row_number().over(w)).join(top, "conversation_id", "left").withColumn("seq", (F.coalesce("_top", F.lit(0)) + F.col("_r")).cast("long")).drop("_r", "_top")


def replays(messages: DataFrame) -> DataFrame:
    """messages with replayed: whether an identical one of the conversation is earlier."""
    return messages.withColumn("replayed", F.col("created_at") > F.min("created_at").over(Window.partitionBy(*_IDENTITY)))


def floods(messages: DataFrame, user_limit: int = 3, other_limit: int = 32) -> DataFrame:
    """conversation_id, second, replayed users and others: seconds in which so many replayed rows came that a batch is refused."""
    r = replays(messages).filter("replayed").withColumn("second", F.date_trunc("second", "created_at"))
    other = r.filter("role != 'user'").groupBy("conversation_id", "second", "identity_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("conversation_id", "second").agg(F.max("n").alias("others"))
    users = r.filter("role = 'user'").groupBy("conversation_id", "second").agg(F.count(F.lit(1)).alias("users"))
    j = users.join(other, ["conversation_id", "second"], "full").fillna(0, ["users", "others"])
    return j.filter((F.col("users") >= user_limit) | (F.col("others") >= other_limit))


def adjacent_duplicates(messages: DataFrame) -> DataFrame:
    """messages with mirrored: an assistant message equal to the one right before it."""
    w = Window.partitionBy("conversation_id").orderBy("seq")
    same = (F.lag("identity_hash").over(w) == F.col("identity_hash")) & (F.col("role") == "assistant")
    return messages.withColumn("mirrored", F.coalesce(same, F.lit(False)))


def heartbeats(messages: DataFrame, ack: str = "heartbeat_ok", marker: str = "heartbeat.md", poll: str = "[heartbeat poll]") -> DataFrame:
    """messages without heartbeat traffic: poll prompts, and turns that hold the marker, up to their acknowledgement."""
    w = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    flat = F.lower(F.trim("content"))
    t = messages.withColumn("_turn", F.count_if(F.col("role") == "user").over(w))
    turn = Window.partitionBy("conversation_id", "_turn")
    is_ack = (F.col("role") == "assistant") & (flat == ack)
    t = t.withColumn("_ack", F.max(F.when(is_ack, F.col("seq"))).over(turn))
    first = F.min(F.when(F.lower("content").contains(marker), F.col("seq"))).over(turn)
    t = t.withColumn("_first", first)
    # the last acknowledgement that comes after a marker reaches back to the turn's beginning
    gone = (F.col("_turn") > 0) & (F.col("_first") <= F.col("_ack")) & (F.col("seq") <= F.col("_ack"))
    return t.filter(~F.coalesce(gone, F.lit(False)) & ~((F.col("role") == "user") & (flat == poll))).select(*messages.columns)


def import_cap(stored: Column) -> Column:
    """How many rows one import may bring: a fifth of those stored, 50 at least."""
    return F.greatest(F.floor(stored * 0.2), F.lit(50)).cast("long")


def epoch_route(checkpoint: Column, transcript: Column) -> Column:
    blank = lambda c: c.isNull() | (c == "")
    return F.when(blank(checkpoint) | blank(transcript), "undeclared").when(checkpoint == transcript, "same-epoch").otherwise("declared-rollover")


def entry_tail(entries: DataFrame, stored: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Entries (conversation_id, index, entry_id) to import: after the anchor and not stored.

    The anchor is the last place of the checkpoint's id (checkpoints: conversation_id, last_entry_id) or else of a stored id;
    conversations without one, and entries before it, bring none.
    """
    known = stored.select("conversation_id", "entry_id").filter("entry_id is not null").distinct().withColumn("known", F.lit(True))
    e = entries.join(known, ["conversation_id", "entry_id"], "left")
    if checkpoints is not None:
        e = e.join(checkpoints.select("conversation_id", "last_entry_id"), "conversation_id", "left")
    else:
        e = e.withColumn("last_entry_id", F.lit(None).cast("string"))
    w = Window.partitionBy("conversation_id")
    e = e.withColumn("anchor", F.coalesce(F.max(F.when(F.col("entry_id") == F.col("last_entry_id"), F.col("index"))).over(w), F.max(F.when(F.col("known"), F.col("index"))).over(w)))
    return e.filter((F.col("index") > F.col("anchor")) & F.col("known").isNull()).select(*entries.columns, "anchor")


def full_replay(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """conversation_id, replay: whether the batch begins with all that is stored."""
    ordered = lambda df: df.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "identity_hash"))), lambda x: x["identity_hash"]).alias("h"))
    j = ordered(batch).withColumnRenamed("h", "b").join(ordered(stored).withColumnRenamed("h", "s"), "conversation_id")
    return j.select("conversation_id", ((F.size("b") >= F.size("s")) & (F.slice("b", 1, F.size("s")) == F.col("s"))).alias("replay"))


def adopt_ids(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """message_id, entry_id: ids that arrive late go to stored rows without one, the k-th of an identity to its k-th."""
    w = Window.partitionBy(*_IDENTITY).orderBy("seq")
    s = stored.filter("entry_id is null").withColumn("k", F.row_number().over(w)).select(*_IDENTITY, "k", "message_id")
    known = stored.filter("entry_id is not null").select("conversation_id", "entry_id")
    i = incoming.join(known, ["conversation_id", "entry_id"], "left_anti").withColumn("k", F.row_number().over(w)).select(*_IDENTITY, "k", "entry_id")
    return s.join(i, [*_IDENTITY, "k"]).select("message_id", "entry_id")


def keep_first_key(rows: DataFrame, key: str) -> DataFrame:
    """rows where a repeated key stays with its first row, and the others lose it."""
    w = Window.partitionBy("conversation_id", key).orderBy("seq")
    return rows.withColumn(key, F.when(F.row_number().over(w) == 1, F.col(key)))


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key by version; a change wins over an equal version."""
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*state.columns)


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: inserts that ignore conflicts."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def get_or_create(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, session_key, conversation_id: the active conversation of the key, else of the id, else null for a new one."""
    active = conversations.filter("active")
    k = active.filter("session_key is not null").groupBy("session_key").agg(F.max("conversation_id").alias("by_key"))
    i = active.groupBy("session_id").agg(F.max("conversation_id").alias("by_id"))
    return sessions.join(k, "session_key", "left").join(i, "session_id", "left").select("session_id", "session_key", F.coalesce("by_key", "by_id").alias("conversation_id"))


def cache_states(turns: DataFrame, cold_after: int = 2) -> DataFrame:
    """turns (conversation_id, turn, cached, input_tokens) with the cache's state after each: hot, cold, or unknown before a verdict; and the cold streak."""
    hit = F.col("cached") > 0
    w = Window.partitionBy("conversation_id").orderBy("turn")
    runs = turns.withColumn("_g", F.count_if(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.when(hit, 0).otherwise(F.count_if(~hit).over(Window.partitionBy("conversation_id", "_g").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("cold_streak", streak.cast("long")).withColumn("state", F.when(hit, "hot").when(F.col("cold_streak") >= cold_after, "cold").otherwise(F.when(F.col("_g") > 0, "hot").otherwise("unknown"))).drop("_g")
