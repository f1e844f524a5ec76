"""Compaction of all conversations at once: leaf chunks, leaf and condensed summaries, their lineage and the active context.

Passes are whole-table steps. The summariser is a column expression or a function; the default says what a chunk covers
and how it begins, so results are the same at every run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminisce.functions.text import estimate_tokens, format_seconds, one_line, summary_id
from reminisce.operators.streamed import carried
from reminisce.operators.tail import runtime_tail
from reminisce.sources.scratch import keep


@dataclass
class Store:
    """The tables that compaction makes and reads."""

    messages: DataFrame
    summaries: DataFrame
    summary_messages: DataFrame
    summary_edges: DataFrame
    context_items: DataFrame


def chunker(threshold: int) -> Callable[[tuple | None, int], tuple]:
    """A step of a fold over token counts: a chunk ends before it would exceed the threshold, or on reaching it."""

    def step(state: tuple | None, tokens: int) -> tuple:
        if state is None:
            return (0, tokens), 0
        chunk, total = state
        if total + tokens > threshold or total >= threshold:
            return (chunk + 1, tokens), chunk + 1
        return (chunk, total + tokens), chunk

    return step


def leaf_chunks(messages: DataFrame, threshold: int, tail: int, cap: int | None = None) -> DataFrame:
    """message_id, conversation_id, seq, chunk of each message outside the fresh tail."""
    outside = runtime_tail(messages, tail, cap).filter("not in_tail").select("message_id", "conversation_id", "seq", F.coalesce("token_count", F.lit(0)).cast("long").alias("t"))
    return carried(outside, "conversation_id", ["seq", "message_id"], ["t"], chunker(threshold), "chunk", T.LongType()).drop("t")


def evaluate(messages: DataFrame, budget: int, threshold: float, observed: DataFrame | None = None) -> DataFrame:
    """conversation_id, current_tokens, limit_tokens, should_compact: the larger of stored and observed tokens against the threshold's share of the budget."""
    stored = messages.groupBy("conversation_id").agg(F.sum("token_count").alias("stored"))
    if observed is not None:
        stored = stored.join(observed, "conversation_id", "left")
    current = F.greatest("stored", F.coalesce("observed", F.lit(0))) if observed is not None else F.col("stored")
    limit = int(threshold * budget)
    return stored.select("conversation_id", current.cast("long").alias("current_tokens"), F.lit(limit).cast("long").alias("limit_tokens"), (current > limit).alias("should_compact"))


def leaf_trigger(messages: DataFrame, chunk_tokens: int, tail: int) -> DataFrame:
    """conversation_id, raw_tokens outside the tail, and whether they make a chunk."""
    t = runtime_tail(messages, tail)
    raw = F.sum(F.when(F.col("in_tail"), 0).otherwise(F.col("token_count"))).cast("long")
    return t.groupBy("conversation_id").agg(raw.alias("raw_tokens")).withColumn("triggered", F.col("raw_tokens") >= chunk_tokens)


def source_text(messages: DataFrame, links: DataFrame) -> DataFrame:
    """summary_id, text: the messages of each leaf as `[time | role]`, a line, the content; blank lines between."""
    line = F.concat(F.lit("["), format_seconds(F.col("created_at")), F.lit(" | "), F.col("role"), F.lit("]\n"), F.col("content"))
    rows = links.join(messages, "message_id").groupBy("summary_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("x"))
    return rows.select("summary_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias("text"))


def describe(n: Column, noun: str, earliest: Column, latest: Column, head: Column) -> Column:
    """The default summary: the times, how many, and how the first begins."""
    return F.concat(F.lit("["), format_seconds(earliest), F.lit(" - "), format_seconds(latest), F.lit("] "), n.cast("string"), F.lit(f" {noun}: "), one_line(head, 60))


def leaf_pass(messages: DataFrame, threshold: int, tail: int, summarize: Callable[..., Column] = describe) -> tuple[DataFrame, DataFrame]:
    """The leaf summaries and their links to messages; the chunks of both are found once, and written."""
    chunks = keep(leaf_chunks(messages, threshold, tail), "chunks").join(messages.drop("conversation_id", "seq"), "message_id")
    g = chunks.groupBy("conversation_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("created_at").alias("earliest_at"), F.max("created_at").alias("latest_at"),
        F.sum("token_count").alias("source_message_token_count"), F.min_by("content", "seq").alias("head"))
    g = g.withColumn("content", summarize(F.col("n"), "messages", F.col("earliest_at"), F.col("latest_at"), F.col("head"))).withColumn("summary_id", summary_id(F.col("conversation_id"), F.lit(0), F.col("first_seq"), F.col("last_seq")))
    order = Window.partitionBy("conversation_id", "chunk").orderBy("seq")
    links = chunks.select("conversation_id", "chunk", "message_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal")).join(g.select("conversation_id", "chunk", "summary_id"), ["conversation_id", "chunk"]).select("summary_id", "message_id", "ordinal")
    summaries = g.select("summary_id", "conversation_id", F.lit("leaf").alias("kind"), F.lit(0).cast("long").alias("depth"), "content", estimate_tokens(F.col("content")).alias("token_count"), "earliest_at", "latest_at",
        F.lit(0).cast("long").alias("descendant_count"), F.lit(0).cast("long").alias("descendant_token_count"), F.col("source_message_token_count").cast("long"), "first_seq", "last_seq")
    return summaries, links


def condensed_pass(summaries: DataFrame, depth: int, fanout: int, summarize: Callable[..., Column] = describe) -> tuple[DataFrame, DataFrame]:
    """Summaries of `fanout` neighbours of a depth, at least two, and the edges to those."""
    level = summaries.filter(F.col("depth") == depth)
    order = Window.partitionBy("conversation_id").orderBy("first_seq")
    level = level.withColumn("p", (F.row_number().over(order) - 1).cast("long")).withColumn("chunk", F.floor(F.col("p") / fanout).cast("long"))
    g = level.groupBy("conversation_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.min("earliest_at").alias("earliest_at"), F.max("latest_at").alias("latest_at"),
        F.sum(F.col("descendant_count") + 1).alias("descendant_count"), F.sum(F.col("descendant_token_count") + F.col("token_count")).alias("descendant_token_count"), F.sum("source_message_token_count").alias("source_message_token_count"), F.min_by("content", "first_seq").alias("head"),
    ).filter("n >= 2")
    g = g.withColumn("content", summarize(F.col("n"), "summaries", F.col("earliest_at"), F.col("latest_at"), F.col("head"))).withColumn("summary_id", summary_id(F.col("conversation_id"), F.lit(depth + 1), F.col("first_seq"), F.col("last_seq")))
    edges = level.select("conversation_id", "chunk", F.col("summary_id").alias("source_id"), (F.col("p") % fanout).alias("ordinal")).join(g.select("conversation_id", "chunk", F.col("summary_id").alias("derived_id")), ["conversation_id", "chunk"]).select("derived_id", "source_id", "ordinal")
    out = g.select("summary_id", "conversation_id", F.lit("condensed").alias("kind"), F.lit(depth + 1).cast("long").alias("depth"), "content", estimate_tokens(F.col("content")).alias("token_count"), "earliest_at", "latest_at", "descendant_count", "descendant_token_count", "source_message_token_count", "first_seq", "last_seq")
    return out, edges


def sweep(messages: DataFrame, threshold: int = 150, tail: int = 2, fanout: int = 2, depths: int | None = None) -> Store:
    """Leaf and condensed passes over every conversation, and the context that is left: newest-depth summaries, then the tail.

    Passes go on until no conversation has two summaries of a depth, or for so many depths. Each pass is written once and
    is what the next reads.
    """
    leaves, links = leaf_pass(messages, threshold, tail)
    levels, links = [keep(leaves, "summaries")], keep(links, "summary_messages")
    edges = [levels[0].select(F.col("summary_id").alias("derived_id"), F.col("summary_id").alias("source_id"), F.lit(0).cast("long").alias("ordinal")).limit(0)]
    while depths is None or len(levels) <= depths:
        more, e = condensed_pass(levels[-1], len(levels) - 1, fanout)
        more = keep(more, "summaries")
        if more.isEmpty():
            break
        levels.append(more)
        edges.append(keep(e, "summary_edges"))
    summaries, edges = reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, edges[1:] or edges)
    return Store(messages, summaries, links, edges, context(messages, summaries, edges, links))


def kept(store: Store) -> Store:
    """The store with its context written once, for what reads it several times; the other tables are written already."""
    return Store(store.messages, store.summaries, store.summary_messages, store.summary_edges, keep(store.context_items, "context_items"))


def context(messages: DataFrame, summaries: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Context items: summaries that no other is made from and messages that no summary covers, by place, ordinals from 0."""
    top = summaries.join(edges.select(F.col("source_id").alias("summary_id")), "summary_id", "left_anti").select("conversation_id", F.col("first_seq").alias("at"), F.lit("summary").alias("item_type"), F.lit(None).cast("long").alias("message_id"), "summary_id")
    loose = messages.join(links.select("message_id"), "message_id", "left_anti").select("conversation_id", F.col("seq").alias("at"), F.lit("message").alias("item_type"), "message_id", F.lit(None).cast("string").alias("summary_id"))
    order = Window.partitionBy("conversation_id").orderBy("at")
    return top.unionByName(loose).withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).select("conversation_id", "ordinal", "item_type", "message_id", "summary_id")


def replace_range(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """items with each conversation's ordinals first..last (ranges: conversation_id, first, last, summary_id) replaced by one summary, and numbered anew."""
    j = items.join(ranges.withColumnRenamed("summary_id", "new_id"), "conversation_id", "left")
    rest = j.filter(F.col("first").isNull() | (F.col("ordinal") < F.col("first")) | (F.col("ordinal") > F.col("last"))).select("conversation_id", F.col("ordinal").alias("at"), "item_type", "message_id", "summary_id")
    new = ranges.select("conversation_id", F.col("first").alias("at"), F.lit("summary").alias("item_type"), F.lit(None).cast("long").alias("message_id"), "summary_id")
    order = Window.partitionBy("conversation_id").orderBy("at")
    return rest.unionByName(new).withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).select("conversation_id", "ordinal", "item_type", "message_id", "summary_id")


def eligible_depth(items: DataFrame, summaries: DataFrame, fanout: int, min_tokens: int) -> DataFrame:
    """conversation_id, depth: the shallowest depth with enough summaries and tokens in the context."""
    s = items.filter("summary_id is not null").join(summaries.select("summary_id", "depth", "token_count"), "summary_id")
    g = s.groupBy("conversation_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t")).filter((F.col("n") >= fanout) & (F.col("t") >= min_tokens))
    return g.groupBy("conversation_id").agg(F.min("depth").alias("depth"))


def prune_for_new_session(items: DataFrame, summaries: DataFrame, keep_depth: int | None) -> DataFrame:
    """What a new session keeps: no messages, summaries of keep_depth or more; all with a negative depth, nothing with None."""
    if keep_depth is None:
        return items.limit(0)
    if keep_depth < 0:
        return items
    return items.filter("item_type = 'summary'").join(summaries.filter(F.col("depth") >= keep_depth).select("summary_id"), "summary_id", "left_semi").select(*items.columns)


def dissolve(items: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """items with each target summary replaced by its sources in order, and numbered anew."""
    gone = items.join(targets.select("summary_id"), "summary_id", "left_semi")
    sources = edges.select(F.col("derived_id").alias("summary_id"), "source_id", F.col("ordinal").alias("then"))
    back = gone.join(sources, "summary_id").select("conversation_id", F.col("ordinal").alias("at"), "then", "item_type", "message_id", F.col("source_id").alias("summary_id"))
    rest = items.join(targets.select("summary_id"), "summary_id", "left_anti").select("conversation_id", F.col("ordinal").alias("at"), F.lit(0).cast("long").alias("then"), "item_type", "message_id", "summary_id")
    order = Window.partitionBy("conversation_id").orderBy("at", "then")
    return rest.unionByName(back).withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).select("conversation_id", "ordinal", "item_type", "message_id", "summary_id")


def transplant(store: Store, mapping: DataFrame, id_step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """summaries, edges and links copied to other conversations (mapping: conversation_id, target_id), ids made anew and messages moved by id_step a conversation."""
    new_id = lambda c, t: F.concat(F.lit("sum_"), F.substring(F.md5(F.concat_ws("|", c, t.cast("string"))), 1, 16))
    ids = store.summaries.join(mapping, "conversation_id").select("summary_id", new_id(F.col("summary_id"), F.col("target_id")).alias("new_id"), "target_id", (F.col("target_id") - F.col("conversation_id")).alias("shift"))
    summaries = store.summaries.join(ids, "summary_id").select(F.col("new_id").alias("summary_id"), F.col("target_id").alias("conversation_id"), *[c for c in store.summaries.columns if c not in ("summary_id", "conversation_id")])
    d, s = ids.select(F.col("summary_id").alias("derived_id"), F.col("new_id").alias("d")), ids.select(F.col("summary_id").alias("source_id"), F.col("new_id").alias("s"))
    edges = store.summary_edges.join(d, "derived_id").join(s, "source_id").select(F.col("d").alias("derived_id"), F.col("s").alias("source_id"), "ordinal")
    links = store.summary_messages.join(ids, "summary_id").select(F.col("new_id").alias("summary_id"), (F.col("message_id") + F.col("shift") * id_step).alias("message_id"), "ordinal")
    return summaries, edges, links


def threshold_for(sessions: DataFrame, rules: list[dict], default: float) -> DataFrame:
    """sessions (model, session_key, context_window) with threshold: of the rules that match, the most specific, the earliest of equals.

    A rule has any of model, session_key, min_window, max_window, which score 100, 50, 20 and 20, and threshold.
    """
    options = []
    for i, r in enumerate(rules):
        match, score = F.lit(True), 0
        for key, points, test in (("model", 100, lambda v: F.col("model") == v), ("session_key", 50, lambda v: F.col("session_key") == v), ("min_window", 20, lambda v: F.col("context_window") >= v), ("max_window", 20, lambda v: F.col("context_window") <= v)):
            if key in r:
                match, score = match & test(r[key]), score + points
        options.append(F.when(F.coalesce(match, F.lit(False)), F.struct(F.lit(score).alias("score"), F.lit(-i).alias("order"), F.lit(float(r["threshold"])).alias("threshold"))))
    best = (F.greatest(*options) if len(options) > 1 else options[0]) if options else None
    return sessions.withColumn("threshold", F.coalesce(best["threshold"], F.lit(default)) if best is not None else F.lit(default))
