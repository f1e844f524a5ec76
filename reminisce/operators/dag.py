"""The graph of summaries: reachability, subtrees, token-capped expansion, roll-ups.

Walks are loops of joins over all roots at once, a level at a time, until the frontier is empty; each level is written, so
that none is computed again. closure() keeps distinct nodes, so shared ones are walked once a root and cycles end. walk()
lists paths, as an expansion shows them; a path that comes back to a node it holds ends. Roll-ups go from the sources up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.operators.compact import Store
from reminisce.sources.scratch import keep

#: Where the messages of a node stand among its sources: after all of them.
_AFTER = 1 << 62


def _steps(edges: DataFrame, down: bool) -> DataFrame:
    a, b = ("derived_id", "source_id") if down else ("source_id", "derived_id")
    return edges.select(F.col(a).alias("node"), F.col(b).alias("next"), F.col("ordinal").cast("long").alias("ordinal"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, roots: DataFrame, down: bool = True, max_depth: int | None = None) -> DataFrame:
    """root, node, level: the distinct nodes that each root reaches, itself at level 0, at the least level."""
    steps = _steps(edges, down).select("node", "next").distinct()
    start = roots.select(F.col("summary_id").alias("root"), F.col("summary_id").alias("node")).distinct().withColumn("level", F.lit(0).cast("long"))
    seen = [keep(start, "closure")]
    while max_depth is None or len(seen) <= max_depth:
        found = seen[-1].join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        front = keep(found.join(_all(seen).select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(len(seen)).cast("long")), "closure")
        if front.isEmpty():
            break
        seen.append(front)
    return _all(seen)


def walk(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, down: bool = True, tokens: DataFrame | None = None, token_cap: int | None = None) -> DataFrame:
    """root, node, level, path, places: every path from the roots, to sources if down, else to derived nodes.

    places are the ordinals on the path, an array that sorts depth first; path is their text, in four digits or more. With
    tokens (node, token_count) and a cap, a path goes no further than its own nodes, the root aside, stay within it.
    """
    steps = _steps(edges, down)
    start = roots.select(F.col("summary_id").alias("root"), F.col("summary_id").alias("node")).withColumns({"level": F.lit(0).cast("long"), "path": F.lit(""), "places": F.array().cast("array<bigint>"), "seen": F.array("node"), "spent": F.lit(0).cast("long")})
    parts = [keep(start, "walk")]
    while max_depth is None or len(parts) <= max_depth:
        front = parts[-1].join(steps, "node").filter(~F.array_contains("seen", F.col("next")))
        front = front.select("root", F.col("next").alias("node"), (F.col("level") + 1).alias("level"), F.concat("path", F.format_string(".%04d", "ordinal")).alias("path"), F.concat("places", F.array("ordinal")).alias("places"), F.concat("seen", F.array("next")).alias("seen"), "spent")
        if token_cap is not None:
            front = front.join(tokens.select("node", "token_count"), "node").withColumn("spent", F.col("spent") + F.col("token_count")).filter(F.col("spent") <= token_cap).drop("token_count")
        front = keep(front, "walk")
        if front.isEmpty():
            break
        parts.append(front)
    return _all(parts).drop("seen", "spent")


def reachable(store: Store, max_depth: int | None = None) -> DataFrame:
    """summary_id, n_sources, first_seq, last_seq, messages and their tokens of the distinct nodes below each summary."""
    nodes = closure(store.summary_edges, store.summaries, max_depth=max_depth).select(F.col("root").alias("summary_id"), "node")
    covered = nodes.join(store.summary_messages.withColumnRenamed("summary_id", "node"), "node").select("summary_id", "message_id").distinct().join(store.messages.select("message_id", "seq", "token_count"), "message_id")
    spans = covered.groupBy("summary_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("message_count"), F.sum("token_count").alias("covered_tokens"))
    return nodes.groupBy("summary_id").agg((F.count(F.lit(1)) - 1).alias("n_sources")).join(spans, "summary_id", "left")


def derived_subtree(store: Store, max_depth: int | None = None) -> DataFrame:
    """root, node, level, path of what is made from each leaf; a node reached twice at its first place."""
    leaves = store.summaries.filter("kind = 'leaf'")
    w = Window.partitionBy("root", "node").orderBy("level", "places")
    return walk(store.summary_edges, leaves, max_depth, down=False).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "places")


def expand(store: Store, roots: DataFrame, token_cap: int, include_messages: bool = True, max_depth: int | None = None) -> DataFrame:
    """root, place, node, message_id, token_count: depth-first below each root, until the next item would exceed the cap."""
    tokens = store.summaries.select(F.col("summary_id").alias("node"), "token_count")
    below = walk(store.summary_edges, roots, max_depth, tokens=tokens, token_cap=token_cap)
    nodes = below.filter("level > 0").join(tokens, "node").select("root", "places", "node", F.lit(None).cast("long").alias("message_id"), "token_count")
    if include_messages:
        links = store.summary_messages.join(store.messages.select("message_id", "token_count"), "message_id")
        found = below.join(links.withColumnRenamed("summary_id", "node"), "node").select("root", F.concat("places", F.array(F.lit(_AFTER) + F.col("ordinal").cast("long"))).alias("places"), "node", "message_id", "token_count")
        nodes = nodes.unionByName(found)
    w = Window.partitionBy("root").orderBy("places")
    # the running sum only grows, so the first item beyond the cap and all after it go
    out = nodes.withColumn("cum", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w).cast("long"))
    return out.filter(F.col("cum") <= token_cap).select("root", "place", "node", "message_id", "token_count", "cum")


def sources(store: Store) -> DataFrame:
    """Edges within a conversation with the source's kind and tokens; edges across conversations are left out."""
    d = store.summaries.select(F.col("summary_id").alias("derived_id"), F.col("conversation_id").alias("c"))
    s = store.summaries.select(F.col("summary_id").alias("source_id"), "conversation_id", "kind", "depth", "token_count")
    return store.summary_edges.join(d, "derived_id").join(s, "source_id").filter("c = conversation_id").drop("c")


def roots(store: Store) -> DataFrame:
    """Summaries that no other is made from."""
    return store.summaries.join(store.summary_edges.select(F.col("source_id").alias("summary_id")), "summary_id", "left_anti")


def leaves_of_messages(hits: DataFrame, store: Store) -> DataFrame:
    """message_id, summary_id: the leaf of each hit, the first link of several; hits without one are left out."""
    w = Window.partitionBy("message_id").orderBy("ordinal", "summary_id")
    j = hits.select("message_id").join(store.summary_messages, "message_id")
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("message_id", "summary_id")


def describe(store: Store) -> DataFrame:
    """Each summary with arrays of its sources, derived summaries and messages, in order."""
    listed = lambda df, key, value, name: df.groupBy(F.col(key).alias("summary_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
    out = store.summaries
    for df, key, value, name in ((store.summary_edges, "derived_id", "source_id", "source_ids"), (store.summary_edges, "source_id", "derived_id", "derived_ids"), (store.summary_messages, "summary_id", "message_id", "message_ids")):
        out = out.join(listed(df, key, value, name), "summary_id", "left")
    return out


def _upwards(start: DataFrame, edges: DataFrame, values: list[Column], own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary_id and values of the nodes that start leads to, the same of those with sources that it doesn't lead to).

    start has summary_id and the values' columns; values are aggregates of these of a node's sources, and of their columns in
    own. A node is settled once all its sources are; those of a cycle never are, and have the aggregates of the sources that are.
    """
    known = [keep(start, "upwards")]
    pending = edges.select("derived_id", "source_id").distinct().join(known[0].select(F.col("summary_id").alias("derived_id")), "derived_id", "left_anti")
    while True:
        settled = _all(known).join(own, "summary_id") if own is not None else _all(known)
        settled = settled.withColumnRenamed("summary_id", "source_id").withColumn("settled", F.lit(True))
        found = pending.join(settled, "source_id", "left").groupBy("derived_id").agg(F.count_if(F.col("settled").isNull()).alias("missing"), *values).withColumnRenamed("derived_id", "summary_id")
        found = keep(found, "upwards")
        new = found.filter("missing = 0").drop("missing")
        if new.isEmpty():
            return _all(known), found.drop("missing")
        known.append(new)
        pending = pending.join(new.select(F.col("summary_id").alias("derived_id")), "derived_id", "left_anti")


def backfill_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """summary_id, depth: 0 for leaves, else one more than the deepest source; 1 for a condensed node without sources, and for what is on or above a cycle or a missing source."""
    bare = nodes.join(edges.select(F.col("derived_id").alias("summary_id")), "summary_id", "left_anti").filter("kind != 'leaf'")
    start = nodes.filter("kind = 'leaf'").select("summary_id", F.lit(0).cast("long").alias("depth")).unionByName(bare.select("summary_id", F.lit(1).cast("long").alias("depth")))
    known, _ = _upwards(start, edges, [(F.max("depth") + 1).alias("depth")])
    return nodes.select("summary_id").join(known, "summary_id", "left").select("summary_id", F.coalesce("depth", F.lit(1)).cast("long").alias("depth"))


def rollup(store: Store) -> DataFrame:
    """summary_id, descendant_count, descendant_token_count, source tokens and times, from the edges: over paths, so shared nodes count each time."""
    zero = F.lit(0).cast("long")
    raw = store.summary_messages.join(store.messages.select("message_id", "token_count", "created_at"), "message_id").groupBy("summary_id").agg(F.sum("token_count").alias("source_message_token_count"), F.min("created_at").alias("earliest_at"), F.max("created_at").alias("latest_at"))
    bare = store.summaries.filter("kind != 'leaf'").join(store.summary_edges.select(F.col("derived_id").alias("summary_id")), "summary_id", "left_anti").select("summary_id")
    bottom = store.summaries.filter("kind = 'leaf'").select("summary_id").unionByName(bare).join(raw, "summary_id", "left")
    start = bottom.select("summary_id", zero.alias("descendant_count"), zero.alias("descendant_token_count"), F.coalesce("source_message_token_count", zero).cast("long").alias("source_message_token_count"), "earliest_at", "latest_at")
    total = lambda c, name: F.coalesce(F.sum(c), zero).cast("long").alias(name)
    values = [
        total(F.col("descendant_count") + 1, "descendant_count"), total(F.col("descendant_token_count") + F.col("own_tokens"), "descendant_token_count"),
        total("source_message_token_count", "source_message_token_count"), F.min("earliest_at").alias("earliest_at"), F.max("latest_at").alias("latest_at"),
    ]
    known, rest = _upwards(start, store.summary_edges, values, store.summaries.select("summary_id", F.col("token_count").alias("own_tokens")))
    return known.unionByName(rest)


def previous_summary(summaries: DataFrame) -> DataFrame:
    """summary_id, previous_id: the summary of the same conversation and depth before it."""
    w = Window.partitionBy("conversation_id", "depth").orderBy("first_seq", "summary_id")
    return summaries.select("summary_id", F.lag("summary_id").over(w).alias("previous_id"))


def prior_context(summaries: DataFrame, n: int = 2) -> DataFrame:
    """summary_id, prior: the contents of up to n non-empty summaries of its depth before it, oldest first."""
    before = Window.partitionBy("conversation_id", "depth").orderBy("first_seq", "summary_id").rowsBetween(Window.unboundedPreceding, -1)
    some = F.trim("content") != ""
    held = summaries.withColumn("prior", F.array().cast("array<string>"))
    for _ in range(n):  # each turn looks one further back: what the last non-empty one has before it, and itself
        held = held.withColumn("prior", F.coalesce(F.last(F.when(some, F.concat("prior", F.array("content"))), ignorenulls=True).over(before), F.array().cast("array<string>")))
    return held.select("summary_id", F.array_join("prior", "\n\n").alias("prior"))
