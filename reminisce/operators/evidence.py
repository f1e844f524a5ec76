"""What proves that rows, files or settings continue what is stored: ids, parents, multiplicities, archives, thresholds; tool pairs as units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.operators.listing import glob
from reminisce.sources.scratch import keep

_C = "conversation_id"


def _held(rows: DataFrame, name: str, flag: str, of: str = "entry_id") -> DataFrame:
    """conversation_id, name, flag: the distinct values of a column, each with true, to be joined from the left."""
    return rows.filter(F.col(of).isNotNull()).select(_C, F.col(of).alias(name)).distinct().withColumn(flag, F.lit(True))


def append_evidence(batch: DataFrame, stored: DataFrame, window: int = 16) -> DataFrame:
    """conversation_id, persisted, adoptable, rewritten, repeated, append_only of each conversation of the batch.

    Rows with an entry id are judged by it: persisted ones are stored under it; adoptable ones aren't, but equal one of the
    newest `window` stored rows that has no id; rewritten ones follow a stored entry (parent_id) that is neither the newest
    nor in the batch. Rows without one count as repeated if their identity is stored as often as the batch has it so far.
    A batch may be appended if there is none of the four. Blank texts prove nothing about adoption.
    """
    newest = stored.withColumn("_r", F.row_number().over(Window.partitionBy(_C).orderBy(F.desc("seq")))).filter(F.col("_r") <= window)
    tip = stored.filter("entry_id is not null").groupBy(_C).agg(F.max_by("entry_id", "seq").alias("_tip"))
    have = stored.groupBy(_C, "identity_hash").agg(F.count(F.lit(1)).alias("_have"))
    has_id = F.col("entry_id").isNotNull()
    k = F.row_number().over(Window.partitionBy(_C, "identity_hash", has_id).orderBy("seq"))
    b = (
        batch.withColumn("_k", k).join(_held(stored, "entry_id", "_held"), [_C, "entry_id"], "left").join(_held(newest.filter("entry_id is null"), "identity_hash", "_open", "identity_hash"), [_C, "identity_hash"], "left")
        .join(_held(stored, "parent_id", "_old"), [_C, "parent_id"], "left").join(_held(batch, "parent_id", "_own"), [_C, "parent_id"], "left").join(tip, _C, "left").join(have, [_C, "identity_hash"], "left")
    )
    is_held, is_open, old, own = (F.coalesce(c, F.lit(False)) for c in ("_held", "_open", "_old", "_own"))
    found = {
        "persisted": has_id & is_held, "adoptable": has_id & ~is_held & is_open & (F.trim("content") != ""),
        "rewritten": has_id & old & ~own & (F.col("parent_id") != F.col("_tip")), "repeated": ~has_id & (F.col("_k") <= F.coalesce("_have", F.lit(0))),
    }
    counts = b.groupBy(_C).agg(*(F.count_if(c).alias(n) for n, c in found.items()))
    return counts.withColumn("append_only", sum((F.col(n) for n in found), F.lit(0)) == 0)


def fully_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """conversation_id, proven: whether every row of the batch has an entry id that is stored. Rows without one prove nothing."""
    return batch.join(_held(stored, "entry_id", "_held"), [_C, "entry_id"], "left").groupBy(_C).agg(F.bool_and(F.coalesce("_held", F.lit(False))).alias("proven"))


def channel_root(key: Column) -> Column:
    """The channel that a session key, its threads and its memory sessions share; null without a channel."""
    found = F.regexp_extract(key, r"^(.*?:channel:[^:]+)(?:$|:thread:|:active-memory:)", 1)
    return F.when(found != "", found)


def foreign_ids(batch: DataFrame, stored: DataFrame, conversations: DataFrame) -> DataFrame:
    """conversation_id, candidates, matched: the raw ids of each conversation's batch, and those that another active one holds.

    batch and stored have conversation_id and raw_id; rows may repeat. For a channel's base
    session its own threads and memory sessions don't count as others. Holders are counted by id and by channel, so an id in
    every conversation is no pair of conversations.
    """
    sessions = conversations.select(_C, F.col("session_key").alias("_key"), F.col("active").alias("_active"), channel_root(F.col("session_key")).alias("_root"))
    holders = stored.filter("raw_id is not null").select(_C, "raw_id").distinct().join(sessions.filter("_active"), _C)
    total = holders.groupBy("raw_id").agg(F.count(F.lit(1)).alias("_total"))
    by_root = holders.filter("_root is not null").groupBy("raw_id", "_root").agg(F.count(F.lit(1)).alias("_kin"))
    own = holders.select(_C, "raw_id", F.lit(1).alias("_self"))
    b = batch.filter("raw_id is not null").select(_C, "raw_id").distinct().join(sessions.select(_C, "_key", "_root"), _C, "left")
    j = b.join(total, "raw_id", "left").join(by_root, ["raw_id", "_root"], "left").join(own, [_C, "raw_id"], "left")
    spared = F.when(F.col("_key") == F.col("_root"), F.coalesce("_kin", F.lit(0))).otherwise(F.coalesce("_self", F.lit(0)))
    return j.groupBy(_C).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.coalesce("_total", F.lit(0)) > spared).alias("matched"))


def debt_thresholds(debts: DataFrame, rules: list[dict]) -> DataFrame:
    """debts with threshold, source, fresh_tail, chunk as they hold now, and superseded: whether the recorded ones are out of date.

    debts have what was recorded (threshold, source, fresh_tail, chunk; null where nothing was), what the configuration gives
    today (the same, named live_...) and the session (model, session_key, context_window; null where unknown). A recorded
    override holds while some rule, as far as the session is known, may apply and gives its values, unless another override
    with other values applies today; any other source counts as global and holds while it equals today's. A rule has
    threshold, maybe fresh_tail and chunk, and any of model, session_key (a session pattern), min_window, max_window.
    """
    values = ("threshold", "fresh_tail", "chunk")
    sized = debts.withColumns({c: F.when(F.col(c) > 0, F.floor(c)) for c in values[1:]}).withColumn("threshold", F.when(~F.isnan(F.col("threshold").cast("double")), F.col("threshold")))

    # sizes that weren't recorded can't differ
    def gives(of: dict[str, Column]) -> Column:
        same = of["threshold"].eqNullSafe(F.col("threshold"))
        for c in values[1:]:
            same &= F.col(c).isNull() | of[c].eqNullSafe(F.col(c))
        return same

    producible = F.lit(False)
    for r in rules:
        may = F.lit(True)
        for key, test in (("model", lambda v: F.col("model") == v), ("session_key", lambda v: F.col("session_key").rlike(glob(v))), ("min_window", lambda v: F.col("context_window") >= v), ("max_window", lambda v: F.col("context_window") <= v)):
            if key in r:
                may &= F.coalesce(test(r[key]), F.lit(True))
        producible |= may & gives({"threshold": F.lit(float(r["threshold"])), "fresh_tail": F.lit(r.get("fresh_tail")).cast("long"), "chunk": F.lit(r.get("chunk")).cast("long")})
    live = {c: F.col(f"live_{c}") for c in values}
    overridden = F.coalesce(F.col("live_source") == "override", F.lit(False))
    holds = F.when(F.col("source") == "override", producible & (~overridden | gives(live))).otherwise(~overridden & live["threshold"].eqNullSafe(F.col("threshold")))
    recorded = F.col("threshold").isNotNull()
    j = sized.withColumns({"_keep": recorded & F.coalesce(holds, F.lit(False)), "superseded": recorded & ~F.coalesce(holds, F.lit(False))})
    now = {c: F.when(F.col("_keep"), F.col(c)).otherwise(live[c]) for c in values}
    now["source"] = F.when(~F.col("_keep"), F.col("live_source")).when(F.col("source") == "override", "override").otherwise("global")
    return j.withColumns(now).drop("_keep")


def rotation(files: DataFrame, most: int, mode: str = "rotate") -> DataFrame:
    """files with action (rotate, warn, skip) and reason: which transcripts are too large and may be cut.

    files: session_id, session_key, path, bytes (null if it couldn't be read), active, excluded, and left_bytes, what an earlier
    rotation left (null for none): a file that stayed too large is left alone until it has grown by `most` again.
    """
    if mode not in ("rotate", "warn", "off"):
        raise ValueError("mode is rotate, warn or off")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    steps = [
        (F.lit(mode == "off"), "skip", "off"), (blank("session_id") | blank("session_key"), "skip", "no session"), (blank("path"), "skip", "no file"), (F.coalesce("excluded", F.lit(False)), "skip", "excluded"),
        (F.col("bytes").isNull(), "warn", "unreadable"), (F.col("bytes") <= most, "skip", "small"), (~F.coalesce("active", F.lit(False)), "skip", "inactive"), (F.coalesce(F.col("bytes") < F.col("left_bytes") + most, F.lit(False)), "skip", "just rotated"),
        (F.lit(True), mode, "large"),
    ]
    verdict = F.coalesce(*(F.when(test, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))) for test, action, reason in steps))
    return files.withColumn("_v", verdict).select("*", "_v.action", "_v.reason").drop("_v")


def reset_evidence(tracked: DataFrame, files: DataFrame, tolerance_seconds: int = 30) -> DataFrame:
    """conversation_id, archived, archived_at, deliberate, replaced of each tracked transcript.

    archived: among files (path) is one named as the tracked path, `.reset.` and a time; archived_at is the latest of those
    times, null if none is one. deliberate: there is such a file and the store was pruned softly (pruned_at). replaced: deliberate,
    and the new transcript's header (header_id, header_at) names the session (session_id) and begins within the tolerance after.
    tracked may have a path twice; a null path has no files.
    """
    pieces = F.split("path", r"\.reset\.")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(F.array_join(F.slice(pieces, F.lit(1), i), ".reset.").alias("path"), F.array_join(F.slice(pieces, i + 1, F.size(pieces)), ".reset.").alias("suffix"))))
    archives = files.filter(F.col("path").contains(".reset.")).select(cut.alias("x")).select("x.*")
    suffix = F.trim("suffix")
    at = F.when(suffix.rlike(r"T\d{2}"), F.try_to_timestamp(F.regexp_replace(suffix, r"T(\d{2})-(\d{2})-(\d{2})", "T$1:$2:$3")))
    newest = archives.groupBy("path").agg(F.max(at).alias("archived_at"), F.lit(True).alias("_archived"))
    j = tracked.join(newest, "path", "left")
    archived = F.coalesce("_archived", F.lit(False))
    deliberate = archived & F.col("pruned_at").isNotNull()
    delay = F.unix_micros("header_at") - F.unix_micros("archived_at")
    mine = (F.col("header_id") == F.trim("session_id")) & (F.trim("session_id") != "") & delay.between(0, tolerance_seconds * 1_000_000)
    return j.select(_C, archived.alias("archived"), "archived_at", deliberate.alias("deliberate"), (deliberate & F.coalesce(mine, F.lit(False))).alias("replaced"))


def delivered(role: Column, content: Column, pattern: str) -> Column:
    """Whether a system message is a copy of something delivered elsewhere, as the pattern knows it."""
    return F.coalesce((role == "system") & content.rlike(pattern), F.lit(False))


def opens_with(role: Column, content: Column, wanted: str, opening: str) -> Column:
    """Whether a message of a role begins, after spaces, with a host's own opening: a leaked context, a metadata preamble."""
    return F.coalesce((role == wanted) & F.regexp_replace(content, r"^\s+", "").startswith(opening), F.lit(False))


def delivery_only(messages: DataFrame, pattern: str, most: int = 4) -> DataFrame:
    """conversation_id, delivery_only: whether a transcript is at most `most` messages, all of them delivered copies."""
    return messages.groupBy(_C).agg((F.bool_and(delivered(F.col("role"), F.col("content"), pattern)) & (F.count(F.lit(1)) <= most)).alias("delivery_only"))


def stored_form(role: Column, blocks: Column, fallback: Column) -> Column:
    """What is stored for a message of blocks (JSON strings): JSON of them, a user's single text as it is, else the fallback text."""
    kind = lambda b: F.get_json_object(b, "$.type")
    text = F.coalesce(fallback, F.lit(""))
    as_block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    single = F.get(blocks, F.lit(0))
    empty = F.when(role == "tool", as_block).when(role == "assistant", F.when(text == "", "[]").otherwise(as_block)).otherwise(text)
    joined = F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))
    return F.when(F.coalesce(F.size(blocks), F.lit(-1)) <= 0, empty).when((role == "user") & (F.size(blocks) == 1) & (kind(single) == "text"), F.get_json_object(single, "$.text")).otherwise(joined)


def pair_units(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conversation_id, place, unit: the messages that leave a context together, each with the smallest place of its unit.

    calls and results have conversation_id, place, call_id. A call and a result of one id belong together, and so does all that
    is linked through them; an id that only calls or only results have links nothing. The smallest place is passed on through
    ids, and from a place to those that chose it, until nothing changes.
    """
    both = calls.select(_C, "call_id").distinct().join(results.select(_C, "call_id").distinct(), [_C, "call_id"], "left_semi")
    sides = calls.select(_C, "place", "call_id").unionByName(results.select(_C, "place", "call_id")).filter("call_id is not null").distinct()
    links = keep(sides.join(both, [_C, "call_id"]), "pair-links")
    units = sides.select(_C, "place").distinct().withColumn("unit", F.col("place"))
    while True:
        nearest = links.join(units, [_C, "place"]).groupBy(_C, "call_id").agg(F.min("unit").alias("_u"))
        through = links.join(nearest, [_C, "call_id"]).groupBy(_C, "place").agg(F.min("_u").alias("_u"))
        step = units.join(through, [_C, "place"], "left").withColumn("_u", F.least("unit", "_u"))
        further = units.select(_C, F.col("place").alias("_u"), F.col("unit").alias("_v"))
        now = step.join(further, [_C, "_u"], "left").select(_C, "place", F.least("_u", "_v").alias("_now"), "unit")
        now = keep(now, "pair-units")
        if now.filter("_now != unit").isEmpty():
            return now.select(_C, "place", "unit")
        units = now.select(_C, "place", F.col("_now").alias("unit"))


def live_places(units: DataFrame, live: DataFrame) -> DataFrame:
    """conversation_id, place, live_place of the messages whose unit holds a live input: the first live place (live: conversation_id, place, live_place) of any."""
    lone = live.join(units, [_C, "place"], "left_anti").select(_C, "place", "live_place")
    first = units.join(live, [_C, "place"]).groupBy(_C, "unit").agg(F.min("live_place").alias("live_place"))
    return units.join(first, [_C, "unit"]).select(_C, "place", "live_place").unionByName(lone)
