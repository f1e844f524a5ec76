"""Queries of what proves that rows, files and settings continue what is stored, and of tool pairs as units, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.functions.text import format_seconds
from reminisce.operators import evidence
from reminisce.plans.base import CONVERSATIONS, MESSAGES
from reminisce.sources.tables import conversations, messages

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}
M, C = f"WITH {MESSAGES}", f"WITH {MESSAGES}, {CONVERSATIONS}"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items()}


def _said(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


@query("append_evidence", f"""{M},
b AS (SELECT conversation_id, seq, content, identity_hash, CASE WHEN seq % 3 <> 0 THEN 'e' || seq END AS id, CASE WHEN seq % 4 = 1 THEN 'e1' ELSE 'e' || (seq - 1) END AS parent FROM m WHERE seq >= 3),
s AS (SELECT conversation_id, seq, identity_hash, CASE WHEN seq <= 2 OR (seq = 4 AND conversation_id % 2 = 0) THEN 'e' || seq END AS id, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS r FROM m WHERE seq <= 5 AND conversation_id % 5 <> 0),
q AS (SELECT b.*, row_number() OVER (PARTITION BY conversation_id, identity_hash, id IS NULL ORDER BY seq) AS k,
  EXISTS (SELECT 1 FROM s WHERE s.conversation_id = b.conversation_id AND s.id = b.id) AS held, EXISTS (SELECT 1 FROM s WHERE s.conversation_id = b.conversation_id AND s.id IS NULL AND r <= 2 AND s.identity_hash = b.identity_hash) AS open,
  EXISTS (SELECT 1 FROM s WHERE s.conversation_id = b.conversation_id AND s.id = b.parent) AND NOT EXISTS (SELECT 1 FROM b p WHERE p.conversation_id = b.conversation_id AND p.id = b.parent) AND parent <> (SELECT max_by(s.id, s.seq) FROM s WHERE s.conversation_id = b.conversation_id AND s.id IS NOT NULL) AS behind,
  (SELECT count(*) FROM s WHERE s.conversation_id = b.conversation_id AND s.identity_hash = b.identity_hash) AS have FROM b),
z AS (SELECT conversation_id, count(*) FILTER (id IS NOT NULL AND held) AS persisted, count(*) FILTER (id IS NOT NULL AND NOT held AND open AND trim(content) <> '') AS adoptable, count(*) FILTER (id IS NOT NULL AND behind) AS rewritten, count(*) FILTER (id IS NULL AND k <= have) AS repeated FROM q GROUP BY 1)
SELECT *, persisted + adoptable + rewritten + repeated = 0 AS append_only FROM z""")
def append_evidence(spark, sf_dir):
    m, seq = messages(spark, sf_dir), F.col("seq")
    batch = m.filter("seq >= 3").withColumns({"entry_id": F.when(seq % 3 != 0, _said("e", seq)), "parent_id": F.when(seq % 4 == 1, "e1").otherwise(_said("e", seq - 1))})
    stored = m.filter("seq <= 5 and conversation_id % 5 != 0").withColumn("entry_id", F.when((seq <= 2) | ((seq == 4) & (F.col("conversation_id") % 2 == 0)), _said("e", seq)))
    return evidence.append_evidence(batch, stored, 2)


@query("replay_proven", f"""{M}, b AS (SELECT conversation_id, CASE WHEN conversation_id % 4 = 1 AND seq = 4 THEN NULL ELSE 'e' || seq END AS id FROM m WHERE seq >= 3), s AS (SELECT conversation_id, 'e' || seq AS id FROM m WHERE seq <= 6 OR conversation_id % 3 = 0)
SELECT conversation_id, bool_and(EXISTS (SELECT 1 FROM s WHERE s.conversation_id = b.conversation_id AND s.id = b.id)) AS proven FROM b GROUP BY 1""")
def replay_proven(spark, sf_dir):
    m, seq = messages(spark, sf_dir), F.col("seq")
    batch = m.filter("seq >= 3").withColumn("entry_id", F.when((F.col("conversation_id") % 4 == 1) & (seq == 4), F.lit(None)).otherwise(_said("e", seq)))
    return evidence.fully_stored(batch, m.filter("seq <= 6 or conversation_id % 3 = 0").withColumn("entry_id", _said("e", seq)))


@query("foreign_raw_ids", f"""{C}, k AS (SELECT conversation_id, active, CASE WHEN session_key LIKE '%:channel:%' AND conversation_id % 2 = 1 THEN session_key || ':thread:' || conversation_id ELSE session_key END AS key FROM c),
r AS (SELECT DISTINCT conversation_id, seq, 'r' || (conversation_id % 12) || '-' || seq || CASE WHEN conversation_id % 3 = 0 THEN '-' || conversation_id ELSE '' END AS raw_id FROM m UNION ALL SELECT conversation_id, 9, CASE WHEN conversation_id % 4 = 2 THEN 'common' END FROM c),
h AS (SELECT conversation_id, key, raw_id FROM r JOIN k USING (conversation_id) WHERE active)
SELECT conversation_id, count(*) AS candidates, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.raw_id = b.raw_id AND h.conversation_id <> b.conversation_id
  AND NOT (coalesce(regexp_full_match(b.key, '.*:channel:[^:]+'), false) AND coalesce(h.key = b.key OR starts_with(h.key, b.key || ':thread:'), false)))) AS matched
FROM (SELECT DISTINCT conversation_id, key, raw_id FROM r JOIN k USING (conversation_id) WHERE seq >= 3 AND raw_id IS NOT NULL) b GROUP BY 1""")
def foreign_raw_ids(spark, sf_dir):
    c, cid = conversations(spark, sf_dir), F.col("conversation_id")
    c = c.withColumn("session_key", F.when(F.col("session_key").contains(":channel:") & (cid % 2 == 1), F.concat("session_key", F.lit(":thread:"), cid.cast("string"))).otherwise(F.col("session_key")))
    raw = F.concat(F.lit("r"), (cid % 12).cast("string"), F.lit("-"), F.col("seq").cast("string"), F.when(cid % 3 == 0, _said("-", cid)).otherwise(""))
    ids = messages(spark, sf_dir).select("conversation_id", F.col("seq").cast("long").alias("seq"), raw.alias("raw_id"))
    ids = ids.unionByName(c.select("conversation_id", F.lit(9).cast("long").alias("seq"), F.when(cid % 4 == 2, "common").alias("raw_id")))
    return evidence.foreign_ids(ids.filter("seq >= 3"), ids, c)


@query("debt_thresholds", f"""{C}, d AS (SELECT conversation_id, session_key, CASE conversation_id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 WHEN 3 THEN 0.75 END AS t, CASE WHEN conversation_id % 3 <> 0 THEN 'override' ELSE 'global' END AS source,
  CASE WHEN conversation_id % 5 IN (1, 2) THEN 8 WHEN conversation_id % 5 = 4 THEN 16 END AS tail, CASE WHEN conversation_id % 6 = 1 THEN 'b' WHEN conversation_id % 2 = 1 THEN 'a' END AS model, CASE WHEN conversation_id % 7 < 5 THEN 0.75 ELSE 0.5 END AS lt, CASE WHEN conversation_id % 7 = 6 THEN 'override' ELSE 'global' END AS ls FROM c),
p AS (SELECT *, (coalesce(model = 'a', true) AND t = 0.5 AND coalesce(tail, 8) = 8) OR (coalesce(regexp_full_match(session_key, 'agent:main:channel:[^:]*'), true) AND t = 0.6 AND tail IS NULL) AS producible FROM d),
k AS (SELECT *, t IS NOT NULL AND CASE WHEN source = 'override' THEN producible AND (ls <> 'override' OR (lt = t AND coalesce(tail, 8) = 8)) ELSE ls <> 'override' AND lt = t END AS keep FROM p)
SELECT conversation_id, (CASE WHEN keep THEN t ELSE lt END)::DOUBLE AS threshold, CASE WHEN keep THEN source ELSE ls END AS source, CASE WHEN keep THEN tail ELSE 8 END AS fresh_tail, t IS NOT NULL AND NOT keep AS superseded FROM k""")
def debt_thresholds(spark, sf_dir):
    c, cid = conversations(spark, sf_dir), F.col("conversation_id")
    number = lambda x: F.lit(x).cast("double")
    debts = c.select(
        "conversation_id", "session_key", F.when(cid % 4 == 1, number(0.5)).when(cid % 4 == 2, number(0.6)).when(cid % 4 == 3, number(0.75)).alias("threshold"), F.when(cid % 3 != 0, "override").otherwise("global").alias("source"),
        F.when((cid % 5).isin(1, 2), 8).when(cid % 5 == 3, 0).when(cid % 5 == 4, 16).alias("fresh_tail"), F.lit(None).cast("long").alias("chunk"), F.when(cid % 6 == 1, "b").when(cid % 2 == 1, "a").alias("model"), F.lit(None).cast("long").alias("context_window"),
        F.when(cid % 7 < 5, number(0.75)).otherwise(number(0.5)).alias("live_threshold"), F.when(cid % 7 == 6, "override").otherwise("global").alias("live_source"), F.lit(8).cast("long").alias("live_fresh_tail"), F.lit(None).cast("long").alias("live_chunk"),
    )
    rules = [{"threshold": 0.5, "model": "a", "min_window": 1000, "fresh_tail": 8}, {"threshold": 0.6, "session_key": "agent:main:channel:*"}]
    return evidence.debt_thresholds(debts, rules).select("conversation_id", "threshold", "source", "fresh_tail", "superseded")


@query("rotation_plan", f"""{C}, f AS (SELECT c.*, CASE WHEN conversation_id % 11 <> 3 THEN (SELECT sum(strlen(content)) FROM m WHERE m.conversation_id = c.conversation_id) END AS b, CASE WHEN conversation_id % 6 = 1 THEN (SELECT sum(strlen(content)) FROM m WHERE m.conversation_id = c.conversation_id) - 300 * (conversation_id % 4) END AS l FROM c)
SELECT conversation_id, CASE WHEN session_key IS NULL THEN 'skip' WHEN conversation_id % 13 = 4 THEN 'skip' WHEN b IS NULL THEN 'warn' WHEN b <= 400 OR NOT active OR coalesce(b < l + 400, false) THEN 'skip' ELSE 'rotate' END AS action,
  CASE WHEN session_key IS NULL THEN 'no session' WHEN conversation_id % 13 = 4 THEN 'excluded' WHEN b IS NULL THEN 'unreadable' WHEN b <= 400 THEN 'small' WHEN NOT active THEN 'inactive' WHEN coalesce(b < l + 400, false) THEN 'just rotated' ELSE 'large' END AS reason FROM f""")
def rotation_plan(spark, sf_dir):
    cid = F.col("conversation_id")
    size = messages(spark, sf_dir).groupBy("conversation_id").agg(F.sum(F.octet_length("content")).alias("size"))
    files = conversations(spark, sf_dir).join(size, "conversation_id").withColumns({"path": _said("s/", cid), "excluded": cid % 13 == 4, "bytes": F.when(cid % 11 != 3, F.col("size")), "left_bytes": F.when(cid % 6 == 1, F.col("size") - 300 * (cid % 4))})
    return evidence.rotation(files, 400).select("conversation_id", "action", "reason")


@query("reset_evidence", f"""{C}, a AS (SELECT conversation_id, CASE WHEN conversation_id % 10 <> 0 THEN TIMESTAMP '2024-02-01 10:00:00' + to_days((conversation_id % 9)::INTEGER) END AS t FROM c WHERE conversation_id % 2 = 0)
SELECT conversation_id, a.conversation_id IS NOT NULL AS archived, strftime(t, '%Y-%m-%d %H:%M:%S') AS archived_at, a.conversation_id IS NOT NULL AND c.conversation_id % 4 = 0 AS deliberate,
  coalesce(t IS NOT NULL AND c.conversation_id % 4 = 0 AND c.conversation_id % 3 <> 0 AND c.conversation_id % 60 - 5 BETWEEN 0 AND 30, false) AS replaced FROM c LEFT JOIN a USING (conversation_id)""")
def reset_evidence(spark, sf_dir):
    cid = F.col("conversation_id")
    path, day = F.concat(F.lit("s/"), cid.cast("string"), F.lit(".jsonl")), (cid % 9).cast("int")
    at = F.date_add(F.lit("2024-02-01"), day)
    begun = F.timestamp_add("SECOND", cid % 60 - 5, F.concat(at.cast("string"), F.lit(" 10:00:00")).cast("timestamp"))
    tracked = conversations(spark, sf_dir).withColumns({"path": path, "pruned_at": F.when(cid % 4 == 0, F.col("updated_at")), "header_id": F.when(cid % 3 == 0, "other").otherwise(F.col("session_id")), "header_at": begun})
    stamp = lambda d: F.concat("path", F.lit(".reset."), d.cast("string"), F.lit("T10-00-00Z"))
    kept = tracked.filter("conversation_id % 2 = 0")
    files = tracked.select("path").unionByName(kept.filter("conversation_id % 10 != 0").select(F.explode(F.array(stamp(at), stamp(F.date_sub(at, 3)))).alias("path"))).unionByName(kept.select(F.concat("path", F.lit(".reset.old")).alias("path")))
    return evidence.reset_evidence(tracked, files).withColumn("archived_at", format_seconds(F.col("archived_at")))


_COPIES = "SELECT conversation_id, seq, message_id, CASE WHEN conversation_id % 3 = 0 THEN 'system' ELSE role END AS role, CASE WHEN conversation_id % 2 = 0 OR seq > 2 THEN 'Delivery-Mirror: ' || seq WHEN seq % 2 = 0 THEN chr(10) || '  Facts of the session' ELSE content END AS content FROM m WHERE seq <= 3 + conversation_id % 3 * 2"


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid, seq = F.col("conversation_id"), F.col("seq")
    content = F.when((cid % 2 == 0) | (seq > 2), _said("Delivery-Mirror: ", seq)).when(seq % 2 == 0, F.lit("\n  Facts of the session")).otherwise(F.col("content"))
    return messages(spark, sf_dir).filter(seq <= 3 + cid % 3 * 2).withColumns({"role": F.when(cid % 3 == 0, "system").otherwise(F.col("role")), "content": content})


@query("delivery_only", f"{M}, d AS ({_COPIES}) SELECT conversation_id, bool_and(role = 'system' AND starts_with(content, 'Delivery-Mirror')) AND count(*) <= 4 AS delivery_only FROM d GROUP BY 1")
def delivery_only(spark, sf_dir):
    return evidence.delivery_only(_copies(spark, sf_dir), r"(?i)\bdelivery[-_\s]?mirror\b")


@query("opening_facts", f"{M}, d AS ({_COPIES}) SELECT message_id, role = 'user' AND starts_with(ltrim(content, chr(10) || ' '), 'Facts of the') AS preamble FROM d")
def opening_facts(spark, sf_dir):
    return _copies(spark, sf_dir).select("message_id", evidence.opens_with(F.col("role"), F.col("content"), "user", "Facts of the").alias("preamble"))


@query("stored_forms", f"""{M} SELECT message_id, CASE WHEN seq % 4 = 0 THEN CASE role WHEN 'tool' THEN '[{{"type":"text","text":""}}]' WHEN 'assistant' THEN '[]' ELSE '' END
  WHEN seq % 4 = 1 THEN CASE WHEN role IN ('tool', 'assistant') THEN '[{{"type":"text","text":"f' || seq || '"}}]' ELSE 'f' || seq END WHEN seq % 4 = 2 AND role = 'user' THEN 't' || seq
  ELSE '[{{"type":"text","text":"t' || seq || '"}}' || CASE WHEN seq % 4 = 3 THEN ',{{"type":"image"}}' ELSE '' END || ']' END AS stored FROM m""")
def stored_forms(spark, sf_dir):
    seq = F.col("seq")
    text = F.to_json(F.struct(F.lit("text").alias("type"), _said("t", seq).alias("text")))
    blocks = F.when(seq % 4 == 2, F.array(text)).when(seq % 4 == 3, F.array(text, F.lit('{"type":"image"}'))).when(seq % 4 == 1, F.array().cast("array<string>"))
    return messages(spark, sf_dir).select("message_id", evidence.stored_form(F.col("role"), blocks, F.when(seq % 4 == 1, _said("f", seq))).alias("stored"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two calls and a result of each three messages, which for every second three answers the next ones too."""
    m, group = messages(spark, sf_dir).select("conversation_id", F.col("seq").alias("place")), F.floor(F.col("place") / 3)
    calls = m.filter("place % 3 != 2").withColumn("call_id", _said("c", group))
    results = m.filter("place % 3 = 2").withColumn("call_id", _said("c", group))
    return calls, results.unionByName(m.filter("place % 6 = 2").withColumn("call_id", _said("c", group + 1)))


_UNITS = f"""WITH RECURSIVE {MESSAGES},
a AS (SELECT conversation_id, seq AS place, 'c' || (seq // 3) AS id FROM m WHERE seq % 3 <> 2), z AS (SELECT conversation_id, seq AS place, 'c' || (seq // 3) AS id FROM m WHERE seq % 3 = 2 UNION ALL SELECT conversation_id, seq, 'c' || (seq // 3 + 1) FROM m WHERE seq % 6 = 2),
e AS (SELECT a.conversation_id, a.place AS x, z.place AS y FROM a JOIN z USING (conversation_id, id)), g AS (SELECT conversation_id, x, y FROM e UNION SELECT conversation_id, y, x FROM e),
w AS (SELECT DISTINCT conversation_id, place AS root, place AS node FROM (SELECT * FROM a UNION ALL SELECT * FROM z) UNION SELECT w.conversation_id, w.root, g.y FROM w JOIN g ON g.conversation_id = w.conversation_id AND g.x = w.node),
u AS (SELECT conversation_id, root AS place, min(node) AS unit FROM w GROUP BY ALL)"""


@query("pair_units", f"{_UNITS} SELECT * FROM u")
def pair_units(spark, sf_dir):
    return evidence.pair_units(*_sides(spark, sf_dir))


@query("live_places", f"{_UNITS} SELECT conversation_id, place, live_place FROM u JOIN (SELECT conversation_id, unit, min(100 - place) AS live_place FROM u WHERE place % 5 = 0 GROUP BY ALL) USING (conversation_id, unit) UNION ALL SELECT DISTINCT conversation_id, -1, 7 FROM m")
def live_places(spark, sf_dir):
    m = messages(spark, sf_dir)
    live = m.filter("seq % 5 = 0").select("conversation_id", F.col("seq").alias("place"), (100 - F.col("seq")).alias("live_place"))
    lone = m.select("conversation_id", F.lit(-1).alias("place"), F.lit(7).alias("live_place")).distinct()
    return evidence.live_places(evidence.pair_units(*_sides(spark, sf_dir)), live.unionByName(lone))
